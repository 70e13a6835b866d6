"""Keyword-stuffed and link-list pages: phrases replicated in the lists of other hosts, joined with list density.

A page is cut into units (lines, list items, sentences). The look of a unit gives a first guess: a list (links,
tags, keywords between separators, one word group said over and over), a sentence, or anything else (code, logs,
tables, contents, own names). Its phrase shingles are exploded and counted over the whole corpus: on which hosts
a phrase stands in lists, and in how many texts it stands in lists and elsewhere. A phrase is *stuffed* if lists of
two hosts or more have it and lists have it more often than all other text, so phrases of prose, code and column
names never are, whatever replicates them.

The stuffed share of each unit then decides what it is, whatever it looked like: few stuffed phrases make a list of
a sentence, half of them make one of a code line, and a short sentence without any is none. A page is flagged if
most of its text is lists and at least SUPPORT of their phrases are stuffed or repeated on the page, or are links or
tags. Every page goes through both measures; none is left out beforehand.

Phrases are of two words (a line of one word is a phrase of its own). Keyword pages shuffle their word pairs, so runs
of five words, as one takes for copied prose, are nearly all unique on them; the README has the figures. Documents
have no address, so the host of a page is its project, else its source.

Scale: one narrow Arrow pass cuts, guesses and hashes (texts are read once); the written units feed both phrase
steps. Phrases are counted with map-side partials. Phrases that make up more than HEAVY of all rows are at most
1 / HEAVY and are looked up by broadcast, all others by a shuffled join on the phrase (by broadcast too where
their table is proven small). Nothing is collected by phrase, page or host.

Defined cases: null, empty and blank texts aren't flagged, nor are texts too short for SUPPORT; texts of any length
are judged whole; repeated rows count once, two texts under one doc_id are judged apart, and doc_id comes out if
either is flagged; null hosts count as one host; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from hashlib import blake2b

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import store

#: A page's lists must hold so many stuffed or repeated phrases, links or tags.
SUPPORT = 5
DENSE = 0.5
#: Stuffed share from which a sentence is a list, and from which it is one if it repeats itself as well; and of other units.
STUFFED, HINTED, TOGETHER, STUFFED_OTHER = 0.2, 0.05, 0.4, 0.5
HEAVY = 1e-5
#: A run of words is keywords if so few of WINDOW neighbouring words are distinct; shorter runs aren't judged.
WINDOW = 24
LEAST_RUN = 9
VARIED = 0.55
#: What a unit looks like.
BLOB, OTHER, SENTENCE, LIST = -1, 0, 1, 2
#: Endings of host names.
ENDINGS = "invalid|example|test|com|net|org|io|info|biz|shop"
URL = re.compile(rf"(?:h(?:tt|xx)ps?://|www[\[.]|\[\.\])\S*|\b[\w-]+(?:\.[\w-]+)*\.(?:{ENDINGS})\b\S*", re.I)
HOSTED = re.compile(rf"://|\[\.\]|[wW][\[.]|\.(?i:{ENDINGS})\b")  # what any address has, found quickly
OWN = re.compile(rf"[-*]?[`(]*(?:[a-z]+(?:_[a-z]+)+[\w.]*|[a-z_]+\.(?!(?:{ENDINGS})\b)[a-z_]+)[,;`)]*")
CODE = re.compile(r'--|/\*|\*/|#|//|\);?$|\w+\s*=\s*|"""|\}|\{|>>>')
#: English words that code begins with too, and what a line has besides if it is code.
LEADS = re.compile(r"(?:def |return\b|select\b|from\b|where\b|create\b|insert\b|import\b|group by|order by|join )", re.I)
SYNTAX = re.compile(r"[=(){}<>*_\[\]]|'[^']*'|;$|\w\.\w|:$|\b(?:is (?:not )?null|(?:or replace|table|view|into|function|procedure) \w|from \w+ import)\b|^from \w+ (?:as )?\w{1,2}$", re.I)
TAGGED = re.compile(r"(?:#(?!(?:define|include|if|ifdef|ifndef|elif|else|endif|pragma|undef|region|endregion|error|line|import)\b)\w+)+[,;|]?")
CAMEL = re.compile(r"(?<=[^\W\dA-Z_])(?=[A-Z])")
LOG = re.compile(r"\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d")
CONTENTS = re.compile(r"\.{3,}\s*\d+$")
WORD = re.compile(r"\w+")
LONG = re.compile(r"\S{41}")
PIECE = re.compile(r"[^\s,;|]+")
ENDED = (".", "!", "?", "…", ":", '"', "”", ")")
INVISIBLE = re.compile("[\\ufeff\\u200b-\\u200d\\u2060]")
ANCHOR = re.compile(r"<a\s[^<>]*>", re.I)
BLOCK = re.compile(r"</?(?:li|ul|ol|p|h\d|tr|td|br|div|a|table)\b[^<>]*>", re.I)
TAG = re.compile(r"<[^<>]*>")
STOP = re.compile(r"(?<=[^\d\s.][.!?])\s+(?=\S)")


def units(text: str) -> list[str]:
    """Lines, list items and sentences of a text."""
    t = INVISIBLE.sub("", text).replace("\xa0", " ").replace("\r", "\n")
    if "<" in t:
        t = TAG.sub(" ", BLOCK.sub("\n", ANCHOR.sub(" \n http://link ", t)))
    t = STOP.sub("\n", t).replace("。", "。\n")
    return [u for line in t.split("\n") if (u := line.strip())]


def variety(words: list) -> float:
    """Share of distinct words in windows (their share falls with the length of any text); 1 for short runs."""
    n = len(words)
    if n < 6:
        return 1.0
    if n <= WINDOW:
        return len(set(words)) / n
    starts = {*range(0, n - WINDOW + 1, WINDOW), n - WINDOW}
    return sum(len(set(words[i : i + WINDOW])) for i in starts) / (WINDOW * len(starts))


def begins_code(u: str) -> bool:
    """A leading mark of code, or a leading word that English has too with syntax (or names alone) after it."""
    if CODE.match(u):
        return True
    lead = LEADS.match(u)
    return bool(lead) and (bool(SYNTAX.search(u)) or all(len(part.split()) <= 1 for part in u[lead.end() :].split(",")))


def items_of(u: str) -> int:
    """How many items the separators of a unit make."""
    n = u.count(",") + u.count(";") + u.count("|") + u.count("·") + u.count("•") + u.count("»") + u.count("\t")
    return n + u.count(" - ") + u.count(" – ") + u.count(" @ ") + u.count(" / ") + 1


def guess(u: str, hosted: bool = True, long: bool = True) -> tuple[int, int, float, list[str]]:
    """(look, links and tags, variety, words) of a unit; words without those of addresses, in lower case.

    hosted, long: whether its text may have addresses, and words of more than 40 characters.
    """
    if "#" in u:
        parts = u.split()
        tagged = [w for w in parts if TAGGED.fullmatch(w)]
        if len(tagged) > 0.5 * len(parts):
            return LIST, sum(w.count("#") for w in tagged), 1.0, WORD.findall(CAMEL.sub(" ", u).lower().replace("_", " "))
    plain, links = u, 0
    if hosted and HOSTED.search(u):
        plain, links = URL.subn(" ", u)
    words = WORD.findall(plain.lower().replace("_", " "))
    if u.endswith("。"):
        return SENTENCE, 0, 1.0, words
    n = len(words)
    varied = variety(words) if n >= 6 else 1.0
    first = u[0]
    if begins_code(u) or first == "|" or (first in "[0123456789" and LOG.match(u)) or (u[-1].isdigit() and CONTENTS.search(u)) or (first in "cC" and u[:8].lower() == "contents"):
        return OTHER, links, varied, words
    own = 0
    if "." in u[:-1] or "_" in u:
        parts = u.split()
        own = sum([1 for w in parts if ("_" in w or "." in w) and OWN.fullmatch(w)])
        if own and own >= 0.5 * sum(1 for w in parts if w not in ("-", "*", "|")):
            return OTHER, links, varied, words
    if long and not links and max(map(len, u.split())) > 40:
        longest = max(map(len, PIECE.findall(u)), default=0)
        if longest >= 64:
            return BLOB, 0, 1.0, []
        if longest > 40:
            return OTHER, 0, varied, words
    if sum(map(u.count, "0123456789")) > 0.4 * len(u):
        return OTHER, links, varied, words
    ended = u.endswith(ENDED)
    if links:
        return (SENTENCE if ended and n >= 6 * links else LIST), links, varied, words
    if n >= LEAST_RUN and varied <= VARIED:
        return LIST, 0, varied, words
    items = items_of(u)
    if ended and (n >= 6 or (own and n >= 4)) and n >= 3 * items:
        return SENTENCE, 0, varied, words
    if n >= 9 and n >= 5 * items:
        return SENTENCE, 0, varied, words
    return LIST, 0, varied, words


class Ids(dict):
    """Words numbered as they come, with a hash of each that is the same in every process."""

    MOST = 500_000

    def __init__(self) -> None:
        super().__init__()
        self.hashes: list[int] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self.hashes)
        self.hashes.append(int.from_bytes(blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little"))
        return n


def _groups(keys):
    """(first of its key, how many have it) of each element."""
    import numpy as np

    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts = np.ones(len(keys), dtype=bool)
    starts[1:] = ordered[1:] != ordered[:-1]
    group = np.cumsum(starts) - 1
    first, size = np.empty(len(keys), dtype=bool), np.empty(len(keys), dtype=np.int64)
    first[order], size[order] = starts, np.bincount(group)[group] if len(keys) else 0
    return first, size


def measure(texts: list[str], ids: Ids) -> dict:
    """Columns of the units of some texts (blobs aside), as arrays in order:

    text: number of the text; unit: number in the text; look; chars; gap: share of words that repeat others nearby; doubtful: a
    short sentence if nothing speaks against it; support: links, tags, and phrases repeated on the page; n: distinct phrases.
    phrases: all units' phrases one after the other, even 63-bit hashes; the lowest bit is set for the first of its page in units of its
    kind (lists, or all else).
    """
    import numpy as np

    of, no, look, chars, marks, varied, ended, lengths, flat = [], [], [], [], [], [], [], [], []
    for i, text in enumerate(texts):
        hosted = HOSTED.search(text) is not None or "<" in text or (not text.isascii() and INVISIBLE.search(text) is not None)
        long = LONG.search(text) is not None
        for k, u in enumerate(units(text)):
            kind, links, share, words = guess(u, hosted, long)
            if kind != BLOB:
                of.append(i)
                no.append(k)
                look.append(kind)
                chars.append(len(u))
                marks.append(links)
                varied.append(share)
                ended.append(u.endswith(ENDED))
                lengths.append(len(words))
                flat += [ids[w] for w in words]
    of, look, marks, varied, n = np.array(of, dtype=np.int64), np.array(look, dtype=np.int8), np.array(marks, dtype=np.int64), np.array(varied), np.array(lengths, dtype=np.int64)
    words = np.array(ids.hashes, dtype=np.uint64)[np.array(flat, dtype=np.int64)] if flat else np.zeros(0, dtype=np.uint64)
    unit = np.repeat(np.arange(len(n)), n)
    last = np.zeros(len(words), dtype=bool)
    last[np.cumsum(n)[n > 0] - 1] = True
    after = np.append(words[1:], np.uint64(0))[: len(words)] * ~last  # a word alone is followed by 0
    mixed = words * np.uint64(0x9E3779B97F4A7C15) + (after ^ (after >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    phrase = (mixed ^ (mixed >> np.uint64(31))) & ~np.uint64(1)
    there = ~last | (n[unit] == 1)
    phrase, unit = phrase[there], unit[there]
    salt = lambda x: (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    own, _ = _groups(phrase ^ salt(unit))
    every = np.bincount(unit, minlength=len(n))
    phrase, unit = phrase[own], unit[own]
    distinct = np.bincount(unit, minlength=len(n))
    listed = look == LIST
    new, often = _groups(phrase ^ salt(of[unit] * 2 + listed[unit]))
    again = every - distinct + np.bincount(unit[often > 1], minlength=len(n))
    # a phrase in every fifth unit is what the page is about
    ruling = often >= np.maximum(3, 0.2 * np.bincount(of, minlength=len(texts))[of[unit]])
    ruled = np.bincount(unit[ruling], minlength=len(n)) > 0
    doubtful = listed & (marks == 0) & (n >= 3) & (varied > VARIED) & np.array(ended, dtype=bool) & ~ruled
    return {"text": of, "unit": np.array(no, dtype=np.int32), "look": look, "chars": np.array(chars, dtype=np.int32), "gap": (1.0 - varied).astype(np.float32), "doubtful": doubtful, "support": (marks + again * listed).astype(np.int32), "n": distinct, "phrases": (phrase | new.astype(np.uint64)).view(np.int64)}


UNITS = "doc_id {kind}, page bigint, host bigint, unit int, look tinyint, chars int, gap float, doubtful boolean, support int, phrases array<bigint>"


def evidence(documents: DataFrame) -> DataFrame:
    """A row for each unit of each text, as `measure` gives it; an Arrow map without a shuffle. page tells texts of one doc_id apart."""
    host = F.xxhash64(F.coalesce("project_id", F.concat(F.lit("source "), F.coalesce("source", F.lit("")))))
    slim = documents.where("text IS NOT NULL").select("doc_id", host.alias("host"), F.xxhash64("text").alias("page"), "text")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        ids = Ids()
        for batch in batches:
            m = measure(batch.column(3).to_pylist(), ids)
            at = pa.array(m["text"])
            offsets = np.concatenate([[0], np.cumsum(m["n"])]).astype(np.int32)
            columns = [batch.column(0).take(at), batch.column(2).take(at), batch.column(1).take(at), *[pa.array(m[c]) for c in ("unit", "look", "chars", "gap", "doubtful", "support")], pa.ListArray.from_arrays(pa.array(offsets), pa.array(m["phrases"]))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "page", "host", "unit", "look", "chars", "gap", "doubtful", "support", "phrases"])
            if len(ids.hashes) > Ids.MOST:
                ids = Ids()

    return store.spread(slim).mapInArrow(run, UNITS.format(kind=documents.schema["doc_id"].dataType.simpleString()))


def stuffed(found: DataFrame) -> DataFrame:
    """(phrase, n) of the phrases in lists of two hosts or more that are rarer in all other text; n: texts it is in."""
    each = found.select("host", (F.col("look") == LIST).alias("listed"), F.explode("phrases").alias("p")).where("p & 1 = 1")
    counted = each.groupBy(F.shiftright("p", 1).alias("phrase")).agg(F.sum(F.col("listed").cast("int")).alias("lists"), F.count("*").alias("n"), F.min(F.when(F.col("listed"), F.col("host"))).alias("low"), F.max(F.when(F.col("listed"), F.col("host"))).alias("high"))
    return counted.where("low <> high AND 2 * lists > n").select("phrase", "n")


def matches(found: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc_id, page, unit, hits): stuffed phrases of each unit that has any."""
    each = found.select("doc_id", "page", "unit", F.explode("phrases").alias("p")).select("doc_id", "page", "unit", F.shiftright("p", 1).alias("phrase"))
    if store.is_small(phrases):
        hits = each.join(F.broadcast(phrases.select("phrase")), "phrase", "left_semi")
    else:
        rows = found.agg(F.sum(F.size("phrases"))).first()[0] or 0
        common = F.broadcast(phrases.where(F.col("n") > HEAVY * rows).select("phrase"))  # at most 1 / HEAVY phrases are in so many rows
        rare = phrases.where(F.col("n") <= HEAVY * rows).select("phrase")
        hits = each.join(common, "phrase", "left_semi").unionByName(each.join(common, "phrase", "left_anti").join(rare, "phrase", "left_semi"))
    return hits.groupBy("doc_id", "page", "unit").agg(F.count("*").alias("hits"))


def pages(documents: DataFrame) -> DataFrame:
    """(doc_id, density, replicated, support, flagged) of every text with a unit: share of its text in lists, stuffed share
    of its phrases, and stuffed or repeated phrases, links and tags in its lists."""
    found = store.materialize(evidence(documents), "spam-units")
    phrases = store.materialize(stuffed(found), "spam-phrases")
    hits = store.checked_broadcast(store.materialize(matches(found, phrases), "spam-hits"))
    key = [F.col("f.doc_id").eqNullSafe(F.col("h.doc_id")), F.col("f.page") == F.col("h.page"), F.col("f.unit") == F.col("h.unit")]
    slim = found.select("doc_id", "page", "unit", "look", "chars", "gap", "doubtful", "support", F.size("phrases").alias("n"))
    both = slim.alias("f").join(hits.alias("h"), key, "left").select("f.*", F.coalesce("hits", F.lit(0)).alias("hits"))
    share = F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(0.0)
    as_list = (
        F.when(F.col("look") == LIST, ~F.col("doubtful") | (F.col("hits") > 0))
        .when(F.col("look") == SENTENCE, (share >= STUFFED) | ((share >= HINTED) & (share + F.col("gap") >= TOGETHER)))
        .otherwise(share >= STUFFED_OTHER)
    )
    judged = both.select("doc_id", "page", "unit", "chars", "n", "hits", as_list.alias("listed"), (F.col("support") + F.col("hits")).alias("support"))
    listed = lambda c: F.sum(F.when(F.col("listed"), F.col(c)).otherwise(0))
    copies = F.sum((F.col("unit") == 0).cast("int"))  # of repeated rows
    of = judged.groupBy("doc_id", "page").agg(listed("chars").alias("in_lists"), F.sum("chars").alias("whole"), (listed("support") / copies).cast("bigint").alias("support"), F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    density = F.round(F.col("in_lists") / F.col("whole"), 6)
    replicated = F.when(F.col("n") > 0, F.round(F.col("hits") / F.col("n"), 6)).otherwise(0.0)
    return of.select("doc_id", density.alias("density"), replicated.alias("replicated"), "support", ((F.col("in_lists") > DENSE * F.col("whole")) & (F.col("support") >= SUPPORT)).alias("flagged"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors needn't have the library installed
