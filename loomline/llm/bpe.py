"""Byte-level BPE as a deterministic automaton over tokens.

The automaton's states are the tokens read last; an arc t1 -> t2 exists iff "t1 t2" can follow each other in
a tokenization. It is compiled by one *merge gadget* for each merge rule, in rule order. The gadget of rule k,
(x, y) -> z, does three things:

- the arc from the state of x over y is cut from rule k on (x y would have been merged);
- z gets a state, a copy of the state of y as it was before rule k: whatever could follow y then can follow z,
  and later rules with y on their left don't concern it;
- z gets an arc wherever x could be read before rule k, and later rules with x on their right don't concern it.

Copies are kept as a pointer and the rule number at which they were frozen (a *spine*), so the table has a few
entries a token instead of tens of thousands. An arc is looked up in the spines once and then kept in a table.

Words are encoded by table-driven transitions: for every prefix of a word there is exactly one last token that
the automaton reaches, found from the tokens that end there; the ids are the arc labels on the way back.
Decoding emits the arc labels' bytes.

Defined cases: null and empty texts have no ids (an empty list); invalid surrogates can't occur in Spark
strings; strings of special tokens in a text are ordinary text; texts of any length are encoded whole, in
linear time for a bounded token length.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import store

#: Folder of the vocabulary files; a parameter of every function that reads them.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the word pattern of the vocabulary (contractions, letters, digits, other signs, white space).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = 1 << 60
CACHE_WORDS = 200_000


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """The compiled transducer: labels (token -> bytes), spines, rules and the arc table filled so far."""

    def __init__(self, vocab: dict[bytes, int], merges: Iterable[tuple[bytes, bytes]]):
        self.ids = vocab
        self.labels = {i: t for t, i in vocab.items()}
        # (token, rule from which on it no longer counts), outermost first; both spines start with the token itself
        self.left: dict[int, tuple[tuple[int, int], ...]] = {}
        self.right: dict[int, tuple[tuple[int, int], ...]] = {}
        self.rules: dict[tuple[int, int], int] = {}
        self.arcs: dict[tuple[int, int], bool] = {}
        self.longest = [1] * 256
        for token, i in vocab.items():
            if len(token) == 1:
                self.left[i] = self.right[i] = ((i, NEVER),)
        for k, (x, y) in enumerate(merges):
            self._gadget(k, vocab[x], vocab[y], vocab[x + y])

    def _gadget(self, k: int, x: int, y: int, z: int) -> None:
        self.right[z] = ((z, NEVER), (y, k), *self.right[y][1:])
        self.left[z] = ((z, NEVER), (x, k), *self.left[x][1:])
        self.rules[x, y] = k
        label = self.labels[z]
        self.longest[label[-1]] = max(self.longest[label[-1]], len(label))

    def arc(self, before: int, token: int) -> bool:
        """Whether token can follow before: no rule joins their facing edges while both edges still exist."""
        key = (before, token)
        known = self.arcs.get(key)
        if known is None:
            rules = self.rules
            # equal rule numbers mean a run of one token, which is merged from the left
            known = not any((k := rules.get((a, b))) is not None and k < until_a and k <= until_b for a, until_a in self.right[before] for b, until_b in self.left[token])
            if len(self.arcs) > 4_000_000:
                self.arcs.clear()
            self.arcs[key] = known
        return known

    def encode_word(self, word: bytes) -> list[int]:
        whole = self.ids.get(word)
        if whole is not None and whole in self.right:
            return [whole]
        ids, arc, longest, n = self.ids, self.arc, self.longest, len(word)
        last = [-1] * (n + 1)
        start = [0] * (n + 1)
        for end in range(1, n + 1):
            for begin in range(max(0, end - longest[word[end - 1]]), end):
                token = ids.get(word[begin:end])
                if token is not None and (begin == 0 or arc(last[begin], token)) and token in self.right:
                    last[end], start[end] = token, begin
                    break
        out, at = [], n
        while at:
            out.append(last[at])
            at = start[at]
        return out[::-1]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(self.labels[i] for i in ids)


def load(path: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> Automaton:
    """Compile the automaton of a byte-level vocabulary file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = byte_letters()
    raw = lambda token: bytes(letters[c] for c in token)
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = {x + y for x, y in merges} | set(letters)
    return Automaton({raw(t): i for t, i in model["vocab"].items() if t in made}, [(raw(x), raw(y)) for x, y in merges])


class Encoder:
    """Whole texts: split into words, encode each word once, keep what was encoded."""

    def __init__(self, automaton: Automaton):
        import regex

        self.automaton, self.words, self.seen = automaton, regex.compile(WORDS), {}

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        seen = self.seen
        for word in self.words.findall(text):
            ids = seen.get(word)
            if ids is None:
                ids = self.automaton.encode_word(word.encode("utf-8"))
                if len(seen) >= CACHE_WORDS:
                    seen.clear()
                if len(word) <= 64:
                    seen[word] = ids
            out += ids
        return out


_encoders: dict[int, Encoder] = {}


def _encoder(automaton) -> Encoder:
    """One encoder for each Python worker, kept between tasks."""
    key = automaton.id if hasattr(automaton, "id") else id(automaton)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(automaton.value if hasattr(automaton, "value") else automaton)
    return _encoders[key]


def shipped(df: DataFrame, tokenizer: str):
    """The automaton as a broadcast: its size is that of the vocabulary, not of the data."""
    return df.sparkSession.sparkContext.broadcast(load(tokenizer))


def encode(df: DataFrame, text: str = "text", into: str = "ids", keep: Iterable[str] = ("doc_id",), tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """df's kept columns with the ids of each text. A narrow map over the scan; only a scan of fewer splits than cores is shuffled."""
    keep = list(keep)
    automaton = shipped(df, tokenizer)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = _encoder(automaton)
        for batch in batches:
            ids = [encoder.encode(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.list_(pa.int32()))], [*keep, into])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"`{into}` array<int>"])
    return store.spread(df.select(*keep, F.col(text).alias("__text"))).mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", into: str = "text", keep: Iterable[str] = ("doc_id",), tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """df's kept columns with the text of each list of ids: the labels of its arcs in a row; null for a null list. Raises for an unknown id."""
    keep = list(keep)
    automaton = shipped(df, tokenizer)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        labels = _encoder(automaton).automaton.labels
        for batch in batches:
            texts = [None if row is None else b"".join([labels[i] for i in row]).decode("utf-8", "replace") for row in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*keep, into])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"`{into}` string"])
    return df.select(*keep, F.col(ids).alias("__ids")).mapInArrow(run, schema)


def count(df: DataFrame, text: str, into: str, keep: Iterable[str], tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """df's kept columns with the number of tokens of each text."""
    keep = list(keep)
    automaton = shipped(df, tokenizer)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = _encoder(automaton)
        for batch in batches:
            sizes = [len(encoder.encode(t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], [*keep, into])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"`{into}` bigint"])
    return store.spread(df.select(*keep, F.col(text).alias("__text"))).mapInArrow(run, schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors needn't have the library installed
