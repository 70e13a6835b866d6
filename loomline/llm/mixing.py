"""Mixing sources to target weights: whole copies plus one hash-seeded Bernoulli copy.

Tokens are summed per source over its different texts; the mixture is as large as the scarcest source allows
(or as asked for), each source gets the repetition rate share * total / tokens, at most its cap, and each text
is emitted floor(rate) times, plus once more with the rate's fraction as probability, drawn from a hash of its
doc_id and a seed. The draw needs no shuffle and repeats exactly after a lost executor.

Only per-source sums (as many rows as mix_targets has sources) reach the driver. Repeated texts are merged by
digest with a map-side combine, so a text in a million copies is one row after the scan.

Defined cases: null and empty texts have no tokens and aren't used; sources are compared without letter case,
outer blanks, and hyphens or blanks for underscores; documents of other or no sources aren't used; a text in
several sources belongs to that of its smallest doc_id; repeated texts count once (that doc_id), so no text is
used more than max_repeats times; null or negative shares count as 0; a source with a share but no text gets
none and doesn't hold back the others; empty tables give an empty mixture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import store
from . import bpe


def source_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"[\s\xa0]+", " "))), r"[ \-]+", "_")


def texts(documents: DataFrame, targets: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, source, n_tokens): one row for each different text of a target source."""
    wanted = F.broadcast(targets.select(source_key(F.col("source")).alias("source")).distinct())  # a row for each source of the mixture
    docs = documents.where("text IS NOT NULL AND text <> ''").select("doc_id", source_key(F.col("source")).alias("source"), F.sha2("text", 256).alias("digest"), "text").join(wanted, "source", "left_semi")
    sized = bpe.count(docs, "text", "n_tokens", ("doc_id", "source", "digest"), tokenizer)
    first = sized.groupBy("digest").agg(F.min_by(F.struct("doc_id", "source", "n_tokens"), F.struct("doc_id", "source")).alias("d"))
    return first.select("d.*")


def rates(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """(source, target_share, max_repeats, n_texts, tokens, rate): one row for each source of the mixture.

    Without total_tokens the mixture is the largest in which every source reaches its share.
    """
    sums = sizes.groupBy("source").agg(F.count("*").alias("n_texts"), F.sum("n_tokens").alias("tokens"))
    goal = targets.select(source_key(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    goal = goal.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = goal.join(sums, "source", "left").fillna(0, ["n_texts", "tokens"]).collect()  # as many rows as sources
    usable = [r for r in rows if r["tokens"] > 0 and r["target_share"] > 0]
    weight = sum(r["target_share"] for r in usable)
    total = total_tokens if total_tokens is not None else min((r["max_repeats"] * r["tokens"] * weight / r["target_share"] for r in usable), default=0.0)
    out = []
    for r in sorted(rows, key=lambda r: r["source"]):
        rate = min(float(r["max_repeats"]), r["target_share"] / weight * total / r["tokens"]) if r in usable else 0.0
        nearest = round(rate)
        rate = float(nearest) if abs(rate - nearest) < 1e-9 else rate
        out.append((r["source"], float(r["target_share"]), int(r["max_repeats"]), int(r["n_texts"]), int(r["tokens"]), rate))
    return sizes.sparkSession.createDataFrame(out, "source string, target_share double, max_repeats int, n_texts bigint, tokens bigint, rate double")


def copies(sizes: DataFrame, rate_table: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of every text that is used."""
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = sizes.join(F.broadcast(rate_table.select("source", "rate")), "source")
    n = (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("bigint")).cast("bigint")
    return drawn.select("doc_id", "source", "n_tokens", n.alias("copies")).where("copies > 0")


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = f"{bpe.TOKENIZERS}/byte_bpe_50k.json", total_tokens: float | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(mixture, report). mixture: (doc_id, source, copy_no, n_tokens), a row for each use of a text."""
    sizes = store.materialize(texts(documents, targets, tokenizer), "mix-sizes")
    rate_table = rates(sizes, targets, total_tokens)
    used = copies(sizes, rate_table, seed)
    mixture = used.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy_no"), "n_tokens")
    got = used.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"), F.sum("copies").alias("mixed_texts"), F.max("copies").alias("most_copies"))
    report = F.broadcast(rate_table).join(got, "source", "left").fillna(0, ["mixed_tokens", "mixed_texts", "most_copies"])
    whole = got.agg(F.sum("mixed_tokens").alias("all_tokens"))
    report = report.join(F.broadcast(whole), F.lit(True), "left").withColumn("actual_share", F.when(F.col("all_tokens") > 0, F.round(F.col("mixed_tokens") / F.col("all_tokens"), 6)).otherwise(F.lit(0.0))).drop("all_tokens")
    return mixture, report
