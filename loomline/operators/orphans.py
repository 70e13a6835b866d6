"""References to records that do not exist, by a skew-aware split.

References are pre-aggregated per key and period first (map-side combine), so a key named by a third of all
rows shrinks to one row a period before anything is joined. Heavy keys (more than `heavy_share` of all
references, hence at most 1 / heavy_share of them) are checked by a broadcast; all other keys go through one
shuffled join. The verdicts of both are united, counted, and joined back to the referring rows, again heavy
keys by broadcast and the rest shuffled.

States: `missing` (not in its table), `deleted` (not in its table, but listed as deleted), `late` (in its
table, but created after the referring record).

Defined cases: null and blank references are none; ids are compared in lower case without the marks around
them; repeated rows of one record count once; a null created_at on either side is never late; references of
marks alone are missing; empty tables give an empty report; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store

#: Referring table, field, referred table.
REFERENCES = (("files", "run_id", "runs"), ("files", "repository_id", "repositories"), ("repositories", "project_id", "projects"), ("runs", "project_id", "projects"))


def key_of(c: Column) -> Column:
    """An id without letter case and the marks around it."""
    return F.regexp_replace(F.lower(c), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def references(tables: dict[str, DataFrame]) -> DataFrame:
    """(src_table, src_field, row_id, target, key, created_at, period) of every non-blank reference."""
    parts = []
    for name in dict.fromkeys(r[0] for r in REFERENCES):
        df, fields = tables[name], [(f, t) for n, f, t in REFERENCES if n == name]
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("src_field"), F.lit(t).alias("target"), F.col(f).alias("ref")) for f, t in fields])).alias("r")
        parts.append(df.select(F.lit(name).alias("src_table"), F.col("id").alias("row_id"), "created_at", each))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    blank = F.regexp_replace("r.ref", r"[\s\xa0]+", "")
    return out.where(blank != "").select("src_table", "r.src_field", "row_id", "r.target", key_of(F.col("r.ref")).alias("key"), "created_at", F.date_format("created_at", "yyyy-MM").alias("period"))


def records(tables: dict[str, DataFrame]) -> DataFrame:
    """(target, key, since): one row for each record of the referred tables."""
    out = None
    for name in dict.fromkeys(r[2] for r in REFERENCES):
        part = tables[name].where("id IS NOT NULL").select(F.lit(name).alias("target"), key_of(F.col("id")).alias("key"), "created_at")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("target", "key").agg(F.min("created_at").alias("since"))


def deletions(deleted: DataFrame) -> DataFrame:
    return deleted.select(F.lower(F.trim("table_name")).alias("target"), key_of(F.col("record_id")).alias("key")).where("key IS NOT NULL").distinct().withColumn("listed", F.lit(True))


def verdicts(refs: DataFrame, known: DataFrame, deleted: DataFrame, heavy_share: float = 0.001) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(heavy keys, heavy, light): all heavy keys, and (target, key, state, since) of the heavy and of the other keys with an orphan;
    state is `late?` if only rows before `since` are."""
    per_period = store.materialize(refs.groupBy("target", "key", "period").agg(F.count("*").alias("n"), F.min("created_at").alias("first")), "refs-per-period")
    per_key = per_period.groupBy("target", "key").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    total = per_period.agg(F.sum("n")).first()[0] or 0
    is_heavy = F.col("n") > F.lit(total * heavy_share)
    # at most 1 / heavy_share keys can be heavy: bounded whatever the data
    heavy = store.materialize(per_key.where(is_heavy), "heavy-keys")
    probe = F.broadcast(heavy.select("target", "key"))
    facts = known.join(probe, ["target", "key"], "left_semi")
    gone = deleted.join(probe, ["target", "key"], "left_semi")
    of_heavy = heavy.join(F.broadcast(facts), ["target", "key"], "left").join(F.broadcast(gone), ["target", "key"], "left")
    of_light = per_key.where(~is_heavy).join(known, ["target", "key"], "left").join(deleted, ["target", "key"], "left")

    def judge(df: DataFrame) -> DataFrame:
        present = F.col("here")
        state = F.when(present & (F.col("first") < F.col("since")), "late?").when(present, F.lit(None).cast("string")).when(F.col("listed"), F.lit("deleted")).otherwise("missing")
        return df.select("target", "key", "since", state.alias("state")).where("state IS NOT NULL")

    return heavy.select("target", "key"), judge(of_heavy), judge(of_light)


def orphans(tables: dict[str, DataFrame], deleted: DataFrame, heavy_share: float = 0.001) -> DataFrame:
    """(src_table, src_field, row_id, state, period) of each orphan reference, one row for each."""
    refs = references(tables)
    known = records(tables).withColumn("here", F.lit(True))
    keys, heavy, light = verdicts(refs, known, deletions(deleted), heavy_share)
    heavy = store.materialize(heavy, "orphan-heavy")  # at most 1 / heavy_share rows
    light = store.checked_broadcast(store.materialize(light, "orphan-light"))
    heavy_rows = refs.join(F.broadcast(heavy), ["target", "key"])
    # rows of heavy keys leave before a shuffle could bring them together
    light_rows = refs.join(F.broadcast(keys), ["target", "key"], "left_anti").join(light, ["target", "key"])
    rows = heavy_rows.unionByName(light_rows).where("state <> 'late?' OR created_at < since")
    state = F.when(F.col("state") == "late?", "late").otherwise(F.col("state"))
    return rows.select("src_table", "src_field", "row_id", state.alias("state"), "period").distinct()


def found(tables: dict[str, DataFrame], deleted: DataFrame) -> DataFrame:
    return orphans(tables, deleted).select("src_table", "src_field", "row_id", "state").distinct()


def counts(tables: dict[str, DataFrame], deleted: DataFrame) -> DataFrame:
    """Orphans per table, field, month of the referring record and state."""
    return orphans(tables, deleted).groupBy("src_table", "src_field", "period", "state").agg(F.count("*").alias("n"))


def load(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    names = ("files", "repositories", "runs", "projects")
    return {n: store.table(spark, sf_dir, n) for n in names}, store.table(spark, sf_dir, "deleted_records")
