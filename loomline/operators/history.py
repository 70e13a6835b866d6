"""History of changing entity attributes, kept by affected-chain rebuild.

Snapshots (as_of_date, payload) are normalised to *changes*: one row for each entity and date, the one
loaded last. A *chain* is the entity's versions with the period each was valid. Late and corrected
snapshots never patch a chain in place: the raw changes of the touched entities alone are fetched,
their chains are rebuilt from the first date on, and the old chains are replaced as a whole.

Cost: a batch touches only its entities. Changes are compacted to one row per entity and date with a
map-side combine first, so the window over an entity is bounded by the number of dates on record,
however many rows a hot entity has.

Defined cases: null, blank, unreadable or non-object payloads and payloads without an ISIN are no
snapshots; null dates neither; an absent, null or blank attribute keeps its former value; repeated rows
change nothing; ties of loaded_at are broken by id; an empty table gives an empty history; extra input
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import store
from ..sources import keyed

ATTRIBUTES = ("ticker", "asset_class", "region", "sector", "currency")
OPEN_END = 99991231
MARKS = r"[\s\xa0_\-]+"


def bare(c: Column) -> Column:
    """A key or value without letter case, blanks, hyphens and underscores."""
    return F.lower(F.regexp_replace(c, MARKS, ""))


def _as_map(payload: Column) -> Column:
    return F.from_json(payload, "map<string,string>", {"allowSingleQuotes": "false"})


def changes_of(snapshots: DataFrame, attributes: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """(entity, as_of_date, loaded_at, seq, <attributes>) of each readable snapshot; values in bare form.

    A payload is parsed once; only values that are objects are parsed again. Rows that are no snapshots leave with the
    generator, as a filter on what was parsed would be pushed below the projection and parse everything twice.
    """
    slim = store.spread(snapshots.select("as_of_date", "loaded_at", "id", "payload")).where("as_of_date IS NOT NULL AND payload IS NOT NULL")
    top = F.map_entries(_as_map(F.col("payload")))
    objects = F.flatten(F.transform(F.filter("top", lambda e: F.ltrim(e["value"]).startswith("{")), lambda e: F.coalesce(F.map_entries(_as_map(e["value"])), F.array().cast("array<struct<key:string,value:string>>"))))
    wanted = [bare_name(a) for a in ("isin", *attributes)]
    named = F.filter(F.transform(F.concat("top", "nested"), lambda e: F.struct(bare(e["key"]).alias("k"), e["value"].alias("v"))), lambda e: e["k"].isin(*wanted) & (F.trim(F.regexp_replace(e["v"], r"[\s\xa0]+", " ")) != ""))
    pick = lambda key: F.try_element_at(F.filter("entries", lambda e: e["k"] == key), F.lit(1))["v"]
    entity = F.upper(F.regexp_replace(pick("isin"), r"[\s\xa0]+", ""))
    row = F.struct(entity.alias("entity"), *[bare(pick(bare_name(a))).alias(a) for a in attributes])
    base = ["as_of_date", "loaded_at", F.col("id").alias("seq")]
    parsed = slim.select(*base, top.alias("top")).withColumn("nested", objects).select("as_of_date", "loaded_at", "seq", named.alias("entries"))
    kept = parsed.select("as_of_date", "loaded_at", "seq", F.explode(F.filter(F.array(row), lambda r: r["entity"] != "")).alias("r"))
    return kept.select("r.entity", "as_of_date", "loaded_at", "seq", *[F.col(f"r.{a}").alias(a) for a in attributes])


def bare_name(name: str) -> str:
    return name.replace("_", "").replace("-", "").lower()


def compact(changes: DataFrame) -> DataFrame:
    """One row for each entity and date: the one loaded last (loaded_at, then seq)."""
    rest = [c for c in changes.columns if c not in ("entity", "as_of_date")]
    order = F.struct(F.col("loaded_at"), F.col("seq"))
    last = F.max_by(F.struct(*rest), order)
    return changes.groupBy("entity", "as_of_date").agg(last.alias("r")).select("entity", "as_of_date", *[F.col(f"r.{c}").alias(c) for c in rest])


def chains(changes: DataFrame, attributes: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """(entity, valid_from, valid_to, <attributes>): one row for each version; valid_to is null at the open end."""
    w = Window.partitionBy("entity").orderBy("as_of_date")
    filled = compact(changes).select("entity", "as_of_date", *[F.last(a, ignorenulls=True).over(w).alias(a) for a in attributes])
    state = F.struct(*[F.col(a) for a in attributes])
    marked = filled.withColumn("before", F.lag(state).over(w)).withColumn("first", F.row_number().over(w) == 1)
    starts = marked.where(F.col("first") | ~F.col("before").eqNullSafe(state))
    return starts.select("entity", F.col("as_of_date").alias("valid_from"), F.lead("as_of_date").over(w).alias("valid_to"), *attributes)


def rebuild_affected(old_chains: DataFrame, old_changes: DataFrame, batch: DataFrame, attributes: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """The chains after a batch of late or corrected changes.

    Only entities named in the batch are fetched from old_changes and rebuilt; all other chains pass through.
    """
    touched = store.checked_broadcast(batch.select("entity").distinct())
    fetched = old_changes.join(touched, "entity", "left_semi")
    rebuilt = chains(fetched.unionByName(batch), attributes)
    return old_chains.join(touched, "entity", "left_anti").unionByName(rebuilt)


def is_late(days: int = 2) -> Column:
    """A change that landed more than `days` after its date: it may fall into the middle of a chain."""
    return F.col("loaded_at") >= F.date_add(F.col("as_of_date"), days + 1)


def build(snapshots: DataFrame, attributes: Sequence[str] = ATTRIBUTES, late_after_days: int = 2) -> DataFrame:
    """The full history of a landing table, through a store of its own: one batch of the snapshots that came in time, then one
    of the late and corrected ones, which rebuilds the chains it touches. The result doesn't depend on the split."""
    spark = snapshots.sparkSession
    changes = store.materialize(compact_within(changes_of(snapshots, attributes), late_after_days), "changes")
    kept = HistoryStore(spark, store.fresh_path(spark, "history"), attributes=attributes)
    kept.apply(changes.where("NOT late").drop("late"))
    kept.apply(changes.where("late").drop("late"))
    found = kept.history()
    return found if found is not None else chains(changes.drop("late").limit(0), attributes)


def compact_within(changes: DataFrame, late_after_days: int) -> DataFrame:
    """compact(), apart for changes in time and late ones."""
    rest = [c for c in changes.columns if c not in ("entity", "as_of_date")]
    late = F.coalesce(is_late(late_after_days), F.lit(False))
    last = F.max_by(F.struct(*rest), F.struct("loaded_at", "seq"))
    return changes.groupBy("entity", "as_of_date", late.alias("late")).agg(last.alias("r")).select("entity", "as_of_date", "late", *[F.col(f"r.{c}").alias(c) for c in rest])


def yyyymmdd(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd").cast("bigint")


def versions(history: DataFrame) -> DataFrame:
    """(isin, valid_from, valid_to) with dates as yyyymmdd and 99991231 as the open end."""
    return history.select(F.col("entity").alias("isin"), yyyymmdd(F.col("valid_from")).alias("valid_from"), F.coalesce(yyyymmdd(F.col("valid_to")), F.lit(OPEN_END).cast("bigint")).alias("valid_to"))


class HistoryStore:
    """Changes and chains on shared storage, filed by entity.

    apply() fetches the raw changes of the batch's entities alone, rebuilds their chains, writes them in place of the old
    ones (with the other chains of their buckets) and publishes both in one step; a reader sees either all old or all new
    chains of a batch, and of two writers one is refused with StaleWriter.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, attributes: Sequence[str] = ATTRIBUTES, rows_per_bucket: int = 1_000_000):
        self.attributes = tuple(attributes)
        self.store = keyed.KeyedStore(spark, path, {"changes": ("entity",), "chains": ("entity",)}, buckets, rows_per_bucket)

    def history(self) -> DataFrame | None:
        """All current chains; None before the first batch."""
        return self.store.read(self.store.manifest(), "chains")

    def changes(self) -> DataFrame | None:
        return self.store.read(self.store.manifest(), "changes")

    def apply(self, batch: DataFrame) -> None:
        """Take in a batch of changes (see changes_of), in any order of dates."""
        manifest = self.store.manifest()
        fresh = store.materialize(compact(batch), "history-batch")
        buckets = self.store.touched(manifest, "chains", fresh)
        if not buckets:
            return
        old = self.store.near(manifest, "changes", fresh)
        rebuilt = chains(fresh if old is None else old.unionByName(fresh), self.attributes)
        there = self.store.read(manifest, "chains", buckets)
        if there is not None:
            rebuilt = rebuilt.unionByName(there.join(store.checked_broadcast(fresh.select("entity").distinct()), "entity", "left_anti"))
        self.store.write(manifest, "changes", fresh)
        self.store.replace(manifest, "chains", rebuilt, buckets)
        self.store.publish(self.store.tidy(manifest))
