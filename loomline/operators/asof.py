"""Attributes as known at event time, from independent change histories per attribute.

Every attribute has its own narrow history (entity, valid_from, value); no wide version table is built, so
attributes that change at different times never multiply versions. A history is turned into intervals and
cut at bucket edges (a day by default); an event finds its interval by an equi-join on (entity, bucket) and
one comparison. Each attribute is matched on its own, and the match adds its column to the event row, which
pivots the attributes back without a second shuffle by event.

Scale: the interval side has entities x buckets + changes rows. It is broadcast only after its rows are
counted; beyond the bound the join shuffles on (entity, bucket), which spreads a hot entity over its days
(and AQE splits what is left). Events are never collected by entity.

Defined cases: events with a null entity or time keep null attributes; an event before the first change
gets null; of facts visible from one moment the one with the greatest effective time counts, then the one learned
last, then the greatest value; duplicates change nothing; empty histories give null attributes; other columns of the events pass
through, but one named like an attribute is replaced by it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import store

DAY = 86_400


def _micros(c: Column) -> Column:
    return F.unix_micros(F.to_timestamp(c.cast("timestamp_ntz").cast("timestamp")))


def known_steps(facts: DataFrame, entity: str, effective: str, learned: str, value: str) -> DataFrame:
    """Step function of what was known best: (entity, valid_from, value).

    A fact is visible from the later of `effective` and `learned`; of the visible ones the one with the
    greatest effective time counts, then the one learned last, then the greatest value. The running best is
    kept only where it changes.
    """
    visible = F.greatest(F.col(effective).cast("timestamp_ntz"), F.col(learned).cast("timestamp_ntz"))
    rank = F.struct(F.col(effective).alias("e"), F.col(learned).alias("l"), F.col(value).alias("v"))
    at = facts.groupBy(F.col(entity).alias("entity"), visible.alias("valid_from")).agg(F.max(rank).alias("best")).where("entity IS NOT NULL AND valid_from IS NOT NULL")
    w = Window.partitionBy("entity").orderBy("valid_from")
    run = at.select("entity", "valid_from", F.max("best").over(w).alias("best"))
    return run.withColumn("before", F.lag("best").over(w)).where("before IS NULL OR before <> best").select("entity", "valid_from", F.col("best.v").alias("value"))


def intervals(history: DataFrame, bucket_seconds: int, horizon: Column | None = None) -> DataFrame:
    """(entity, bucket, from_us, to_us, value): the steps of a history, cut at bucket edges up to the horizon."""
    w = Window.partitionBy("entity").orderBy("valid_from")
    size = bucket_seconds * 1_000_000
    steps = history.select("entity", _micros(F.col("valid_from")).alias("from_us"), F.lead(_micros(F.col("valid_from"))).over(w).alias("to_us"), "value")
    if horizon is not None:
        steps = steps.where(F.col("from_us") <= horizon)
    end = F.col("from_us") if horizon is None else F.least(F.coalesce(F.col("to_us") - 1, horizon), horizon)
    return steps.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("from_us") / size), F.floor(F.greatest(end, F.col("from_us")) / size))))


def latest(events: DataFrame, ts: str) -> int | None:
    """The greatest time in microseconds; ask the raw table, so that one column is read and nothing else computed."""
    return events.select(F.max(ts).alias("t")).select(_micros(F.col("t"))).first()[0]


def match(events: DataFrame, entity: str, ts: str, histories: Mapping[str, DataFrame], bucket_seconds: int = DAY, latest: int | None = None) -> DataFrame:
    """events with one column for each attribute of histories: its value known at ts.

    histories: attribute -> (entity, valid_from, value), one value for each entity and valid_from. latest: a time (microseconds)
    that no event is after, if it is known.
    """
    size = bucket_seconds * 1_000_000
    top = latest if latest is not None else events.agg(F.max(_micros(F.col(ts))).alias("m")).first()["m"]
    us, bucket = "__us", "__bucket"
    out = events.withColumn(us, _micros(F.col(ts))).withColumn(bucket, F.floor(F.col(us) / size))
    for name, history in histories.items():
        cut = store.materialize(intervals(history, bucket_seconds, F.lit(top if top is not None else 0)), f"steps-{name}")
        side = store.checked_broadcast(cut.select(F.col("entity").alias("__e"), F.col("bucket").alias("__b"), F.col("from_us").alias("__from"), F.col("to_us").alias("__to"), F.col("value").alias("__value")))
        on = (out[entity] == side["__e"]) & (out[bucket] == side["__b"]) & (out[us] >= side["__from"]) & (side["__to"].isNull() | (out[us] < side["__to"]))
        joined = out.join(side, on, "left").drop("__e", "__b", "__from", "__to")
        out = joined.drop(name).withColumnRenamed("__value", name)
    return out.drop(us, bucket)
