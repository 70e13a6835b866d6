"""File-arrival streams: debounced micro-batches, idempotent ingestion, session states, windows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def watch(spark: SparkSession, path: str, glob: str = "*.sql", per_trigger: int = 200) -> DataFrame:
    """A stream of (path, content, at) of files that arrive; at most `per_trigger` a batch (back-pressure)."""
    raw = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).schema("value string").load(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("at"))


def debounce(events: DataFrame, gap: str = "5 seconds", key: str = "stream", path: str = "path", at: str = "ts") -> DataFrame:
    """(key, batch_start, batch_end, paths): events closer than the gap are one batch, each path once.

    Batch and stream alike; a stream needs a watermark and emits a batch when the gap is over.
    """
    g = events.groupBy(F.session_window(at, gap).alias("w"), F.col(key).alias("key")).agg(F.array_sort(F.collect_set(path)).alias("paths"))
    return g.select("key", F.col("w.start").alias("batch_start"), F.col("w.end").alias("batch_end"), "paths")


def capped_batches(events: DataFrame, size: int = 50, gap_seconds: float = 5.0, key: str = "key", path: str = "path", at: str = "ts") -> DataFrame:
    """(key, batch, path): arrivals cut after `gap_seconds` of silence or `size` different paths; a batch twin of the stateful stream."""
    w = Window.partitionBy(key).orderBy(at, path)
    stamped = events.withColumn("__gap", (F.unix_micros(F.col(at).cast("timestamp")) - F.lag(F.unix_micros(F.col(at).cast("timestamp"))).over(w) > gap_seconds * 1e6).cast("int"))
    session = stamped.withColumn("__s", F.sum(F.coalesce("__gap", F.lit(0))).over(w))
    first = session.groupBy(key, "__s", path).agg(F.min(at).alias("__t"))
    n = F.row_number().over(Window.partitionBy(key, "__s").orderBy("__t", path))
    return first.select(F.col(key).alias("key"), F.concat_ws("-", F.col("__s").cast("string"), F.floor((n - 1) / size).cast("string")).alias("batch"), F.col(path).alias("path"))


def capped_stream(events: DataFrame, size: int = 50, gap_seconds: float = 5.0, key: str = "key", path: str = "path", at: str = "ts") -> DataFrame:
    """A stream of (key, batch, paths, reason): arrivals are gathered until `size` different paths are pending or none came for the gap.

    State is a key's pending paths (fewer than `size`) and the time of the last arrival; an event-time timer ends a pending batch
    when the watermark passes the gap. `events` needs a watermark on its time.
    """
    gap = int(gap_seconds * 1_000_000)

    def step(group, frames, state):
        import pandas as pd

        pending, last, n = state.get if state.exists else ([], 0, 0)
        pending, out = list(pending), []
        if state.hasTimedOut:
            out.append((group[0], n, pending, "idle"))
            pending, n = [], n + 1
        else:
            rows = pd.concat(list(frames)).sort_values([at, path], kind="stable")
            for name, when in zip(rows[path], rows[at].astype("datetime64[us]").astype("int64"), strict=True):
                if pending and when - last > gap:
                    out.append((group[0], n, pending, "idle"))
                    pending, n = [], n + 1
                last = max(last, int(when))
                if name not in pending:
                    pending.append(name)
                if len(pending) >= size:
                    out.append((group[0], n, pending, "size"))
                    pending, n = [], n + 1
        state.update((pending, last, n))
        if pending:
            state.setTimeoutTimestamp(max((last + gap) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "batch", "paths", "reason"])

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"key {kind}, batch bigint, paths array<string>, reason string", "pending array<string>, last bigint, n bigint", "append", "EventTimeTimeout")


def rate_limited(requests: DataFrame, limits: dict[str, int], default: int = 100, window: str = "1 minute", key: str = "user_id", kind: str = "kind", at: str = "ts") -> DataFrame:
    """(key, kind, start, n, allowed, refused) of each fixed window."""
    table = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]) if limits else F.create_map(F.lit(""), F.lit(default))
    g = requests.groupBy(F.window(at, window).alias("w"), F.col(key).alias("key"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    limit = F.coalesce(F.element_at(table, F.col("kind")), F.lit(default))
    return g.select("key", "kind", F.col("w.start").alias("start"), "n", F.least("n", limit).cast("bigint").alias("allowed"), F.greatest(F.col("n") - limit, F.lit(0)).cast("bigint").alias("refused"))


def tumbling(events: DataFrame, window: str, late: str | None, by: str, at: str = "ts", value: str = "value") -> DataFrame:
    """(start, by, n, total) of each window; on a stream with `late` as watermark."""
    e = events.withWatermark(at, late) if late and events.isStreaming else events
    g = e.groupBy(F.window(at, window).alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return g.select(F.col("w.start").alias("start"), by, "n", "total")


def session_states(events: DataFrame) -> DataFrame:
    """(ingestion_id, file, state): the newest state of each file; an update-mode stream or a batch."""
    return events.groupBy("ingestion_id", "file").agg(F.max_by("state", "at").alias("state"))


def ingest_batches(stream: DataFrame, path: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame]):
    """Purge-then-write: each micro-batch replaces the output of its files, so a file that comes again is idempotent.

    The file's bucket is the partition; a batch rewrites only the partitions it touches (dynamic overwrite).
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        fresh = parse(batch.groupBy("path").agg(F.max_by("content", "at").alias("content"), F.max("at").alias("at"))).withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(64)).cast("int"))
        out = fresh
        try:
            old = spark.read.parquet(path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            touched = fresh.select("bucket").distinct()
            kept = old.join(F.broadcast(touched), "bucket", "left_semi").join(fresh.select("path"), "path", "left_anti")  # at most 64 buckets
            out = fresh.unionByName(kept)
        out = out.persist()
        out.count()
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        out.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- circuit breaker ------------------------------------------------------------------------------


#: A breaker that has seen no call: state, failures in a row, when it opened.
FRESH = ("closed", 0, 0.0)


def breaker(outcomes: Iterable[tuple[float, bool]], failures: int = 1, cooldown: float = 60.0) -> list[str]:
    """State after each (time, rate_limited) outcome: closed, open, half_open.

    `failures` rate-limit errors in a row open the circuit; calls are refused until the cooldown is over, then
    one trial is let through, which closes the circuit or opens it again.
    """
    return resume(FRESH, outcomes, failures, cooldown)[0]


def resume(before: tuple[str, int, float], outcomes: Iterable[tuple[float, bool]], failures: int, cooldown: float) -> tuple[list[str], tuple[str, int, float]]:
    """The states of a breaker that goes on from where it stood, and where it stands then."""
    (state, bad, since), out = before, []
    for at, limited in outcomes:
        if state == "open" and at - since > cooldown:
            state = "half_open"
        if state != "open":
            if limited:
                bad += 1
                if state == "half_open" or bad >= failures:
                    state, since = "open", at
            else:
                state, bad = "closed", 0
        out.append(state)
    return out, (state, bad, since)


def replay_breaker(calls: DataFrame, failures: int = 1, cooldown: float = 60.0) -> DataFrame:
    """calls (service, at, limited) with state; calls of one time go by limited, those that passed first.

    A service's calls are sorted within one partition and folded Arrow batch by batch; only the breaker's state is
    carried from one to the next, so memory is bounded whatever a service's calls and no boundary resets it.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        of, now = None, FRESH
        for batch in batches:
            services, ats, limited = (batch.column(i).to_pylist() for i in range(3))
            states = []
            for service, group in groupby(zip(services, ats, limited, strict=True), key=lambda r: r[0]):
                more, now = resume(now if of == (service,) else FRESH, ((at / 1e6, bad) for _, at, bad in group), failures, cooldown)
                of = (service,)
                states += more
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(states, pa.string())], ["service", "at", "limited", "state"])

    us = calls.select("service", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "limited")
    return us.repartition("service").sortWithinPartitions("service", "at", "limited").mapInArrow(run, "service string, at bigint, limited boolean, state string")


def slices(c: Column, size: int = 64) -> Column:
    """A text in pieces of `size` characters, as a streamed answer is sent."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)), F.lit(size)), lambda i: F.substring(c, i, F.lit(size)))


# --- scheduling -----------------------------------------------------------------------------------

#: Priorities of work, most urgent first, and the scheduler pools they run in.
PRIORITIES = ("CRITICAL", "NORMAL", "BATCH")


def in_pool(spark: SparkSession, priority: str) -> None:
    """Run this thread's next jobs in the pool of a priority (needs `spark.scheduler.mode=FAIR` to matter)."""
    if priority not in PRIORITIES:
        raise ValueError(f"unknown priority {priority!r}")
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", priority.lower())


def by_priority(tasks: DataFrame, priority: str = "priority", order: str = "seq") -> DataFrame:
    """tasks in the order they should run: by priority, then as they came."""
    rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col(priority))
    return tasks.orderBy(F.when(rank > 0, rank).otherwise(len(PRIORITIES) + 1), order)


def snapshot_if_changed(tables: dict[str, DataFrame], base: str, stamp: str, before: str | None) -> tuple[str | None, str]:
    """(path of a new snapshot or None, hash): a periodic trigger's step; writes only if row counts changed."""
    from ..sources import tables as T

    moved, now = T.changed(tables, before)
    spark = next(iter(tables.values())).sparkSession
    return (T.create_snapshot(spark, tables, base, stamp) if moved else None), now


def recent(events: DataFrame, k: int = 10_000, at: str = "ts") -> DataFrame:
    """The last k events, oldest first: the bounded buffer of a dashboard."""
    return events.orderBy(F.desc(at)).limit(k).orderBy(at)
