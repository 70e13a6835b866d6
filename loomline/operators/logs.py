"""Logs, activity, metrics and the quality of retrieval and answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import store

#: Log levels by rank.
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


def rank(level: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level), F.lit(0))


def log_filter(logs: DataFrame, level: str | None = None, start: str | None = None, end: str | None = None, module: str | None = None, request_id: str | None = None, search: str | None = None, **extra: str) -> DataFrame:
    """Entries by level (application logs only), time, module (exact or `prefix*`; entries without one pass),
    request, fields of `extra` (a map) and a text in the message."""
    if level:
        logs = logs.where((F.col("category") != "app") | (rank(F.col("level")) >= LEVELS.index(level) + 1))
    if start:
        logs = logs.where(F.col("timestamp") >= F.lit(start).cast(logs.schema["timestamp"].dataType))
    if end:
        logs = logs.where(F.col("timestamp") <= F.lit(end).cast(logs.schema["timestamp"].dataType))
    if module:
        fits = F.col("module").startswith(module[:-1]) if module.endswith("*") else F.col("module") == module
        logs = logs.where(F.col("module").isNull() | fits)
    if request_id:
        logs = logs.where(F.col("request_id") == request_id)
    for key, value in extra.items():
        logs = logs.where(F.col("extra")[key] == value)
    if search:
        logs = logs.where(F.contains(F.lower("message"), F.lit(search.lower())))
    return logs


def log_stats(logs: DataFrame) -> DataFrame:
    """(category, total, errors, oldest, newest)."""
    return logs.groupBy("category").agg(F.count("*").alias("total"), F.sum(F.col("level").isin("ERROR", "CRITICAL").cast("bigint")).alias("errors"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"))


# --- metrics --------------------------------------------------------------------------------------


def histogram(values: DataFrame, buckets: Sequence[float], by: str, value: str = "value") -> DataFrame:
    """(by, bucket, n): cumulative counts up to each bucket's bound; the last bound is infinity."""
    sums = [F.sum((F.col(value) <= b).cast("bigint")).alias(f"b{i}") for i, b in enumerate(buckets)]
    wide = values.where(F.col(value).isNotNull()).groupBy(by).agg(*sums, F.count("*").alias("inf"))
    pairs = F.array(*[F.struct(F.lit(str(float(b))).alias("bucket"), F.col(f"b{i}").alias("n")) for i, b in enumerate(buckets)], F.struct(F.lit("+Inf").alias("bucket"), F.col("inf").alias("n")))
    return wide.select(by, F.inline(pairs))


def percentiles(values: DataFrame, by: str, quantiles: Sequence[float], value: str = "value") -> DataFrame:
    """(by, n, mean, p<q>...): exact order statistics at index int(n * q) of the sorted values.

    Values are counted per (group, value) first; the index is found by a running count over distinct values, which is spread
    over tasks where a group has many.
    """
    v = store.materialize(values.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("c")), "percentiles")
    total = v.groupBy(by).agg(F.sum("c").alias("n"), F.round(F.sum(F.col("v") * F.col("c")) / F.sum("c"), 6).alias("mean"))
    j = store.running(v, [by], [F.col("v")], F.col("c"), "r").join(total, by)
    picks = [F.min(F.when(F.col("r") > F.floor(F.col("n") * q), F.col("v"))).alias(f"p{round(q * 100)}") for q in quantiles]
    return j.groupBy(by, "n", "mean").agg(*picks)


def prometheus(samples: DataFrame) -> DataFrame:
    """(line): text exposition of samples (name, kind, help, labels map, value), metric by metric."""
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    sample = F.concat("name", F.when(F.size("labels") > 0, F.concat(F.lit("{"), labels, F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string"))
    g = samples.groupBy("name").agg(F.first("help").alias("help"), F.first("kind").alias("kind"), F.array_sort(F.collect_list(sample)).alias("s"))
    text = F.concat(F.array(F.concat(F.lit("# HELP "), "name", F.lit(" "), "help"), F.concat(F.lit("# TYPE "), "name", F.lit(" "), "kind")), "s")
    return g.select("name", F.posexplode(text).alias("pos", "line")).orderBy("name", "pos").select("line")


def activity(events: DataFrame, ok: Column, latency: str = "value", cached: Column | None = None) -> DataFrame:
    """(total, ok, success_rate, avg_latency, cache_hit_rate): one row over all events; the hit rate is that of events that asked a cache."""
    hits = F.avg(cached.cast("double")) if cached is not None else F.lit(None).cast("double")
    return events.agg(F.count("*").alias("total"), F.sum(ok.cast("bigint")).alias("ok"), F.round(F.avg(ok.cast("double")), 6).alias("success_rate"), F.round(F.avg(latency), 2).alias("avg_latency"), F.round(hits, 6).alias("cache_hit_rate"))


def error_types(events: DataFrame, ok: Column, kind: Column, latency: str = "value") -> DataFrame:
    """(error_type, n, share, avg_latency) of the events that failed; a null kind is `unknown`."""
    bad = events.where(~ok).groupBy(F.coalesce(kind, F.lit("unknown")).alias("error_type")).agg(F.count("*").alias("n"), F.round(F.avg(latency), 2).alias("avg_latency"))
    whole = bad.agg(F.sum("n").alias("__all"))
    return bad.join(F.broadcast(whole), F.lit(True)).select("error_type", "n", F.round(F.col("n") / F.col("__all"), 6).alias("share"), "avg_latency")  # one row


def top(events: DataFrame, by: str, k: int = 10) -> DataFrame:
    return events.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(k)


def ema(series: DataFrame, by: str, order: Sequence[str], value: str = "value", alpha: float = 0.3) -> DataFrame:
    """(by, ema): exponential average in order, seeded with the first value; an average of 0 counts as unseeded.

    The fold has a closed form, a sum over all values: the first value that isn't 0 weighs (1 - alpha)^(values after it), any
    later one alpha times that, so that partial sums do it. An average can be 0 again later only if values of both signs cancel
    out exactly, and is then taken as it is. Rows should differ in order; the numbers in order are spread over tasks.
    """
    v = series.where(F.col(value).isNotNull()).select(by, *order, F.col(value).cast("double").alias("__v"))
    numbered = store.running(v, [by], [F.desc(c) for c in order], F.lit(1), "__after").withColumn("__after", F.col("__after") - 1)
    seeds = numbered.groupBy(by).agg(F.max(F.when(F.col("__v") != 0, F.col("__after"))).alias("__first"))
    j = numbered.join(store.checked_broadcast(seeds), by)
    weight = F.pow(F.lit(1 - alpha), F.col("__after")) * F.when(F.col("__after") == F.col("__first"), 1.0).otherwise(alpha)
    part = F.when(F.col("__after") <= F.col("__first"), weight * F.col("__v"))
    return j.groupBy(by).agg(F.round(F.coalesce(F.sum(part), F.lit(0.0)), 6).alias("ema"))


def progress(events: DataFrame) -> DataFrame:
    """(ingestion_id, files, done, errors, percentage, status) of each session, from its per-file events (file, state, at)."""
    last = events.groupBy("ingestion_id", "file").agg(F.max_by("state", F.struct("at", "state")).alias("state"))
    done = F.col("state").isin("complete", "error", "skipped").cast("bigint")
    g = last.groupBy("ingestion_id").agg(F.count("*").alias("files"), F.sum(done).alias("done"), F.sum((F.col("state") == "error").cast("bigint")).alias("errors"))
    status = F.when(F.col("done") < F.col("files"), "running").when(F.col("errors") == F.col("files"), "failed").when(F.col("errors") > 0, "completed_with_errors").otherwise("completed")
    return g.select("ingestion_id", "files", "done", "errors", F.round(100 * F.col("done") / F.col("files")).cast("int").alias("percentage"), status.alias("status"))


def data_hash(counts: DataFrame) -> DataFrame:
    """(hash) of a table of (name, n) whatever its order; changes with any count."""
    return counts.agg(F.md5(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))))).alias("hash"))


# --- quality --------------------------------------------------------------------------------------


def retrieval_quality(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, precision, recall, rr, ndcg) at k. ranked: (query_id, id, rank); relevant: (query_id, id)."""
    hits = ranked.where(F.col("rank") <= k).join(relevant.select("query_id", "id").distinct().withColumn("hit", F.lit(1)), ["query_id", "id"], "left").fillna(0, ["hit"])
    totals = relevant.select("query_id", "id").distinct().groupBy("query_id").agg(F.count("*").alias("all"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("all"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
    g = hits.groupBy("query_id").agg(F.sum("hit").alias("h"), F.sum(F.col("hit") / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    j = totals.join(g, "query_id", "left").fillna(0, ["h"]).fillna(0.0, ["dcg"])
    return j.select("query_id", F.round(F.col("h") / k, 6).alias("precision"), F.round(F.col("h") / F.col("all"), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"))


def share_named(answer: Column, wanted: Column) -> Column:
    """Share of the wanted names that an answer contains, ignoring case; 0 for none wanted."""
    return F.when(F.size(wanted) > 0, F.size(F.filter(wanted, lambda w: F.contains(F.lower(answer), F.lower(w)))) / F.size(wanted)).otherwise(F.lit(0.0))


#: Words that are no names of tables.
SQL_WORDS = ("select", "from", "where", "join", "left", "right", "inner", "outer", "group", "order", "having", "limit", "offset", "and", "or", "not", "null", "true", "false", "case", "when", "then", "else", "end", "with", "as", "on", "using", "into", "values")


def answer_quality(answers: DataFrame) -> DataFrame:
    """(id, accuracy, citation, hallucination, completeness). answers: (id, answer, entities, concepts, files, contexts)."""
    a = F.col("answer")
    words = F.array_distinct(F.regexp_extract_all(F.lower(a), F.lit(r"(?<![\p{L}\p{N}_])[a-z_]{3,}(?![\p{L}\p{N}_])"), F.lit(0)))
    from_context = F.flatten(F.transform("contexts", lambda c: F.regexp_extract_all(c, F.lit(r"(?i)(?:FROM|JOIN)\s+(\w+)"), F.lit(1))))
    allowed = F.transform(F.concat("entities", from_context), F.lower)
    strange = F.filter(words, lambda w: ~F.array_contains(allowed, w) & ~w.isin(*SQL_WORDS) & (F.length(w) > 3))
    cited = F.contains(a, F.lit("```")) | F.exists("files", lambda f: (f != "") & F.contains(a, f))
    return answers.select("id", F.round(0.6 * share_named(a, F.col("entities")) + 0.4 * share_named(a, F.col("concepts")), 6).alias("accuracy"), cited.cast("double").alias("citation"), F.round(F.when(F.size(words) > 0, F.size(strange) / F.size(words)).otherwise(0.0), 6).alias("hallucination"), F.round(F.when(F.size("entities") == 0, 1.0).otherwise(share_named(a, F.col("entities"))), 6).alias("completeness"))
