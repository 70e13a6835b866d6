"""Metadata, log, metric, quality, streaming and pass-through SQL queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import store
from ..operators import asof, logs, sqlapi
from ..operators import metadata as M
from ..sources import tables as T
from ..store import table
from ..streaming import files as ST


def events(spark, sf) -> DataFrame:
    return table(spark, sf, "events")


# --- metadata -------------------------------------------------------------------------------------


def m01_project_counts(spark, sf):
    files = table(spark, sf, "files").select("id", "project_id").distinct()
    return M.with_counts(table(spark, sf, "projects").select("id", "name"), "id", repositories=(table(spark, sf, "repositories"), "project_id"), files=(files, "project_id"))


def m02_context_errors(spark, sf):
    p = table(spark, sf, "projects").where("context IS NOT NULL")
    return p.select("id", F.size(M.context_errors(F.col("context"))).alias("errors"))


def m03_latest_version(spark, sf):
    f = table(spark, sf, "files").where("relative_path IS NOT NULL").select("id", "project_id", "relative_path", "created_at").distinct()
    return M.latest_versions(f, ("project_id", "relative_path"), ("created_at", "id"))


def m04_links_of(spark, sf):
    r = table(spark, sf, "repositories").select(F.col("id").alias("source_id"), F.col("project_id").alias("target_id"))
    return M.links_of(r, "default")


def m05_bad_links(spark, sf):
    r = table(spark, sf, "repositories").select("id", "project_id").where("project_id IS NOT NULL")
    first = r.groupBy("project_id").agg(F.min("id").alias("target_id"))
    links = r.join(first, "project_id").select("project_id", F.col("id").alias("source_id"), "target_id")
    return M.bad_links(links, r)


def m06_link_detect(spark, sf):
    d = table(spark, sf, "documents").where("text IS NOT NULL AND source IS NOT NULL")
    refs = d.select(F.col("source").alias("repository_id"), F.explode(F.regexp_extract_all("text", F.lit(r"[a-z]+_[a-z]+\.[a-z]+_[a-z]+"), F.lit(0))).alias("name"))
    return M.detect_links(refs)


def m07_register_status(spark, sf):
    f = table(spark, sf, "files").where("relative_path IS NOT NULL AND file_hash IS NOT NULL").select("id", "project_id", "relative_path", "file_hash", "created_at").distinct()
    return M.registration_history(f, ("project_id",), "relative_path", "file_hash", ("created_at", "id")).select("id", "registration")


def m08_run_results(spark, sf):
    return M.run_results(table(spark, sf, "files").select("id", "run_id", "status").distinct())


def m08_next_sequence(spark, sf):
    first = table(spark, sf, "runs").where("project_id IS NOT NULL AND timestamp IS NOT NULL").orderBy("created_at", "id").select("project_id", "timestamp").first()  # one row
    return M.next_sequence(table(spark, sf, "runs"), *first)


def m09_set_status(spark, sf):
    f = table(spark, sf, "files").select("id", "status", "processed_at").distinct()
    u = f.where("status = 'pending'").select("id", F.lit("error").alias("new_status"))
    return M.set_status(f, u, F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")).groupBy("status").agg(F.count("*").alias("n"), F.count("processed_at").alias("stamped"))


def m10_recent_files(spark, sf):
    f = table(spark, sf, "files").select("id", "created_at").distinct()
    return M.page(f, [F.desc("created_at"), F.asc("id")], 20, 10)


def m11_chat_artifacts(spark, sf):
    e = events(spark, sf).select(F.col("user_id"), F.col("event_type"), "value", "event_id")
    old = e.where("value < 50").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"))
    new = e.where("value >= 50").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"))
    return M.put(old, new, ("user_id", "event_type"))


def m12_extensions(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(M.extensions(F.concat(F.lit(".SQL, py,,Json ,sql,x"), "n_nationkey")), ",").alias("ext"))


def m13_first_models(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("usage_type"), F.col("c_name").alias("model_id"), F.col("c_nationkey").alias("priority"), (F.col("c_acctbal") > 0).alias("enabled"))
    return M.first_models(c).select("usage_type", "model_id", F.size("chain").cast("bigint").alias("n"))


def f01_file_filter(spark, sf):
    return M.file_filter(table(spark, sf, "files"), source="upload", status="processed").select("id").distinct()


def f02_derived(spark, sf):
    return table(spark, sf, "files").select("id", M.status_of().alias("status"), M.type_of().alias("type")).distinct()


def f04_file_search(spark, sf):
    return M.search_files(table(spark, sf, "files"), "Rates_1").select("id").distinct()


def f06_null_safe(spark, sf):
    f = table(spark, sf, "files").select("id", "repository_id", "file_hash").distinct()
    g = f.groupBy("repository_id", "file_hash").agg(F.min("id").alias("first"))
    return f.join(g, f.repository_id.eqNullSafe(g.repository_id) & f.file_hash.eqNullSafe(g.file_hash)).where("id <> first").select("id", "first")


def a03_file_stats(spark, sf):
    return M.file_stats(table(spark, sf, "files").select("id", "status", "processed_at").distinct())


def w04_version_history(spark, sf):
    f = table(spark, sf, "files").where("relative_path IS NOT NULL").select("id", "project_id", "relative_path", "created_at").distinct()
    return M.version_numbers(f, ("project_id", "relative_path"), ("created_at", "id")).select("id", F.col("version").cast("bigint").alias("version"))


# --- logs, metrics, quality -----------------------------------------------------------------------


def as_logs(spark, sf) -> DataFrame:
    e = events(spark, sf)
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "DEBUG").when(F.col("event_type") == "purchase", "WARNING").otherwise("INFO")
    return e.select("event_id", F.col("ts").alias("timestamp"), F.when(F.col("user_id") % 2 == 0, "app").otherwise("audit").alias("category"), level.alias("level"), F.concat(F.col("event_type"), F.lit(" of user "), "user_id").alias("message"), F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("api."), "event_type")).alias("module"), F.col("user_id").cast("string").alias("request_id"))


def f09_log_query(spark, sf):
    return logs.log_filter(as_logs(spark, sf), level="WARNING", start="2024-01-05 00:00:00", end="2024-01-20 00:00:00", module="api.p*", search="USER 1").select("event_id")


def t03_paging(spark, sf):
    return M.page(as_logs(spark, sf).select("event_id", "timestamp"), [F.desc("timestamp"), F.desc("event_id")], 50, 100)


def a08_histogram(spark, sf):
    return logs.histogram(events(spark, sf), (5.0, 10.0, 50.0, 100.0, 200.0), "event_type")


def a08_percentiles(spark, sf):
    return logs.percentiles(events(spark, sf), "event_type", (0.5, 0.95, 0.99))


def a09_activity(spark, sf):
    return logs.activity(events(spark, sf), F.col("event_type") != "error", cached=F.when(F.col("event_type") == "view", F.col("value") < 50))


def a09_error_types(spark, sf):
    return logs.error_types(events(spark, sf), F.col("value") < 50, F.when(F.col("event_type") != "click", F.col("event_type")))


def a10_ema_slow(spark, sf):
    """An average whose weights reach far back."""
    return logs.ema(events(spark, sf), "event_type", ("ts", "event_id"), alpha=0.01)


def t03_page_of(spark, sf):
    return M.page_of(as_logs(spark, sf).select("event_id", "timestamp"), [F.desc("timestamp"), F.desc("event_id")], 50, 100)


def k14_cache_stats(spark, sf):
    from ..operators import chunking as K

    d = table(spark, sf, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("file_hash"), "source", F.length("text").alias("file_size"), "created_at").groupBy("file_hash").agg(F.min("file_size").alias("file_size"), F.min("created_at").alias("created_at"))
    cache = d.where("file_size > 500").select("file_hash", (F.col("file_size") % 2).alias("schema_version"), "created_at", "file_size")
    return K.cache_stats(cache, d, 1, 365, F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"))


def m03_update_projects(spark, sf):
    p = table(spark, sf, "projects")
    changes = p.where("description IS NULL").select("id", F.lit("described").alias("description"))
    return M.update(p, changes, F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")).select("id", "description", "updated_at")


def m03_delete_projects(spark, sf):
    """What is left of projects and repositories without the projects that have no description."""
    p, r = table(spark, sf, "projects"), table(spark, sf, "repositories")
    links = r.select(F.col("id").alias("source_id"), F.col("project_id").alias("target_id")).where("target_id IS NOT NULL")
    left = M.delete_project(p.where("description IS NULL"), p, r, links)
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in zip(("projects", "repositories", "links"), left, strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def m02_update_context(spark, sf):
    """Contexts that are valid are taken over, others aren't."""
    p = table(spark, sf, "projects")
    new = p.select("id", F.when(F.length("id") % 2 == 0, F.lit('{"description": "d", "domain_hints": ["x"]}')).otherwise(F.lit('{"description": 5}')).alias("context"))
    return M.update_context(p, new, F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")).select("id", "context", "updated_at")


def a09_top_endpoints(spark, sf):
    return logs.top(events(spark, sf), "user_id", 10)


def a10_ema(spark, sf):
    return logs.ema(events(spark, sf), "event_type", ("ts", "event_id"))


def a13_log_stats(spark, sf):
    return logs.log_stats(as_logs(spark, sf))


def a14_prefix_totals(spark, sf):
    e = as_logs(spark, sf).where(F.col("module").startswith("api.p"))
    return e.groupBy("module").agg(F.count("*").alias("n"))


def a15_data_hash(spark, sf):
    counts = events(spark, sf).groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    return logs.data_hash(counts)


def a16_progress(spark, sf):
    f = table(spark, sf, "files").where("run_id IS NOT NULL").select(F.col("run_id").alias("ingestion_id"), F.col("id").alias("file"), F.when(F.col("status") == "processed", "complete").otherwise(F.coalesce("status", F.lit("pending"))).alias("state"), F.col("created_at").alias("at")).distinct()
    return logs.progress(f)


def a17_ir_metrics(spark, sf):
    from . import search_queries as Q

    ranked = Q.v03_dense_many(spark, sf)
    p = Q.points(spark, sf)
    relevant = p.where("id % 100 = 0").select(F.col("id").alias("query_id"), "label").join(p.select("id", "label"), "label").select("query_id", "id")
    return logs.retrieval_quality(ranked, relevant, 5)


def a18_answer_metrics(spark, sf):
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    a = d.select(F.col("doc_id").alias("id"), F.col("text").alias("answer"), F.array(F.lit("trade_feed"), F.lit("isin")).alias("entities"), F.array(F.lit("audit"), F.lit("weekend"), F.lit("Mapping")).alias("concepts"), F.array(F.lit("raw_market.price_tick")).alias("files"), F.array(F.lit("select * from counterparty join portfolio")).alias("contexts"))
    return logs.answer_quality(a)


def sk14_prometheus(spark, sf):
    s = events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"))
    return logs.prometheus(s.select(F.lit("events_total").alias("name"), F.lit("counter").alias("kind"), F.lit("Events").alias("help"), F.create_map(F.lit("type"), F.col("event_type")).alias("labels"), F.col("n").alias("value")))


def sk06_graph_snapshot(spark, sf):
    from ..operators import graph as G

    return T.graph_snapshot(*G.from_foreign_keys(spark, sf), "post")


def sk11_statement_texts(spark, sf):
    d = table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return T.statement_texts(d).groupBy("id").agg(F.count("*").alias("statements"))


# --- streaming (batch twins) ----------------------------------------------------------------------


def st04_debounce(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("stream"), F.col("event_type").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    d = ST.debounce(e, "2 hours")
    return d.select("key", F.col("batch_start").cast("timestamp_ntz").alias("batch_start"), F.array_join("paths", ",").alias("paths"))


def st04_capped_batches(spark, sf):
    e = events(spark, sf).select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("path"), "ts")
    return ST.capped_batches(e, 5, 3600.0).groupBy("key", "batch").agg(F.count("*").alias("n"))


def st07_session_states(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("ingestion_id"), F.col("event_type").alias("file"), F.col("value").alias("state"), F.struct("ts", "event_id").alias("at"))
    return ST.session_states(e)


def st11_breaker(spark, sf):
    c = events(spark, sf).select(F.col("event_type").alias("service"), F.col("ts").alias("at"), (F.col("value") > 50).alias("limited"))
    return ST.replay_breaker(c).groupBy("service", "state").agg(F.count("*").alias("n"))


def st12_rate_limit(spark, sf):
    e = events(spark, sf).select("user_id", F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    return ST.rate_limited(e, {"purchase": 1, "error": 2}, 3, "1 day").select("key", "kind", F.col("start").cast("timestamp_ntz").alias("start"), "n", "allowed", "refused")


def st13_tumbling(spark, sf):
    e = events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return ST.tumbling(e, "1 day", "1 hour", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


# --- SQL surface, archives ------------------------------------------------------------------------

#: The same text runs on Spark and in the comparison.
SQL = {
    "sql_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "sql_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "sql_grouping_sets": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    "sql_having": "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "sql_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "sql_except": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45",
    "sql_union": "SELECT c_name AS name FROM customer UNION SELECT s_name FROM supplier",
    "sql_recursive": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n, n * n AS sq FROM t",
    "sql_window": "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS r, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders",
    "sql_exists": "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_discount > 0.09) AND s_acctbal > (SELECT avg(s_acctbal) FROM supplier)",
    "sql_range_join": "SELECT p_partkey, b.band FROM part JOIN (VALUES (0, 1000, 'low'), (1000, 1500, 'mid'), (1500, 100000, 'high')) AS b(lo, hi, band) ON p_retailprice >= b.lo AND p_retailprice < b.hi",
    "sql_lateral": "SELECT n.n_nationkey, c.best FROM nation n, LATERAL (SELECT max(c_acctbal) AS best FROM customer WHERE c_nationkey = n.n_nationkey) c",
    "sql_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus",
    "sql_join_aggregate": "SELECT n_name, o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, o_orderpriority",
    "sql_left_join_distinct": "SELECT c_nationkey, count(DISTINCT o_orderkey) AS orders, count(DISTINCT c_custkey) AS customers FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey",
}
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _sql(name: str):
    def run(spark, sf):
        used = {t: table(spark, sf, t) for t in _TABLES if t in SQL[name]}
        return sqlapi.query(spark, SQL[name], used)

    run.__name__ = name
    return run


def sql_asof(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("entity"), F.col("o_orderdate").alias("at"))
    h = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").cast("string").alias("entity"), F.col("l_shipdate").cast("timestamp_ntz").alias("valid_from")).agg(F.max("l_partkey").alias("value"))
    return asof.match(o, "entity", "at", {"part": h}, asof.DAY * 365).select("o_orderkey", "part")


def sql_pivot(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)


def x01_snapshot_query(spark, sf):
    base = store.fresh_path(spark, "snapshots")
    T.create_snapshot(spark, {t: table(spark, sf, t) for t in (*_TABLES, "events", "projects", "repositories", "runs", "files")}, base, "20260101_000000")
    return sqlapi.query(spark, "SELECT r_name, count(DISTINCT c_custkey) AS n, count(*) AS orders FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name", T.load_snapshot(spark, base, T.snapshots(spark, base)[0]))


def x02_archives_union(spark, sf):
    base = store.fresh_path(spark, "archives")
    o = table(spark, sf, "orders")
    T.export_archive({"orders": o.where("o_orderstatus = 'F'")}, base, "2026-01")
    T.export_archive({"orders": o.where("o_orderstatus <> 'F'")}, base, "2026-02")
    return T.read_archive(spark, base, "orders", None, "o_totalprice > 100000").select("o_orderkey", "o_orderstatus")


_F = "f AS (SELECT DISTINCT * FROM files)"
_L = "lg AS (SELECT event_id, ts AS timestamp, CASE WHEN user_id % 2 = 0 THEN 'app' ELSE 'audit' END AS category, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'DEBUG' WHEN 'purchase' THEN 'WARNING' ELSE 'INFO' END AS level, event_type || ' of user ' || user_id AS message, CASE WHEN user_id % 3 > 0 THEN 'api.' || event_type END AS module FROM events)"
_SQLW = "'select','from','where','join','left','right','inner','outer','group','order','having','limit','offset','and','or','not','null','true','false','case','when','then','else','end','with','as','on','using','into','values'"

ORACLES = {
    "m01_project_counts": f"WITH {_F} SELECT p.id, p.name, (SELECT count(*) FROM repositories r WHERE r.project_id = p.id) AS repositories, (SELECT count(*) FROM (SELECT DISTINCT id, project_id FROM f) g WHERE g.project_id = p.id) AS files FROM projects p",
    "m02_context_errors": "SELECT id, CASE WHEN json_valid(context) THEN 0 ELSE 1 END AS errors FROM projects WHERE context IS NOT NULL",
    "m03_latest_version": f"WITH {_F} SELECT project_id, relative_path, id, created_at FROM f WHERE relative_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_id, relative_path ORDER BY created_at DESC, id DESC) = 1",
    "m04_links_of": "SELECT id AS source_id, project_id AS target_id FROM repositories WHERE id = 'default' OR project_id = 'default'",
    "m05_bad_links": "SELECT project_id, min(id) AS source_id, min(id) AS target_id FROM repositories WHERE project_id IS NOT NULL GROUP BY 1",
    "m06_link_detect": "WITH n AS (SELECT DISTINCT source AS r, unnest(regexp_extract_all(text, '[a-z]+_[a-z]+\\.[a-z]+_[a-z]+')) AS name FROM documents WHERE source IS NOT NULL), z AS (SELECT r, count(*) AS n FROM n GROUP BY 1), p AS (SELECT a.r AS ra, b.r AS rb, count(*) AS shared FROM n a JOIN n b ON a.name = b.name AND a.r < b.r GROUP BY ALL) SELECT ra AS repo_a, rb AS repo_b, shared, round(shared / least(x.n, y.n), 6) AS confidence FROM p JOIN z x ON x.r = ra JOIN z y ON y.r = rb",
    "m07_register_status": f"WITH {_F} SELECT id, CASE WHEN row_number() OVER (PARTITION BY project_id, file_hash ORDER BY created_at, id) > 1 THEN 'duplicate' WHEN row_number() OVER (PARTITION BY project_id, relative_path ORDER BY created_at, id) > 1 THEN 'new_version' ELSE 'new_file' END AS registration FROM (SELECT DISTINCT id, project_id, relative_path, file_hash, created_at FROM f WHERE relative_path IS NOT NULL AND file_hash IS NOT NULL)",
    "m08_run_results": "WITH g AS (SELECT run_id, count(*) FILTER (WHERE status = 'error') AS n FROM (SELECT DISTINCT id, run_id, status FROM files WHERE run_id IS NOT NULL) GROUP BY 1) SELECT run_id, CASE WHEN n = 0 THEN 'completed' ELSE 'completed_with_errors' END AS status, CASE WHEN n > 0 THEN n || ' files failed' END AS error_message FROM g",
    "m08_next_sequence": "SELECT coalesce(max(sequence), 0) + 1 AS sequence FROM runs WHERE (project_id, timestamp) = (SELECT (project_id, timestamp) FROM runs WHERE project_id IS NOT NULL AND timestamp IS NOT NULL ORDER BY created_at, id LIMIT 1)",
    "m09_set_status": "SELECT CASE WHEN status = 'pending' THEN 'error' ELSE status END AS status, count(*) AS n, count(CASE WHEN status = 'pending' THEN TIMESTAMP '2026-01-01' ELSE processed_at END) AS stamped FROM (SELECT DISTINCT id, status, processed_at FROM files) GROUP BY 1",
    "m10_recent_files": "SELECT id, created_at FROM (SELECT DISTINCT id, created_at FROM files) ORDER BY created_at DESC, id LIMIT 20 OFFSET 10",
    "m11_chat_artifacts": "WITH n AS (SELECT user_id, event_type, max_by(value, event_id) AS value FROM events WHERE value >= 50 GROUP BY ALL), o AS (SELECT user_id, event_type, max_by(value, event_id) AS value FROM events WHERE value < 50 GROUP BY ALL) SELECT * FROM n UNION ALL SELECT * FROM o WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM n)",
    "m12_extensions": "SELECT n_nationkey, '.sql,.py,.json,.x' || n_nationkey AS ext FROM nation",
    "m13_first_models": "SELECT c_mktsegment AS usage_type, min_by(c_name, ROW(c_nationkey, c_name)) AS model_id, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1",
    "f01_file_filter": "SELECT DISTINCT id FROM files WHERE source = 'upload' AND NOT coalesce(is_superseded, false) AND coalesce(status, CASE WHEN processed_at IS NOT NULL THEN 'processed' ELSE 'pending' END) = 'processed'",
    "f02_derived": "SELECT DISTINCT id, coalesce(status, CASE WHEN processed_at IS NOT NULL THEN 'processed' ELSE 'pending' END) AS status, coalesce(file_type, nullif(lower(regexp_extract(filename, '\\.([^.]+)$', 1)), ''), 'unknown') AS type FROM files",
    "f04_file_search": "SELECT DISTINCT id FROM files WHERE contains(lower(filename), 'rates_1') OR contains(lower(relative_path), 'rates_1')",
    "f06_null_safe": "WITH g AS (SELECT repository_id, file_hash, min(id) AS first FROM files GROUP BY ALL) SELECT DISTINCT id, first FROM files f JOIN g ON f.repository_id IS NOT DISTINCT FROM g.repository_id AND f.file_hash IS NOT DISTINCT FROM g.file_hash WHERE id <> first",
    "a03_file_stats": "SELECT count(*) AS total, count(*) FILTER (WHERE s = 'processed') AS processed, count(*) FILTER (WHERE s = 'error') AS failed, count(*) FILTER (WHERE s = 'pending') AS pending, count(*) FILTER (WHERE s = 'skipped') AS skipped FROM (SELECT DISTINCT id, coalesce(status, CASE WHEN processed_at IS NOT NULL THEN 'processed' ELSE 'pending' END) AS s FROM files)",
    "w04_version_history": "SELECT id, row_number() OVER (PARTITION BY project_id, relative_path ORDER BY created_at DESC, id DESC) AS version FROM (SELECT DISTINCT id, project_id, relative_path, created_at FROM files WHERE relative_path IS NOT NULL)",
    "f09_log_query": f"WITH {_L} SELECT event_id FROM lg WHERE (category <> 'app' OR level IN ('WARNING', 'ERROR', 'CRITICAL')) AND timestamp BETWEEN '2024-01-05' AND '2024-01-20' AND (module IS NULL OR module LIKE 'api.p%') AND contains(lower(message), 'user 1')",
    "t03_paging": f"WITH {_L} SELECT event_id, timestamp FROM lg ORDER BY timestamp DESC, event_id DESC LIMIT 50 OFFSET 100",
    "a08_histogram": "SELECT event_type, b.bucket, count(*) FILTER (WHERE value <= b.le) AS n FROM events, (VALUES ('5.0', 5.0), ('10.0', 10.0), ('50.0', 50.0), ('100.0', 100.0), ('200.0', 200.0), ('+Inf', CAST('infinity' AS DOUBLE))) b(bucket, le) WHERE value IS NOT NULL GROUP BY ALL",
    "a08_percentiles": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, " + ", ".join(f"list_sort(list(value))[CAST(floor(count(*) * {q}) AS INT) + 1] AS p{round(q * 100)}" for q in (0.5, 0.95, 0.99)) + " FROM events WHERE value IS NOT NULL GROUP BY 1",
    "a09_activity": "SELECT count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS ok, round(avg(CAST(event_type <> 'error' AS DOUBLE)), 6) AS success_rate, round(avg(value), 2) AS avg_latency, round(avg(CASE WHEN event_type = 'view' THEN CAST(value < 50 AS DOUBLE) END), 6) AS cache_hit_rate FROM events",
    "a09_error_types": "WITH b AS (SELECT CASE WHEN event_type <> 'click' THEN event_type ELSE 'unknown' END AS error_type, value FROM events WHERE value >= 50) SELECT error_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM b), 6) AS share, round(avg(value), 2) AS avg_latency FROM b GROUP BY 1",
    "t03_page_of": f"WITH {_L} SELECT event_id, timestamp, (SELECT count(*) FROM lg) AS total, (SELECT count(*) FROM lg) > 150 AS has_more FROM lg ORDER BY timestamp DESC, event_id DESC LIMIT 50 OFFSET 100",
    "k14_cache_stats": "WITH d AS (SELECT sha256(text) AS h, any_value(length(text)) AS size, min(created_at) AS lo, max(created_at) AS hi FROM documents WHERE text IS NOT NULL GROUP BY 1), c AS (SELECT *, size % 2 = 1 AND lo >= TIMESTAMP '2026-01-01' - INTERVAL 365 DAYS AS fresh FROM d WHERE size > 500) SELECT count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (WHERE NOT fresh) AS expired, count(*) FILTER (WHERE fresh) AS hits, (SELECT count(*) FROM d) - count(*) FILTER (WHERE fresh) AS misses, round(count(*) FILTER (WHERE fresh) / (SELECT count(*) FROM d), 6) AS hit_rate FROM c",
    "m03_update_projects": "SELECT id, coalesce(description, 'described') AS description, CASE WHEN description IS NULL THEN TIMESTAMP '2026-01-01' ELSE updated_at END AS updated_at FROM projects",
    "m03_delete_projects": "WITH g AS (SELECT id FROM projects WHERE description IS NULL), r AS (SELECT * FROM repositories WHERE coalesce(project_id, '') NOT IN (SELECT id FROM g)) SELECT 'projects' AS table_name, count(*) AS n FROM projects WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'repositories', count(*) FROM r UNION ALL SELECT 'links', count(*) FROM r WHERE project_id IS NOT NULL",
    "m02_update_context": "SELECT id, CASE WHEN length(id) % 2 = 0 THEN '{\"description\": \"d\", \"domain_hints\": [\"x\"]}' ELSE context END AS context, CASE WHEN length(id) % 2 = 0 THEN TIMESTAMP '2026-01-01' ELSE updated_at END AS updated_at FROM projects",
    "a09_top_endpoints": "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10",
    "a10_ema": "SELECT event_type, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, v: CASE WHEN a = 0 THEN v ELSE 0.3 * v + 0.7 * a END), 6) AS ema FROM events WHERE value IS NOT NULL GROUP BY 1",
    "a10_ema_slow": "SELECT event_type, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, v: CASE WHEN a = 0 THEN v ELSE 0.01 * v + 0.99 * a END), 6) AS ema FROM events WHERE value IS NOT NULL GROUP BY 1",
    "a13_log_stats": f"WITH {_L} SELECT category, count(*) AS total, count(*) FILTER (WHERE level IN ('ERROR', 'CRITICAL')) AS errors, min(timestamp) AS oldest, max(timestamp) AS newest FROM lg GROUP BY 1",
    "a14_prefix_totals": f"WITH {_L} SELECT module, count(*) AS n FROM lg WHERE module LIKE 'api.p%' GROUP BY 1",
    "a15_data_hash": "SELECT md5('{' || string_agg('\"' || event_type || '\":' || n, ',' ORDER BY event_type) || '}') AS hash FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)",
    "a16_progress": "WITH s AS (SELECT run_id AS ingestion_id, count(*) AS files, count(*) FILTER (WHERE status IN ('processed', 'error', 'skipped')) AS done, count(*) FILTER (WHERE status = 'error') AS errors FROM (SELECT DISTINCT id, run_id, status FROM files WHERE run_id IS NOT NULL) GROUP BY 1) SELECT *, CAST(round(100 * done / files) AS INT) AS percentage, CASE WHEN done < files THEN 'running' WHEN errors = files THEN 'failed' WHEN errors > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM s",
    "a17_ir_metrics": "WITH r AS (SELECT q.vec_id AS query_id, e.label = q.label AS hit, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0), t AS (SELECT q.vec_id AS query_id, count(*) AS n FROM embeddings q JOIN embeddings e USING (label) WHERE q.vec_id % 100 = 0 GROUP BY 1) SELECT query_id, round(count(*) FILTER (WHERE hit) / 5, 6) AS precision, round(count(*) FILTER (WHERE hit) / any_value(n), 6) AS recall, round(coalesce(1 / min(rank) FILTER (WHERE hit), 0), 6) AS rr, round(coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE hit), 0) / list_sum(list_transform(range(1, CAST(least(any_value(n), 5) AS INT) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM r JOIN t USING (query_id) WHERE rank <= 5 GROUP BY query_id",
    "a18_answer_metrics": f"WITH d AS (SELECT doc_id AS id, lower(text) AS a, text, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_matches(x, '^[a-z_]{{3,}}$'))) AS w FROM documents WHERE text IS NOT NULL) SELECT id, round(0.3 * (CAST(contains(a, 'trade_feed') AS INT) + CAST(contains(a, 'isin') AS INT)) + 0.4 * (CAST(contains(a, 'audit') AS INT) + CAST(contains(a, 'weekend') AS INT) + CAST(contains(a, 'mapping') AS INT)) / 3, 6) AS accuracy, CAST(contains(text, '```') OR contains(text, 'raw_market.price_tick') AS DOUBLE) AS citation, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: length(x) > 3 AND x NOT IN ('trade_feed', 'isin', 'counterparty', 'portfolio', {_SQLW}))) / len(w) ELSE 0 END, 6) AS hallucination, (CAST(contains(a, 'trade_feed') AS INT) + CAST(contains(a, 'isin') AS INT)) / 2 AS completeness FROM d",
    "sk14_prometheus": "SELECT '# HELP events_total Events' AS line UNION ALL SELECT '# TYPE events_total counter' UNION ALL SELECT 'events_total{type=\"' || event_type || '\"} ' || count(*) FROM events GROUP BY event_type",
    "sk11_statement_texts": "SELECT doc_id AS id, len(list_filter(string_split(text, ';'), lambda s: regexp_matches(s, '[^ \\t\\n\\v\\f\\r]'))) AS statements FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[^; \\t\\n\\v\\f\\r]')",
    "st04_debounce": "WITH g AS (SELECT user_id, event_type, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 2 HOURS THEN 1 ELSE 0 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id AS key, min(ts) AS batch_start, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS paths FROM s GROUP BY user_id, k",
    "st04_capped_batches": "WITH g AS (SELECT event_type AS key, CAST(user_id AS VARCHAR) AS path, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 1 HOUR THEN 1 ELSE 0 END AS brk FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, CAST(user_id AS VARCHAR))), s AS (SELECT *, sum(brk) OVER (PARTITION BY key ORDER BY ts, path ROWS UNBOUNDED PRECEDING) AS k FROM g), f AS (SELECT key, k, path, min(ts) AS t FROM s GROUP BY ALL), b AS (SELECT key, k, (row_number() OVER (PARTITION BY key, k ORDER BY t, path) - 1) // 5 AS j FROM f) SELECT key, CAST(k AS BIGINT) || '-' || j AS batch, count(*) AS n FROM b GROUP BY ALL",
    "st07_session_states": "SELECT user_id AS ingestion_id, event_type AS file, max_by(value, ROW(ts, event_id)) AS state FROM events GROUP BY ALL",
    "st12_rate_limit": "WITH g AS (SELECT user_id AS key, event_type AS kind, date_trunc('day', ts) AS start, count(*) AS n, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 ELSE 3 END AS l FROM events GROUP BY ALL) SELECT key, kind, CAST(start AS TIMESTAMP) AS start, n, least(n, l) AS allowed, greatest(n - l, 0) AS refused FROM g",
    "st13_tumbling": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "sql_asof": "WITH h AS (SELECT o_custkey, l_shipdate, max(l_partkey) AS part FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) SELECT o_orderkey, part FROM orders o ASOF LEFT JOIN h ON o.o_custkey = h.o_custkey AND o.o_orderdate >= h.l_shipdate",
    "sql_pivot": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1",
    "x01_snapshot_query": "SELECT r_name, count(DISTINCT c_custkey) AS n, count(*) AS orders FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name",
    "x02_archives_union": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 100000",
    # with one failure a circuit opens at the first limited call more than the cooldown after it opened last
    "st11_breaker": """
WITH RECURSIVE c AS (SELECT event_type AS service, ts AS seen, value > 50 AS refused FROM events),
o(service, since) AS (
  SELECT service, min(seen) FROM c WHERE refused GROUP BY 1
  UNION ALL
  SELECT * FROM (SELECT o.service, (SELECT min(c.seen) FROM c WHERE c.service = o.service AND c.refused AND c.seen > o.since + INTERVAL 60 SECOND) AS since FROM o) WHERE since IS NOT NULL),
s AS (SELECT c.*, o.since FROM c ASOF LEFT JOIN o ON c.service = o.service AND c.seen >= o.since)
SELECT service, CASE WHEN since IS NOT NULL AND seen <= since + INTERVAL 60 SECOND AND (refused OR seen > since) THEN 'open' ELSE 'closed' END AS state, count(*) AS n FROM s GROUP BY ALL""",
    "sk06_graph_snapshot": """
WITH l AS (SELECT 'Customer' AS k, count(*) AS n FROM customer UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Region', count(*) FROM region UNION ALL SELECT 'Supplier', count(*) FROM supplier),
t AS (SELECT 'CONTAINS' AS k, (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n UNION ALL SELECT 'DERIVES', count(*) FROM orders UNION ALL SELECT 'READS_FROM', count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem))
SELECT '{"phase":"post","node_count":' || (SELECT sum(n) FROM l) || ',"edge_count":' || (SELECT sum(n) FROM t) || ',"node_label_counts":{' || (SELECT string_agg('"' || k || '":' || n, ',' ORDER BY k) FROM l) || '},"relationship_type_counts":{' || (SELECT string_agg('"' || k || '":' || n, ',' ORDER BY k) FROM t) || '}}' AS metadata""",
    **SQL,
}
QUERIES = {n: (_sql(n) if n in SQL else globals()[n]) for n in ORACLES}
