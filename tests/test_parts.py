"""Operators that no registered query reaches, and ways that only large tables take."""

import json
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from loomline import store
from loomline.operators import chunking as K
from loomline.operators import graph as G
from loomline.operators import logs as L
from loomline.operators import metadata as M
from loomline.operators import parsing as P
from loomline.operators import search as V
from loomline.operators import sqlapi
from loomline.sources import tables as T
from loomline.streaming import files as ST

AT = datetime(2024, 1, 1)
EDGES = "source_id string, target_id string, type string"


def large(monkeypatch):
    """As if no table were small."""
    monkeypatch.setattr(store, "is_small", lambda *a, **k: False)


def test_small_tables_are_measured_in_rows_and_bytes(spark):
    df = spark.createDataFrame([("x" * 1000, [1, 2, 3], i) for i in range(100)], "s string, a array<bigint>, i bigint")
    assert store.is_small(df) and not store.is_small(df, rows=99) and not store.is_small(df, size=100_000) and store.is_small(df.select("i"), size=10_000)


def test_a_cluster_needs_a_shared_folder(spark):
    class Other:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        store.shared_dir(Other)


def test_running_sums_either_way(spark, monkeypatch):
    data = [(g, i, (i * 7) % 5) for g in ("a", "b", None) for i in range(40)]
    df = spark.createDataFrame(data, "g string, i int, v bigint")
    want = rows(store.running(df, ["g"], [F.desc("i")], F.col("v"), "r"))
    every = rows(store.running(df.where("g = 'a'"), [], [F.col("i")], F.lit(1), "r"))
    large(monkeypatch)
    assert rows(store.running(df, ["g"], [F.desc("i")], F.col("v"), "r")) == want
    assert rows(store.running(df.where("g = 'a'"), [], [F.col("i")], F.lit(1), "r")) == every and sorted(r[-1] for r in every) == list(range(1, 41))


def fold(values, alpha):
    a = 0.0
    for v in values:
        a = v if a == 0 else alpha * v + (1 - alpha) * a
    return round(a, 6)


@pytest.mark.parametrize("alpha", [0.01, 0.3, 1.0])
def test_ema_reaches_all_the_way_back(spark, alpha):
    series = {"a": [0.0, 0.0, 1000.0] + [1.0] * 400, "b": [5.0], "c": [0.0, 0.0], "d": [float(i % 13) for i in range(300)]}
    df = spark.createDataFrame([(k, i, v) for k, vs in series.items() for i, v in enumerate([*vs, None])], "k string, i int, value double")
    assert dict(rows(L.ema(df, "k", ("i",), alpha=alpha))) == pytest.approx({k: fold(v, alpha) for k, v in series.items()})


def test_percentiles_of_many_values(spark, monkeypatch):
    df = spark.createDataFrame([("a", float((i * 37) % 101)) for i in range(300)] + [("b", 2.0)], "g string, value double")
    want = rows(L.percentiles(df, "g", (0.5, 0.99)))
    large(monkeypatch)
    assert rows(L.percentiles(df, "g", (0.5, 0.99))) == want


def test_sql_rows_are_all_counted(spark):
    df = spark.range(12_345)
    assert sqlapi.rows(df)["row_count"] == 12_345 and not sqlapi.rows(df)["truncated"]
    some = sqlapi.rows(df, limit=10)
    assert (len(some["rows"]), some["row_count"], some["truncated"]) == (10, 12_345, True)


def chain(spark, n):
    return spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}", "CALLS") for i in range(n)], EDGES)


def test_a_path_of_twenty_hops(spark):
    got = G.shortest_path(chain(spark, 20), "n00", "n20").first()
    assert got["hops"] == 20 and got["path"][0] == "n00" and got["path"][-1] == "n20"


def test_lineage_rows_and_edge_store(spark, tmp_path):
    e = spark.createDataFrame([("a", "b", "READS"), ("b", "c", "READS"), ("c", "a", "READS"), ("b", "d", "CALLS"), ("a", "b", "CALLS"), ("x", "y", "READS")], EDGES)
    n = spark.createDataFrame([(i, "p" if i in "cd" else "q", "r1" if i == "d" else "r2") for i in "abcdxy"], "id string, project_id string, repository_id string")
    seed = spark.createDataFrame([("a",)], "id string")
    want = [("a", "CALLS", "b", 1), ("a", "READS", "b", 1), ("b", "CALLS", "d", 2), ("b", "READS", "c", 2), ("c", "READS", "a", 3)]
    assert rows(G.lineage_rows(e, seed)) == want
    assert rows(G.lineage_rows(e, seed, 1)) == want[:2]
    assert rows(G.lineage_rows(e, seed, 5, nodes=n, project="p")) == want[:4]
    assert rows(G.lineage_rows(e, seed, 5, nodes=n, project="p", repositories=["r1"])) == [*want[:3]]
    assert rows(G.lineage_rows(e, spark.createDataFrame([("d",)], "id string"), 2, reverse=True)) == [("a", "CALLS", "b", 2), ("a", "READS", "b", 2), ("b", "CALLS", "d", 1)]
    kept = G.EdgeStore(spark, f"file://{tmp_path}/e", buckets=8)
    kept.add(e)
    assert rows(G.lineage_rows(kept, seed)) == want and rows(G.reach(kept, seed, 2)) == [("a", 0), ("b", 1), ("c", 2), ("d", 2)]
    assert G.shortest_path(kept, "d", "c").first()["path"] == ["d", "b", "c"] and G.shortest_path(kept, "a", "x").collect() == []


def test_review_notes_and_lost_ends(spark):
    e = spark.createDataFrame([("a", "b", "X", "proposed"), ("a", "c", "X", None)], EDGES + ", status string")
    v = spark.createDataFrame([("a", "b", "X", "approve", "fine")], EDGES + ", verdict string, notes string")
    got = {r["target_id"]: r for r in G.review(e, v, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got["b"]["status"] == "approved" and got["b"]["reviewer_notes"] == "fine" and got["b"]["reviewed_at"] is not None and got["c"]["reviewed_at"] is None
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [r["target_id"] for r in G.without_ends(e, nodes).collect()] == ["c"]


# --- retrieval ---


def vectors(spark, n, size=8):
    import random

    rnd = random.Random(7)
    return spark.createDataFrame([(i, [rnd.gauss(3 * (i % 5 == k % 5), 1) for k in range(size)]) for i in range(n)], "id bigint, vector array<double>")


def test_many_queries_tile_by_tile(spark, monkeypatch):
    p = vectors(spark, 300)
    q = p.where("id % 10 = 0").select(F.col("id").alias("query_id"), "vector")
    want = rows(V.dense_many(p, q, 4))
    large(monkeypatch)
    monkeypatch.setattr(V, "POINT_TILE", 70)
    monkeypatch.setattr(V, "QUERY_BLOCK", 8)
    assert rows(V.dense_many(p, q, 4)) == want and len(want) == 120
    assert V.dense_many(p, q.limit(0), 4).collect() == []


def test_index_recall(spark, tmp_path):
    p = vectors(spark, 600)
    index = V.VectorIndex(spark, f"file://{tmp_path}/v", cells=8, probes=4)
    index.fit(p)
    index.add(p.where("id < 400"))
    index.add(p.where("id >= 400"))
    q = p.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    exact = {(r["query_id"], r["id"]) for r in V.dense_many(p, q, 10).collect()}
    found = {(r["query_id"], r["id"]) for r in index.search(q, 10).collect()}
    assert len(exact & found) >= 0.9 * len(exact) and len(found) == len(exact)


def test_collections_and_memory(spark):
    c = spark.createDataFrame([("code", 64, "cosine")], "name string, size int, distance string")
    assert V.create_collection(c, "code", 64).count() == 1 and V.create_collection(c, "docs", 8).count() == 2
    with pytest.raises(ValueError):
        V.create_collection(c, "code", 8)
    turns = spark.createDataFrame([("1", "s", "user", "old", "t", [1.0])], "id string, session_id string, role string, content string, timestamp string, vector array<double>")
    said = spark.createDataFrame([("1", "user", "new", "t", [1.0]), ("2", "assistant", "yes", "t", [1.0])], "id string, role string, content string, timestamp string, vector array<double>")
    both = V.remember(turns, "s", said)
    assert sorted(r["content"] for r in both.collect()) == ["new", "yes"] and V.forget(both, "s").count() == 0


def test_points_by_id(spark):
    p = spark.createDataFrame([(7, "a"), (8, "b")], "id bigint, text string")
    assert V.point_by_id(p, "7").first()["text"] == "a" and V.point_by_id(p, 8).first()["text"] == "b" and V.point_by_id(p, "x").collect() == []
    assert V.point_by_id(p.select(F.col("id").cast("string").alias("id")), 7).count() == 1


def test_evidence_of_nodes(spark):
    n = spark.createDataFrame([("i", "Table", "dw.x"), ("j", None, None)], "id string, label string, name string")
    got = {r["note"]: r for r in V.node_evidence(n, "p").collect()}
    assert got["Graph node dw.x"]["block"] == "[urn:li:neo4j-node:p:Table/dw.x]\nNode: dw.x (Table)" and "Graph node j" in got


# --- metadata ---


def test_links_of_copies_and_common_names(spark, monkeypatch):
    refs = [(r, n) for r in ("a", "b", "c") for n in ("x", "Y")] + [("d", "x"), ("d", "z"), ("e", "z"), (None, "x"), ("f", None)]
    df = spark.createDataFrame(refs, "repository_id string, name string")
    want = [("a", "b", 2, 1.0), ("a", "c", 2, 1.0), ("a", "d", 1, 0.5), ("d", "e", 1, 1.0)]
    assert rows(M.detect_links(df)) == want
    assert rows(M.detect_links(df, least=2)) == want[:2]
    assert rows(M.common_names(df, 1)) == [("x", 4, 2), ("z", 2, 2)]
    monkeypatch.setattr(M, "COMMON", 1)  # all names of two classes are common: only copies are left as pairs
    assert rows(M.detect_links(df)) == want[:2]


def test_create_update_delete(spark):
    p = spark.createDataFrame([("p1", "one", AT, AT), ("p2", "two", AT, AT)], "id string, name string, created_at timestamp, updated_at timestamp")
    now = F.lit("2025-01-01").cast("timestamp")
    more = M.create(p, spark.createDataFrame([("p2", "no"), ("p3", "three"), ("p3", "three")], "id string, name string"), now)
    assert {(r["id"], r["name"], r["created_at"].year) for r in more.collect()} == {("p1", "one", 2024), ("p2", "two", 2024), ("p3", "three", 2025)}
    changed = M.update(p, spark.createDataFrame([("p1", "uno"), ("p2", None), ("p9", "x")], "id string, name string"), now)
    assert {(r["id"], r["name"], r["updated_at"].year) for r in changed.collect()} == {("p1", "uno", 2025), ("p2", "two", 2025)}
    repos = spark.createDataFrame([("r1", "p1"), ("r2", "p2")], "id string, project_id string")
    links = spark.createDataFrame([("r1", "r2"), ("r2", "p2"), ("p1", "p2")], "source_id string, target_id string")
    left = M.delete_project(spark.createDataFrame([("p1",)], "id string"), p, repos, links)
    assert [rows(d.select(d.columns[0])) for d in left] == [[("p2",)], [("r2",)], [("r2",)]]
    old = spark.createDataFrame([(1, AT), (2, AT + timedelta(days=40))], "i int, created_at timestamp")
    assert [r["i"] for r in M.expire(old, 30, now=F.lit("2024-02-15").cast("timestamp")).collect()] == [2]


def test_pages_tell_what_is_left(spark):
    df = spark.range(25)
    assert [(r["id"], r["total"], r["has_more"]) for r in M.page_of(df, [F.col("id")], 2, 22).collect()] == [(22, 25, True), (23, 25, True)]
    assert [r["has_more"] for r in M.page_of(df, [F.col("id")], 5, 20).collect()] == [False] * 5 and M.page_of(df, [F.col("id")], 5, 30).collect() == []


def test_settings_and_free_models(spark):
    s = spark.createDataFrame([("default", [".sql"], 50, AT, "x")], "id string, allowed_extensions array<string>, max_file_size_mb int, updated_at timestamp, updated_by string")
    got = M.save_settings(s, ["SQL", ".py"], 10, "api", F.lit("2025-01-01").cast("timestamp")).collect()
    assert [(r["allowed_extensions"], r["max_file_size_mb"], r["updated_by"]) for r in got] == [([".sql", ".py"], 10, "api")]
    df = spark.createDataFrame([("m1",), ("paid",), (None,), ("",)], "m string").select("m", M.free_model(F.col("m"), ["m1"], "d").alias("f")).select("m", "f.*")
    assert rows(df) == [("", "d", False), ("m1", "m1", False), ("paid", "d", True), (None, "d", None)] or rows(df) == [("", "d", False), ("m1", "m1", False), ("paid", "d", True), (None, "d", False)]


def test_blobs_and_tag_blocks(spark):
    from loomline.functions import scalar as S
    from loomline.sources import files as SF

    df = spark.createDataFrame([("U0VM\nRUNU\n", "base64"), ("plain", "utf-8"), ("!!", "base64"), (None, "base64")], "content string, encoding string")
    assert [r["content"] for r in SF.decode_blobs(df).collect()] == ["SELECT", "plain", None, None]
    assert "x" in spark.range(1).select(S.tag_block("note", F.lit("x"))).first()[0]


# --- code ---


def test_whole_chunk_records(spark):
    wide = "aaaaaaaaaa + " * 250
    sql = f"SELECT 1;\n\nWITH one AS (SELECT {wide}1 AS x FROM dw.t), two AS (SELECT o.x, {wide}2 AS y\nFROM one o) SELECT * FROM two;"
    py = "import os\nfrom a import b\n\n@d\ndef f(x):\n    return os.x('select * from dw.t')\n"
    df = spark.createDataFrame([("a.sql", sql), ("b.py", py), ("c.txt", "one\ntwo"), ("d.sql", None), ("e.sql", "")], "path string, content string")
    got = {(r["path"], r["chunk_no"]): r for r in K.chunk_records(df).collect()}
    assert [(r["kind"], r["start_line"], r["end_line"], r["dependencies"]) for k, r in sorted(got.items()) if k[0] == "a.sql"] == [("SQL_STATEMENT", 1, 1, []), ("SQL_CTE", 3, 3, []), ("SQL_CTE", 3, 4, ["one"]), ("SQL_STATEMENT", 4, 4, ["two"])]
    assert got["a.sql", 2]["columns"] == ["o.x"] and got["a.sql", 2]["context"] == "-- CTEs defined: one" and got["a.sql", 1]["tables"] == ["dw.t"]
    assert (got["b.py", 0]["kind"], got["b.py", 0]["dependencies"]) == ("PYTHON_IMPORT", ["a", "os"]) and (got["b.py", 1]["functions"], got["b.py", 1]["start_line"], got["b.py", 1]["language"]) == (["f"], 4, "python")
    assert (got["c.txt", 0]["language"], got["c.txt", 0]["end_line"]) == ("txt", 2) and not [k for k in got if k[0] in "d.sql e.sql"]


def test_subqueries_of_an_oversized_statement():
    wide = "aaaaaaaaaa + " * 600
    got = K.cut_statement(f"SELECT * FROM (SELECT x FROM t) a, (SELECT {wide}1) b")
    assert [(k, c) for k, c, *_ in got] == [("SQL_SUBQUERY", "(SELECT x FROM t)")]
    assert [k for k, *_ in K.cut_statement(f"SELECT {wide}1; SELECT 2")] == ["SQL_STATEMENT", "SQL_STATEMENT"]


def test_parse_cache(spark):
    schema = "file_hash string, schema_version int, created_at timestamp, last_accessed timestamp, file_size bigint"
    cache = spark.createDataFrame([(f"h{i}", 1, AT, AT + timedelta(days=i), 10) for i in range(4)], schema)
    new = spark.createDataFrame([("h0", 1, AT, AT + timedelta(days=9), 20), ("n", 1, AT, AT + timedelta(days=8), 20)], schema)
    kept = K.cache_put(cache, new, 3)
    assert sorted(r["file_hash"] for r in kept.collect()) == ["h0", "h3", "n"]
    asked = spark.createDataFrame([("h0",), ("zz",), ("h0",)], "file_hash string")
    assert K.cache_touch(cache, asked, F.lit("2025-01-01").cast("timestamp")).where("year(last_accessed) = 2025").count() == 1
    got = K.cache_stats(cache, asked, 1, 30, F.lit("2024-01-10").cast("timestamp")).first()
    assert (got["entries"], got["bytes"], got["expired"], got["hits"], got["misses"], got["hit_rate"]) == (4, 40, 0, 2, 1, round(2 / 3, 6))


def test_nodes_for_lost_ends(spark):
    e = spark.createDataFrame([("urn:li:Table:p:dw.x", "plain", "X")], EDGES)
    nodes = spark.createDataFrame([("other",)], "id string")
    assert rows(P.fallback_nodes(e, nodes)) == [("plain", "DataAsset", "plain"), ("urn:li:Table:p:dw.x", "Table", "dw.x")]


# --- sinks ---


def read(spark, path, kind="json"):
    return spark.read.format(kind).load(path)


def test_exports(spark, tmp_path):
    base = f"file://{tmp_path}"
    n = spark.createDataFrame([("a", "Table", "dw.a"), ("b", None, "dw.b")], "id string, label string, name string")
    e = spark.createDataFrame([("a", "b", "X")], EDGES)
    T.write_graph_json(n, e, f"{base}/g")
    stats = json.loads(read(spark, f"{base}/g/statistics").first()["metadata"])
    assert read(spark, f"{base}/g/nodes").count() == 2 and stats["node_label_counts"] == {"Table": 1, "UNKNOWN": 1} and stats["edge_count"] == 1
    T.write_points(spark.createDataFrame([(1, [0.5, 1.0])], "id int, vector array<double>"), f"{base}/p")
    assert read(spark, f"{base}/p").first()["vector"] == [0.5, 1.0]
    T.write_chunks(spark.createDataFrame([("s", "TABLE", "c1"), ("s", "VIEW", "c2")], "source string, object_type string, chunk string"), f"{base}/c")
    assert rows(read(spark, f"{base}/c", "parquet").select("source", "object_type", "chunk")) == [("s", "TABLE", "c1"), ("s", "VIEW", "c2")]
    T.dead_letters(e, "boom", f"{base}/d")
    T.dead_letters(e, "boom", f"{base}/d")
    letters = read(spark, f"{base}/d").collect()
    assert len(letters) == 2 and json.loads(letters[0]["item"])["source_id"] == "a"


def test_audit_log_and_its_retention(spark, tmp_path):
    path = f"file://{tmp_path}/audit"
    events = spark.createDataFrame([(AT, "login", "mail a@b.com now"), (AT + timedelta(days=5), "query", "x")], "timestamp timestamp, event_type string, details string")
    T.audit(events, path)
    assert "a@b.com" not in " ".join(r["details"] for r in read(spark, path).collect())
    assert T.expire_audit(spark, path, "2024-01-03") == ["date=2024-01-01"] and read(spark, path).count() == 1


def test_archives_and_what_is_kept(spark, tmp_path):
    df = spark.createDataFrame([(1, AT), (2, AT + timedelta(days=40)), (3, None)], "i int, created_at timestamp")
    old, kept = T.archived_then_kept(df, "2024-02-01")
    assert rows(old.select("i")) == [(1,)] and rows(kept.select("i")) == [(2,), (3,)]
    T.export_archive({"t": old, "none": old.limit(0)}, f"file://{tmp_path}/a", "2024-01")
    assert [(r["month"], r["table"], r["bytes"] > 0) for r in T.archives(spark, f"file://{tmp_path}/a").collect()] == [("2024-01", "t", True)]


def test_ingestion_logs(spark):
    index = spark.createDataFrame([(f"i{k}", "p" if k % 2 else "q", f"2024-01-0{k}") for k in range(1, 8)], "ingestion_id string, project_id string, started_at string")
    got, n = T.ingestion_logs(index, 2, project_id="p")
    assert [r["ingestion_id"] for r in got.collect()] == ["i7", "i5"] and n == 4


# --- streams ---


def test_capped_stream(spark, tmp_path):
    arrived = [("a", f"f{i}", AT + timedelta(seconds=i)) for i in range(5)] + [("a", "f0", AT + timedelta(seconds=60)), ("a", "f1", AT + timedelta(seconds=61)), ("b", "g", AT + timedelta(seconds=2))]
    spark.createDataFrame(arrived, "key string, path string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, path string, ts timestamp").parquet(f"{tmp_path}/in").withWatermark("ts", "0 seconds")
    query = ST.capped_stream(stream, 3, 5.0).writeStream.format("memory").queryName("capped").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["key"], r["batch"]): (r["paths"], r["reason"]) for r in spark.table("capped").collect()}
    assert got["a", 0] == (["f0", "f1", "f2"], "size") and got["a", 1] == (["f3", "f4"], "idle") and got["b", 0] == (["g"], "idle")
