import base64
import json
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from loomline.sources import files as S
from loomline.sources import tables as T
from loomline.streaming import files as ST


def test_code_files(spark, tmp_path):
    for name, text in (("a.sql", "SELECT 1;\nSELECT 2;"), ("d/b.py", "x = 1"), (".hid/c.sql", "no"), ("venv/d.sql", "no"), ("e.txt", "no"), ("d/f.json", "{}")):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    got = {r["path"].rsplit("/", 1)[-1]: r["content"] for r in S.corpus(spark, str(tmp_path)).collect()}
    assert got == {"a.sql": "SELECT 1;\nSELECT 2;", "b.py": "x = 1", "f.json": "{}"}
    (tmp_path / "bad.sql").write_bytes(b"\xff ok")
    up = {r["path"].rsplit("/", 1)[-1]: r["status"] for r in S.uploads(spark, str(tmp_path)).collect()}
    assert up["a.sql"] == "accepted" and up["e.txt"] == "unsupported"
    with pytest.raises(ValueError):
        S.uploads(spark, str(tmp_path), most_mb=0)
    (tmp_path / "d" / "g.sql.b64").write_bytes(base64.b64encode(b"SELECT 9"))
    spark.dataSource.register(S.RepositorySource)
    repo = {r["path"]: r["content"] for r in spark.read.format("repository").option("path", str(tmp_path)).load().collect()}
    assert repo["d/g.sql"] == "SELECT 9" and repo["bad.sql"].endswith("ok") and ".hid/c.sql" not in repo


def test_log_files(spark, tmp_path):
    for name in ("app_2024-01-01.jsonl", "app_2024-01-05.jsonl", "nodate.jsonl"):
        (tmp_path / name).write_text('{"m": "%s"}\n\nbroken\n' % name)
    got = rows(S.log_files(spark, str(tmp_path), "m string", start="2024-01-03T00:00").where("m IS NOT NULL"))
    assert got == [("app_2024-01-05.jsonl",), ("nodate.jsonl",)]


def test_archives_and_snapshots(spark, tmp_path):
    base = f"file://{tmp_path}"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    assert T.export_archive({"t": df, "empty": df.limit(0)}, f"{base}/ar", "2024-01") == [("t", 2)]
    T.export_archive({"t": df.withColumn("more", F.lit(1))}, f"{base}/ar", "2024-02")
    assert T.read_archive(spark, f"{base}/ar", "t").count() == 4 and T.read_archive(spark, f"{base}/ar", "t", ["2024-01"], "id > 1").count() == 1
    with pytest.raises(FileNotFoundError):
        T.read_archive(spark, f"{base}/ar", "nothing")
    for stamp in ("1", "2", "3"):
        T.create_snapshot(spark, {"t": df}, f"{base}/sn", stamp)
    assert T.prune_snapshots(spark, f"{base}/sn", 2) == ["snapshot_1"] and T.snapshots(spark, f"{base}/sn") == ["snapshot_3", "snapshot_2"]
    assert rows(T.load_snapshot(spark, f"{base}/sn", "snapshot_3")["t"]) == [(1, "a"), (2, "b")]
    moved, h = T.changed({"t": df}, None)
    assert moved and T.changed({"t": df}, h) == (False, h)
    wide, v = T.migrate(df, 1, {1: {"x": 1}, 2: {"y": "z"}})
    assert v == 2 and wide.columns == ["id", "name", "y"] and T.migrate(wide, 1, {2: {"y": "z"}})[0].columns == wide.columns


def test_index_and_texts(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    (tmp_path / "r1" / "ingestion_index.json").write_text(json.dumps([{"ingestion_id": "i1", "filenames": ["a"]}]))
    (tmp_path / "ingestion_index.json").write_text(json.dumps({"ingestion_id": "i2"}))
    (tmp_path / "r2").mkdir()
    (tmp_path / "r2" / "ingestion_index.json").write_text("oops")
    assert rows(T.read_index(spark, str(tmp_path)).select("ingestion_id")) == [("i1",), ("i2",)]
    n = spark.createDataFrame([("1", "Table", "t", {"b": "2", "a": "1"}), ("2", "View", "v", {})], "id string, label string, name string, props map<string,string>")
    assert rows(T.entity_texts(n).select("text")) == [("Table: t (a=1, b=2)",), ("View: v",)]
    o = spark.createDataFrame([("f", "TABLE", "s", "t", "1"), ("f", "TABLE", "s", "t", "2")], "path string, kind string, schema string, name string, statement string")
    assert rows(T.object_files(o).select("file_name")) == [("tables/s.t.sql",), ("tables/s.t_1.sql",)]


def test_stream_ingestion_is_idempotent(spark, tmp_path):
    src, out = tmp_path / "in", f"{tmp_path}/out"
    src.mkdir()

    def run():
        q = ST.ingest_batches(ST.watch(spark, str(src)), out, f"{tmp_path}/cp", lambda b: b.select("path", F.length("content").alias("n"), "at"))
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted(r["n"] for r in spark.read.parquet(out).collect())

    (src / "a.sql").write_text("12345")
    assert run() == [5]
    (src / "b.sql").write_text("123")
    (src / "skip.txt").write_text("1")
    assert run() == [3, 5]


def test_stream_windows(spark, tmp_path):
    at = datetime(2024, 1, 1)
    data = [(1, "a", at), (1, "a", at + timedelta(seconds=3)), (1, "b", at + timedelta(seconds=7)), (1, "a", at + timedelta(seconds=30))]
    df = spark.createDataFrame(data, "stream int, path string, ts timestamp")
    assert [r["paths"] for r in ST.debounce(df).orderBy("batch_start").collect()] == [["a", "b"], ["a"]]
    df.write.parquet(f"{tmp_path}/e")
    live = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/e").withWatermark("ts", "1 minute")
    q = ST.debounce(live).writeStream.format("memory").queryName("batches").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    capped = {(r["batch"]): r["n"] for r in ST.capped_batches(df, 1, 5.0, "stream").groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert capped == {"0-0": 1, "0-1": 1, "1-0": 1}


def test_breaker_and_slices(spark):
    assert ST.breaker([(0, True), (1, True), (2, True), (3, False), (63, True), (70, False), (130, False), (131, True)], failures=3) == ["closed", "closed", "open", "open", "open", "open", "closed", "closed"]
    assert ST.breaker([(0, True), (60, False), (61, False), (62, True)]) == ["open", "open", "closed", "open"]
    assert spark.range(1).select(ST.slices(F.lit("abcde"), 2)).first()[0] == ["ab", "cd", "e"]


def test_priorities_snapshots_and_buffers(spark, tmp_path):
    t = spark.createDataFrame([("BATCH", 1), ("CRITICAL", 2), ("other", 0), ("NORMAL", 3)], "priority string, seq int")
    assert [r["seq"] for r in ST.by_priority(t).collect()] == [2, 3, 1, 0]
    ST.in_pool(spark, "BATCH")
    ST.in_pool(spark, "NORMAL")
    with pytest.raises(ValueError):
        ST.in_pool(spark, "x")
    path, h = ST.snapshot_if_changed({"t": t}, f"file://{tmp_path}/s", "1", None)
    assert path.endswith("snapshot_1") and ST.snapshot_if_changed({"t": t}, f"file://{tmp_path}/s", "2", h) == (None, h)
    assert [r["seq"] for r in ST.recent(t, 2, "seq").collect()] == [2, 3]


def test_names_and_tree_of_chunks(spark):
    c = spark.createDataFrame([("\nCREATE OR REPLACE FUNCTION a.f(x int)\nAS",), ("create table t (a int)",), ("SELECT 1",), ("",), (None,)], "chunk string")
    assert [(r["object_type"], r["object_name"]) for r in T.chunk_names(c).collect()][:4] == [("FUNCTION", "a.f"), ("TABLE", "t"), ("MISC", "unknown"), ("MISC", "unknown")]


def test_table_functions(spark):
    from loomline.functions import sql_functions

    spark.createDataFrame([("r1", "p", "s", 4)], "id string, project_id string, timestamp string, sequence int").createOrReplaceTempView("runs")
    spark.createDataFrame([("f1", "p", None, "a.sql", "h", 1), ("f2", "p", None, "a.sql", "g", 2), ("f3", "p", "r", "a.sql", "h", 3)], "id string, project_id string, repository_id string, relative_path string, file_hash string, created_at int").createOrReplaceTempView("files")
    sql_functions.register(spark)
    assert spark.sql("SELECT get_next_sequence('p', 's'), get_next_sequence('p', 'other')").first()[:] == (5, 1)
    assert spark.sql("SELECT id FROM find_duplicate_file('p', NULL, 'h')").collect() == [("f1",)]
    assert spark.sql("SELECT id FROM find_previous_file_version('p', NULL, 'a.sql')").collect() == [("f2",)]
    assert spark.sql("SELECT kind, name FROM code_entities('import os')").collect() == [("import", "os")]
    assert spark.sql("SELECT chunk FROM code_chunks('sql', 'SELECT 1; SELECT 2')").count() == 2


def test_breaker_goes_on_across_midnight(spark):
    from datetime import datetime, timedelta

    midnight = datetime(2024, 1, 2)
    near = [("a", -10, True), ("a", 5, False), ("a", 49, False), ("a", 51, False), ("b", -20, True), ("b", -10, True), ("b", 5, True), ("b", 20, False), (None, -1, True), (None, 1, False)]
    df = spark.createDataFrame([(s, midnight + timedelta(seconds=t), x) for s, t, x in near], "service string, at timestamp, limited boolean")
    of = lambda n, s: [r["state"] for r in ST.replay_breaker(df, n).orderBy("at").collect() if r["service"] == s]
    assert of(1, "a") == ["open", "open", "open", "closed"] and of(1, None) == ["open", "open"]
    assert of(3, "b") == ["closed", "closed", "open", "open"] and of(3, "a") == ["closed"] * 4
    # over Arrow batches and days, as the fold over all calls of a service
    many = [(f"s{i % 3}", i * 7919 % 4_000_003 / 20, i % 5 < 2) for i in range(3000)]
    df = spark.createDataFrame([(s, midnight + timedelta(seconds=t), x) for s, t, x in many], "service string, at timestamp, limited boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = ST.replay_breaker(df, 2, 300.0).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for s in ("s0", "s1", "s2"):
        calls = sorted((t, x) for n, t, x in many if n == s)
        assert [r["state"] for r in sorted((r for r in got if r["service"] == s), key=lambda r: r["at"])] == ST.breaker(calls, 2, 300.0)
