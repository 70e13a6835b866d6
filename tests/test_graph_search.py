import pytest
from conftest import rows
from pyspark.sql import functions as F

from loomline.functions import scalar as S
from loomline.operators import graph as G
from loomline.operators import search as V


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([(i, "Table", f"dw.{i}") for i in "abcdef"], "id string, label string, name string")
    edges = spark.createDataFrame([("a", "b", "READS_FROM"), ("b", "c", "CONTAINS"), ("c", "a", "CONTAINS"), ("c", "d", "CALLS"), ("e", "f", "CALLS"), ("a", "c", "CALLS")], "source_id string, target_id string, type string")
    return nodes, edges


def seed(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_traversals_end_on_cycles(spark, graph):
    _, e = graph
    assert rows(G.downstream(e, seed(spark, "a"))) == [("b", 1), ("c", 1), ("d", 2)]
    assert rows(G.upstream(e, seed(spark, "d"), 2)) == [("a", 2), ("b", 2), ("c", 1)]
    assert rows(G.downstream(e, seed(spark, "zz"))) == []
    assert rows(G.lineage(e, seed(spark, "e"), 2, "down")) == [("e", 0, "self"), ("f", 1, "downstream")]
    assert rows(G.downstream(G.flow(e), seed(spark, "b"), 1)) == [("a", 1), ("c", 1)]


def test_trails_and_shortest_path(spark, graph):
    _, e = graph
    assert sorted("".join(r["path"]) for r in G.trails(e, seed(spark, "a"), 3, closed=True).collect()) == ["ab", "abc", "abca", "abcd", "ac", "aca", "acab", "acd"]
    assert sorted("".join(r["path"]) for r in G.trails(e, seed(spark, "a"), 3).collect()) == ["ab", "abc", "abcd", "ac", "acab", "acd"]
    assert G.shortest_path(e, "b", "d").first()["path"] == ["b", "c", "d"]
    assert G.shortest_path(e, "a", "f").collect() == [] and G.shortest_path(e, "a", "a").first()["hops"] == 0


def test_upserts_and_purge(spark, graph):
    n, e = graph
    new = spark.createDataFrame([("a", "Table", None), ("b", "Table", "new"), ("z", "View", "zed")], "id string, label string, name string")
    got = {r["id"]: r["name"] for r in G.upsert_nodes(n, new).collect()}
    assert got["a"] == "dw.a" and got["b"] == "new" and got["z"] == "zed" and len(got) == 7
    more = spark.createDataFrame([("a", "nowhere", "CALLS"), ("f", "a", "CALLS"), ("f", "a", "CALLS")], "source_id string, target_id string, type string")
    assert G.upsert_edges(e, more, n).count() == 7
    left, edges = G.purge(n, e, seed(spark, "c"))
    assert left.count() == 5 and rows(edges.select("source_id", "target_id")) == [("a", "b"), ("e", "f")]
    known, linked = G.link_projects(n, e.withColumn("created_at", F.lit(1)), "p", "q", F.lit(5))
    _, again = G.link_projects(known, linked, "p", "q", F.lit(9))
    assert again.where("type = 'PROJECT_LINK'").select("created_at").collect() == [(5,)] and G.unlink_projects(again, "p", "q").count() == 6


def test_governance(spark, graph):
    n, e = graph
    p = spark.createDataFrame([("a", "d", "reads-from", 0.5), ("a", "b", "reads from", 0.5), ("a", "x", "CALLS", 0.5), ("d", "e", "1st", 2.0)], "source_id string, target_id string, type string, confidence double")
    assert {r["type"]: r["reason"] for r in G.judge_proposals(p, n, e).orderBy(F.desc("target_id")).collect()} | {} == {"CALLS": "missing_context_node", "REL_1ST": "bad_confidence", "READS_FROM": "edge_exists"}
    v = G.validate(n, e, n.where("id <> 'a'"), e.where("type <> 'CALLS'")).first()
    assert (v["status"], v["expected_nodes"], v["missing_nodes"], v["missing_edges"]) == ("failed", 6, 1, 3)
    steps = spark.createDataFrame([(1, 1, "int"), (1, 2, "BIGINT"), (1, 3, "varchar(3)"), (2, None, None)], "path_id int, pos int, data_type string")
    assert {r["path_id"]: r["confidence"] for r in G.path_confidence(steps).collect()} == {1: 0.9, 2: 0.7}


def test_visual_numbers_nodes(graph):
    n, e = graph
    nodes, links = G.visual(n, e)
    assert [r["index"] for r in nodes.orderBy("id").collect()] == list(range(6)) and (0, 1, "READS_FROM") in rows(links)


def test_scalars(spark):
    df = spark.createDataFrame([("\\a//b\\c/", "x s. sales_orders ab.cd reads"), (None, None)], "p string, q string")
    r = df.select(S.urn(F.lit("table"), F.lit(" p "), F.col("p")), S.urn_parts(S.urn(F.lit("t"), F.lit(""), F.lit("a:b:c")))["asset_path"], S.is_urn(F.lit("urn:x:a:b:c")), S.terms(F.col("q")), S.asks_lineage(F.col("q"))).collect()
    assert r[0][0] == "urn:li:table:p:a/b/c" and r[0][1] == "a:b:c" and r[0][2] is False and r[0][3] == ["sales_orders", "sales_order", "ab.cd", "reads", "read"] and r[0][4] is True and r[1][0] == "urn:li:table:p:unknown"
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(S.salvage_json(F.lit('<think>{no}</think>```json\n{"a": {"b": 1}}\n``` bye'))) == '{"a": {"b": 1}}' and one(S.salvage_json(F.lit("none"))) is None
    assert one(S.database_name(F.lit("AdventureWorksLT-All.sql"))) == "adventureworkslt" and one(S.database_name(F.lit("/data/northwind/raw.sql"))) == "northwind" and one(S.database_name(F.lit("x.sql"))) == "default"
    assert one(S.sanitize_relative_path(F.lit("/../a b/./.c.sql"))) == "a_b/c.sql" and one(S.file_type(F.lit("x/y.PY"))) == "python"
    assert one(S.redact(F.lit("a.b@c.org 123-45-6789 5551234567"))) == "[EMAIL] [SSN] [PHONE]"
    assert one(S.term_index(F.lit("customer_orders"))) == 5814


def test_retrieval(spark):
    pts = spark.createDataFrame([(1, [1.0, 0.0, 0.0], "alpha text"), (2, [0.0, 1.0, 0.0], "beta text"), (3, [0.0, 0.0, 0.0], "zero"), (4, None, "none"), (5, [1.0], "short")], "id bigint, vector array<float>, text string")
    assert rows(V.dense(pts, [1, 0, 0], 2)) == [(1, 1.0), (2, 0.0)]
    assert V.hybrid(pts, "alpha", [1.0, 0.0, 0.0], 3).first()["id"] == 1
    assert V.sparse_search(pts, "!!", 3).collect() == [] and rows(V.sparse_search(pts, "text text", 3).select("id")) == [(1,), (2,)]
    assert V.semantic_cache(pts, [0.9, 0.1, 0.0]).first()["id"] == 1 and V.semantic_cache(pts, [0.5, 0.5, 0.0]).collect() == []
    fused = {r["id"]: r["fused"] for r in V.fuse(pts.selectExpr("id", "double(10 - id) AS score"), pts.where("id > 3").selectExpr("id", "double(id) AS score")).collect()}
    assert fused[1] == round(0.5 / 61, 9) and fused[5] == round(0.5 / 65 + 0.5 / 61, 9)
    left, gone = V.delete_by(pts, text="zero")
    assert left.count() == 4 and gone.first()["deleted"] == 1
    ranked = spark.createDataFrame([(i, "x" * 1000) for i in range(1, 21)], "rank int, text string")
    assert V.trim_context(ranked).count() == 6 and V.trim_context(ranked, 10).count() == 3
    assert sum(x != 0 for x in spark.range(1).select(V.hash_embedding(F.lit("a b c"), 16)).first()[0]) <= 3
