"""The graph queries over the whole foreign-key graph, reads and parts included."""

from collections import defaultdict

import pytest
from conftest import SMALL, rows
from test_registry import duck, norm  # noqa: F401

import __spark_entry__ as entry
from loomline.operators import graph as G
from loomline.plans import graph_queries as Q


@pytest.mark.parametrize("name", ["g03_endpoint_merge", "g18_lineage_payload", "g30_visual_graph", "g33_chat_context"])
def test_whole_graph_equals_sql(spark, duck, name):  # noqa: F811
    df = entry.queries()[name](spark, SMALL)
    got = sorted(tuple(map(norm, r)) for r in df.collect())
    r = duck.execute(entry.oracle_sql()[name])
    assert df.columns == [d[0] for d in r.description]
    assert got == sorted(tuple(map(norm, x)) for x in r.fetchall())


def test_reads_and_parts_are_in(spark):
    lineage = rows(entry.queries()["g18_lineage_payload"](spark, SMALL))
    assert any(i.startswith("P") and d == 3 for i, d, _ in lineage)
    assert entry.queries()["g03_endpoint_merge"](spark, SMALL).where("type = 'READS_FROM'").limit(1).count()


def brute(edges, source, target):
    """The lexicographically first of the shortest undirected paths."""
    beside = defaultdict(set)
    for a, b in edges:
        beside[a].add(b)
        beside[b].add(a)
    seen, level = {source}, {source: [source]}
    while level and target not in level:
        now = {}
        for at, path in level.items():
            for x in beside[at] - seen:
                now[x] = min(now.get(x, [*path, x]), [*path, x])
        seen |= now.keys()
        level = now
    return level.get(target)


def test_shortest_path_through_parts(spark):
    _, e = Q.fk(spark, SMALL)
    edges = [(r["source_id"], r["target_id"]) for r in e.collect()]
    got = entry.queries()["g10_shortest_path"](spark, SMALL).first()
    assert got["path"].split(">") == brute(edges, "C1", got["path"].split(">")[-1]) and got["hops"] == got["path"].count(">")
    orders = sorted({a for a, b in edges if b == "P1"})
    assert len(orders) > 1
    far = G.shortest_path(e, orders[0], orders[-1]).first()["path"]
    assert far == brute(edges, orders[0], orders[-1]) and far == [orders[0], "P1", orders[-1]]


def test_visual_lineage(spark):
    nodes = spark.createDataFrame([(i, "Table", f"dw.{i}") for i in ["a", "m", "z", *(f"u{i}" for i in range(7)), *(f"d{i}" for i in range(3))]], "id string, label string, name string")
    edges = spark.createDataFrame([*((f"u{i}", "a", "CALLS") for i in range(7)), ("a", "d0", "READS_FROM"), ("a", "d0", "CALLS"), ("d0", "d1", "CALLS"), ("d1", "d2", "CALLS"), ("d2", "x", "CALLS"), ("a", "m", "CALLS")], "source_id string, target_id string, type string")
    n, links = G.visual_lineage(nodes, edges, nodes.where("id IN ('a', 'm', 'z')"))
    want = [(f"u{i}", "a", "CALLS") for i in range(5)] + [("a", "d0", "CALLS"), ("a", "m", "CALLS"), ("a", "d1", "RELATED"), ("a", "d2", "RELATED"), ("a", "x", "RELATED")] + [(f"u{i}", "m", "RELATED") for i in range(4)]
    assert rows(links) == sorted(((f"{s}-{t}", s, t, k) for s, t, k in want), key=repr)
    assert {r["id"]: r["name"] for r in n.collect()} == {i: f"dw.{i}" for i in ("a", "m", "d0", "d1", "d2", "u0", "u1", "u2", "u3", "u4")} | {"x": "x"}
    assert [d.collect() for d in G.visual_lineage(nodes, edges, nodes.limit(0))] == [[], []]
    assert entry.queries()["g30_lineage_graph"](spark, SMALL).count() > 5
