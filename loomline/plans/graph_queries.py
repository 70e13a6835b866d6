"""Graph queries over the foreign-key graph of the order tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import graph as G
from ..store import table

NODES = """
nodes AS (
  SELECT 'R' || r_regionkey AS id, 'Region' AS label, r_name AS name FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'Nation', n_name FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'Customer', c_name FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'Supplier', s_name FROM supplier
  UNION ALL SELECT 'P' || p_partkey, 'Part', p_name FROM part
  UNION ALL SELECT 'O' || o_orderkey, 'Order', 'order ' || o_orderkey FROM orders)"""
EDGES = """
edges AS (
  SELECT 'R' || n_regionkey AS source_id, 'N' || n_nationkey AS target_id, 'CONTAINS' AS type FROM nation
  UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, 'CONTAINS' FROM customer
  UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, 'CONTAINS' FROM supplier
  UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey, 'DERIVES' FROM orders
  UNION ALL SELECT DISTINCT 'O' || l_orderkey, 'P' || l_partkey, 'READS_FROM' FROM lineitem)"""
#: Edges with the governance columns that the queries derive from the keys.
GOVERNED = """
gov AS (
  SELECT 'O' || l_orderkey AS source_id, 'P' || l_partkey AS target_id, 'READS_FROM' AS type,
    CASE WHEN min(l_linenumber) % 3 = 0 THEN NULL ELSE 'llm' END AS source,
    CASE WHEN min(l_linenumber) % 2 = 0 THEN 'proposed' END AS status,
    CASE WHEN min(l_linenumber) % 4 <> 1 THEN CAST(round(1 - max(l_discount), 4) AS DOUBLE) END AS confidence
  FROM lineitem GROUP BY ALL)"""


def fk(spark: SparkSession, sf: str):
    return G.from_foreign_keys(spark, sf)


def seeds(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


def governed(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("n"), F.max("l_discount").alias("d"))
    return li.select(F.concat(F.lit("O"), "l_orderkey").alias("source_id"), F.concat(F.lit("P"), "l_partkey").alias("target_id"), F.lit("READS_FROM").alias("type"),
                     F.when(F.col("n") % 3 != 0, "llm").alias("source"), F.when(F.col("n") % 2 == 0, "proposed").alias("status"), F.when(F.col("n") % 4 != 1, F.round(1 - F.col("d"), 4).cast("double")).alias("confidence"))


def g01_upsert_nodes(spark, sf):
    n, _ = fk(spark, sf)
    new = table(spark, sf, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.lit("Nation").alias("label"), F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).alias("name"))
    return G.upsert_nodes(n, new)


def g03_endpoint_merge(spark, sf):
    n, e = fk(spark, sf)
    new = table(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("source_id"), F.concat(F.lit("C"), F.col("s_suppkey") * 20).alias("target_id"), F.lit("SERVES").alias("type"))
    return G.upsert_edges(e, new, n)


def g06_name_search(spark, sf):
    return G.find_by_name(fk(spark, sf)[0], "Nation_1").select("id", "label", "name")


def g07_multi_name_search(spark, sf):
    return G.find_by_names(fk(spark, sf)[0], ["IRAN", "al", "asia", "Supplier#00000000"], 50).select("id", "label", "name")


def g08_upstream(spark, sf):
    return G.lineage_rows(fk(spark, sf)[1], seeds(spark, "P1"), 4, reverse=True)


def g09_downstream(spark, sf):
    return G.lineage_rows(fk(spark, sf)[1], seeds(spark, "R0"), 3)


def g09_downstream_nodes(spark, sf):
    return G.downstream(fk(spark, sf)[1], seeds(spark, "R0"), 3)


def g09_downstream_of_project(spark, sf):
    """Only ways that end at suppliers: the labels stand for projects."""
    n, e = fk(spark, sf)
    return G.lineage_rows(e, seeds(spark, "R1"), 3, nodes=n.withColumn("project_id", F.col("label")).withColumn("repository_id", F.lit("fk")), project="Supplier", repositories=["fk"])


def g10_shortest_path(spark, sf):
    """From the first customer to the last supplier of its region."""
    nation, customer, supplier = (table(spark, sf, t) for t in ("nation", "customer", "supplier"))
    region = customer.where("c_custkey = 1").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey")
    of_region = supplier.join(nation.join(region, "n_regionkey", "left_semi"), F.col("s_nationkey") == F.col("n_nationkey"))
    last = of_region.agg(F.max("s_suppkey")).first()[0]  # one row
    return G.shortest_path(fk(spark, sf)[1], "C1", f"S{last}").select(F.array_join("path", ">").alias("path"), "hops")


def g11_graph_stats(spark, sf):
    return G.stats(*fk(spark, sf))


def g12_purge_detach(spark, sf):
    n, e = fk(spark, sf)
    left, edges = G.purge(n, e, n.where("label = 'Customer'"))
    return G.stats(left, edges)


def g15_suffix_enrichment(spark, sf):
    n, _ = fk(spark, sf)
    props = spark.createDataFrame([("steel", "metal"), ("ia", "ends in ia"), ("china", "china")], "key string, owner string")
    return G.enrich(n, props).where("owner IS NOT NULL").select("id", "owner")


def g16_urn_lookup(spark, sf):
    return G.by_urn(fk(spark, sf)[0].withColumn("project_id", F.lit("tpch")), F.lit("urn:li:nation:tpch:nation_7"), "tpch").select("id", "label", "name")


def g17_edge_urn(spark, sf):
    n, e = fk(spark, sf)
    return G.edge_by_path(e, n, "CONTAINS/Region:asia->Nation:NATION_7").select("source_id", "target_id", "type")


def g18_lineage_payload(spark, sf):
    return G.lineage(fk(spark, sf)[1], seeds(spark, "N7"), 5)


def g20_review(spark, sf):
    e = governed(spark, sf)
    v = e.where("status = 'proposed'").select("source_id", "target_id", "type", F.when(F.coalesce("confidence", F.lit(0.0)) >= 0.95, "approve").otherwise("reject").alias("verdict"))
    return G.review(e, v).groupBy("status").agg(F.count("*").alias("n"))


def g21_schema_rollup(spark, sf):
    n, e = fk(spark, sf)
    return G.schema_rollup(e, n.where("label = 'Region'"), n.where("label = 'Nation'"))


def g22_dependencies(spark, sf):
    n, e = fk(spark, sf)
    return G.dependencies(e, n.where("label = 'Nation'"), "CONTAINS")


def g23_context_subgraph(spark, sf):
    n, e = fk(spark, sf)
    return G.context_subgraph(n, e, "a", ("Region", "Nation"), 40)[1]


def g25_proposal_filter(spark, sf):
    n, e = fk(spark, sf)
    p = table(spark, sf, "customer").select(F.concat(F.lit("N"), F.col("c_nationkey") + F.when(F.col("c_custkey") % 5 == 0, 1).otherwise(0)).alias("source_id"), F.concat(F.lit("C"), F.col("c_custkey") + F.when(F.col("c_custkey") % 7 == 0, 100000000).otherwise(0)).alias("target_id"), F.lit("contains").alias("type"), F.when(F.col("c_custkey") % 11 == 0, 1.5).otherwise(0.5).alias("confidence"))
    return G.judge_proposals(p, n, e).groupBy("reason").agg(F.count("*").alias("n"), F.min("confidence").alias("low"), F.round(F.avg("confidence"), 6).alias("mean"), F.max("confidence").alias("high"))


def g27_validation(spark, sf):
    n, e = fk(spark, sf)
    expected = table(spark, sf, "supplier").select(F.concat(F.lit("N"), F.col("s_nationkey")).alias("source_id"), F.concat(F.lit("S"), F.col("s_suppkey") + F.when(F.col("s_suppkey") % 10 == 0, 5000000).otherwise(0)).alias("target_id"), F.lit("CONTAINS").alias("type"))
    return G.validate(expected.select(F.col("target_id").alias("id")), expected, n, e)


def g28_relationship_names(spark, sf):
    return table(spark, sf, "events").select("event_type").distinct().select("event_type", S.relationship_name(F.concat(F.lit("9 "), "event_type", F.lit("-to"))).alias("type"))


def g29_backfill(spark, sf):
    return G.backfill(governed(spark, sf)).groupBy("source", "status").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))


def g30_visual_graph(spark, sf):
    n, e = fk(spark, sf)
    return G.visual(n, e)[1]


def g31_bounded_paths(spark, sf):
    return G.trails(fk(spark, sf)[1], seeds(spark, "R1"), 3).groupBy("hops", F.array_join("types", ">").alias("types")).agg(F.count("*").alias("n"))


def g34_path_confidence(spark, sf):
    steps = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path_id"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_linenumber") % 3 == 0, "varchar(10)").when(F.col("l_linenumber") % 3 == 1, "INT").otherwise("decimal(5,2)").alias("data_type"))
    return G.path_confidence(steps).groupBy("issues", "confidence").agg(F.count("*").alias("n"))


def g_flow_downstream(spark, sf):
    return G.downstream(G.flow(fk(spark, sf)[1]), seeds(spark, "P1"), 2)


def g24_existing_edges(spark, sf):
    _, e = fk(spark, sf)
    keys = table(spark, sf, "orders").select(F.concat(F.lit("C"), "o_custkey").alias("source_id"), F.concat(F.lit("O"), F.col("o_orderkey") + F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).alias("target_id"), F.lit("DERIVES").alias("type"))
    return G.existing_edges(e, keys)


def g32_catalogue(spark, sf):
    from ..operators import sqlapi

    n, e = fk(spark, sf)
    return sqlapi.query(spark, G.CATALOGUE["labels"], {"nodes": n, "edges": e})


def g33_chat_context(spark, sf):
    n, e = fk(spark, sf)
    return G.chat_context(n, e, "what depends on nation_17 downstream?", 3, 2)


def sc11_node_scan(spark, sf):
    return G.node_scan(fk(spark, sf)[0].withColumn("project_id", F.lit("fk")), label="Nation", contains="_1", project_id="fk").select("id", "label", "name")


def sc12_edge_scan(spark, sf):
    n, _ = fk(spark, sf)
    return G.edge_scan(governed(spark, sf), n, 0.97, status="proposed").select("source_id", "target_id", "type", "confidence")


def sc13_entity_by_id(spark, sf):
    return G.by_id(fk(spark, sf)[0], "N7")


def g13_clear(spark, sf):
    return G.stats(*G.clear(*fk(spark, sf)))


def g05_edges_without_ends(spark, sf):
    """What an endpoint merge leaves out, as it would be retried."""
    n, _ = fk(spark, sf)
    new = table(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("source_id"), F.concat(F.lit("C"), F.col("s_suppkey") * 20).alias("target_id"), F.lit("SERVES").alias("type"))
    return G.without_ends(new, n)


def g30_lineage_graph(spark, sf):
    n, e = fk(spark, sf)
    return G.visual_lineage(n, e, G.find_by_names(n, ["nation_17", "asia"]))[1]


_DOWN = """
WITH RECURSIVE {EDGES}, hop(id, depth) AS (SELECT '{seed}', 0 UNION SELECT {to}, depth + 1 FROM hop JOIN {edges} e ON {at} = hop.id WHERE depth < {depth})
SELECT id, CAST(min(depth) AS INT) AS depth FROM hop WHERE depth > 0 GROUP BY id"""


def _walk(seed: str, depth: int, at: str = "source_id", to: str = "target_id", edges: str = "edges", extra: str = "") -> str:
    return _DOWN.format(EDGES=EDGES + extra, seed=seed, depth=depth, at=at, to=to, edges=edges)


_ROWS = """
WITH RECURSIVE {EDGES}, hop(id, depth) AS (SELECT '{seed}', 0 UNION SELECT {to}, depth + 1 FROM hop JOIN edges e ON {at} = hop.id WHERE depth < {depth}),
near AS (SELECT id, min(depth) AS depth FROM hop GROUP BY id)
SELECT source_id AS source, type AS relationship, target_id AS target, CAST(depth + 1 AS INT) AS depth FROM near JOIN edges ON {at} = near.id WHERE depth < {depth}"""


def _rows(seed: str, depth: int, at: str = "source_id", to: str = "target_id") -> str:
    return _ROWS.format(EDGES=EDGES, seed=seed, depth=depth, at=at, to=to)


ORACLES = {
    "g01_upsert_nodes": f"WITH {NODES} SELECT id, label, CASE WHEN label = 'Nation' AND CAST(substr(id, 2) AS INT) % 2 = 0 THEN lower(name) ELSE name END AS name FROM nodes",
    "g03_endpoint_merge": f"WITH {EDGES} SELECT source_id, target_id, type FROM edges UNION ALL SELECT 'S' || s_suppkey, 'C' || (s_suppkey * 20), 'SERVES' FROM supplier WHERE s_suppkey * 20 IN (SELECT c_custkey FROM customer)",
    "g06_name_search": f"WITH {NODES} SELECT * FROM nodes WHERE contains(lower(name), 'nation_1') ORDER BY id LIMIT 100",
    "g07_multi_name_search": f"WITH {NODES} SELECT * FROM nodes WHERE contains(lower(name), 'iran') OR contains(lower(name), 'asia') OR contains(lower(name), 'supplier#00000000') ORDER BY id LIMIT 50",
    "g08_upstream": _rows("P1", 4, "target_id", "source_id"),
    "g09_downstream": _rows("R0", 3),
    "g09_downstream_nodes": _walk("R0", 3),
    "g09_downstream_of_project": "SELECT 'N' || s_nationkey AS source, 'CONTAINS' AS relationship, 'S' || s_suppkey AS target, 2 AS depth FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 UNION ALL SELECT DISTINCT 'R1', 'CONTAINS', 'N' || n_nationkey, 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1",
    "sc11_node_scan": f"WITH {NODES} SELECT * FROM nodes WHERE label = 'Nation' AND contains(lower(name), '_1') ORDER BY id LIMIT 1000",
    "sc12_edge_scan": f"WITH {GOVERNED} SELECT source_id, target_id, type, confidence FROM gov WHERE status = 'proposed' AND confidence >= 0.97 ORDER BY source_id, target_id LIMIT 1000",
    "sc13_entity_by_id": f"WITH {NODES} SELECT * FROM nodes WHERE id = 'N7'",
    "g13_clear": "SELECT 'node' AS kind, CAST(NULL AS VARCHAR) AS name, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'edge', NULL, 0",
    "g05_edges_without_ends": "SELECT 'S' || s_suppkey AS source_id, 'C' || (s_suppkey * 20) AS target_id, 'SERVES' AS type FROM supplier WHERE s_suppkey * 20 NOT IN (SELECT c_custkey FROM customer)",
    "g10_shortest_path": """
WITH me AS (SELECT c_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1),
last AS (SELECT max(s_suppkey) AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = (SELECT n_regionkey FROM me))
SELECT CASE WHEN c_nationkey = s_nationkey THEN 'C1>N' || c_nationkey || '>S' || k ELSE 'C1>N' || c_nationkey || '>R' || n_regionkey || '>N' || s_nationkey || '>S' || k END AS path,
  CASE WHEN c_nationkey = s_nationkey THEN 2 ELSE 4 END AS hops FROM me, last JOIN supplier ON s_suppkey = k""",
    "g11_graph_stats": f"WITH {NODES}, {EDGES} SELECT 'node' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY ROLLUP (label) UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY ROLLUP (type)",
    "g12_purge_detach": f"WITH {NODES}, {EDGES} SELECT 'node' AS kind, label AS name, count(*) AS n FROM nodes WHERE label <> 'Customer' GROUP BY ROLLUP (label) UNION ALL SELECT 'edge', type, count(*) FROM edges WHERE left(source_id, 1) <> 'C' AND left(target_id, 1) <> 'C' GROUP BY ROLLUP (type)",
    "g15_suffix_enrichment": f"WITH {NODES}, props(key, owner) AS (VALUES ('steel', 'metal'), ('ia', 'ends in ia'), ('china', 'china')) SELECT id, max_by(owner, ROW(length(key), key)) AS owner FROM nodes, props WHERE ends_with(lower(name), key) GROUP BY id",
    "g16_urn_lookup": f"WITH {NODES} SELECT * FROM nodes WHERE label = 'Nation' AND lower(name) = 'nation_7'",
    "g17_edge_urn": "SELECT 'R' || n_regionkey AS source_id, 'N' || n_nationkey AS target_id, 'CONTAINS' AS type FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name = 'NATION_7' AND r_name = 'ASIA'",
    "g18_lineage_payload": f"SELECT 'N7' AS id, 0 AS depth, 'self' AS direction UNION ALL SELECT id, depth, 'upstream' FROM ({_walk('N7', 5, 'target_id', 'source_id')}) UNION ALL SELECT id, depth, 'downstream' FROM ({_walk('N7', 5)})",
    "g20_review": f"WITH {GOVERNED} SELECT CASE WHEN status = 'proposed' THEN CASE WHEN coalesce(confidence, 0) >= 0.95 THEN 'approved' ELSE 'rejected' END ELSE status END AS status, count(*) AS n FROM gov GROUP BY 1",
    "g21_schema_rollup": "SELECT 'R' || r_regionkey AS id, r_name AS name, count(n_nationkey) AS n, coalesce(string_agg(n_name, ',' ORDER BY n_name), '') AS members FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL",
    "g22_dependencies": "SELECT 'N' || n_nationkey AS id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_out, 1 AS n_in FROM nation",
    "g23_context_subgraph": f"WITH {NODES}, {EDGES}, picked AS (SELECT id FROM nodes WHERE label IN ('Region', 'Nation') AND contains(lower(name), 'a') ORDER BY id LIMIT 40) SELECT * FROM edges WHERE source_id IN (SELECT id FROM picked) AND target_id IN (SELECT id FROM picked)",
    "g24_existing_edges": "SELECT 'C' || a.o_custkey AS source_id, 'O' || a.o_orderkey AS target_id, 'DERIVES' AS type FROM orders a JOIN (SELECT DISTINCT o_custkey, o_orderkey + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS k FROM orders) b ON a.o_orderkey = b.k AND a.o_custkey = b.o_custkey",
    "g32_catalogue": f"WITH {NODES} SELECT label, count(*) AS n FROM nodes GROUP BY 1",
    "g33_chat_context": "SELECT 'N17' AS id, 0 AS depth, 'self' AS direction UNION ALL SELECT 'R' || n_regionkey, 1, 'upstream' FROM nation WHERE n_nationkey = 17 UNION ALL SELECT 'C' || c_custkey, 1, 'downstream' FROM customer WHERE c_nationkey = 17 UNION ALL SELECT 'S' || s_suppkey, 1, 'downstream' FROM supplier WHERE s_nationkey = 17 UNION ALL SELECT 'O' || o_orderkey, 2, 'downstream' FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 17",
    "g25_proposal_filter": """
WITH p AS (SELECT c_nationkey + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS nk, c_custkey, c_nationkey, CASE WHEN c_custkey % 11 = 0 THEN 1.5 ELSE 0.5 END AS confidence FROM customer)
SELECT CASE WHEN nk NOT IN (SELECT n_nationkey FROM nation) OR c_custkey % 7 = 0 THEN 'missing_context_node' WHEN nk = c_nationkey THEN 'edge_exists' WHEN confidence > 1 THEN 'bad_confidence' END AS reason,
  count(*) AS n, CAST(min(confidence) AS DOUBLE) AS low, round(avg(confidence), 6) AS mean, CAST(max(confidence) AS DOUBLE) AS high FROM p GROUP BY 1""",
    "g27_validation": "SELECT CASE WHEN k = 0 THEN 'passed' ELSE 'failed' END AS status, n AS expected_nodes, n AS expected_edges, k AS missing_nodes, k AS missing_edges FROM (SELECT count(*) AS n, count(*) FILTER (WHERE s_suppkey % 10 = 0) AS k FROM supplier)",
    "g28_relationship_names": "SELECT DISTINCT event_type, 'REL_9_' || upper(event_type) || '_TO' AS type FROM events",
    "g29_backfill": f"WITH {GOVERNED} SELECT coalesce(source, 'parser') AS source, coalesce(status, 'approved') AS status, count(*) AS n, round(sum(coalesce(confidence, 1.0)), 4) AS confidence FROM gov GROUP BY 1, 2",
    "g30_visual_graph": f"WITH {NODES}, {EDGES}, num AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM nodes) SELECT a.i AS source, b.i AS target, type FROM edges JOIN num a ON a.id = source_id JOIN num b ON b.id = target_id",
    "g31_bounded_paths": f"WITH {EDGES}, one AS (SELECT * FROM edges WHERE source_id = 'R1'), two AS (SELECT e.target_id, o.type || '>' || e.type AS types FROM one o JOIN edges e ON e.source_id = o.target_id) SELECT 1 AS hops, type AS types, count(*) AS n FROM one GROUP BY ALL UNION ALL SELECT 2, types, count(*) FROM two GROUP BY ALL UNION ALL SELECT 3, t.types || '>' || e.type, count(*) FROM two t JOIN edges e ON e.source_id = t.target_id GROUP BY ALL",
    "g34_path_confidence": "WITH s AS (SELECT l_orderkey, l_linenumber % 3 = 0 AS txt, lead(l_linenumber % 3 = 0) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nxt FROM lineitem), g AS (SELECT l_orderkey, count(*) FILTER (WHERE nxt IS NOT NULL AND nxt <> txt) AS issues FROM s GROUP BY 1) SELECT issues, greatest(0.0, round(1 - 0.1 * issues, 6)) AS confidence, count(*) AS n FROM g GROUP BY ALL",
    "g_flow_downstream": _walk("P1", 2, edges="fl", extra=", fl AS (SELECT CASE WHEN type IN ('READS_FROM', 'DERIVES') THEN target_id ELSE source_id END AS source_id, CASE WHEN type IN ('READS_FROM', 'DERIVES') THEN source_id ELSE target_id END AS target_id FROM edges)"),
}
#: Without SQL, with brute-force tests.
QUERIES = {name: globals()[name] for name in (*ORACLES, "g30_lineage_graph")}
