"""The property graph: nodes (id, label, name, ...) and edges (source_id, target_id, type, ...) as DataFrames.

Writes are set-based: an upsert is a union followed by "the newest row of each key" with map-side partials;
edges load only if both ends exist. Traversals go level by level: each level asks the edges for those at the distinct
frontier and writes what it found to the shared folder, so plans stay flat and lost executors cost one level. The
edges themselves are never copied: a level is a semi-join, which goes below unions and distincts to the scans, or a look
into the buckets of an `EdgeStore`. One visited set is kept; it and the frontier are broadcast only if proven small.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import store
from ..functions import scalar as S
from ..sources import keyed

# --- loading --------------------------------------------------------------------------------------


def from_foreign_keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the order tables: region, nation, customer, supplier, orders, part."""
    t = lambda n: store.table(spark, sf_dir, n)
    key = lambda p, c: F.concat(F.lit(p), F.col(c))
    spec = (("region", "R", "r_regionkey", "r_name", "Region"), ("nation", "N", "n_nationkey", "n_name", "Nation"), ("customer", "C", "c_custkey", "c_name", "Customer"), ("supplier", "S", "s_suppkey", "s_name", "Supplier"), ("part", "P", "p_partkey", "p_name", "Part"))
    nodes = [t(n).select(key(p, k).alias("id"), F.lit(label).alias("label"), F.col(name).alias("name")) for n, p, k, name, label in spec]
    nodes.append(t("orders").select(key("O", "o_orderkey").alias("id"), F.lit("Order").alias("label"), key("order ", "o_orderkey").alias("name")))
    edge = lambda df, a, b, kind: df.select(a.alias("source_id"), b.alias("target_id"), F.lit(kind).alias("type"))
    edges = [
        edge(t("nation"), key("R", "n_regionkey"), key("N", "n_nationkey"), "CONTAINS"),
        edge(t("customer"), key("N", "c_nationkey"), key("C", "c_custkey"), "CONTAINS"),
        edge(t("supplier"), key("N", "s_nationkey"), key("S", "s_suppkey"), "CONTAINS"),
        edge(t("orders"), key("C", "o_custkey"), key("O", "o_orderkey"), "DERIVES"),
        edge(t("lineitem"), key("O", "l_orderkey"), key("P", "l_partkey"), "READS_FROM").distinct(),
    ]
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return union(nodes), union(edges)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """old with new merged in by keys: the new value of a column wins unless it is null; columns in keep
    are only set on creation. A key that comes twice in new keeps the value of its last non-null by order of `seq`, if there."""
    rest = [c for c in old.columns if c not in keys]
    a = old.select("*", F.lit(0).alias("__gen"), F.lit(0).cast("bigint").alias("__seq"))
    b = new.select(*old.columns, F.lit(1).alias("__gen"), (F.col("seq") if "seq" in new.columns else F.lit(0)).cast("bigint").alias("__seq"))
    order = F.struct("__gen", "__seq")
    newest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order))
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order))
    both = a.unionByName(b)
    merged = both.groupBy(*keys).agg(*[(first(c) if c in keep else newest(c)).alias(c) for c in rest]) if rest else both.select(*keys).distinct()
    return merged.select(*old.columns)


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(nodes, new, ("label", "id"))


def upsert_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are no nodes are left out."""
    return upsert(edges, with_ends(new, nodes), ("source_id", "type", "target_id"))


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id").distinct()
    return edges.join(ids, edges.source_id == ids.id, "left_semi").join(ids, edges.target_id == ids.id, "left_semi")


def without_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node: what an endpoint merge leaves out, to be retried or reported."""
    ids = nodes.select("id").distinct()
    known = ids.withColumn("__k", F.lit(True))
    j = edges.join(known.withColumnRenamed("id", "source_id").withColumnRenamed("__k", "__a"), "source_id", "left").join(known.withColumnRenamed("id", "target_id").withColumnRenamed("__k", "__b"), "target_id", "left")
    return j.where("__a IS NULL OR __b IS NULL").select(*edges.columns)


def link_projects(nodes: DataFrame, edges: DataFrame, source: str, target: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """Both project nodes and a PROJECT_LINK between them; created_at is only set on creation."""
    spark = nodes.sparkSession
    ends = spark.createDataFrame([(source, "Project", source), (target, "Project", target)], "id string, label string, name string")
    known = upsert(nodes, _like(ends, nodes), ("label", "id"))
    link = spark.createDataFrame([(source, target, "PROJECT_LINK")], "source_id string, target_id string, type string").withColumn("created_at", now)
    return known, upsert(edges, _like(link, edges), ("source_id", "type", "target_id"), keep=("created_at",))


def unlink_projects(edges: DataFrame, source: str, target: str) -> DataFrame:
    return edges.where(~((F.col("type") == "PROJECT_LINK") & (F.col("source_id") == source) & (F.col("target_id") == target)))


def _like(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(other.schema[c].dataType).alias(c) for c in other.columns])


# --- scans and lookups ----------------------------------------------------------------------------


def node_scan(nodes: DataFrame, label: str | None = None, contains: str | None = None, limit: int = 1000, **equal: str) -> DataFrame:
    for c, v in equal.items():
        nodes = nodes.where(F.col(c).isin(list(v)) if isinstance(v, list | tuple) else F.col(c) == v)
    if label:
        nodes = nodes.where(F.col("label") == label)
    if contains:
        nodes = nodes.where(F.contains(F.lower("name"), F.lit(contains.lower())))
    return nodes.orderBy("id").limit(limit)


def edge_scan(edges: DataFrame, nodes: DataFrame, least_confidence: float | None = None, limit: int = 1000, **equal: str) -> DataFrame:
    for c, v in equal.items():
        edges = edges.where(F.col(c) == v)
    if least_confidence is not None:
        edges = edges.where(F.col("confidence") >= least_confidence)
    return with_ends(edges, nodes).orderBy("source_id", "target_id", "type").limit(limit)


def find_by_name(nodes: DataFrame, pattern: str, limit: int = 100) -> DataFrame:
    return nodes.where(F.contains(F.lower("name"), F.lit(pattern.lower()))).orderBy("id").limit(limit)


def find_by_names(nodes: DataFrame, patterns: Sequence[str], limit: int = 50) -> DataFrame:
    """Nodes whose name contains any pattern of more than two characters."""
    wanted = sorted({p.lower() for p in patterns if len(p) > 2})
    hit = F.exists(F.array(*[F.lit(p) for p in wanted]), lambda p: F.contains(F.lower(F.col("name")), p)) if wanted else F.lit(False)
    return nodes.where(hit).dropDuplicates(["id"]).orderBy("id").limit(limit)


def enrich(nodes: DataFrame, props: DataFrame) -> DataFrame:
    """nodes with the columns of props (key, ...) where the lower-case name is the key or ends with it.

    Keys are matched by an equi-join on their length and the name's tail, not by a nested loop: the distinct
    lengths of the keys are few, and each name is exploded to one tail for each length.
    """
    keyed = props.withColumn("__key", F.lower("key")).withColumn("__n", F.length("__key")).drop("key")
    lengths = F.broadcast(keyed.agg(F.collect_set("__n").alias("__lengths")))
    extra = [c for c in keyed.columns if c not in ("__key", "__n")]
    tails = nodes.select("id", F.lower("name").alias("__name")).join(lengths, F.lit(True), "left").select("id", "__name", F.explode("__lengths").alias("__n")).where(F.length("__name") >= F.col("__n"))
    tails = tails.withColumn("__key", F.expr("right(__name, __n)"))
    best = tails.join(keyed, ["__key", "__n"]).groupBy("id").agg(*[F.max_by(c, F.struct("__n", "__key")).alias(c) for c in extra])
    return nodes.drop(*extra).join(best, "id", "left")


def by_urn(nodes: DataFrame, urn: Column, project: str) -> DataFrame:
    """The node whose label (ignoring case), project and name (ignoring case) a URN names."""
    p = S.urn_parts(urn)
    return nodes.where((F.lower("label") == F.lower(p["entity_type"])) & (p["project_id"] == project) & (F.lower("name") == F.lower(p["asset_path"]))).orderBy("id").limit(1)


EDGE_URN = r"^([^/]+)/([A-Za-z_][A-Za-z0-9_]*):(.*)->([A-Za-z_][A-Za-z0-9_]*):(.*)$"


def edge_by_path(edges: DataFrame, nodes: DataFrame, path: str) -> DataFrame:
    """Edges that `TYPE/SourceLabel:name->TargetLabel:name` names; none for an unsafe label."""
    part = lambda i: F.regexp_extract(F.lit(path), EDGE_URN, i)
    end = lambda side, label, name: nodes.where((F.col("label") == label) & (F.lower("name") == F.lower(name))).select(F.col("id").alias(side))
    return edges.where(F.col("type") == part(1)).join(end("source_id", part(2), part(3)), "source_id").join(end("target_id", part(4), part(5)), "target_id")


# --- traversal ------------------------------------------------------------------------------------


def flow(edges: DataFrame) -> DataFrame:
    """Edges in the direction of data flow: reads, derivations and aliases point from the asset to its reader."""
    turned = F.col("type").isin("READS_FROM", "DERIVES", "READS", "ALIAS_OF")
    a, b = F.when(turned, F.col("target_id")).otherwise(F.col("source_id")), F.when(turned, F.col("source_id")).otherwise(F.col("target_id"))
    return edges.select(a.alias("source_id"), b.alias("target_id"), *[c for c in edges.columns if c not in ("source_id", "target_id")])


class EdgeStore:
    """Edges on shared storage, filed by source and by target: a level of a traversal opens only the buckets of its frontier."""

    SIDES = {"source_id": "by_source", "target_id": "by_target"}

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, rows_per_bucket: int = 1_000_000):
        self.store = keyed.KeyedStore(spark, path, {name: (side,) for side, name in self.SIDES.items()}, buckets, rows_per_bucket)

    def add(self, edges: DataFrame) -> None:
        manifest = self.store.manifest()
        for name in self.SIDES.values():
            self.store.write(manifest, name, edges)
        self.store.publish(self.store.tidy(manifest))

    def at(self, side: str, ids: DataFrame) -> DataFrame | None:
        """Edges whose end on a side is one of ids (id)."""
        return self.store.near(self.store.manifest(), self.SIDES[side], ids.select(F.col("id").alias(side)))


def edges_at(edges: DataFrame | EdgeStore, side: str, ids: DataFrame) -> DataFrame | None:
    """Edges whose end on a side is one of ids (id), which should be materialised, and carry a broadcast hint if they are small."""
    if isinstance(edges, EdgeStore):
        return edges.at(side, ids)
    return edges.join(ids.select(F.col("id").alias(side)), side, "left_semi").select(*edges.columns)


def _hinted(df: DataFrame, size: tuple[int, int]) -> DataFrame:
    return F.broadcast(df) if size[0] <= store.BROADCAST_ROWS and size[1] <= store.BROADCAST_BYTES else df


def levels(edges: DataFrame | EdgeStore, seeds: DataFrame, depth: int | None, reverse: bool = False) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """(d, edges from nodes first reached in d - 1 hops, nodes (id) first reached in d hops) for d = 1, 2, ... while there are any."""
    here, there = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    visited = frontier = store.materialize(seeds.select("id").where("id IS NOT NULL").distinct(), "reach-0")
    size = seen = store.measured(frontier)  # each level is measured once
    d = 1
    while size[0] and (depth is None or d <= depth):
        found = edges_at(edges, here, _hinted(frontier, size))
        if found is None:
            return
        hop = store.materialize(found.distinct(), f"reach-edges-{d}")
        frontier = store.materialize(hop.select(F.col(there).alias("id")).distinct().join(_hinted(visited, seen), "id", "left_anti"), f"reach-{d}")
        yield d, hop, frontier
        if d == depth:
            return
        size = store.measured(frontier)
        seen = (seen[0] + size[0], seen[1] + size[1])
        visited = visited.unionByName(frontier)
        d += 1


def reach(edges: DataFrame | EdgeStore, seeds: DataFrame, depth: int | None, reverse: bool = False) -> DataFrame:
    """(id, depth): nodes within `depth` hops of the seeds (id), with the least depth; seeds are depth 0."""
    parts = [seeds.select("id").distinct().withColumn("depth", F.lit(0))]
    parts += [frontier.withColumn("depth", F.lit(d)) for d, _, frontier in levels(edges, seeds, depth, reverse)]
    return reduce(DataFrame.unionByName, parts)


def downstream(edges: DataFrame | EdgeStore, seeds: DataFrame, depth: int = 10) -> DataFrame:
    return reach(edges, seeds, depth).where("depth > 0")


def upstream(edges: DataFrame | EdgeStore, seeds: DataFrame, depth: int = 10) -> DataFrame:
    return reach(edges, seeds, depth, reverse=True).where("depth > 0")


def lineage_rows(edges: DataFrame | EdgeStore, seeds: DataFrame, depth: int = 10, reverse: bool = False, nodes: DataFrame | None = None, project: str | None = None, repositories: Sequence[str] | None = None) -> DataFrame:
    """(source, relationship, target, depth, and the edges' other columns): the edges on ways of up to `depth` hops from the seeds.

    depth is the least number of hops at which an edge is met (1 at the seeds). With a project or repositories only ways
    count that end in a node of those (nodes: id, project_id, repository_id): edges are pruned level by level from the far end.
    """
    here, there = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    hops = [(d, hop) for d, hop, _ in levels(edges, seeds, depth, reverse)]
    if project is not None or repositories is not None:
        ends = nodes if project is None else nodes.where(F.col("project_id") == project)
        ends = ends.select("id", *(["repository_id"] if repositories is not None else []))
        ends = (ends if repositories is None else ends.where(F.col("repository_id").isin(list(repositories)))).select("id").distinct()
        kept, wanted = [], None
        for d, hop in reversed(hops):
            good = hop.join(ends.withColumnRenamed("id", there), there, "left_semi")
            if wanted is not None:  # or it leads on to a node that counts
                good = good.unionByName(hop.join(wanted.withColumnRenamed("id", there), there, "left_semi")).distinct()
            good = store.materialize(good, "lineage-kept")
            wanted = good.select(F.col(here).alias("id")).distinct()
            kept.append((d, good))
        hops = kept[::-1]
    more = [c for c in hops[0][1].columns if c not in ("source_id", "target_id", "type")] if hops else []
    rows = [h.select(F.col("source_id").alias("source"), F.col("type").alias("relationship"), F.col("target_id").alias("target"), F.lit(d).alias("depth"), *more) for d, h in hops]
    return reduce(DataFrame.unionByName, rows) if rows else seeds.sparkSession.createDataFrame([], "source string, relationship string, target string, depth int")


def lineage(edges: DataFrame | EdgeStore, seeds: DataFrame, depth: int = 5, direction: str = "both") -> DataFrame:
    """(id, depth, direction) of a node's surroundings, the node itself as `self`."""
    parts = [seeds.select("id", F.lit(0).alias("depth"), F.lit("self").alias("direction"))]
    if direction in ("both", "up", "upstream"):
        parts.append(upstream(edges, seeds, depth).withColumn("direction", F.lit("upstream")))
    if direction in ("both", "down", "downstream"):
        parts.append(downstream(edges, seeds, depth).withColumn("direction", F.lit("downstream")))
    return reduce(DataFrame.unionByName, parts)


def trails(edges: DataFrame, seeds: DataFrame, depth: int, closed: bool = False) -> DataFrame:
    """(path, types, hops): every edge-simple path of 1..depth hops from the seeds; as many rows as there are paths.

    Paths that end where they began are walked on, but come out only if `closed`.
    """
    hops = edges.select(F.col("source_id").alias("at"), F.col("target_id").alias("next"), "type", F.xxhash64("source_id", "type", "target_id").alias("edge"))
    now = seeds.select(F.col("id").alias("at"), F.array("id").alias("path"), F.array().cast("array<string>").alias("types"), F.array().cast("array<bigint>").alias("used"))
    out = []
    for d in range(1, depth + 1):
        step = now.join(hops, "at").where(~F.array_contains("used", F.col("edge")))
        now = store.materialize(step.select(F.col("next").alias("at"), F.array_append("path", F.col("next")).alias("path"), F.array_append("types", F.col("type")).alias("types"), F.array_append("used", F.col("edge")).alias("used")), f"trails-{d}")
        out.append(now.select("path", "types", F.lit(d).alias("hops")))
    every = reduce(DataFrame.unionByName, out)
    return every if closed else every.where(F.col("path")[0] != F.element_at("path", -1))


def shortest_path(edges: DataFrame | EdgeStore, source: str, target: str) -> DataFrame:
    """(path, hops) of a shortest undirected path, the lexicographically first; no row if there is none.

    The search goes on as long as it meets new nodes, however long the path is.
    """
    spark = edges.store.spark if isinstance(edges, EdgeStore) else edges.sparkSession
    frontier = store.materialize(spark.createDataFrame([(source, [source])], "id string, path array<string>"), "path-0")
    visited, d, seen = frontier.select("id"), 0, (0, 0)
    while True:
        n, there, letters, steps = frontier.agg(F.count("*"), F.max(F.col("id") == target), F.sum(F.octet_length("id")), F.max(F.size("path"))).first()
        if there:
            return frontier.where(F.col("id") == target).select("path", F.lit(d).alias("hops"))
        if not n:
            break
        size = (n, n * 64 + letters)
        seen = (seen[0] + n, seen[1] + size[1])
        ids = _hinted(frontier.select("id"), size)
        sides = [(e.select(F.col(a).alias("id"), F.col(b).alias("next"))) for a, b in (("source_id", "target_id"), ("target_id", "source_id")) if (e := edges_at(edges, a, ids)) is not None]
        if not sides:
            break
        near = store.materialize(reduce(DataFrame.unionByName, sides).distinct().join(_hinted(visited.withColumnRenamed("id", "next"), seen), "next", "left_anti"), "path-near")
        step = near.join(_hinted(frontier, (n, size[1] * (steps + 1))), "id").groupBy("next").agg(F.min(F.array_append("path", F.col("next"))).alias("path"))
        d += 1
        frontier = store.materialize(step.withColumnRenamed("next", "id"), f"path-{d}")
        visited = visited.unionByName(frontier.select("id"))
    return spark.createDataFrame([], "path array<string>, hops int")


# --- counting, cleaning, exporting ----------------------------------------------------------------


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): counts by label and by type, and in all (name null)."""


    def tally(df: DataFrame, column: str, kind: str) -> DataFrame:
        each = df.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n"))
        total = each.agg(F.lit(None).cast("string").alias("name"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))  # of an empty graph too
        return each.unionByName(total).select(F.lit(kind).alias("kind"), "name", "n")

    return tally(nodes, "label", "node").unionByName(tally(edges, "type", "edge"))


def purge(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes gone (id) and all that touches them."""
    ids = gone.select("id").distinct()
    left = nodes.join(ids, "id", "left_anti")
    return left, edges.join(ids, edges.source_id == ids.id, "left_anti").join(ids, edges.target_id == ids.id, "left_anti")


def schema_rollup(edges: DataFrame, parents: DataFrame, children: DataFrame) -> DataFrame:
    """(id, name, n, members): parents with their CONTAINS children, also those without any."""
    held = edges.where("type = 'CONTAINS'").join(children.select(F.col("id").alias("target_id"), F.col("name").alias("child")), "target_id")
    return parents.join(held.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("child")), ",").alias("members")), "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce("members", F.lit("")).alias("members"))


def dependencies(edges: DataFrame, of: DataFrame, kind: str) -> DataFrame:
    """(id, n_out, n_in): distinct references of a type out of and into each node of `of`, zero where there are none."""
    e = edges.where(F.col("type") == kind)
    out = e.groupBy(F.col("source_id").alias("id")).agg(F.countDistinct("target_id").alias("n_out"))
    into = e.groupBy(F.col("target_id").alias("id")).agg(F.countDistinct("source_id").alias("n_in"))
    return of.select("id").join(out, "id", "left").join(into, "id", "left").fillna(0, ["n_out", "n_in"])


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges among the given nodes."""
    return with_ends(edges, nodes)


#: Labels of what a context is made of.
CONTEXT_LABELS = ("File", "DataAsset", "Column", "FunctionOrProcedure")


def context_subgraph(nodes: DataFrame, edges: DataFrame, scope: str, labels: Sequence[str] = CONTEXT_LABELS, most: int = 20, path: str = "name") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges among them): the first `most` nodes by id of the given labels whose path contains the scope, ignoring case."""
    some = nodes.where(F.col("label").isin(list(labels)) & F.contains(F.lower(path), F.lit(scope.lower()))).orderBy("id").limit(most)
    return some, induced(some, edges)


def visual(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes numbered from 0 by id and links by those numbers; links with unknown ends are left out.

    Numbers come from a range partitioning and per-partition offsets, not from one global window.
    """
    ordered = store.materialize(nodes.select("id", "label", "name").repartitionByRange("id").sortWithinPartitions("id").withColumn("__p", F.spark_partition_id()), "visual")
    w = Window.partitionBy("__p").orderBy("id")
    sizes = ordered.groupBy("__p").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    offsets = F.broadcast(sizes.select("__p", (F.sum("n").over(Window.orderBy("low")) - F.col("n")).alias("offset")))  # a row for each partition
    numbered = ordered.join(offsets, "__p").select("id", "label", "name", (F.row_number().over(w) - 1 + F.col("offset")).cast("bigint").alias("index"))
    ends = numbered.select("id", "index")
    links = edges.join(ends.toDF("source_id", "source"), "source_id").join(ends.toDF("target_id", "target"), "target_id").select("source", "target", "type")
    return numbered, links


def visual_lineage(nodes: DataFrame, edges: DataFrame, found: DataFrame, entities: int = 2, each: int = 5, depth: int = 5) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, name) and links (id, source, target, label) around the first few nodes found.

    Each centre has its `each` nearest upstream and downstream nodes (ties by id), linked with it directly; a link
    is labelled by the edge between its ends, else RELATED. Nodes are distinct by id, links by source and target.
    """
    spark = nodes.sparkSession
    parts = []
    for (centre,) in found.select("id").distinct().orderBy("id").limit(entities).collect():
        around = store.materialize(lineage(edges, spark.createDataFrame([(centre,)], "id string"), depth), "visual-lineage")
        for direction in ("upstream", "downstream"):
            near = around.where(F.col("direction") == direction).orderBy("depth", "id").limit(each)
            ends = (F.col("id"), F.lit(centre)) if direction == "upstream" else (F.lit(centre), F.col("id"))
            parts.append(near.select(ends[0].alias("source"), ends[1].alias("target")))
        parts.append(around.where("direction = 'self'").select(F.col("id").alias("source"), F.lit(None).cast("string").alias("target")))
    shown = store.materialize(reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "source string, target string"), "visual-links").distinct()
    ids = shown.select(F.col("source").alias("id")).unionByName(shown.select(F.col("target").alias("id"))).where("id IS NOT NULL").distinct()
    known = nodes.select("id", "label", "name").dropDuplicates(["id"])
    types = edges.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "type").join(store.checked_broadcast(shown), ["source", "target"], "left_semi").groupBy("source", "target").agg(F.min("type").alias("type"))
    links = shown.where("target IS NOT NULL").join(types, ["source", "target"], "left")
    return ids.join(known, "id", "left").select("id", "label", F.coalesce("name", "id").alias("name")), links.select(F.concat_ws("-", "source", "target").alias("id"), "source", "target", F.coalesce("type", F.lit("RELATED")).alias("label"))


# --- governance -----------------------------------------------------------------------------------


def backfill(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"source": F.coalesce("source", F.lit("parser")), "status": F.coalesce("status", F.lit("approved")), "confidence": F.coalesce("confidence", F.lit(1.0))})


def review(edges: DataFrame, verdicts: DataFrame, now: Column | None = None) -> DataFrame:
    """edges with the status of verdicts (source_id, target_id, type, verdict, perhaps notes), reviewed_at and reviewer_notes; others as they are."""
    notes = F.col("notes") if "notes" in verdicts.columns else F.lit(None).cast("string")
    v = verdicts.select("source_id", "target_id", "type", F.when(F.col("verdict") == "approve", "approved").otherwise("rejected").alias("__s"), notes.alias("__n"))
    j = edges.join(v, ["source_id", "target_id", "type"], "left")
    old = lambda c, kind: F.col(c) if c in edges.columns else F.lit(None).cast(kind)
    at = now if now is not None else F.current_timestamp()
    done = F.col("__s").isNotNull()
    return j.withColumns({"status": F.coalesce("__s", "status"), "reviewed_at": F.when(done, at).otherwise(old("reviewed_at", "timestamp")), "reviewer_notes": F.when(done, F.col("__n")).otherwise(old("reviewer_notes", "string"))}).drop("__s", "__n")


def judge_proposals(proposals: DataFrame, context: DataFrame, edges: DataFrame) -> DataFrame:
    """proposals with reason: missing_context_node, edge_exists, bad_confidence, or null (accepted)."""
    ids = context.select("id").distinct()
    p = proposals.withColumn("type", S.relationship_name(F.col("type")))
    p = p.join(ids.select(F.col("id").alias("source_id"), F.lit(True).alias("__a")), "source_id", "left").join(ids.select(F.col("id").alias("target_id"), F.lit(True).alias("__b")), "target_id", "left")
    p = p.join(edges.select("source_id", "target_id", "type", F.lit(True).alias("__e")).distinct(), ["source_id", "target_id", "type"], "left")
    reason = F.when(F.col("__a").isNull() | F.col("__b").isNull(), "missing_context_node").when(F.col("__e"), "edge_exists").when(~F.col("confidence").between(0, 1) | F.col("confidence").isNull(), "bad_confidence")
    return p.withColumn("reason", reason).drop("__a", "__b", "__e")


def validate(expected_nodes: DataFrame, expected_edges: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(status, expected_nodes, expected_edges, missing_nodes, missing_edges), one row."""
    on = ["source_id", "target_id", "type"]
    lost_n = expected_nodes.select("id").distinct().join(nodes.select("id"), "id", "left_anti")
    lost_e = expected_edges.select(*on).distinct().join(edges.select(*on), on, "left_anti")
    tally = lambda df, name: df.agg(F.count("*").alias(name))
    row = tally(expected_nodes.select("id").distinct(), "expected_nodes")
    for df, name in ((expected_edges.select(*on).distinct(), "expected_edges"), (lost_n, "missing_nodes"), (lost_e, "missing_edges")):
        row = row.join(F.broadcast(tally(df, name)), F.lit(True))  # one row each
    return row.select(F.when(F.col("missing_nodes") + F.col("missing_edges") == 0, "passed").otherwise("failed").alias("status"), "*")


def path_confidence(steps: DataFrame) -> DataFrame:
    """(path_id, issues, confidence): 1 - 0.1 for each step whose type doesn't fit the next, - 0.3 without a path; 0 at least.

    steps: (path_id, pos, data_type); a path without steps has one row with a null pos.
    """
    w = Window.partitionBy("path_id").orderBy("pos")
    s = steps.withColumn("__next", F.lead("data_type").over(w))
    bad = F.sum(F.when(F.col("__next").isNotNull() & ~S.compatible(F.col("data_type"), F.col("__next")), 1).otherwise(0))
    g = s.groupBy("path_id").agg(bad.alias("issues"), F.count("pos").alias("__n"))
    return g.select("path_id", "issues", F.greatest(F.lit(0.0), F.round(1 - 0.1 * F.col("issues") - F.when(F.col("__n") == 0, 0.3).otherwise(0.0), 6)).alias("confidence"))


# --- lookups of the service -----------------------------------------------------------------------


def by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    """The node of an id; of several labels the first."""
    return nodes.where(F.col("id") == node_id).orderBy("label").limit(1)


def existing_edges(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """The keys (source_id, target_id, type) that are edges."""
    on = ["source_id", "target_id", "type"]
    return keys.select(*on).distinct().join(edges.select(*on), on, "left_semi")


#: Questions that are asked again and again, as SQL over the views `nodes` and `edges`.
CATALOGUE = {
    "all_tables": "SELECT id, name FROM nodes WHERE label IN ('Table', 'DataAsset')",
    "children": "SELECT e.source_id, n.id, n.label, n.name FROM edges e JOIN nodes n ON n.id = e.target_id WHERE e.type = 'CONTAINS'",
    "derivations": "SELECT source_id, target_id, type FROM edges WHERE type IN ('DERIVES', 'DERIVES_FROM', 'TRANSFORMS_TO')",
    "labels": "SELECT label, count(*) AS n FROM nodes GROUP BY label",
    "types": "SELECT type, count(*) AS n FROM edges GROUP BY type",
}


def chat_context(nodes: DataFrame, edges: DataFrame | EdgeStore, question: str, entities: int = 3, depth: int = 2) -> DataFrame:
    """(id, depth, direction): the surroundings of the first few nodes whose names the question's terms are in."""
    spark = nodes.sparkSession
    found = spark.range(1).select(S.terms(F.lit(question))).first()[0]  # one row
    hits = find_by_names(nodes, found, 10).orderBy("id").limit(entities).select("id")
    return lineage(edges, store.materialize(hits, "chat-entities"), depth)


def clear(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An empty graph of the same shape."""
    return nodes.limit(0), edges.limit(0)
