"""Dense, sparse and hybrid retrieval over DataFrames.

Points are rows (id, vector, text, payload columns). A query is a literal, so a search is a filter, a
projection and a TakeOrderedAndProject: nothing is shuffled but k rows of each partition. Sparse search sums
weights per document with map-side partials, over the terms of the query alone.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import store
from ..functions import scalar as S
from ..sources import keyed


def collection_info(points: DataFrame, vector: str = "vector") -> DataFrame:
    return points.agg(F.count("*").alias("points"), F.coalesce(F.max(F.size(vector)), F.lit(0)).cast("bigint").alias("dimensions"))


def upsert_points(points: DataFrame, new: DataFrame) -> DataFrame:
    """Replace by id."""
    return points.join(new.select("id"), "id", "left_anti").unionByName(new)


def matching(points: DataFrame, **equal: object) -> DataFrame:
    for c, v in equal.items():
        points = points.where(F.col(c) == v)
    return points


def point_by_id(points: DataFrame, point_id: str | int) -> DataFrame:
    """The point of an id; a text of digits is a number where ids are numbers."""
    kind = points.schema["id"].dataType
    numeric = kind.typeName() in ("byte", "short", "integer", "long")
    if numeric and not str(point_id).lstrip("-").isdigit():
        return points.limit(0)
    return points.where(F.col("id") == F.lit(int(point_id) if numeric else str(point_id)).cast(kind))


def delete_by(points: DataFrame, **equal: object) -> tuple[DataFrame, DataFrame]:
    """(points left, (deleted) one row): equality on the given columns; nulls don't match."""
    hit = F.lit(True)
    for c, v in equal.items():
        hit = hit & F.coalesce(F.col(c) == v, F.lit(False))
    return points.where(~hit), points.agg(F.coalesce(F.sum(hit.cast("bigint")), F.lit(0)).alias("deleted"))


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def dense(points: DataFrame, query: Sequence[float], k: int = 10, vector: str = "vector", **equal: object) -> DataFrame:
    """(id, score): the k points of the greatest cosine (ties by id); payload filters come before the ranking."""
    score = S.cosine(F.col(vector), vector_literal(query))
    best = matching(points, **equal).where(F.col(vector).isNotNull()).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return best.select("id", F.round("score", 6).alias("score"))


#: Queries that are scored together, points that they meet at once, and bytes of query vectors that are broadcast at most.
QUERY_BLOCK, POINT_TILE, QUERY_BYTES = 256, 20_000, 32_000_000


def best_of(ids, vectors, names, matrix, k: int):
    """(query_id, id, score) of the k points of a batch nearest to each query, by one product; norms of 0 score 0."""
    import numpy as np
    import pandas as pd

    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    scores = unit(np.array(vectors, dtype="float64")) @ unit(np.array(matrix, dtype="float64")).T
    ids = np.asarray(ids)
    out = []
    for j, q in enumerate(names):
        best = np.lexsort((ids, -scores[:, j]))[:k]
        out.append(pd.DataFrame({"query_id": q, "id": ids[best], "score": scores[best, j]}))
    return out


def dense_many(points: DataFrame, queries: DataFrame, k: int = 10, vector: str = "vector") -> DataFrame:
    """(query_id, id, score, rank) for every query row (query_id, vector) against all points.

    Few queries are broadcast and meet every Arrow batch of points in one scan. More are met tile by tile: points are cut into
    tiles and queries into blocks by hash, and each (tile, block) is one product of bounded size. Either way a batch keeps its k
    best per query, and the final rank is over at most k rows of each.
    """
    q = queries.where(F.col(vector).isNotNull()).select("query_id", F.col(vector).cast("array<double>").alias("q"))
    p = points.where(F.col(vector).isNotNull()).select("id", F.col(vector).cast("array<double>").alias("v"))
    q = store.materialize(q, "queries")
    schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, id {p.schema['id'].dataType.simpleString()}, score double"
    if store.is_small(q, size=QUERY_BYTES):
        rows = q.collect()  # proven small
        shipped = q.sparkSession.sparkContext.broadcast(([r["query_id"] for r in rows], [r["q"] for r in rows]))

        def run(batches):
            names, matrix = shipped.value
            for pdf in batches:
                for at in range(0, len(names) if len(pdf) else 0, QUERY_BLOCK):
                    yield from best_of(pdf["id"], pdf["v"].tolist(), names[at : at + QUERY_BLOCK], matrix[at : at + QUERY_BLOCK], k)

        near = p.mapInPandas(run, schema)
    else:
        tiles, blocks = -(-p.count() // POINT_TILE), -(-q.count() // QUERY_BLOCK)
        tile, block = F.pmod(F.xxhash64("id"), F.lit(tiles)), F.pmod(F.xxhash64("query_id"), F.lit(blocks))
        left = p.withColumn("tile", tile).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
        right = q.withColumn("block", block).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)).cast("array<bigint>")))

        def met(a, b):
            import pandas as pd

            found = best_of(a["id"], a["v"].tolist(), b["query_id"].tolist(), b["q"].tolist(), k) if len(a) and len(b) else []
            return pd.concat(found) if found else pd.DataFrame({"query_id": [], "id": [], "score": []})

        near = left.groupBy("tile", "block").cogroup(right.groupBy("tile", "block")).applyInPandas(met, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


# --- collections and an index ---------------------------------------------------------------------


def create_collection(collections: DataFrame, name: str, size: int, distance: str = "cosine") -> DataFrame:
    """collections (name, size, distance) with a new one; one that is there stays as it is, and another size for it is refused."""
    there = collections.where(F.col("name") == name).select("size").limit(1).collect()  # one row
    if there and there[0][0] != size:
        raise ValueError(f"collection {name} has vectors of {there[0][0]}, not {size}")
    if there:
        return collections
    return collections.unionByName(collections.sparkSession.createDataFrame([(name, size, distance)], collections.schema))


class VectorIndex:
    """An inverted-file index: every point is filed under the nearest of `cells` centroids, a search opens the cells nearest to it.

    Centroids are fitted (spherical k-means) on at most `sample` points, those of the smallest hashes; all points are filed. A
    point is stored with its cell, so a search reads `probes` buckets of cells and scores those points exactly.
    """

    def __init__(self, spark, path: str, cells: int = 16, sample: int = 20_000, probes: int = 13):
        self.store = keyed.KeyedStore(spark, path, {"points": ("cell",)}, buckets=cells)
        self.cells, self.sample, self.probes = cells, sample, probes

    def fit(self, points: DataFrame, rounds: int = 12) -> None:
        """Learn the centroids and keep them in the manifest."""
        import numpy as np

        rows = points.where("vector IS NOT NULL").select("vector").orderBy(F.xxhash64("id")).limit(self.sample).collect()  # a bounded sample
        m = np.array([r[0] for r in rows], dtype="float64").reshape(len(rows), -1)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        centres = m[np.linspace(0, len(m) - 1, min(self.cells, len(m))).astype(int)] if len(m) else m
        for _ in range(rounds if len(m) else 0):
            nearest = np.argmax(m @ centres.T, axis=1)
            sums = np.array([m[nearest == c].sum(axis=0) if (nearest == c).any() else centres[c] for c in range(len(centres))])
            centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
        manifest = self.store.manifest()
        manifest["more"] = {"centroids": centres.tolist()}
        self.store.publish(manifest)

    def _nearest(self, df: DataFrame, n: int) -> DataFrame:
        """df (..., vector) with cells: the n nearest centroids, nearest first."""
        centres = self.store.manifest()["more"]["centroids"]

        def run(batches):
            import numpy as np

            c = np.array(centres, dtype="float64")
            for pdf in batches:
                if len(pdf):
                    m = np.array(pdf["vector"].tolist(), dtype="float64")
                    pdf["cells"] = list(np.argsort(-(m @ c.T), axis=1, kind="stable")[:, :n].astype("int32"))
                    yield pdf

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.mapInPandas(run, f"{fields}, cells array<int>")

    def add(self, points: DataFrame) -> None:
        """File points (id, vector)."""
        manifest = self.store.manifest()
        filed = self._nearest(points.where("vector IS NOT NULL").select("id", F.col("vector").cast("array<double>").alias("vector")), 1)
        self.store.write(manifest, "points", filed.select("id", "vector", F.col("cells")[0].alias("cell")))
        self.store.publish(self.store.tidy(manifest))

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, id, score, rank): the k nearest points of the probed cells for each query (query_id, vector)."""
        asked = self._nearest(queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")), self.probes)
        asked = store.materialize(asked.select("query_id", F.col("vector").alias("q"), F.explode("cells").alias("cell")), "probes")
        points = self.store.near(self.store.manifest(), "points", asked)
        scored = points.join(store.checked_broadcast(asked), "cell").select("query_id", "id", S.cosine(F.col("vector"), F.col("q")).alias("score"))
        # the k best of each query and bucket of points first, so that no query's points meet in one task
        some = Window.partitionBy("query_id", F.pmod(F.xxhash64("id"), F.lit(16))).orderBy(F.desc("score"), "id")
        few = scored.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return few.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-zA-Z0-9_]+"), F.lit(0))


def sparse(docs: DataFrame, text: str = "text", only: Sequence[int] | None = None) -> DataFrame:
    """(id, idx, w): the keyword vector of each text, or of it the given indexes alone. Terms that share an index
    are separate counts of one index: the greater weight holds."""
    terms = store.spread(docs.select("id", text)).select("id", F.explode(words(F.col(text))).alias("term"))
    if only is not None:  # before the aggregation, so that only the query's terms are shuffled
        terms = terms.where(S.term_index(F.col("term")).isin(list(only)))
    counted = terms.groupBy("id", "term").agg(F.count("*").alias("f"))
    return counted.groupBy("id", S.term_index(F.col("term")).alias("idx")).agg(F.max(S.term_weight(F.col("f"))).alias("w"))


def sparse_search(docs: DataFrame, query: str, k: int = 10, text: str = "text") -> DataFrame:
    """(id, score): dot product with the query's keyword vector; only texts that share a term."""
    spark = docs.sparkSession
    q = {r["idx"]: r["w"] for r in sparse(spark.createDataFrame([(0, query)], "id int, q string"), "q").collect()}  # as many rows as the query has words
    if not q:
        return docs.select("id").limit(0).withColumn("score", F.lit(0.0))
    weights = F.create_map(*[F.lit(x) for i, w in sorted(q.items()) for x in (int(i), float(w))])
    hits = sparse(docs, text, sorted(q))
    return hits.groupBy("id").agg(F.round(F.sum(F.col("w") * F.element_at(weights, F.col("idx").cast("int"))), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def fuse(dense_hits: DataFrame, sparse_hits: DataFrame, k: int = 10, weight: float = 0.5, rrf_k: int = 60) -> DataFrame:
    """(id, fused): reciprocal rank fusion of two short ranked lists (id, score)."""
    def ranked(df: DataFrame, w: float) -> DataFrame:
        r = F.row_number().over(Window.orderBy(F.desc("score"), "id"))  # over at most 2k rows
        return df.select("id", (F.lit(w) / (rrf_k + r)).alias("part"))

    both = ranked(dense_hits, weight).unionByName(ranked(sparse_hits, 1 - weight))
    return both.groupBy("id").agg(F.round(F.sum("part"), 9).alias("fused")).orderBy(F.desc("fused"), "id").limit(k)


def hybrid(points: DataFrame, query: str, vector: Sequence[float], k: int = 10, weight: float = 0.5, **equal: object) -> DataFrame:
    some = matching(points, **equal)
    return fuse(dense(some, vector, 2 * k), sparse_search(some, query, 2 * k), k, weight)


def semantic_cache(cache: DataFrame, vector: Sequence[float], least: float = 0.95) -> DataFrame:
    """The best entry of cosine `least` or more, or no row."""
    return dense(cache, vector, 1).where(F.col("score") >= least)


def remember(turns: DataFrame, session: str, said: DataFrame) -> DataFrame:
    """turns with the turns said (id, role, content, timestamp, vector) of a session; one with an id that is there replaces it."""
    new = said.withColumn("session_id", F.lit(session)).select(*turns.columns)
    return upsert_points(turns, new)


def forget(turns: DataFrame, session: str) -> DataFrame:
    """turns without those of a session."""
    return turns.where(~F.col("session_id").eqNullSafe(F.lit(session)))


def memory_context(turns: DataFrame, vector: Sequence[float], query: str, k: int = 5) -> DataFrame:
    """(id, score, line): the k turns nearest to the query, without the query itself, as `[time] role: content`."""
    best = store.checked_broadcast(dense(turns, vector, k + 1))
    rows = turns.join(best, "id").where(F.col("content") != query)
    return rows.select("id", "score", F.format_string("[%s] %s: %s", F.col("timestamp").cast("string"), "role", "content").alias("line")).orderBy(F.desc("score"), "id").limit(k)


def mentions(chunks: DataFrame, column: str, *wanted: str) -> DataFrame:
    """chunks with n = how many of the wanted names their array names; those with none are left out, most first."""
    n = sum((F.array_contains(column, w).cast("int") for w in wanted), F.lit(0))
    return chunks.withColumn("n", n).where("n > 0").orderBy(F.desc("n"), "id")


def corpus_search(chunks: DataFrame, what: str, name: str) -> DataFrame:
    """chunks whose text defines a column, joins a table, aggregates or casts a column."""
    n = name.replace("\\", "\\\\")
    patterns = {"definition": rf"(?i)\b{n}\s+\w+(\(\d+(,\s*\d+)?\))?", "join": rf"(?i)\bjoin\s+(\w+\.)*{n}\b", "aggregation": rf"(?i)\b(sum|avg|min|max|count)\s*\(\s*(distinct\s+)?(\w+\.)?{n}\s*\)", "cast": rf"(?i)\b(cast|convert|try_cast)\s*\([^()]*\b{n}\b"}
    return chunks.where(F.col("text").rlike(patterns[what]))


def trim_context(ranked: DataFrame, budget: int = 1500, least: int = 3, group: str | None = None) -> DataFrame:
    """The prefix of ranked (rank, text) that fits: the first `least` rows and all within the token budget."""
    sized = ranked.withColumn("tokens", S.tokens(F.col("text")))
    used = store.running(sized, [group] if group else [], [F.col("rank")], F.col("tokens"), "used")
    return used.where((F.col("rank") <= least) | (F.col("used") <= budget))


def response_mode(n: Column, tokens: Column, budget: int = 1500, most: int = 10) -> Column:
    return F.when((n > most) | (tokens > budget), "tree_summarize").otherwise("compact")


def truncate_blocks(blocks: DataFrame, budget: int = 8000, separator: int = 2, group: str | None = None) -> DataFrame:
    """The prefix of blocks (pos, text) whose joined length, a quarter taken as tokens, is within the budget."""
    joined = store.running(blocks, [group] if group else [], [F.col("pos")], F.length("text") + separator, "length").withColumn("length", F.col("length") - separator)
    return joined.where(F.floor(F.col("length") / 4) <= budget)


def embed_misses(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """(key, text): different texts that the embedding cache (key, ...) lacks."""
    keyed = texts.select(F.md5(F.concat(F.lit(f"{model}:"), "text")).alias("key"), "text").dropDuplicates(["key"])
    return keyed.join(cache.select("key"), "key", "left_anti")


def hash_embedding(c: Column, size: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed counts of hashed words."""
    idx = F.transform(words(c), lambda w: F.xxhash64(w))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(idx, F.lit(0.0), lambda s, h: s + F.when(F.pmod(h, F.lit(size)) == i, F.when(F.shiftright(h, 32) % 2 == 0, 1.0).otherwise(-1.0)).otherwise(0.0)))


def retrieve(points: DataFrame, vector: Sequence[float], k: int = 5, budget: int = 1500) -> DataFrame:
    """(id, score, rank, source): the k nearest chunks within the context budget, with the first 200 characters as source."""
    best = dense(points, vector, k)
    ranked = best.join(points.select("id", "text"), "id").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # over k rows
    return trim_context(ranked, budget).select("id", "score", "rank", F.substring("text", 1, 200).alias("source"))


#: Kinds of evidence that an answer may cite.
EVIDENCE = ("graph", "chunk", "doc")


#: Entity types of evidence URNs are qdrant-chunk and neo4j-node.
def chunk_evidence(hits: DataFrame, collection: str, project: str, most: int = 1000) -> DataFrame:
    """(id, type, note, block) of retrieved chunks (id, text, file_path, chunk_type, project_id): each block names its URN, file and type."""
    urn = S.urn(F.lit("qdrant-chunk"), F.coalesce("project_id", F.lit(project)), F.concat(F.lit(f"{collection}/"), F.col("id").cast("string")))
    path, kind = F.coalesce("file_path", F.lit("unknown")), F.coalesce("chunk_type", F.lit("unknown"))
    block = F.concat_ws("\n", F.concat(F.lit("["), urn, F.lit("]")), F.concat(F.lit("File: "), path), F.concat(F.lit("Type: "), kind), F.concat(F.lit("Content: "), F.substring(F.coalesce("text", F.lit("")), 1, most)))
    return hits.select(urn.alias("id"), F.lit("chunk").alias("type"), F.concat(F.lit("Vector match from "), path).alias("note"), block.alias("block"))


def node_evidence(nodes: DataFrame, project: str) -> DataFrame:
    """(id, type, note, block) of graph nodes (id, label, name)."""
    name, label = F.coalesce("name", "id", F.lit("unknown")), F.coalesce("label", F.lit("Node"))
    urn = S.urn(F.lit("neo4j-node"), F.lit(project), F.concat_ws("/", label, name))
    return nodes.select(urn.alias("id"), F.lit("graph").alias("type"), F.concat(F.lit("Graph node "), name).alias("note"), F.concat(F.lit("["), urn, F.lit("]\nNode: "), name, F.lit(" ("), label, F.lit(")")).alias("block"))


def resolve_sources(cited: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(id, type, note) of cited evidence with a valid URN and a known kind (its own or the retrieved one's); all retrieved evidence if none is left."""
    r = retrieved.groupBy("id").agg(F.first("type", ignorenulls=True).alias("__type"), F.first("note", ignorenulls=True).alias("__note"))
    j = cited.where(S.is_urn(F.col("id"))).join(r, "id", "left")
    kind = F.when(F.col("type").isin(*EVIDENCE), F.col("type")).otherwise(F.col("__type"))
    good = store.materialize(j.select("id", kind.alias("type"), F.coalesce("note", "__note", F.lit("Relevant evidence")).alias("note")).where(F.col("type").isin(*EVIDENCE)), "sources")
    return good if good.limit(1).count() else retrieved.select("id", "type", "note")


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors needn't have the library installed
