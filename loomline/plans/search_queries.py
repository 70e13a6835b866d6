"""Retrieval queries over embeddings and documents, and their SQL. Chunks are documents; a document's vector is that of its id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import store
from ..functions import scalar as S
from ..operators import search as V
from ..store import table

WORDS = "pricing desk asked for the late mapping of the gateway"


def points(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def docs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text", "source", "lang")


def vector(spark, sf, i: int) -> list[float]:
    return points(spark, sf).where(F.col("id") == i).first()["vector"]  # one row


def v01_collection_info(spark, sf):
    return V.collection_info(points(spark, sf))


def v02_upsert_points(spark, sf):
    p = points(spark, sf).select("id", "label")
    return V.upsert_points(p, p.where("label = 3").withColumn("label", F.lit(-1)))


def v03_dense_topk(spark, sf):
    return V.dense(points(spark, sf), vector(spark, sf, 0), 10)


def v03_dense_filtered(spark, sf):
    return V.dense(points(spark, sf), vector(spark, sf, 0), 10, label=3)


def v03_dense_many(spark, sf):
    """Every vector whose id is divisible by 100 against all vectors."""
    p = points(spark, sf)
    return V.dense_many(p, p.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector"), 5).select("query_id", "id", "score", F.col("rank").cast("bigint").alias("rank"))


def _index(spark, sf) -> V.VectorIndex:
    index = V.VectorIndex(spark, store.fresh_path(spark, "vectors"))
    p = points(spark, sf)
    index.fit(p)
    index.add(p)
    return index


def v01_index_search(spark, sf):
    """Every vector whose id is divisible by 100 against the index."""
    p = points(spark, sf)
    return _index(spark, sf).search(p.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector"), 10)


def v01_index_recall(spark, sf):
    """(queries, enough): whether the index finds nine tenths of the ten nearest of those queries."""
    p = points(spark, sf)
    q = p.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    exact = V.dense_many(p, q, 10).select("query_id", "id")
    found = exact.join(_index(spark, sf).search(q, 10).select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return found.agg(F.countDistinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


def v04_sparse_encode(spark, sf):
    return V.sparse(docs(spark, sf)).groupBy("idx").agg(F.count("*").alias("n"), F.round(F.sum("w"), 4).alias("w"))


def v05_sparse_topk(spark, sf):
    return V.sparse_search(docs(spark, sf), WORDS, 10)


def v06_hybrid_rrf(spark, sf):
    return V.hybrid(points(spark, sf).join(docs(spark, sf), "id"), WORDS, vector(spark, sf, 0), 10)


def v07_delete_by_file(spark, sf):
    return V.delete_by(docs(spark, sf), source="wiki", lang="en")[1]


def v08_semantic_cache(spark, sf):
    return V.semantic_cache(points(spark, sf), vector(spark, sf, 7))


def v09_memory(spark, sf):
    turns = points(spark, sf).join(docs(spark, sf), "id").select("id", "vector", F.lit("2024-01-01").alias("timestamp"), F.coalesce("source", F.lit("?")).alias("role"), F.col("text").alias("content"))
    return V.memory_context(turns, vector(spark, sf, 3), "no such text", 5)


def v11_mentions(spark, sf):
    chunks = docs(spark, sf).select("id", F.array_distinct(F.regexp_extract_all("text", F.lit(r"[a-z_]+\.[a-z_]+"), F.lit(0))).alias("tables"))
    return V.mentions(chunks, "tables", "raw_market.trade_feed", "mart_risk.fx_daily").select("id", F.col("n").cast("bigint").alias("n"))


def v13_corpus_search(spark, sf):
    d = docs(spark, sf)
    parts = [V.corpus_search(d, what, name).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n") for what, name in (("definition", "settle_date"), ("join", "trade_feed"), ("aggregation", "quantity"), ("cast", "price_ccy"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def v14_context_trim(spark, sf):
    ranked = docs(spark, sf).where("text <> ''").select(F.col("source"), F.col("id").alias("rank_id"), "text").where("source IS NOT NULL")
    from pyspark.sql import Window

    r = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("rank_id")))
    return V.trim_context(r, 1500, 3, "source").groupBy("source").agg(F.count("*").alias("n"), F.max("used").cast("bigint").alias("used"))


def v15_response_mode(spark, sf):
    d = docs(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.sum(S.tokens(F.col("text"))).alias("t"))
    return d.select("source", V.response_mode(F.col("n"), F.col("t")).alias("mode"))


def v16_truncate(spark, sf):
    blocks = docs(spark, sf).select(F.col("id").alias("pos"), "text", "source")
    return V.truncate_blocks(blocks, group="source").select("source", "pos", F.col("length").cast("bigint").alias("length"))


def v17_embedding_cache(spark, sf):
    d = docs(spark, sf)
    cache = d.where("source = 'wiki'").select(F.md5(F.concat(F.lit("m:"), "text")).alias("key")).distinct()
    return V.embed_misses(d.select("text"), cache, "m").select("key")


def v18_query_key(spark, sf):
    return docs(spark, sf).select("id", S.cache_key([F.col("text"), F.coalesce("source", F.lit(""))]).alias("key"))


def v19_retrieve(spark, sf):
    p = points(spark, sf).join(docs(spark, sf), "id")
    return V.retrieve(p, vector(spark, sf, 5), 5).select("id", "score", F.col("rank").cast("bigint").alias("rank"), F.length("source").alias("chars"))


def v20_chunk_evidence(spark, sf):
    hits = docs(spark, sf).select("id", "text", F.col("source").alias("file_path"), F.col("lang").alias("chunk_type"), F.lit(None).cast("string").alias("project_id"))
    return V.chunk_evidence(hits, "code", "tpch").select("id", "note", F.md5("block").alias("block"))


def v21_resolve_sources(spark, sf):
    d = docs(spark, sf)
    urn = S.urn(F.lit("qdrant-chunk"), F.lit("tpch"), F.concat(F.lit("code/"), F.col("id").cast("string")))
    cited = d.select(F.when(F.col("source") == "wiki", "no urn").otherwise(urn).alias("id"), F.when(F.col("lang") == "en", "other").otherwise("doc").alias("type"), F.when(F.col("lang") == "de", "cited").alias("note"))
    retrieved = d.where("source = 'web_crawl'").select(urn.alias("id"), F.lit("chunk").alias("type"), F.lit("found").alias("note"))
    return V.resolve_sources(cited, retrieved)


def s_terms(spark, sf):
    return docs(spark, sf).select("id", F.array_join(S.terms(F.col("text")), "|").alias("terms"))


def s_lineage_words(spark, sf):
    return docs(spark, sf).select("id", S.asks_lineage(F.col("text")).alias("asks"))


def s_pii_redact(spark, sf):
    t = table(spark, sf, "customer")
    text = F.concat(F.lit("mail c"), F.col("c_custkey"), F.lit("@shop.example.com or call "), (F.col("c_custkey") + 5550000000), F.lit(", id 123-45-"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit(", card 4111 1111 1111 "), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit("."))
    return t.select("c_custkey", S.redact(text).alias("text"))


def s_urn_roundtrip(spark, sf):
    t = table(spark, sf, "files")
    u = S.urn(F.lit("dataset"), F.col("project_id"), F.col("relative_path"))
    return t.select("id", u.alias("urn"), S.urn_parts(u)["asset_path"].alias("asset_path"), S.is_urn(F.col("relative_path")).alias("path_is_urn")).distinct()


def s_file_names(spark, sf):
    t = table(spark, sf, "files").select("filename").distinct()
    return t.select("filename", S.file_type(F.col("filename")).alias("type"), S.kebab(F.col("filename")).alias("kebab"))


def _cos(q: int) -> str:
    return f"round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {q})), 6)"


_D = "d AS (SELECT doc_id AS id, text, source, lang FROM documents WHERE text IS NOT NULL)"
_SP = r"""
tf AS (SELECT id, term, count(*) AS f FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[a-zA-Z0-9_]+')) AS term FROM d) GROUP BY ALL),
sp AS (SELECT id, ('0x' || right(md5(term), 5))::BIGINT % 262144 AS idx, max(2.5 * f / (f + 1.5)) AS w FROM tf GROUP BY ALL),
qt AS (SELECT term, count(*) AS f FROM (SELECT unnest(regexp_extract_all(lower('{words}'), '[a-zA-Z0-9_]+')) AS term) GROUP BY 1),
q AS (SELECT ('0x' || right(md5(term), 5))::BIGINT % 262144 AS idx, max(2.5 * f / (f + 1.5)) AS qw FROM qt GROUP BY 1)""".replace("{words}", WORDS)

ORACLES = {
    "v20_chunk_evidence": f"WITH {_D} SELECT 'urn:li:qdrant-chunk:tpch:code/' || id AS id, 'Vector match from ' || coalesce(source, 'unknown') AS note, md5('[urn:li:qdrant-chunk:tpch:code/' || id || ']' || chr(10) || 'File: ' || coalesce(source, 'unknown') || chr(10) || 'Type: ' || coalesce(lang, 'unknown') || chr(10) || 'Content: ' || substring(text, 1, 1000)) AS block FROM d",
    "v21_resolve_sources": f"WITH {_D} SELECT 'urn:li:qdrant-chunk:tpch:code/' || id AS id, CASE WHEN lang = 'en' THEN 'chunk' ELSE 'doc' END AS type, CASE WHEN lang = 'de' THEN 'cited' WHEN source = 'web_crawl' THEN 'found' ELSE 'Relevant evidence' END AS note FROM d WHERE source IS DISTINCT FROM 'wiki' AND (lang IS DISTINCT FROM 'en' OR source = 'web_crawl')",
    "v01_index_recall": "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 100 = 0",
    "v01_collection_info": "SELECT count(*) AS points, CAST(max(len(embedding)) AS BIGINT) AS dimensions FROM embeddings",
    "v02_upsert_points": "SELECT vec_id AS id, CASE WHEN label = 3 THEN -1 ELSE label END AS label FROM embeddings",
    "v03_dense_topk": f"SELECT vec_id AS id, {_cos(0)} AS score FROM embeddings e ORDER BY score DESC, id LIMIT 10",
    "v03_dense_filtered": f"SELECT vec_id AS id, {_cos(0)} AS score FROM embeddings e WHERE label = 3 ORDER BY score DESC, id LIMIT 10",
    "v03_dense_many": "SELECT query_id, id, score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) WHERE rank <= 5",
    "v04_sparse_encode": f"WITH {_D}, {_SP} SELECT idx, count(*) AS n, round(sum(w), 4) AS w FROM sp GROUP BY 1",
    "v05_sparse_topk": f"WITH {_D}, {_SP} SELECT id, round(sum(w * qw), 6) AS score FROM sp JOIN q USING (idx) GROUP BY id ORDER BY score DESC, id LIMIT 10",
    "v06_hybrid_rrf": f"WITH d AS (SELECT doc_id AS id, text FROM documents JOIN embeddings ON vec_id = doc_id WHERE text IS NOT NULL), {_SP}, a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT vec_id AS id, {_cos(0)} AS score FROM embeddings e WHERE vec_id IN (SELECT id FROM d)) QUALIFY r <= 20), b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT id, round(sum(w * qw), 6) AS score FROM sp JOIN q USING (idx) GROUP BY id) QUALIFY r <= 20) SELECT id, round(sum(p), 9) AS fused FROM (SELECT id, 0.5 / (60 + r) AS p FROM a UNION ALL SELECT id, 0.5 / (60 + r) FROM b) GROUP BY id ORDER BY fused DESC, id LIMIT 10",
    "v07_delete_by_file": "SELECT count(*) AS deleted FROM documents WHERE text IS NOT NULL AND source = 'wiki' AND lang = 'en'",
    "v08_semantic_cache": f"SELECT * FROM (SELECT vec_id AS id, {_cos(7)} AS score FROM embeddings e ORDER BY score DESC, id LIMIT 1) WHERE score >= 0.95",
    "v09_memory": f"SELECT vec_id AS id, {_cos(3)} AS score, '[2024-01-01] ' || coalesce(source, '?') || ': ' || text AS line FROM embeddings e JOIN documents ON doc_id = vec_id WHERE text IS NOT NULL ORDER BY score DESC, id LIMIT 5",
    "v11_mentions": f"WITH {_D}, m AS (SELECT id, CAST(list_contains(t, 'raw_market.trade_feed') AS INT) + CAST(list_contains(t, 'mart_risk.fx_daily') AS INT) AS n FROM (SELECT id, regexp_extract_all(text, '[a-z_]+\\.[a-z_]+') AS t FROM d)) SELECT id, CAST(n AS BIGINT) AS n FROM m WHERE n > 0",
    "v13_corpus_search": f"WITH {_D} SELECT 'definition' AS what, count(*) FILTER (WHERE regexp_matches(text, '(?i)\\bsettle_date\\s+\\w+(\\(\\d+(,\\s*\\d+)?\\))?')) AS n FROM d UNION ALL SELECT 'join', count(*) FILTER (WHERE regexp_matches(text, '(?i)\\bjoin\\s+(\\w+\\.)*trade_feed\\b')) FROM d UNION ALL SELECT 'aggregation', count(*) FILTER (WHERE regexp_matches(text, '(?i)\\b(sum|avg|min|max|count)\\s*\\(\\s*(distinct\\s+)?(\\w+\\.)?quantity\\s*\\)')) FROM d UNION ALL SELECT 'cast', count(*) FILTER (WHERE regexp_matches(text, '(?i)\\b(cast|convert|try_cast)\\s*\\([^()]*\\bprice_ccy\\b')) FROM d",
    "v14_context_trim": f"WITH {_D}, r AS (SELECT source, length(text) // 4 AS t, row_number() OVER (PARTITION BY source ORDER BY id) AS rank, sum(length(text) // 4) OVER (PARTITION BY source ORDER BY id ROWS UNBOUNDED PRECEDING) AS used FROM d WHERE text <> '' AND source IS NOT NULL) SELECT source, count(*) AS n, CAST(max(used) AS BIGINT) AS used FROM r WHERE rank <= 3 OR used <= 1500 GROUP BY 1",
    "v15_response_mode": f"WITH {_D} SELECT source, CASE WHEN count(*) > 10 OR sum(length(text) // 4) > 1500 THEN 'tree_summarize' ELSE 'compact' END AS mode FROM d GROUP BY 1",
    "v16_truncate": f"WITH {_D}, b AS (SELECT source, id AS pos, CAST(sum(length(text) + 2) OVER (PARTITION BY source ORDER BY id ROWS UNBOUNDED PRECEDING) - 2 AS BIGINT) AS length FROM d) SELECT * FROM b WHERE length // 4 <= 8000",
    "v17_embedding_cache": f"WITH {_D}, k AS (SELECT source, md5('m:' || text) AS key FROM d) SELECT DISTINCT key FROM k WHERE key NOT IN (SELECT key FROM k WHERE source = 'wiki')",
    "v18_query_key": f"WITH {_D} SELECT id, sha256(text || ':' || coalesce(source, '')) AS key FROM d",
    "v19_retrieve": f"WITH p AS (SELECT vec_id AS id, {_cos(5)} AS score, text FROM embeddings e JOIN documents ON doc_id = vec_id WHERE text IS NOT NULL ORDER BY score DESC, id LIMIT 5), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank, sum(length(text) // 4) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM p) SELECT id, score, rank, CAST(least(length(text), 200) AS INT) AS chars FROM r WHERE rank <= 3 OR used <= 1500",
    "s_terms": f"WITH {_D}, t AS (SELECT id, list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_\\\\.]*'), lambda x: trim(x, '.,')) AS l FROM d), u AS (SELECT id, i, j, CASE WHEN j = 1 THEN l[i] ELSE l[i][:-2] END AS w FROM t, unnest(range(1, len(l) + 1)) a(i), (VALUES (1), (2)) b(j) WHERE length(l[i]) > 3 AND (j = 1 OR (l[i][-1] = 's' AND length(l[i]) > 4))), f AS (SELECT id, w, min(i * 2 + j) AS p FROM u GROUP BY ALL), g AS (SELECT id, string_agg(w, '|' ORDER BY p) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) AS r FROM f) WHERE r <= 15 GROUP BY id) SELECT d.id, coalesce(terms, '') AS terms FROM d LEFT JOIN g USING (id)",
    "s_lineage_words": f"WITH {_D} SELECT id, regexp_matches(lower(text), 'lineage|upstream|downstream|depends|dependency|derive|reads|writes|impact|flows') AS asks FROM d",
    "s_pii_redact": "SELECT c_custkey, 'mail [EMAIL] or call ' || CASE WHEN c_custkey + 5550000000 >= 0 THEN '[PHONE]' END || ', id [SSN], card [CARD].' AS text FROM customer",
    "s_urn_roundtrip": r"WITH p AS (SELECT DISTINCT id, project_id, trim(regexp_replace(replace(trim(coalesce(relative_path, '')), '\', '/'), '/+', '/', 'g'), '/') AS path, coalesce(regexp_matches(relative_path, '^urn:li:[^:]*:[^:]*:'), false) AS path_is_urn FROM files) SELECT id, 'urn:li:dataset:' || coalesce(nullif(project_id, ''), 'default') || ':' || CASE WHEN path = '' THEN 'unknown' ELSE path END AS urn, CASE WHEN path = '' THEN 'unknown' ELSE path END AS asset_path, path_is_urn FROM p",
    "s_file_names": r"SELECT DISTINCT filename, CASE WHEN e = 'py' THEN 'python' WHEN e <> '' THEN e ELSE 'unknown' END AS type, trim(regexp_replace(lower(filename), '[^a-z0-9]+', '-', 'g'), '-') AS kebab FROM (SELECT filename, lower(regexp_extract(filename, '[^/]\.([^./]+)$', 1)) AS e FROM files)",
}
#: The index has its own order of equal scores; its recall is compared.
QUERIES = {n: globals()[n] for n in (*ORACLES, "v01_index_search")}
