"""Parsing and chunking queries, and their SQL. The documents are the code: comments, tables, functions and prose of all kinds;
scripts with headers, routines and writes are put together from the order tables' names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sql_functions
from ..operators import chunking as K
from ..operators import parsing as P
from ..sources import tables as T
from ..store import table


def code(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.concat_ws("/", F.coalesce("source", F.lit("none")), F.col("doc_id").cast("string")).alias("path"))


def scripts(spark, sf) -> DataFrame:
    """A script for each supplier: a routine, two views, a table and reads."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("k"))
    k = F.col("k")
    sql = F.concat(F.lit("-- load of "), k, F.lit("\nCREATE OR REPLACE VIEW rep.v_"), k, F.lit(" AS SELECT a.qty * 2 AS double_qty FROM raw.t_"), k, F.lit(" a JOIN raw.dim d ON a.id = d.id;\nCREATE TABLE dw.f_"), k, F.lit(" AS WITH x AS (SELECT * FROM stg.s_"), k, F.lit(") SELECT sum(x.amt) AS total FROM x;\nCREATE OR ALTER PROCEDURE dw.p_"), k, F.lit(" AS INSERT INTO dw.log VALUES (1);\nEXEC dw.p_clean;\nCREATE VIEW rep.w_"), k, F.lit(" AS SELECT 1;\n"))
    return s.select("k", F.concat(F.lit("etl/"), k, F.lit(".sql")).alias("path"), sql.alias("content"))


def headers(spark, sf) -> DataFrame:
    """A script with object headers for each supplier."""
    k = F.col("s_suppkey").cast("string")
    head = lambda t, n: F.concat(F.lit(f"/****** Object:  {t} [dbo].[{n}"), k, F.lit("]    Script Date: 1/1/2024 ******/\n"))
    sql = F.concat(F.lit("USE db\nGO\n"), head("Table", "T"), F.lit("CREATE TABLE [dbo].[T"), k, F.lit("](id int)\nGO\n"), head("Index", "IX"), F.lit("CREATE UNIQUE NONCLUSTERED INDEX [IX] ON [dbo].[T"), k, F.lit("] (id)\nGO\n"), head("ForeignKey", "FK"), F.lit("ALTER TABLE [dbo].[T"), k, F.lit("] WITH CHECK ADD CONSTRAINT [FK"), k, F.lit("] FOREIGN KEY(id) REFERENCES [dbo].[X] (id)\nEXEC sys.sp_addextendedproperty @name=N'owner', @value=N'team "), k, F.lit("'\n"))
    return table(spark, sf, "supplier").select(F.concat(F.lit("s"), k).alias("path"), sql.alias("content"))


def ps01_sql_lineage(spark, sf):
    j = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return P.intended_lineage(scripts(spark, sf)).select("path", "write", j("reads"), j("writes"), j("views"), j("routines"), j("calls"))


def ps01_column_lineage(spark, sf):
    return P.column_lineage(scripts(spark, sf).select("path", "content")).select("path", "target", F.array_join("sources", ",").alias("sources"), "transformation")


def ps02_regex_lineage(spark, sf):
    return P.regex_lineage(code(spark, sf)).select("id", "write", F.array_join("routines", ",").alias("routines"), F.array_join("views", ",").alias("views"))


def ps04_graph_of_scripts(spark, sf):
    n, e = P.to_graph(P.intended_lineage(scripts(spark, sf)), "tpch")
    a = n.groupBy("label").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), F.col("label").alias("name"), "n")
    return a.unionByName(e.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), F.col("type").alias("name"), "n"))


def ps04_columns(spark, sf):
    """Edges by type of the scripts' whole graph: columns, transformations and fallback nodes included."""
    n, e = P.full_graph(scripts(spark, sf), "tpch")
    a = n.groupBy("label").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), F.col("label").alias("name"), "n")
    return a.unionByName(e.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), F.col("type").alias("name"), "n"))


def ps04_transformations(spark, sf):
    """The key and logic of each column's transformation."""
    rows = P.column_lineage(P.intended_lineage(scripts(spark, sf)))
    n, _ = P.column_graph(rows, "tpch")
    return n.where("label = 'Transformation'").select("id", "name")


def ps05_attachments(spark, sf):
    k = F.col("s_suppkey").cast("string")
    sql = F.concat(F.lit("CREATE TRIGGER dw.tr_"), k, F.lit(" AFTER INSERT ON dw.t_"), k, F.lit(" AS BEGIN END;\nCREATE SYNONYM dbo.s_"), k, F.lit(" FOR dw.t_"), k, F.lit(";\n"))
    return P.attachments(table(spark, sf, "supplier").select(k.alias("path"), sql.alias("content")), "tpch")


def ps21_object_filters(spark, sf):
    """Objects by type, and tables with children."""
    o = P.header_objects(headers(spark, sf))
    found = P.tables_with_children(o, P.group_children(o)).select("path", F.lit("with_children").alias("what"))
    return found.unionByName(P.objects_of(o, "INDEX").select("path", F.lit("index").alias("what"))).unionByName(P.indexed_views(o, P.group_children(o)).select("path", F.lit("indexed_view").alias("what")))


def k03_chunk_records(spark, sf):
    """Spans, tables, columns and functions of the scripts' chunks."""
    r = K.chunk_records(scripts(spark, sf), ("path",))
    return r.select("path", "chunk_no", "language", "kind", "start_line", "end_line", F.array_join("tables", ",").alias("tables"), F.array_join("columns", ",").alias("columns"), F.array_join("functions", ",").alias("functions"), "tokens")


def k03_oversized(spark, sf):
    """Statements over the token budget: without and with common table expressions, and with subqueries, one of each for each supplier."""
    k = F.col("s_suppkey").cast("string")
    wide = F.repeat(F.lit("aaaaaaaaaa + "), 250)
    sub = F.concat(F.lit("SELECT * FROM (SELECT a.x FROM dw.t_"), k, F.lit(" a) q, (SELECT b.y FROM dw.u_"), k, F.lit(" b) r WHERE "), wide, wide, F.lit("1 > 0"))
    cte = F.concat(F.lit("WITH one AS (SELECT "), wide, F.lit("1 AS x FROM dw.t_"), k, F.lit("), two AS (SELECT "), wide, F.lit("2 AS y FROM one) SELECT * FROM one, two"))
    files = table(spark, sf, "supplier").select(F.explode(F.array(F.struct(F.concat(F.lit("sub/"), k, F.lit(".sql")).alias("path"), sub.alias("content")), F.struct(F.concat(F.lit("cte/"), k, F.lit(".sql")).alias("path"), cte.alias("content")))).alias("f")).select("f.*")
    return K.chunk_records(files, ("path",)).select("path", "chunk_no", "kind", F.array_join("tables", ",").alias("tables"), F.array_join("dependencies", ",").alias("dependencies"), "context")


def ps07_python_ast(spark, sf):
    return P.python_lineage(code(spark, sf).select("id", "content")).select("id", F.size("functions").alias("functions"), F.size("classes").alias("classes"), F.size("imports").alias("imports"), "ok")


def ps08_python_tables(spark, sf):
    return code(spark, sf).select("id", F.array_join(P.python_tables(F.col("content")), ",").alias("tables"))


def ps10_json_summary(spark, sf):
    s = P.json_summary(F.col("props"))
    return table(spark, sf, "events").select("event_id", s["type"].alias("type"), F.array_join(s["keys"], ",").alias("keys"))


def ps11_json_enrichment(spark, sf):
    t = table(spark, sf, "nation")
    body = F.concat(F.lit('{"'), "n_name", F.lit('": {"owner": "o'), "n_nationkey", F.lit('", "x": 1}, "skip": {"x": 2}, "n": 3}'))
    return P.json_enrichments(t.select(body.alias("content"))).select("name", "owner")


def ps12_json_graph(spark, sf):
    t = table(spark, sf, "events").select(F.concat(F.lit("e"), "event_id").alias("path"), F.col("props").alias("content"))
    n, e = P.json_graph(t, "tpch")
    return n.groupBy("label").agg(F.count("*").alias("n")).unionByName(e.groupBy("type").agg(F.count("*").alias("n")).select(F.col("type").alias("label"), "n"))


def ps15_classify(spark, sf):
    return P.classify(scripts(spark, sf).select("path", "content")).select("path", "kind", "schema", "name", F.length("statement").alias("size"))


def ps16_header_objects(spark, sf):
    return P.header_objects(headers(spark, sf)).select("path", "kind", "schema", "name", "parent")


def ps19_group_children(spark, sf):
    return P.group_children(P.header_objects(headers(spark, sf))).select("path", "parent_name", "child_kind", F.array_join("children", ",").alias("children"))


def ps20_extended_properties(spark, sf):
    return headers(spark, sf).select("path", F.inline(P.extended_properties(F.col("content"))))


def k01_sql_chunks(spark, sf):
    return K.chunk_files(scripts(spark, sf), ("path",)).groupBy("path", "kind").agg(F.count("*").alias("chunks"))


def k04_domain_chunks(spark, sf):
    return K.domain_chunks(scripts(spark, sf).select("path", "content")).select("path", F.col("chunk_no").cast("bigint").alias("chunk_no"), "domain", F.length("chunk").alias("size"))


def k06_python_chunks(spark, sf):
    return K.chunk_files(code(spark, sf), ("id",), extension=F.lit("py"))


def k08_generic_chunks(spark, sf):
    return K.chunk_files(code(spark, sf), ("id",), extension=F.lit("txt")).select("id", "chunk_no", "chunk", "tokens")


def k10_chunk_tables(spark, sf):
    return code(spark, sf).select("id", F.array_join(K.tables_of(F.col("content")), ",").alias("tables"))


def k12_embedding_text(spark, sf):
    c = code(spark, sf)
    return c.select("id", K.embedding_text(F.lit(""), F.col("path"), F.lit("generic"), K.tables_of(F.col("content")), F.col("content")).alias("text"))


def k14_cache_misses(spark, sf):
    c = code(spark, sf)
    cache = c.where("path LIKE 'wiki/%'").select(F.sha2("content", 256).alias("file_hash"), F.lit(1).alias("schema_version"), F.current_timestamp().alias("created_at"))
    return K.cache_misses(c, cache, 1).select("id", "file_hash")


def sk08_chunk_names(spark, sf):
    return T.chunk_names(K.domain_chunks(scripts(spark, sf).select("path", "content"))).select("path", F.col("chunk_no").cast("bigint").alias("chunk_no"), "object_type", "object_name")


def sk09_object_files(spark, sf):
    return T.manifest(T.object_files(P.classify(scripts(spark, sf).select("path", "content")))).select("kind", "n")


def sk10_hierarchy(spark, sf):
    o = P.header_objects(headers(spark, sf))
    return T.hierarchy(o, P.group_children(o))


def _views(spark, sf):
    table(spark, sf, "runs").createOrReplaceTempView("runs")
    table(spark, sf, "files").createOrReplaceTempView("files")
    sql_functions.register(spark)


def udf_sql_functions(spark, sf):
    """The scalar SQL function: the next sequence of every run's project and time."""
    _views(spark, sf)
    return spark.sql("SELECT r.id, get_next_sequence(r.project_id, r.timestamp) AS next FROM (SELECT DISTINCT id, project_id, timestamp FROM runs) r")


def udf_duplicate_files(spark, sf):
    """The table SQL function: for every file the first of its project and repository with its content."""
    _views(spark, sf)
    return spark.sql("SELECT f.id, d.id AS first FROM (SELECT DISTINCT id, project_id, repository_id, file_hash FROM files) f, LATERAL find_duplicate_file(f.project_id, f.repository_id, f.file_hash) d")


def udtf_code_entities(spark, sf):
    code(spark, sf).createOrReplaceTempView("code_texts")
    spark.udtf.register("code_entities", sql_functions.CodeEntities)
    return spark.sql("SELECT c.id, e.kind, count(*) AS n FROM code_texts c, LATERAL code_entities(c.content) e GROUP BY c.id, e.kind")


_D = "d AS (SELECT doc_id AS id, text AS content, coalesce(source, 'none') || '/' || doc_id AS path FROM documents WHERE text IS NOT NULL)"
_K = "s AS (SELECT CAST(s_suppkey AS VARCHAR) AS k, 'etl/' || s_suppkey || '.sql' AS path FROM supplier)"
_LIST = lambda pattern, g=1: f"coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(content, '{pattern}', {g}))), ','), '')"

ORACLES = {
    "sk08_chunk_names": f"WITH {_K} SELECT path, CAST(u.no AS BIGINT) AS chunk_no, u.t AS object_type, u.n || k AS object_name FROM s, (VALUES (0, 'VIEW', 'rep.v_'), (1, 'VIEW', 'rep.w_'), (2, 'TABLE', 'dw.f_'), (3, 'PROCEDURE', 'dw.p_')) u(no, t, n)",
    "sk09_object_files": "SELECT u.kind, count(*) * u.m AS n FROM supplier, (VALUES ('VIEW', 2), ('TABLE', 1), ('PROCEDURE', 1)) u(kind, m) GROUP BY u.kind, u.m",
    "sk10_hierarchy": "SELECT 's' || s_suppkey AS path, 'table/dbo.T' || s_suppkey || u.x AS folder, CAST(1 AS BIGINT) AS n FROM supplier, (VALUES (''), ('/indexes'), ('/foreign_keys')) u(x)",
    "udf_sql_functions": "SELECT DISTINCT r.id, CAST(coalesce((SELECT max(sequence) FROM runs q WHERE q.project_id = r.project_id AND q.timestamp = r.timestamp), 0) + 1 AS INT) AS next FROM (SELECT DISTINCT id, project_id, timestamp FROM runs) r",
    "udf_duplicate_files": "SELECT f.id, (SELECT arg_min(g.id, ROW(g.created_at, g.id)) FROM files g WHERE g.project_id = f.project_id AND g.repository_id IS NOT DISTINCT FROM f.repository_id AND g.file_hash = f.file_hash) AS first FROM (SELECT DISTINCT id, project_id, repository_id, file_hash FROM files) f WHERE f.project_id IS NOT NULL AND f.file_hash IS NOT NULL",
    "ps01_sql_lineage": f"WITH {_K} SELECT path, 'dw.f_' || k AS write, 'raw.dim,raw.t_' || k || ',stg.s_' || k AS reads, 'dw.f_' || k || ',dw.log' AS writes, 'rep.v_' || k || ',rep.w_' || k AS views, 'dw.p_' || k AS routines, 'dw.p_clean' AS calls FROM s",
    "ps01_column_lineage": f"WITH {_K} SELECT path, 'double_qty' AS target, 'a.qty' AS sources, 'a.qty * 2' AS transformation FROM s UNION ALL SELECT path, 'total', 'x.amt', 'sum(x.amt)' FROM s",
    "ps02_regex_lineage": f"WITH {_D} SELECT id, nullif(regexp_extract(content, '(?i)CREATE\\s+TABLE\\s+([a-zA-Z0-9_\\.]+)', 1), '') AS write, {_LIST('(?i)CREATE\\s+(?:OR\\s+ALTER\\s+|OR\\s+REPLACE\\s+)?(?:PROCEDURE|PROC|FUNCTION)\\s+([a-zA-Z0-9_\\.]+)')} AS routines, {_LIST('(?i)CREATE\\s+(?:OR\\s+ALTER\\s+|OR\\s+REPLACE\\s+)?VIEW\\s+([a-zA-Z0-9_\\.]+)')} AS views FROM d",
    "ps04_graph_of_scripts": "WITH c AS (SELECT count(*) AS n FROM supplier) SELECT 'node' AS kind, u.name, CASE u.m WHEN 0 THEN u.extra ELSE n * u.m + u.extra END AS n FROM c, (VALUES ('File', 1, 0), ('Table', 1, 1), ('DataAsset', 2, 1), ('View', 2, 0), ('FunctionOrProcedure', 1, 1)) u(name, m, extra) UNION ALL SELECT 'edge', u.name, n * u.m FROM c, (VALUES ('DERIVES', 3), ('CONTAINS', 5), ('CALLS', 1)) u(name, m)",
    "ps04_columns": "WITH c AS (SELECT count(*) AS n FROM supplier) SELECT 'node' AS kind, u.name, CASE u.m WHEN 0 THEN u.extra ELSE n * u.m + u.extra END AS n FROM c, (VALUES ('File', 1, 0), ('Table', 1, 1), ('DataAsset', 2, 3), ('View', 2, 0), ('FunctionOrProcedure', 1, 1), ('Column', 2, 2), ('Transformation', 2, 0)) u(name, m, extra) UNION ALL SELECT 'edge', u.name, n * u.m + u.extra FROM c, (VALUES ('DERIVES', 3, 0), ('CONTAINS', 7, 2), ('CALLS', 1, 0), ('GENERATES', 2, 0), ('INPUT_TO', 2, 0)) u(name, m, extra)",
    "ps04_transformations": f"WITH {_K} SELECT 'urn:li:Transformation:tpch:transformation:' || sha256('dw.f_' || k || '.' || u.c || ':' || u.l) AS id, u.l AS name FROM s, (VALUES ('double_qty', 'a.qty * 2'), ('total', 'sum(x.amt)')) u(c, l)",
    "ps05_attachments": "SELECT 'urn:li:Trigger:tpch:dw.tr_' || s_suppkey AS source_id, 'urn:li:DataAsset:tpch:dw.t_' || s_suppkey AS target_id, 'ATTACHED_TO' AS type FROM supplier UNION ALL SELECT 'urn:li:Synonym:tpch:dbo.s_' || s_suppkey, 'urn:li:DataAsset:tpch:dw.t_' || s_suppkey, 'ALIAS_OF' FROM supplier",
    "ps21_object_filters": "SELECT 's' || s_suppkey AS path, u.what FROM supplier, (VALUES ('with_children'), ('index')) u(what)",
    "k03_chunk_records": f"""WITH {_K} SELECT path, u.no AS chunk_no, 'sql' AS language, 'SQL_STATEMENT' AS kind, u.a AS start_line, u.b AS end_line, replace(u.t, '#', k) AS tables, u.c AS columns, replace(u.f, '#', k) AS functions, CAST(floor(length(replace(u.x, '#', k)) / 4) AS INT) AS tokens
      FROM s, (VALUES (0, 1, 2, 'raw.dim,raw.t_#', 'a.id,a.qty,d.id,rep.v_#', '', '-- load of #' || chr(10) || 'CREATE OR REPLACE VIEW rep.v_# AS SELECT a.qty * 2 AS double_qty FROM raw.t_# a JOIN raw.dim d ON a.id = d.id;'),
      (1, 3, 3, 'stg.s_#,x', 'dw.f_#,x.amt', '', 'CREATE TABLE dw.f_# AS WITH x AS (SELECT * FROM stg.s_#) SELECT sum(x.amt) AS total FROM x;'),
      (2, 4, 4, 'dw.log', 'dw.p_#', 'dw.p_#', 'CREATE OR ALTER PROCEDURE dw.p_# AS INSERT INTO dw.log VALUES (1);'), (3, 5, 5, '', 'dw.p_clean', '', 'EXEC dw.p_clean;'), (4, 6, 6, '', 'rep.w_#', '', 'CREATE VIEW rep.w_# AS SELECT 1;')) u(no, a, b, t, c, f, x)""".replace("u.c AS columns", "replace(u.c, '#', k) AS columns"),
    "k03_oversized": "SELECT u.p || '/' || s_suppkey || '.sql' AS path, u.no AS chunk_no, u.kind, replace(u.t, '#', CAST(s_suppkey AS VARCHAR)) AS tables, u.d AS dependencies, u.c AS context FROM supplier, (VALUES ('sub', 0, 'SQL_SUBQUERY', 'dw.t_#', '', ''), ('sub', 1, 'SQL_SUBQUERY', 'dw.u_#', '', ''), ('cte', 0, 'SQL_CTE', 'dw.t_#', '', ''), ('cte', 1, 'SQL_CTE', 'one', 'one', '-- CTEs defined: one'), ('cte', 2, 'SQL_STATEMENT', 'one', 'one,two', '-- CTEs defined: one, two')) u(p, no, kind, t, d, c)",
    "ps08_python_tables": f"WITH {_D} SELECT id, coalesce(array_to_string(list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(content, '(?i)\\b(?:FROM|JOIN)\\s+([a-zA-Z0-9_\\.]+)', 1), regexp_extract_all(content, '(?i)\\bINSERT\\s+INTO\\s+([a-zA-Z0-9_\\.]+)', 1)), regexp_extract_all(content, '(?i)\\bUPDATE\\s+([a-zA-Z0-9_\\.]+)', 1)))), ','), '') AS tables FROM d",
    "ps10_json_summary": "SELECT event_id, CASE json_type(props) WHEN 'OBJECT' THEN 'dict' WHEN 'ARRAY' THEN 'list' ELSE 'scalar' END AS type, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events",
    "ps11_json_enrichment": "SELECT n_name AS name, 'o' || n_nationkey AS owner FROM nation",
    "ps12_json_graph": "SELECT 'JsonDocument' AS label, count(*) AS n FROM events UNION ALL SELECT 'JsonKey', sum(len(json_keys(props)))::BIGINT FROM events UNION ALL SELECT 'HAS_KEY', sum(len(json_keys(props)))::BIGINT FROM events",
    "ps15_classify": f"WITH {_K} SELECT path, u.kind, u.schema, u.name || k AS name, length(replace(u.t, '#', k)) AS size FROM s, (VALUES ('VIEW', 'rep', 'v_', 'CREATE OR REPLACE VIEW rep.v_# AS SELECT a.qty * 2 AS double_qty FROM raw.t_# a JOIN raw.dim d ON a.id = d.id'), ('VIEW', 'rep', 'w_', 'CREATE VIEW rep.w_# AS SELECT 1'), ('TABLE', 'dw', 'f_', 'CREATE TABLE dw.f_# AS WITH x AS (SELECT * FROM stg.s_#) SELECT sum(x.amt) AS total FROM x'), ('PROCEDURE', 'dw', 'p_', 'CREATE OR ALTER PROCEDURE dw.p_# AS INSERT INTO dw.log VALUES (1)')) u(kind, schema, name, t)",
    "ps16_header_objects": "SELECT 's' || s_suppkey AS path, u.kind, 'dbo' AS schema, u.p || s_suppkey AS name, CASE WHEN u.kind <> 'TABLE' THEN '[dbo].[T' || s_suppkey || ']' END AS parent FROM supplier, (VALUES ('TABLE', 'T'), ('INDEX', 'IX'), ('FOREIGN_KEY', 'FK')) u(kind, p)",
    "ps19_group_children": "SELECT 's' || s_suppkey AS path, '[dbo].[T' || s_suppkey || ']' AS parent_name, u.kind AS child_kind, '[dbo].[' || u.p || s_suppkey || ']' AS children FROM supplier, (VALUES ('indexes', 'IX'), ('foreign_keys', 'FK')) u(kind, p)",
    "ps20_extended_properties": "SELECT 's' || s_suppkey AS path, 'owner' AS name, 'team ' || s_suppkey AS value FROM supplier",
    "k01_sql_chunks": f"WITH {_K} SELECT path, 'SQL_STATEMENT' AS kind, CAST(5 AS BIGINT) AS chunks FROM s",
    "k10_chunk_tables": f"WITH {_D} SELECT id, {_LIST('(?i)\\b(?:FROM|JOIN|INTO|UPDATE)\\s+([a-zA-Z_][\\w.]*)')} AS tables FROM d",
    "k12_embedding_text": f"WITH {_D}, t AS (SELECT *, {_LIST('(?i)\\b(?:FROM|JOIN|INTO|UPDATE)\\s+([a-zA-Z_][\\w.]*)')} AS tables FROM d) SELECT id, '-- File: ' || path || chr(10) || '-- Type: generic' || chr(10) || CASE WHEN tables <> '' THEN '-- Tables: ' || replace(tables, ',', ', ') || chr(10) ELSE '' END || content AS text FROM t",
    "k14_cache_misses": f"WITH {_D} SELECT id, sha256(content) AS file_hash FROM d WHERE sha256(content) NOT IN (SELECT sha256(content) FROM d WHERE path LIKE 'wiki/%')",
    "k04_domain_chunks": f"WITH {_K} SELECT path, CAST(u.no AS BIGINT) AS chunk_no, u.domain, length(replace(u.t, '#', k)) AS size FROM s, (VALUES (0, 'VIEW', 'CREATE OR REPLACE VIEW rep.v_# AS SELECT a.qty * 2 AS double_qty FROM raw.t_# a JOIN raw.dim d ON a.id = d.id;'), (1, 'VIEW', 'CREATE VIEW rep.w_# AS SELECT 1;'), (2, 'TABLE', 'CREATE TABLE dw.f_# AS WITH x AS (SELECT * FROM stg.s_#) SELECT sum(x.amt) AS total FROM x;'), (3, 'PROCEDURE', 'CREATE OR ALTER PROCEDURE dw.p_# AS INSERT INTO dw.log VALUES (1);' || chr(10) || 'EXEC dw.p_clean;')) u(no, domain, t)",
}
QUERIES = {n: globals()[n] for n in (*ORACLES, "ps07_python_ast", "udtf_code_entities", "k06_python_chunks", "k08_generic_chunks")}
