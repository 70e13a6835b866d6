from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from loomline.operators import chunking as K
from loomline.operators import logs as L
from loomline.operators import metadata as M
from loomline.operators import parsing as P
from loomline.operators import sqlapi as Q

SQL = """-- FROM ignored
WITH c AS (SELECT * FROM raw.orders o, raw.items i), d AS (SELECT 1)
INSERT INTO dw.sales SELECT sum(c.amt) AS total FROM c JOIN [dbo].[dim x] x ON 1 = 1 WHERE s = 'FROM nowhere';
CREATE MATERIALIZED VIEW dw.mv AS SELECT 1; CREATE TRIGGER dw.tr AFTER INSERT; CREATE SYNONYM dw.sy FOR a.b; EXEC dw.proc1; DELETE FROM dw.old WHERE 1 = 0; UPDATE dw.upd SET a = 1;"""


def test_sql_lineage(spark):
    r = P.intended_lineage(spark.createDataFrame([("f", SQL)], "path string, content string")).first()
    assert r["reads"] == ["dbo.dimx", "raw.items", "raw.orders"] and set(r["writes"]) == {"dw.sales", "dw.old", "dw.upd"} and r["write"] == "dw.sales"
    assert (r["materialized_views"], r["triggers"], r["synonyms"], r["calls"]) == (["dw.mv"], ["dw.tr"], ["dw.sy"], ["dw.proc1"])
    none = P.intended_lineage(spark.createDataFrame([("f", ""), ("g", "SELECT 1 FROM t"), ("h", None)], "path string, content string")).orderBy("path").collect()
    assert [x["write"] for x in none] == [None, "console", None]


def test_spark_parser(spark):
    r = P.spark_lineage(spark, "CREATE TABLE dw.f AS WITH x AS (SELECT * FROM stg.s) SELECT sum(x.amt) AS total FROM x JOIN dim.d ON x.id = d.id")
    assert r["reads"] == ["dim.d", "stg.s"] and r["writes"] == ["dw.f"]
    assert P.spark_lineage(spark, "INSERT INTO t.a SELECT * FROM t.b")["writes"] == ["t.a"]
    with pytest.raises(ValueError):
        P.spark_lineage(spark, "CREATE PROCEDURE x AS BEGIN EXEC y END")


def test_python_and_json(spark):
    code = "import os\nfrom a.b import c\nclass K(Base):\n    '''doc'''\n    def m(self): pass\nasync def no(): pass\ndef f(x, y):\n    return 'select 1 from dw.t join dw.u'\n"
    df = spark.createDataFrame([(1, code), (2, "def broken(:\n  import x"), (3, None), (4, "")], "id int, content string")
    r = {x["id"]: x for x in P.python_lineage(df).collect()}
    assert [f["name"] for f in r[1]["functions"]] == ["f", "m"] and r[1]["classes"][0]["bases"] == ["Base"] and r[1]["imports"] == ["os", "a.b"] and r[1]["tables"] == ["a.b", "dw.t", "dw.u"]
    assert r[2]["ok"] is False and [f["name"] for f in r[2]["functions"]] == ["broken"] and r[3]["functions"] == []
    j = spark.createDataFrame([('[{"name": "t", "owner": "o"}, {"x": 1}, 3]',), ('{"tables": [{"table": "u", "sla": "1h"}]}',), ('{"v": {"tags": ["a"], "name": "w"}, "n": 1}',), ("broken",), (None,)], "content string")
    assert rows(P.json_enrichments(j).select("name", "owner", "sla")) == sorted([("t", "o", None), ("u", None, "1h"), ("w", None, None)], key=repr)
    s = j.select(P.json_summary(F.col("content")).alias("s")).collect()
    assert s[0]["s"]["type"] == "list" and s[0]["s"]["keys"] == ["name", "owner"] and s[0]["s"]["array_length"] == 3 and s[3]["s"] is None and s[4]["s"] is None


def test_registry_and_dialects():
    r = P.default_registry()
    assert r.get(".SQL") is P.intended_lineage and r.get(".txt") is None and P.dialect("auto") == "tsql" and len(P.DIALECTS) == 18
    with pytest.raises(ValueError):
        P.dialect("cobol")


def test_packing():
    assert K.pack(["x" * 400] * 5, 250, "|") == ["|".join(["x" * 400] * 2)] * 2 + ["x" * 400]
    assert K.pack_statements("a; b;;") == ["a;\n\nb;"] and K.pack_lines("") == [""]
    text = "\n".join(f"{i:04}" + "y" * 396 for i in range(40))
    parts = K.pack_overlapping(text)
    assert parts[1][0].startswith(f"{parts[0][2] - 5:04}") and parts[-1][2] == 40
    assert K.sql_chunks("SELECT ';' ; CREATE FUNCTION f() AS $$ a; b; $$; -- c; d\nSELECT 2") == ["SELECT ';' ;", "CREATE FUNCTION f() AS $$ a; b; $$;", "-- c; d\nSELECT 2"]
    big = "WITH a AS (SELECT 1 " + "x" * 3500 + "), b AS (SELECT * FROM a " + "y" * 3500 + ") SELECT * FROM b"
    parts = [c for _, c, *_ in K.cut_statement(big)]
    assert len(parts) == 3 and parts[1].startswith("WITH a AS") and parts[2].endswith("SELECT * FROM b")
    kinds = [k for k, *_ in K.python_chunks("import os\n@d\ndef f():\n    pass\nclass A:\n    def m(self):\n        pass\n")]
    assert kinds == ["PYTHON_IMPORT", "PYTHON_FUNCTION", "PYTHON_CLASS"] and K.python_chunks("def (")[0][0] == "GENERIC"


def test_registration(spark):
    schema = "id string, project_id string, repository_id string, relative_path string, file_hash string, created_at timestamp_ntz"
    old = spark.createDataFrame([("1", "p", None, "a.sql", "h1", datetime(2024, 1, 1)), ("2", "p", None, "a.sql", "h2", datetime(2024, 1, 2))], schema)
    new = spark.createDataFrame([("3", "p", None, "a.sql", "h1", None), ("4", "p", None, "a.sql", "h3", None), ("5", "p", "r", "a.sql", "h1", None)], schema)
    assert {r["id"]: (r["registration"], r["supersedes"]) for r in M.register(old, new).collect()} == {"3": ("duplicate", None), "4": ("new_version", "2"), "5": ("new_file", None)}
    texts = ['{"description": "d", "domain_hints": ["a", "b"], "format": "text"}', '{"description": 1, "format": "x"}', '{"source_entities": "x", "domain_hints": [1]}', "oops", '{"domain_hints": []}']
    c = spark.createDataFrame([(t,) for t in texts], "c string")
    got = c.select(F.size(M.context_errors(F.col("c"))), M.context_block(F.col("c"))).collect()
    assert [r[0] for r in got] == [0, 2, 2, 1, 0] and got[0][1] == "<project_context>\n  <description>d</description>\n  <format>text</format>\n  <domain_hints>a, b</domain_hints>\n</project_context>" and got[4][1] == ""


def test_sql_surface(spark):
    t = {"people": spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")}
    assert Q.rows(Q.query(spark, "SELECT name FROM people WHERE id = 2 -- DROP", t)) == {"columns": ["name"], "rows": [["b"]], "row_count": 1, "truncated": False}
    for sql in ("DELETE FROM people", "SELECT 'DROP'", "  ", "VALUES (1)", "SELECT 1 /* */ ; DROP TABLE x", "EXEC x"):
        with pytest.raises(Q.RefusedSQL):
            Q.query(spark, sql, t)
    assert "people" not in [x.name for x in spark.catalog.listTables()]
    slow = Q.query(spark, "SELECT count(*) AS n FROM range(100000000000) WHERE hash(id) = 1")
    with pytest.raises(Exception, match="(?i)cancel"):
        Q.rows(slow, timeout=2)
    assert not spark.sparkContext.getJobTags() and Q.rows(Q.query(spark, "SELECT count(*) AS n FROM people", t))["rows"] == [[2]]


def test_logs_and_quality(spark):
    e = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate((10, 20, 0, 40))] + [("b", 0, None)], "k string, i int, value double")
    assert rows(L.ema(e, "k", ("i",))) == [("a", round(0.3 * 40 + 0.7 * (0.7 * 13), 6))]
    h = {(r["k"], r["bucket"]): r["n"] for r in L.histogram(e, (0.0, 20.0), "k").collect()}
    assert h == {("a", "0.0"): 1, ("a", "20.0"): 3, ("a", "+Inf"): 4}
    assert L.percentiles(e, "k", (0.5, 0.99)).first()["p50"] == 20.0
    ranked = spark.createDataFrame([("q", "x", 1), ("q", "r1", 2), ("q", "r2", 3), ("z", "x", 1)], "query_id string, id string, rank int")
    relevant = spark.createDataFrame([("q", "r1"), ("q", "r2"), ("q", "r3"), ("z", "y")], "query_id string, id string")
    m = {r["query_id"]: r for r in L.retrieval_quality(ranked, relevant, 3).collect()}
    assert m["q"]["precision"] == round(2 / 3, 6) and m["q"]["rr"] == 0.5 and m["z"]["rr"] == 0.0 and 0 < m["q"]["ndcg"] < 1
