"""Code into rows: lineage of SQL, Python and JSON files, SQL objects, and their graph.

What regular expressions can say is said by built-in functions over a column of texts. Syntax trees (Python's
own, and Spark's SQL parser) need imperative code: Python is parsed in an Arrow map over the files, SQL
statements by Spark's parser where the text is Spark SQL, else by the patterns.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S

NAME = r"([a-zA-Z0-9_\.]+)"
OR = r"(?:OR\s+ALTER\s+|OR\s+REPLACE\s+)?"
#: Object kinds and the statements that create them.
ROUTINE = rf"(?i)CREATE\s+{OR}(?:PROCEDURE|PROC|FUNCTION)\s+{NAME}"
VIEW = rf"(?i)CREATE\s+{OR}VIEW\s+{NAME}"
TABLE = rf"(?i)CREATE\s+TABLE\s+{NAME}"
#: Calls that are no procedures.
BUILT_IN_CALLS = ("count", "sum", "avg", "min", "max", "cast", "convert")


def find(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def regex_lineage(files: DataFrame, content: str = "content") -> DataFrame:
    """files with routines, views (distinct, sorted) and write (the first created table, or null); reads stay empty."""
    c = F.col(content)
    return files.withColumns({
        "reads": F.array().cast("array<string>"),
        "write": F.try_element_at(find(c, TABLE), F.lit(1)),
        "routines": F.array_sort(F.array_distinct(find(c, ROUTINE))),
        "views": F.array_sort(F.array_distinct(find(c, VIEW))),
    })


IDENT = r'((?:[\w"`]|\[[^\]]+\])+(?:\s*\.\s*(?:[\w"`]|\[[^\]]+\])+)*)'


def _sql_clean(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"--[^\n]*", " "), r"(?s)/\*.*?\*/", " "), r"'(?:[^']|'')*'", "''")


def _plain(a: Column) -> Column:
    return F.transform(a, lambda x: F.regexp_replace(x, r'[\[\]"`\s]', ""))


def intended_lineage(files: DataFrame, content: str = "content") -> DataFrame:
    """files with reads, writes, views, materialized_views, triggers, synonyms, routines, calls.

    Names of common table expressions are no reads, nor is what a statement writes. `write` is the first
    write, else `console` if anything is read.
    """
    c = _sql_clean(F.col(content))
    ctes = _plain(find(c, rf"(?i)(?:\bWITH\s+(?:RECURSIVE\s+)?|,\s*){IDENT}\s*(?:\([^()]*\)\s*)?AS\s*(?:NOT\s+MATERIALIZED\s*|MATERIALIZED\s*)?\("))
    writes = F.array_distinct(F.concat(
        _plain(find(c, rf"(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+|EXTERNAL\s+|UNLOGGED\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{IDENT}")),
        _plain(find(c, rf"(?i)\bINSERT\s+(?:INTO|OVERWRITE)\s+(?:TABLE\s+)?{IDENT}")),
        _plain(find(c, rf"(?i)\bUPDATE\s+(?:ONLY\s+)?{IDENT}\s+(?:AS\s+\w+\s+|(?!SET\b)\w+\s+)?SET\b")),
        _plain(find(c, rf"(?i)\bMERGE\s+INTO\s+{IDENT}")),
        _plain(find(c, rf"(?i)\bDELETE\s+FROM\s+{IDENT}"))))
    deleted = _plain(find(c, rf"(?i)\bDELETE\s+FROM\s+{IDENT}"))
    reads = F.array_distinct(_plain(F.concat(find(c, rf"(?i)\b(?:FROM|JOIN|USING)\s+(?!LATERAL\b|UNNEST\b|SELECT\b)(?:ONLY\s+)?{IDENT}(?!\s*\()"), find(c, rf"(?i)\bFROM\s+{IDENT}\s+\w+\s*,\s*{IDENT}", 2))))
    out = files.withColumns({"__ctes": ctes, "__deleted": deleted, "writes": writes, "__reads": reads})
    out = out.withColumn("reads", F.array_sort(F.array_except(F.array_except("__reads", "__ctes"), "__deleted")))
    simple = lambda what: F.array_sort(F.array_distinct(_plain(find(c, rf"(?i)\bCREATE\s+{OR}{what}\s+(?:IF\s+NOT\s+EXISTS\s+)?{IDENT}"))))
    calls = F.filter(F.array_distinct(F.transform(find(c, rf"(?i)\b(?:EXEC(?:UTE)?|CALL)\s+(?!AS\b|IMMEDIATE\b|FUNCTION\b|PROCEDURE\b){IDENT}"), lambda x: F.regexp_replace(x, r'[\[\]"`\s]', ""))), lambda x: ~F.lower(x).isin(*BUILT_IN_CALLS))
    return out.withColumns({
        "views": simple("VIEW"), "materialized_views": simple(r"MATERIALIZED\s+VIEW"), "triggers": simple("TRIGGER"), "synonyms": simple("SYNONYM"),
        "routines": simple(r"(?:PROCEDURE|PROC|FUNCTION)"), "calls": calls,
        "write": F.coalesce(F.try_element_at("writes", F.lit(1)), F.when(F.size("reads") > 0, "console")),
    }).drop("__ctes", "__deleted", "__reads")


def spark_lineage(spark: SparkSession, sql: str) -> dict:
    """reads, writes and {target: (sources, expression)} of one Spark SQL statement, by Spark's own parser.

    Raises ValueError where the statement isn't Spark SQL. Runs on the driver: for statements, not for corpora.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:  # noqa: BLE001 - a JVM parse error
        raise ValueError(str(e).splitlines()[0]) from None
    tree = plan.treeString()
    ctes = set(re.findall(r"CTE \[([^\]]*)\]", tree))
    hidden = {n.strip() for c in ctes for n in c.split(",")}
    relations = [r.replace(", ", ".") for r in re.findall(r"'UnresolvedRelation \[([^\]]+)\]", tree)]
    targets = [t.replace(", ", ".") for t in re.findall(r"UnresolvedIdentifier \[([^\]]+)\]", tree)]
    if "InsertIntoStatement" in tree and relations:
        targets.append(relations.pop(0))
    columns = {}
    for alias, expression in re.findall(r"(\w+)(?:#\d+)? *<- *([^\n]+)", "\n".join(f"{a} <- {e}" for e, a in re.findall(r"(\S[^,\[\]]*?) AS (\w+)#\d+", tree))):
        sources = sorted(set(re.findall(r"'([A-Za-z_][\w.]*)", expression)))
        columns[alias] = (sources, expression.strip().lstrip("'"))
    return {"reads": sorted(set(relations) - hidden), "writes": sorted(set(targets)), "columns": columns}


def column_lineage(files: DataFrame, content: str = "content") -> DataFrame:
    """(file columns..., target, sources, transformation): aliased projections of each text, by pattern."""
    c = _sql_clean(F.col(content))
    pair = F.explode(F.arrays_zip(find(c, r"(?i)([\w.]+(?:\((?:[^()]|\([^()]*\))*\))?(?:\s*[-+*/]\s*[\w.]+(?:\([^()]*\))?)*)\s+AS\s+(\w+)", 1).alias("e"), find(c, r"(?i)([\w.]+(?:\((?:[^()]|\([^()]*\))*\))?(?:\s*[-+*/]\s*[\w.]+(?:\([^()]*\))?)*)\s+AS\s+(\w+)", 2).alias("t")))
    rows = files.withColumn("__p", pair)
    names = F.filter(find(F.col("__p.e"), r"([A-Za-z_][\w.]*)(?!\s*\()(?![\w.])"), lambda x: ~F.lower(x).isin("as", "distinct", "case", "when", "then", "else", "end", "and", "or", "not", "null", "int", "bigint", "decimal", "date", "varchar", "string", "double", "float", "timestamp"))
    words = ("select", "with", "insert", "update", "delete", "begin", "as", "return", "materialized", "not", "table")
    return rows.where(~F.lower("__p.t").isin(*words)).withColumns({"target": F.col("__p.t"), "sources": F.array_sort(F.array_distinct(names)), "transformation": F.col("__p.e")}).drop("__p")


def python_tables(c: Column) -> Column:
    """Tables that SQL inside Python text names."""
    return F.array_sort(F.array_distinct(F.concat(find(c, rf"(?i)\b(?:FROM|JOIN)\s+{NAME}"), find(c, rf"(?i)\bINSERT\s+INTO\s+{NAME}"), find(c, rf"(?i)\bUPDATE\s+{NAME}"))))


PYTHON_SCHEMA = "classes array<struct<name:string,bases:array<string>,doc:string>>, functions array<struct<name:string,args:array<string>,doc:string>>, imports array<string>, ok boolean"


def parse_python(text: str) -> tuple:
    """(classes, functions, imports, ok) of a module; on a syntax error what patterns find. Async functions are left out."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError):
        classes = [(n, [], None) for n in re.findall(r"(?m)^\s*class\s+(\w+)", text or "")]
        functions = [(n, [], None) for n in re.findall(r"(?m)^\s*def\s+(\w+)", text or "")]
        return classes, functions, sorted(set(re.findall(r"(?m)^\s*(?:from|import)\s+([\w.]+)", text or ""))), False
    classes, functions, imports = [], [], []
    for node in ast.walk(tree):
        if isinstance(node, ast.ClassDef):
            classes.append((node.name, [ast.unparse(b) for b in node.bases], ast.get_docstring(node)))
        elif isinstance(node, ast.FunctionDef):
            functions.append((node.name, [a.arg for a in node.args.args], ast.get_docstring(node)))
        elif isinstance(node, ast.Import):
            imports += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports.append(node.module or "")
    return classes, functions, imports, True


def python_lineage(files: DataFrame, content: str = "content") -> DataFrame:
    """files (path, content) with classes, functions, imports and tables."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = [parse_python(t) for t in pdf["__c"]]
            names = ("classes", "functions", "imports", "ok")
            keys = ({"classes": ("name", "bases", "doc"), "functions": ("name", "args", "doc")})
            cols = {n: [[dict(zip(keys[n], x, strict=True)) for x in r[i]] if n in keys else r[i] for r in rows] for i, n in enumerate(names)}
            yield pd.concat([pdf.drop(columns="__c").reset_index(drop=True), pd.DataFrame(cols)], axis=1)

    kept = [c for c in files.columns if c != content]
    schema = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in kept) + (", " if kept else "") + "tables array<string>, " + PYTHON_SCHEMA
    return files.select(*kept, python_tables(F.col(content)).alias("tables"), F.col(content).alias("__c")).mapInPandas(run, schema)


# --- JSON -----------------------------------------------------------------------------------------


def json_summary(c: Column) -> Column:
    """struct(type, keys, array_length) of a JSON text; keys of the first element for a list; null if unreadable."""
    kind = F.substring(F.ltrim(c), 1, 1)
    ok = F.try_parse_json(c).isNotNull()
    keys = F.when(kind == "{", F.json_object_keys(c)).when(kind == "[", F.json_object_keys(F.get_json_object(c, "$[0]")))
    return F.when(ok, F.struct(F.when(kind == "{", "dict").when(kind == "[", "list").otherwise("scalar").alias("type"), F.array_sort(keys).alias("keys"), F.json_array_length(c).alias("array_length")))


#: Properties that JSON files may add to nodes.
ENRICHMENT = ("owner", "sla", "description", "tags")


def json_enrichments(docs: DataFrame, content: str = "content") -> DataFrame:
    """(name, owner, sla, description, tags): entries of a list, of `entities` or `tables`, or of a mapping of objects.

    Entries without a name or without any of the properties are left out.
    """
    c = F.col(content)
    as_map = "map<string,string>"
    objects = lambda a: F.filter(a, lambda x: F.ltrim(x).startswith("{"))
    items = lambda j: F.transform(objects(F.from_json(j, "array<string>")), lambda x: F.from_json(x, as_map))
    top = F.from_json(c, as_map)

    def entry(e: Column) -> Column:
        value = F.from_json(e["value"], as_map)
        own = F.create_map(F.lit("name"), F.coalesce(value["name"], e["key"]))
        return F.when(F.ltrim(e["value"]).startswith("{"), F.map_concat(own, F.map_filter(value, lambda k, v: k != "name")))

    named = F.filter(F.transform(F.map_entries(top), entry), lambda m: m.isNotNull())
    entries = F.coalesce(items(c), items(top["entities"]), items(top["tables"]), named)
    e = docs.select(F.explode(entries).alias("m"))
    filled = lambda k: F.nullif(F.col("m")[k], F.lit(""))
    rows = e.select(F.coalesce(filled("name"), filled("table"), filled("table_name"), filled("id")).alias("name"), F.exists(F.map_keys("m"), lambda k: k.isin(*ENRICHMENT)).alias("any"), *[F.col("m")[k].alias(k) for k in ENRICHMENT])
    return rows.where("name IS NOT NULL AND any").drop("any")


# --- SQL objects ----------------------------------------------------------------------------------

#: Kinds of objects in this order, and the statements that create them.
OBJECTS = (
    ("TABLE", r"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([^\s(]+)"),
    ("VIEW", r"CREATE\s+(?:OR\s+(?:ALTER|REPLACE)\s+)?VIEW\s+([^\s(]+)"),
    ("FUNCTION", r"CREATE\s+(?:OR\s+(?:ALTER|REPLACE)\s+)?FUNCTION\s+([^\s(]+)"),
    ("PROCEDURE", r"CREATE\s+(?:OR\s+(?:ALTER|REPLACE)\s+)?(?:PROCEDURE|PROC)\s+([^\s(]+)"),
    ("TRIGGER", r"CREATE\s+(?:OR\s+(?:ALTER|REPLACE)\s+)?TRIGGER\s+([^\s(]+)"),
    ("INDEX", r"CREATE\s+(?:UNIQUE\s+)?INDEX\s+([^\s(]+)"),
    ("SCHEMA", r"CREATE\s+SCHEMA\s+(?:IF\s+NOT\s+EXISTS\s+)?([^\s;]+)"),
)
FOLDERS = {"TABLE": "tables", "VIEW": "views", "FUNCTION": "functions", "PROCEDURE": "stored_procedures", "TRIGGER": "triggers", "INDEX": "indexes", "SCHEMA": "schemas"}


def classify(files: DataFrame, content: str = "content") -> DataFrame:
    """files with (kind, database, schema, name, statement) for each created object; comments don't count."""
    clean = F.regexp_replace(F.regexp_replace(F.col(content), r"--[^\n]*", ""), r"(?s)/\*.*?\*/", "")

    def of(k: str, p: str) -> Column:
        found = F.regexp_extract_all("__c", F.lit(rf"(?is)({p}.*?)(?:;|\bGO\b|\z)"), F.lit(1))
        return F.transform(found, lambda s: F.struct(F.lit(k).alias("kind"), F.regexp_extract(s, f"(?is){p}", 1).alias("full"), S.strip(s).alias("statement")))

    structs = [of(k, p) for k, p in OBJECTS]
    rows = files.withColumn("__c", clean).withColumn("__o", F.explode(F.concat(*structs)))
    parts = F.split(F.rtrim(F.col("__o.full")), r"\.")
    n = F.size(parts)
    return rows.withColumns({
        "kind": F.col("__o.kind"), "database": F.when(n == 3, parts[0]), "schema": F.when(n == 3, F.try_element_at(parts, F.lit(2))).when(n == 2, parts[0]),
        "name": F.when(n == 3, F.try_element_at(parts, F.lit(3))).when(n == 2, F.try_element_at(parts, F.lit(2))).otherwise(parts[0]), "statement": F.col("__o.statement")}).drop("__c", "__o")


#: Fixed value: the comment before each object of a scripted database.
HEADER = r"/\*{6}\s+Object:\s+(\w+)\s+(\[[\w\.\[\]]+\])\s+Script Date:([^\*]+)\*{6}/"
#: Object types of script headers.
HEADER_TYPES = {
    "table": "TABLE", "view": "VIEW", "storedprocedure": "PROCEDURE", "userdefinedfunction": "FUNCTION", "index": "INDEX", "default": "CONSTRAINT", "foreignkey": "FOREIGN_KEY",
    "check": "CHECK_CONSTRAINT", "primarykey": "PRIMARY_KEY", "trigger": "TRIGGER", "schema": "SCHEMA", "userdefinedtype": "TYPE", "xmlschemacollection": "XML_SCHEMA",
}


def header_objects(files: DataFrame, content: str = "content") -> DataFrame:
    """files with (pos, kind, full_name, schema, name, parent, sql): a row for each script header; text before the first is dropped."""
    pieces = F.split(F.col(content), rf"(?i)(?={HEADER})")
    rows = files.select("*", F.posexplode(pieces).alias("pos", "sql")).where(F.col("sql").rlike(f"(?i)^{HEADER}"))
    head = lambda i: F.regexp_extract("sql", f"(?i)^{HEADER}", i)
    kinds = F.create_map(*[F.lit(x) for kv in HEADER_TYPES.items() for x in kv])
    parts = F.split(F.regexp_replace(head(2), r"[\[\]]", ""), r"\.")
    kind = F.coalesce(F.element_at(kinds, F.regexp_replace(F.lower(head(1)), "[_ ]", "")), F.lit("UNKNOWN"))
    index_on = F.regexp_extract("sql", r"(?i)CREATE\s+(?:UNIQUE\s+)?(?:CLUSTERED\s+|NONCLUSTERED\s+)?INDEX\s+\[?\w+\]?\s+ON\s+(\[[^\]]+\]\.\[[^\]]+\]|\[[^\]]+\])", 1)
    altered = F.regexp_extract("sql", r"(?i)ALTER\s+TABLE\s+(\[[\w\.\[\]]+\])\s+(?:WITH\s+CHECK\s+)?ADD\s+CONSTRAINT\s+\[[\w\.\[\]]+\]", 1)
    return rows.withColumns({
        "kind": kind, "full_name": head(2), "schema": F.when(F.size(parts) == 1, "dbo").otherwise(F.try_element_at(parts, F.lit(-2))), "name": F.element_at(parts, -1),
        "parent": F.coalesce(F.when((kind == "INDEX") & (index_on != ""), index_on), F.nullif(altered, F.lit("")))})


def group_children(objects: DataFrame, by: str = "path") -> DataFrame:
    """(by, parent_name, child_kind, children): children of each object under the parent found by full name, else by bare name."""
    kids = objects.where("parent IS NOT NULL")
    heads = objects.groupBy(by, "full_name").agg(F.min("pos").alias("pos"))
    bare = objects.groupBy(by, "name").agg(F.min_by("full_name", "pos").alias("by_name"))
    last = F.element_at(F.split(F.regexp_replace("parent", r"[\[\]]", ""), r"\."), -1)
    joined = kids.withColumn("__bare", last).join(heads.select(by, F.col("full_name").alias("parent"), F.col("full_name").alias("exact")), [by, "parent"], "left").join(bare.withColumnRenamed("name", "__bare"), [by, "__bare"], "left")
    up = F.upper("sql")
    kind = F.when(up.contains("FOREIGN"), "foreign_keys").when(up.contains("CHECK") & up.contains("CONSTRAINT"), "check_constraints").when(up.contains("DEFAULT"), "defaults").when(F.col("kind") == "INDEX", "indexes").otherwise("constraints")
    named = joined.withColumn("parent_name", F.coalesce("exact", "by_name")).where("parent_name IS NOT NULL")
    return named.groupBy(by, "parent_name", kind.alias("child_kind")).agg(F.array_sort(F.collect_list("full_name")).alias("children"))


def extended_properties(c: Column) -> Column:
    p = r"(?is)EXEC\s+sys\.sp_addextendedproperty\s+@name=N'(\w+)',\s+@value=N'([^']*)'"
    return F.arrays_zip(find(c, p, 1).alias("name"), find(c, p, 2).alias("value"))


# --- parsed files into the graph ------------------------------------------------------------------


def to_graph(parsed: DataFrame, project: str, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of parsed SQL files (see intended_lineage): URN ids, files contain what they create,
    writers read (DERIVES from a table written, READS_FROM from a file that only reads), files call routines."""
    node_id = lambda label, name: S.urn(label, F.lit(project), name)
    asset = F.lit("DataAsset")

    def named_as(col: str, label: str) -> Column:
        return F.transform(col, lambda n: F.struct(F.lit(label).alias("label"), n.alias("name")))

    listed = F.explode(F.concat(*[named_as(col, label) for col, label in (("writes", "Table"), ("reads", "DataAsset"), ("views", "View"), ("materialized_views", "MaterializedView"), ("triggers", "Trigger"), ("synonyms", "Synonym"), ("routines", "FunctionOrProcedure"), ("calls", "FunctionOrProcedure"))]))
    files = parsed.select(node_id(F.lit("File"), F.col(path)).alias("id"), F.lit("File").alias("label"), F.col(path).alias("name"))
    named = parsed.select(listed.alias("n")).select(node_id(F.when(F.col("n.label").isin("Table", "DataAsset"), asset).otherwise(F.col("n.label")), F.col("n.name")).alias("id"), "n.label", "n.name")
    nodes = files.unionByName(named).groupBy("id").agg(F.max("label").alias("label"), F.min("name").alias("name"))
    me = node_id(F.lit("File"), F.col(path))
    table = lambda c: node_id(asset, c)

    def arcs(col: str, source: Column, target: Column, kind: Column) -> DataFrame:
        return parsed.select(path, "write", F.explode(col).alias("x")).select(source.alias("source_id"), target.alias("target_id"), kind.alias("type"))

    x, wrote = F.col("x"), F.col("write").isNotNull() & (F.col("write") != "console")
    edges = arcs("reads", F.when(wrote, table(F.col("write"))).otherwise(me), table(x), F.when(wrote, F.lit("DERIVES")).otherwise(F.lit("READS_FROM")))
    for col, label in (("writes", None), ("views", "View"), ("materialized_views", "MaterializedView"), ("triggers", "Trigger"), ("synonyms", "Synonym"), ("routines", "FunctionOrProcedure")):
        edges = edges.unionByName(arcs(col, me, table(x) if label is None else node_id(F.lit(label), x), F.lit("CONTAINS")))
    return nodes, edges.unionByName(arcs("calls", me, node_id(F.lit("FunctionOrProcedure"), x), F.lit("CALLS"))).distinct()


def column_graph(columns: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of column lineage: rows (write, target, sources, transformation), of column_lineage over intended_lineage.

    A written table contains its columns, a transformation (keyed by column and logic) generates one, source columns are input to it
    and lie in their tables. Sources without a table lie in `unknown`; rows that write nothing have no column.
    """
    rows = columns.where("write IS NOT NULL AND write <> 'console' AND target <> ''").select("write", "target", "sources", "transformation").distinct()
    node_id = lambda label, name: S.urn(F.lit(label), F.lit(project), name)
    full = F.concat_ws(".", "write", "target")
    key = F.concat(F.lit("transformation:"), F.sha2(F.concat_ws(":", full, "transformation"), 256))
    made = rows.select(node_id("DataAsset", F.col("write")).alias("table"), F.col("write").alias("table_name"), node_id("Column", full).alias("column"), "target", node_id("Transformation", key).alias("step"), "transformation", F.explode_outer("sources").alias("source"))
    parts = F.split("source", r"\.")
    of = F.when(F.size(parts) > 1, parts[0]).otherwise(F.lit("unknown"))
    s = made.withColumns({"source_table": F.when(F.col("source").isNotNull(), of), "source_name": F.element_at(parts, -1)})
    s = s.withColumns({"source_column": F.when(F.col("source").isNotNull(), node_id("Column", F.concat_ws(".", "source_table", "source_name"))), "source_asset": F.when(F.col("source").isNotNull(), node_id("DataAsset", F.col("source_table")))})
    node = lambda i, label, name: F.struct(F.col(i).alias("id"), F.lit(label).alias("label"), F.col(name).alias("name"))
    edge = lambda a, b, kind: F.struct(F.col(a).alias("source_id"), F.col(b).alias("target_id"), F.lit(kind).alias("type"))
    nodes = s.select(F.inline(F.array(node("table", "Table", "table_name"), node("column", "Column", "target"), node("step", "Transformation", "transformation"), node("source_column", "Column", "source_name"), node("source_asset", "DataAsset", "source_table")))).where("id IS NOT NULL")
    edges = s.select(F.inline(F.array(edge("table", "column", "CONTAINS"), edge("step", "column", "GENERATES"), edge("source_asset", "source_column", "CONTAINS"), edge("source_column", "step", "INPUT_TO")))).where("source_id IS NOT NULL")
    return nodes.groupBy("id").agg(F.max("label").alias("label"), F.min("name").alias("name")), edges.distinct()


def attachments(files: DataFrame, project: str, content: str = "content") -> DataFrame:
    """Edges ATTACHED_TO from triggers to their tables, and ALIAS_OF from synonyms to what they stand for."""
    c = _sql_clean(F.col(content))
    node_id = lambda label, name: S.urn(F.lit(label), F.lit(project), name)

    def pairs(pattern: str, label: str, kind: str) -> DataFrame:
        both = F.explode(F.arrays_zip(_plain(find(c, pattern, 1)).alias("a"), _plain(find(c, pattern, 2)).alias("b")))
        return files.select(both.alias("p")).select(node_id(label, F.col("p.a")).alias("source_id"), node_id("DataAsset", F.col("p.b")).alias("target_id"), F.lit(kind).alias("type"))

    trigger = pairs(rf"(?is)\bCREATE\s+{OR}(?:CONSTRAINT\s+)?TRIGGER\s+{IDENT}\s[^;]*?\bON\s+{IDENT}", "Trigger", "ATTACHED_TO")
    return trigger.unionByName(pairs(rf"(?i)\bCREATE\s+{OR}SYNONYM\s+{IDENT}\s+FOR\s+{IDENT}", "Synonym", "ALIAS_OF")).distinct()


def full_graph(files: DataFrame, project: str, path: str = "path", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of SQL files with their columns, transformations, triggers and synonyms; ends without a node get one."""
    parsed = intended_lineage(files, content)
    nodes, edges = to_graph(parsed, project, path)
    more, columns = column_graph(column_lineage(parsed, content), project)
    edges = edges.unionByName(columns).unionByName(attachments(files, project, content)).distinct()
    nodes = nodes.unionByName(more).groupBy("id").agg(F.max("label").alias("label"), F.min("name").alias("name"))
    return nodes.unionByName(fallback_nodes(edges, nodes)), edges


def fallback_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, label, name) for the ends of edges that are no nodes, as their URNs name them; an end that is no URN is a DataAsset of that name."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    lost = ends.join(nodes.select("id"), "id", "left_anti")
    u = S.urn_parts(F.col("id"))
    return lost.select("id", F.coalesce(F.nullif(u["entity_type"], F.lit("")), F.lit("DataAsset")).alias("label"), F.coalesce(F.nullif(u["asset_path"], F.lit("")), F.col("id")).alias("name"))


def objects_of(objects: DataFrame, kind: str) -> DataFrame:
    """Header objects of a kind."""
    return objects.where(F.col("kind") == kind)


def tables_with_children(objects: DataFrame, children: DataFrame, by: str = "path") -> DataFrame:
    """Tables that have indexes, keys or constraints."""
    return objects_of(objects, "TABLE").join(children.select(by, F.col("parent_name").alias("full_name")).distinct(), [by, "full_name"], "left_semi")


def indexed_views(objects: DataFrame, children: DataFrame, by: str = "path") -> DataFrame:
    """Views that have an index."""
    indexed = children.where("child_kind = 'indexes'").select(by, F.col("parent_name").alias("full_name")).distinct()
    return objects_of(objects, "VIEW").join(indexed, [by, "full_name"], "left_semi")


def json_graph(docs: DataFrame, project: str, path: str = "path", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """A JsonDocument node for each file and a JsonKey node for each key, joined by HAS_KEY."""
    rows = docs.select(path, F.explode(json_summary(F.col(content))["keys"]).alias("key"))
    doc = S.urn(F.lit("JsonDocument"), F.lit(project), F.col(path))
    key = S.urn(F.lit("JsonKey"), F.lit(project), F.concat_ws("/", path, "key"))
    nodes = docs.select(doc.alias("id"), F.lit("JsonDocument").alias("label"), F.col(path).alias("name")).unionByName(rows.select(key.alias("id"), F.lit("JsonKey").alias("label"), F.col("key").alias("name")))
    return nodes.distinct(), rows.select(doc.alias("source_id"), key.alias("target_id"), F.lit("HAS_KEY").alias("type"))


class Registry:
    """Parsers by file extension; the first that takes an extension is used."""

    def __init__(self) -> None:
        self.plugins: list[tuple[tuple[str, ...], object]] = []

    def register(self, extensions: tuple[str, ...], parser) -> None:
        self.plugins.append((tuple(e.lower() for e in extensions), parser))

    def get(self, extension: str):
        return next((p for exts, p in self.plugins if extension.lower() in exts), None)


def default_registry() -> Registry:
    r = Registry()
    r.register((".sql", ".ddl", ".dml"), intended_lineage)
    r.register((".py", ".pyspark"), python_lineage)
    r.register((".json",), json_graph)
    return r


#: SQL dialects; the first is the default.
DIALECTS = ("tsql", "postgres", "mysql", "duckdb", "spark", "bigquery", "snowflake", "oracle", "fabric", "redshift", "presto", "trino", "hive", "sqlite", "athena", "databricks", "clickhouse", "teradata")


def dialect(name: str) -> str:
    """The dialect to read a text in; `auto` is the default. Raises ValueError for an unknown one."""
    found = DIALECTS[0] if name == "auto" else name.lower()
    if found not in DIALECTS:
        raise ValueError(f"unknown SQL dialect {name!r}; known: {', '.join(DIALECTS)}")
    return found
