"""Snapshots, monthly archives and other exports of tables as Parquet, and their readers."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..functions.scalar import redact, strip
from ..operators import logs


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listing(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it isn't there."""
    p, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def export_archive(tables: Mapping[str, DataFrame], base: str, month: str) -> list[tuple[str, int]]:
    """Write each non-empty table under month=<month>/<table>, Snappy compressed; (table, rows) of those written."""
    done = []
    for name, df in tables.items():
        out = f"{base}/month={month}/{name}"
        n = df.count()
        if n:
            df.write.mode("overwrite").option("compression", "snappy").parquet(out)
            done.append((name, n))
    return done


def read_archive(spark: SparkSession, base: str, table: str, months: Iterable[str] | None = None, where: str | None = None) -> DataFrame:
    """Rows of a table's archives (all months, or those given) as a bag; the predicate reaches the scan."""
    have = [m for m in listing(spark, base) if m.startswith("month=") and table in listing(spark, f"{base}/{m}")]
    wanted = [m for m in have if months is None or m[6:] in set(months)]
    if not wanted:
        raise FileNotFoundError(f"no archive of {table} under {base}")
    df = spark.read.option("mergeSchema", "true").parquet(*[f"{base}/{m}/{table}" for m in wanted])
    return df.where(where) if where else df


def archived_then_kept(df: DataFrame, cutoff: str, at: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """(rows before the cutoff, rows to keep)."""
    old = F.coalesce(F.col(at) < F.lit(cutoff).cast(df.schema[at].dataType), F.lit(False))
    return df.where(old), df.where(~old)


def create_snapshot(spark: SparkSession, tables: Mapping[str, DataFrame], base: str, stamp: str) -> str:
    """Write all tables under a temporary name and rename the folder at the end: readers see whole snapshots only."""
    tmp, out = f"{base}/.tmp-{stamp}", f"{base}/snapshot_{stamp}"
    try:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp}/{name}")
        source, fs = _fs(spark, tmp)
        target, _ = _fs(spark, out)
        if not fs.rename(source, target):
            raise OSError(f"{out} couldn't be made")
    except BaseException:
        store.drop_path(spark, tmp)
        raise
    return out


def snapshots(spark: SparkSession, base: str) -> list[str]:
    """Names of snapshots, newest first."""
    return sorted((n for n in listing(spark, base) if n.startswith("snapshot_")), reverse=True)


def load_snapshot(spark: SparkSession, base: str, name: str) -> dict[str, DataFrame]:
    if name not in snapshots(spark, base):
        raise FileNotFoundError(name)
    return {t: spark.read.parquet(f"{base}/{name}/{t}") for t in listing(spark, f"{base}/{name}")}


def prune_snapshots(spark: SparkSession, base: str, keep: int) -> list[str]:
    gone = snapshots(spark, base)[keep:]
    for name in gone:
        store.drop_path(spark, f"{base}/{name}")
    return gone


def changed(tables: Mapping[str, DataFrame], before: str | None) -> tuple[bool, str]:
    """Whether the tables' row counts differ from those of the hash before, and their hash."""
    spark = next(iter(tables.values())).sparkSession
    counts = spark.createDataFrame([(n, df.count()) for n, df in tables.items()], "name string, n bigint")
    now = logs.data_hash(counts).first()["hash"]
    return now != before, now


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes, relationships and statistics (counts by label and type) as folders of JSON lines."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/relationships")
    graph_snapshot(nodes, edges, "export").write.mode("overwrite").json(f"{path}/statistics")


def graph_snapshot(nodes: DataFrame, edges: DataFrame, phase: str) -> DataFrame:
    """(metadata JSON) one row: phase, counts, and counts by label and type; unlabelled nodes are UNKNOWN."""
    def tally(df: DataFrame, column: str, name: str) -> DataFrame:
        g = df.groupBy(F.coalesce(column, F.lit("UNKNOWN")).alias("k")).agg(F.count("*").alias("n"))
        return g.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name), F.coalesce(F.sum("n"), F.lit(0)).alias(f"{name}_total"))  # a row for each label

    both = tally(nodes, "label", "labels").join(F.broadcast(tally(edges, "type", "types")), F.lit(True))
    return both.select(F.to_json(F.struct(F.lit(phase).alias("phase"), F.col("labels_total").alias("node_count"), F.col("types_total").alias("edge_count"), F.col("labels").alias("node_label_counts"), F.col("types").alias("relationship_type_counts"))).alias("metadata"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks by source and object type, as folders of Parquet (one file for each task and folder, not for each chunk)."""
    chunks.write.mode("overwrite").partitionBy("source", "object_type").parquet(path)


def object_files(objects: DataFrame, source: str = "path") -> DataFrame:
    """objects with file_name: folder of the kind and the name, numbered where names repeat."""
    from pyspark.sql import Window

    from ..operators.parsing import FOLDERS

    folder = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv]), F.col("kind")), F.lit("unknown"))
    base = F.regexp_replace(F.concat_ws(".", "schema", "name"), r"[\[\]\"`]", "")
    n = F.row_number().over(Window.partitionBy(source, "kind", base).orderBy("statement"))
    return objects.withColumn("file_name", F.concat(folder, F.lit("/"), base, F.when(n > 1, F.concat(F.lit("_"), (n - 1).cast("string"))).otherwise(""), F.lit(".sql")))


def manifest(files: DataFrame) -> DataFrame:
    """(kind, n, files): created files by kind."""
    return files.groupBy("kind").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("file_name")), ",").alias("files"))


def entity_texts(nodes: DataFrame) -> DataFrame:
    """(id, text) as `Label: name (key=value, ...)` from nodes with a props map."""
    props = F.array_join(F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    return nodes.select("id", F.concat("label", F.lit(": "), "name", F.when(F.size("props") > 0, F.concat(F.lit(" ("), props, F.lit(")"))).otherwise("")).alias("text"))


def statement_texts(files: DataFrame, content: str = "content") -> DataFrame:
    """files with (pos, statement): non-empty statements between semicolons."""
    rows = files.select(*[c for c in files.columns if c != content], F.posexplode(F.split(F.col(content), ";")).alias("pos", "s"))
    return rows.withColumn("statement", strip(F.col("s"))).drop("s").where("statement <> ''")


def audit(events: DataFrame, path: str) -> None:
    """Append audit events by day, with personal data redacted in their details."""
    events.withColumn("details", redact(F.col("details"))).withColumn("date", F.to_date("timestamp")).write.mode("append").partitionBy("date").json(path)


def expire_audit(spark: SparkSession, path: str, oldest: str) -> list[str]:
    """Delete the days of an audit log before a date (yyyy-mm-dd); the days deleted."""
    gone = [n for n in listing(spark, path) if n.startswith("date=") and n[5:] < oldest]
    for name in gone:
        store.drop_path(spark, f"{path}/{name}")
    return gone


def archives(spark: SparkSession, base: str) -> DataFrame:
    """(month, table, bytes) of every archive under a folder."""
    found = []
    for month in (m for m in listing(spark, base) if m.startswith("month=")):
        for name in listing(spark, f"{base}/{month}"):
            p, fs = _fs(spark, f"{base}/{month}/{name}")
            found.append((month[6:], name, fs.getContentSummary(p).getLength()))
    return spark.createDataFrame(found, "month string, table string, bytes bigint")


def dead_letters(failed: DataFrame, error: str, path: str) -> None:
    failed.select(F.current_timestamp().alias("timestamp"), F.lit(error).alias("error"), F.to_json(F.struct("*")).alias("item")).write.mode("append").json(path)


def migrate(df: DataFrame, version: int, steps: Mapping[int, Mapping[str, object]]) -> tuple[DataFrame, int]:
    """df with the columns that each later schema version adds (with defaults); applying a step twice changes nothing."""
    for v in sorted(steps):
        if v > version:
            for column, default in steps[v].items():
                df = df if column in df.columns else df.withColumn(column, F.lit(default))
            version = v
    return df, version


def read_index(spark: SparkSession, base: str) -> DataFrame:
    """All ingestion_index.json files below a folder, malformed ones left out."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "ingestion_index.json").text(base, wholetext=True)
    entry = "ingestion_id string, source string, project_id string, project_status string, repository_id string, run_id string, status string, started_at string, completed_at string, filenames array<string>, source_repo string"
    some = F.coalesce(F.from_json("value", f"array<struct<{', '.join(f'{c.split()[0]}:{c.split(None, 1)[1]}' for c in entry.split(', '))}>>"), F.array(F.from_json("value", entry)))
    return raw.select(F.inline(some)).where("ingestion_id IS NOT NULL")


def dumps(row: dict) -> str:
    return json.dumps(row, sort_keys=True, default=str)


def chunk_names(chunks: DataFrame, chunk: str = "chunk") -> DataFrame:
    """chunks with object_type and object_name as their first line tells: the folder and file name of a chunk."""
    first = F.upper(F.substring_index(strip(F.col(chunk)), "\n", 1))
    line = F.substring_index(strip(F.col(chunk)), "\n", 1)
    kinds = ("FUNCTION", "TABLE", "VIEW", "PROCEDURE", "TRIGGER", "SCHEMA", "INDEX")
    begins = lambda k: first.rlike(rf"\bCREATE\s+(?:OR\s+(?:REPLACE|ALTER)\s+)?(?:UNIQUE\s+)?(?:TEMP(?:ORARY)?\s+)?{k}\b")
    kind = F.coalesce(*[F.when(begins(k), F.lit(k)) for k in kinds], F.lit("MISC"))
    name = F.regexp_extract(line, r"(?i)\b(?:FUNCTION|TABLE|VIEW|PROCEDURE|TRIGGER|SCHEMA|INDEX)\s+(?:IF\s+NOT\s+EXISTS\s+)?([^\s(;]+)", 1)
    return chunks.withColumns({"object_type": kind, "object_name": F.when((kind != "MISC") & (name != ""), F.regexp_replace(name, r"[^\w.\-]", "_")).otherwise("unknown")})


def hierarchy(objects: DataFrame, children: DataFrame, by: str = "path") -> DataFrame:
    """(by, folder, n): the object tree's folders, `<kind>/<name>` for parents and `<kind>/<name>/<child kind>` below, with their files."""
    heads = objects.where("parent IS NULL").select(by, F.concat_ws("/", F.lower("kind"), F.regexp_replace("full_name", r"[\[\]]", "")).alias("folder"), "full_name")
    below = heads.join(children.withColumnRenamed("parent_name", "full_name"), [by, "full_name"]).select(by, F.concat_ws("/", "folder", "child_kind").alias("folder"), F.size("children").cast("bigint").alias("n"))
    return heads.select(by, "folder", F.lit(1).cast("bigint").alias("n")).unionByName(below)


def write_points(points: DataFrame, path: str) -> None:
    """Embeddings as JSON lines, one point a line."""
    points.write.mode("overwrite").json(path)


def ingestion_logs(index: DataFrame, limit: int = 50, **equal: str) -> tuple[DataFrame, int]:
    """(the newest entries that match, how many match in all)."""
    for c, v in equal.items():
        index = index.where(F.col(c) == v)
    return index.orderBy(F.desc("started_at"), "ingestion_id").limit(limit), index.count()
