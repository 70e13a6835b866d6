"""Code files, uploads, repositories and logs as DataFrames."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import scalar as S

CORPUS = ("sql", "py", "json")
SKIPPED = r"(^|/)(\.[^/]+|__pycache__|venv)(/|$)"


def code_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, content): a row for each file, found recursively, read whole."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """SQL, Python and JSON files below a folder, without hidden folders, caches and environments."""
    df = code_files(spark, path, "*.{sql,py,json}")
    below = F.regexp_replace("path", r"^file:/+", "/")
    return df.where(~F.regexp_replace(below, "^" + os.path.abspath(path).replace(".", r"\."), "").rlike(SKIPPED)).withColumn("file_type", S.file_type(F.col("path")))


def uploads(spark: SparkSession, path: str, extensions: tuple[str, ...] = (".sql", ".py", ".json"), most_mb: int = 50) -> DataFrame:
    """(path, size, status, content): files with outcome `accepted`, `unsupported` or `too_large`; broken UTF-8 is replaced."""
    if not 1 <= most_mb <= 500:
        raise ValueError("the size limit is between 1 and 500 MB")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    status = F.when(~ext.isin(*[e.lower() for e in extensions]), "unsupported").when(F.col("length") > most_mb * 1024 * 1024, "too_large").otherwise("accepted")
    return df.select("path", F.col("length").alias("size"), status.alias("status"), F.when(status == "accepted", F.make_valid_utf8(F.col("content").cast("string"))).alias("content"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, plain or compressed; blank and broken lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def log_files(spark: SparkSession, path: str, schema: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Log lines of the files whose names' dates lie within; files without a date are always read."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(path).withColumn("__d", F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4}-\d{2}-\d{2})", 1))
    if start:
        df = df.where((F.col("__d") == "") | (F.col("__d") >= start[:10]))
    if end:
        df = df.where((F.col("__d") == "") | (F.col("__d") <= end[:10]))
    return df.drop("__d")


def decode_blobs(listing: DataFrame, content: str = "content", encoding: str = "encoding") -> DataFrame:
    """listing with the content of base64 blobs (as repository services send them, in lines) as text; broken ones are null, other encodings stay."""
    raw = F.try_to_binary(F.regexp_replace(content, r"\s+", ""), F.lit("base64"))
    return listing.withColumn(content, F.when(F.lower(encoding) == "base64", F.make_valid_utf8(raw.cast("string"))).otherwise(F.col(content)))


class RepositorySource(DataSource):
    """A checked-out repository as a table (path, content, size): `spark.read.format("repository").option("path", ...)`.

    Top-level entries are the partitions; hidden folders are skipped; base64 exports (`*.b64`) are decoded.
    """

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return "path string, content string, size bigint"

    def reader(self, schema) -> DataSourceReader:
        return RepositoryReader(self.options)


class RepositoryReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.extensions = options["path"], tuple(options.get("extensions", ".sql,.py,.json").split(","))

    def partitions(self):
        return [InputPartition(n) for n in sorted(os.listdir(self.root)) if not n.startswith(".")] or [InputPartition("")]

    def read(self, partition) -> Iterator[tuple]:
        import base64

        top = os.path.join(self.root, partition.value)
        walk = os.walk(top) if os.path.isdir(top) else [(self.root, [], [partition.value] if partition.value else [])]
        for folder, folders, names in walk:
            folders[:] = [f for f in folders if not f.startswith(".")]
            for name in sorted(names):
                encoded = name.endswith(".b64")
                if not (name[:-4] if encoded else name).endswith(self.extensions):
                    continue
                with open(os.path.join(folder, name), "rb") as f:
                    raw = base64.b64decode(f.read()) if encoded else f.read()
                path = os.path.relpath(os.path.join(folder, name[:-4] if encoded else name), self.root)
                yield (path, raw.decode("utf-8", errors="replace"), len(raw))
