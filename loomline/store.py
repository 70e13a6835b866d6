"""Tables of one test-data directory, cuts in the lineage, and size-checked broadcasts.

Intermediate tables go to the folder that the cluster names in `spark.checkpoint.dir`, which all
executors share. Only where that setting is absent and the master is local (tests, a laptop) a folder of our own is used.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

#: A side of a join is broadcast only if it has at most so many rows, and at most so many bytes as rows in memory.
BROADCAST_ROWS = 400_000
BROADCAST_BYTES = 32_000_000
#: Bytes of a row in memory besides its strings and arrays: header, null bits and hash entry, and each field.
ROW_BYTES, FIELD_BYTES = 32, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; where none is set, a folder of this machine, if all executors are on it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(?:\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "loomline-shared")
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends (or by `drop_path`)."""
    path = f"{shared_dir(spark)}/loomline/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    p, fs = file_system(spark, path)
    fs.deleteOnExit(p)
    return path


def file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and go on from the written table.

    It is computed a single time, survives lost executors, and its row count is known from footers.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[int, int]:
    """(rows, bytes as rows in memory) of df, of at most `rows` + 1 of its rows; their strings, binaries and arrays are measured."""
    wide = [F.octet_length(F.col(f"`{f.name}`")) if isinstance(f.dataType, StringType | BinaryType) else F.size(F.col(f"`{f.name}`")) * FIELD_BYTES for f in df.schema.fields if isinstance(f.dataType, StringType | BinaryType | ArrayType)]
    extra = sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(0))
    n, more = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(extra), F.lit(0))).first()
    return n, n * (ROW_BYTES + FIELD_BYTES * len(df.columns)) + more


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most `rows` rows and takes at most `size` bytes as rows in memory; it should be materialised or cheap."""
    n, taken = measured(df, rows)
    return n <= rows and taken <= size


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is small (see is_small), else df as it is (a shuffled join)."""
    return F.broadcast(df) if is_small(df, rows, size) else df


def running(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: Column, into: str) -> DataFrame:
    """df with `into`: the running sum of value within `by`, in order (which must tell all rows of a group apart).

    A small table takes one window. A larger one is range-partitioned by group and order; sums run within each partition and are
    lifted by the totals of the group's partitions before it, so a group of any size is spread over many tasks.
    """
    local = lambda *keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    valued = df.withColumn("__value", value)
    if is_small(valued):
        return valued.withColumn(into, F.sum("__value").over(local(*by))).drop("__value")
    cut = valued.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("__part", F.spark_partition_id())
    cut = materialize(cut, "running")
    totals = cut.groupBy(*by, "__part").agg(F.sum("__value").alias("__total"))  # a row for each group and partition
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    lifts = totals.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__part").alias("__at"), F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__lift"))
    on = [cut[c].eqNullSafe(lifts[f"__by_{c}"]) for c in by] + [cut["__part"] == lifts["__at"]]
    summed = cut.withColumn("__run", F.sum("__value").over(local(*by, "__part")))
    return summed.join(checked_broadcast(lifts), on).withColumn(into, F.col("__run") + F.col("__lift")).select(*df.columns, into)


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores: only a scan of fewer splits than cores is shuffled,
    so that CPU-heavy maps over it use them all. Larger inputs stay where they are."""
    plan = df._jdf.queryExecution()
    if "AdaptiveSparkPlan" in plan.executedPlan().toString():
        return df  # it has a shuffle already, and asking for its partitions would run it
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df


def drop_path(spark: SparkSession, path: str) -> None:
    p, fs = file_system(spark, path)
    fs.delete(p, True)
