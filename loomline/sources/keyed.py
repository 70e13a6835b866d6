"""Tables on shared storage that are read and written by key: history is fetched bucket by bucket, never as a whole.

Every table is filed by a hash bucket of its key, in *generations*: folders that are written once and never
changed. A manifest names the generations that count, and which buckets each has. A batch writes new generations
beside the old ones and publishes the next manifest by one rename that fails if another writer was first, so readers
see either all of a batch or nothing of it, and no update is lost.

What a batch reads are the buckets its keys fall into. The number of buckets is doubled when they hold more than
`rows_per_bucket` rows on average, so a bucket stays of one size while history grows; a row is rewritten as often as the
table doubles. Small generations are merged size by size (the smaller half when there are more than MOST), which also
bounds the number of files of a bucket.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import store

#: Generations of a table before the smaller half of them is merged.
MOST = 16
KEPT_MANIFESTS = 2


class StaleWriter(RuntimeError):
    """Another writer published first; take the batch in again."""


class KeyedStore:
    """Keyed tables under one folder. keys: table -> its key columns."""

    def __init__(self, spark: SparkSession, path: str, keys: Mapping[str, Sequence[str]], buckets: int = 16, rows_per_bucket: int = 1_000_000):
        self.spark, self.path, self.keys, self.rows_per_bucket = spark, path.rstrip("/"), {t: list(k) for t, k in keys.items()}, rows_per_bucket
        self.first_buckets = buckets

    # --- the manifest ---

    def _versions(self) -> list[int]:
        p, fs = store.file_system(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n[9:-5].isdigit())

    def manifest(self) -> dict:
        versions = self._versions()
        if not versions:
            return {"version": 0, "tables": {t: {"buckets": self.first_buckets, "generations": []} for t in self.keys}, "more": {}}
        p, fs = store.file_system(self.spark, f"{self.path}/manifest-{versions[-1]}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def publish(self, manifest: dict) -> dict:
        """Make the manifest (read before, and changed since) the current one; StaleWriter if it isn't the next."""
        jvm = self.spark.sparkContext._jvm
        after = manifest | {"version": manifest["version"] + 1}
        tmp, fs = store.file_system(self.spark, f"{self.path}/.manifest-{uuid.uuid4().hex}")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(after).encode()))
        out.close()
        target, _ = store.file_system(self.spark, f"{self.path}/manifest-{after['version']}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(tmp, target, plain)
        except Exception as e:
            fs.delete(tmp, False)
            if fs.exists(target):
                raise StaleWriter(f"version {after['version']} of {self.path} is another writer's") from e
            raise
        for v in self._versions()[:-KEPT_MANIFESTS]:
            old, _ = store.file_system(self.spark, f"{self.path}/manifest-{v}.json")
            fs.delete(old, False)
        return after

    # --- reading ---

    def bucket_of(self, table: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys[table]), F.lit(buckets)).cast("int")

    def touched(self, manifest: dict, table: str, rows: DataFrame) -> list[int]:
        """The buckets of a table that the keys of rows fall into: at most as many numbers as the table has buckets."""
        return sorted(r[0] for r in rows.select(self.bucket_of(table, manifest["tables"][table]["buckets"]).alias("b")).distinct().collect())

    def read(self, manifest: dict, table: str, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """The table's rows, or those of the given buckets alone; None if there are none. Only the buckets' files are opened."""
        wanted = None if buckets is None else set(buckets)
        parts = []
        for g in manifest["tables"][table]["generations"]:
            names = [b for b in g["buckets"] if wanted is None or b in wanted]
            if names:
                parts.append(self.spark.read.schema(g["schema"]).parquet(*[f"{g['path']}/bucket={b}" for b in names]))
        return reduce(DataFrame.unionByName, parts) if parts else None

    def near(self, manifest: dict, table: str, rows: DataFrame) -> DataFrame | None:
        """The table's rows with a key of rows."""
        if not manifest["tables"][table]["generations"]:
            return None
        key = self.keys[table]
        found = self.read(manifest, table, self.touched(manifest, table, rows))
        return None if found is None else found.join(store.checked_broadcast(rows.select(*key).distinct()), key, "left_semi")

    # --- writing ---

    def write(self, manifest: dict, table: str, df: DataFrame) -> DataFrame:
        """df as a new generation of the table in the (unpublished) manifest; the written rows."""
        entry = manifest["tables"][table]
        generation = self._generation(table, df, entry["buckets"])
        if generation["buckets"]:
            entry["generations"] = [*entry["generations"], generation]
        return self.spark.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(generation["path"])

    def _generation(self, table: str, df: DataFrame, buckets: int) -> dict:
        path = f"{self.path}/{table}/{uuid.uuid4().hex}"
        counted = Observation()
        # rebalanced, not repartitioned: a few files a bucket, and a bucket of a hot key is split over tasks
        filed = df.withColumn("bucket", self.bucket_of(table, buckets)).hint("rebalance", "bucket").observe(counted, F.count("*").alias("rows"))
        filed.write.option("compression", "zstd").partitionBy("bucket").parquet(path)  # keys and digests are long and kept
        p, fs = store.file_system(self.spark, path)
        names = sorted(int(s.getPath().getName()[7:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("bucket="))
        return {"path": path, "buckets": names, "rows": counted.get["rows"], "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)}

    def replace(self, manifest: dict, table: str, df: DataFrame, buckets: Sequence[int]) -> DataFrame:
        """df in place of all that the given buckets held; older generations lose these buckets."""
        gone = set(buckets)
        entry = manifest["tables"][table]
        kept = [g | {"buckets": [b for b in g["buckets"] if b not in gone]} for g in entry["generations"]]
        entry["generations"] = [g for g in kept if g["buckets"]]
        return self.write(manifest, table, df)

    def tidy(self, manifest: dict) -> dict:
        """The manifest with more buckets where they are full, and with small generations merged."""
        for table, entry in manifest["tables"].items():
            rows = sum(g["rows"] for g in entry["generations"])
            wanted = entry["buckets"]
            while rows > wanted * self.rows_per_bucket:
                wanted *= 2
            if wanted > entry["buckets"]:
                whole = self.read(manifest, table)
                entry |= {"buckets": wanted, "generations": [self._generation(table, whole, wanted)]}
            elif len(entry["generations"]) > MOST:
                by_size = sorted(entry["generations"], key=lambda g: g["rows"])
                few = by_size[: len(by_size) // 2 + 1]
                merged = self.read({"tables": {table: {"generations": few}}}, table)
                entry["generations"] = [*(g for g in entry["generations"] if g not in few), self._generation(table, merged, entry["buckets"])]
        return manifest

    def clean(self) -> int:
        """Delete generations that no kept manifest names (of batches that were never published, or were merged); how many."""
        kept = set()
        for v in self._versions()[-KEPT_MANIFESTS:]:
            p, fs = store.file_system(self.spark, f"{self.path}/manifest-{v}.json")
            stream = fs.open(p)
            kept |= {g["path"] for t in json.loads(bytes(stream.readAllBytes()).decode())["tables"].values() for g in t["generations"]}
            stream.close()
        n = 0
        for table in self.keys:
            p, fs = store.file_system(self.spark, f"{self.path}/{table}")
            for s in fs.listStatus(p) if fs.exists(p) else []:
                path = f"{self.path}/{table}/{s.getPath().getName()}"
                if path not in kept:
                    fs.delete(s.getPath(), True)
                    n += 1
        return n
