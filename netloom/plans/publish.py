"""Publishing: JSON documents, sharded adjacency, digests, and the atomic swap of a whole snapshot."""

from __future__ import annotations

import contextlib
import gzip
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators.topology import BUCKETS, bucket


def documents(nodes: DataFrame, key: str, order: list, name: str, fields: list[str]) -> DataFrame:
    """key, json: one document per key, its items in order. Keys are tiles or groups of bounded size."""
    items = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("_o"), F.struct(*fields).alias("_v"))))
    docs = nodes.groupBy(key).agg(items.alias("i"))
    return docs.select(key, F.to_json(F.struct(F.col(key).alias("id"), F.transform("i", lambda x: x["_v"]).alias(name))).alias("json"))


def write_documents(docs: DataFrame, key: str, path: str) -> None:
    """One JSON text file below a folder per key."""
    docs.select(key, F.col("json").alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def sharded_adjacency(adj: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, asn, json: each AS's neighbours in order. adj: asn, nbr, role, position."""
    near = F.transform(F.array_sort(F.collect_list(F.struct("position", "nbr", "role"))), lambda x: F.array(x["nbr"].cast("string"), x["role"]))
    docs = adj.groupBy("asn").agg(F.to_json(F.struct(near.alias("neighbors"))).alias("json"))
    return docs.withColumn("bucket", bucket(F.col("asn"), buckets))


def write_sharded(df: DataFrame, path: str, key: str = "asn", buckets: int = BUCKETS) -> None:
    """Parquet below one folder per bucket; each bucket is written by few tasks, so files stay few."""
    keyed = df if "bucket" in df.columns else df.withColumn("bucket", bucket(F.col(key), buckets))
    keyed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def keyed_lines(df: DataFrame, value: Column) -> DataFrame:
    """bucket, json: a line {"asn": value} for each network, so that a bucket of any size is written by rows."""
    return df.select("bucket", F.to_json(F.create_map(F.col("asn").cast("string"), value)).alias("json"))


def file_sizes(spark: SparkSession, root: str) -> DataFrame:
    """path, length, gzip_length (level 6) of every document below root; files are read one by one."""

    def sizes(batches):
        for b in batches:
            b["gzip_length"] = [len(gzip.compress(c, 6, mtime=0)) for c in b.pop("content")]
            yield b

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(root)
    return files.select("path", "length", "content").mapInPandas(sizes, "path string, length bigint, gzip_length bigint")


def file_manifest(sizes: DataFrame) -> DataFrame:
    """One row: number of files, their bytes, bytes after gzip, the largest file and its bytes (of equals the first path)."""
    return sizes.agg(
        F.count("*").alias("files"), F.sum("length").alias("totalJsonBytesExcludingManifest"), F.sum("gzip_length").alias("estimatedGzipBytesExcludingManifest"),
        F.min_by("path", F.struct(-F.col("length"), "path")).alias("largestFile"), F.max("length").alias("largestFileBytes"))


class Published:
    """Snapshots of named tables below a root. A new one becomes current only after all of its tables are written; a
    failed load leaves the old one in place."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _path(self, p: str):
        path = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}")
        return path, path.getFileSystem(self.conf)

    @contextlib.contextmanager
    def staged(self, df: DataFrame):
        """df, written once below the root and read back; deleted at the end."""
        place = f".staged-{uuid.uuid4().hex}"
        path, fs = self._path(place)
        try:
            df.write.parquet(f"{self.root}/{place}")
            yield self.spark.read.schema(df.schema).parquet(f"{self.root}/{place}")
        finally:
            fs.delete(path, True)

    def publish(self, tables: dict[str, DataFrame], snapshot: str) -> str:
        """Writes the tables, then points CURRENT at them by one rename."""
        place = f"{snapshot}-{uuid.uuid4().hex[:8]}"
        try:
            for name, df in tables.items():
                df.write.parquet(f"{self.root}/{place}/{name}")
        except Exception:
            path, fs = self._path(place)
            fs.delete(path, True)
            raise
        temp, fs = self._path(f".current-{uuid.uuid4().hex}")
        out = fs.create(temp, True)
        out.write(bytearray(json.dumps({"place": place, "tables": sorted(tables)}).encode()))
        out.close()
        current, _ = self._path("CURRENT")
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename").getField("OVERWRITE").get(None)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(current.toUri() if current.toUri().getScheme() else fs.getUri(), self.conf)
        context.rename(temp, current, options)
        return place

    def current(self) -> dict | None:
        path, fs = self._path("CURRENT")
        if not fs.exists(path):
            return None
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/CURRENT").collect()))

    def table(self, name: str) -> DataFrame:
        now = self.current()
        if now is None:
            raise LookupError("nothing is published")
        return self.spark.read.parquet(f"{self.root}/{now['place']}/{name}")
