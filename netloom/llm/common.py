"""Helpers shared by the operators: tables, stage tables in the shared folder, free column names, byte-text batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from netloom.session import own_folder, ship

#: White space as the operators' contracts define it, as a Java character class.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Stages:
    """Intermediate tables in the shared folder. A written table cuts lineage and outlives executors; those that a lazy
    result may still read go when the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = ship(spark)
        self.root = own_folder(spark, f"netloom-{name}")
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Delete stage tables at once that no lazy result still reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
                p = jvm.org.apache.hadoop.fs.Path(f)
                p.getFileSystem(conf).delete(p, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that clash with no column of df, compared as Spark compares them."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def filter_rows(df: DataFrame, run) -> DataFrame:
    """df.mapInArrow(run) for a run that keeps the columns, whatever their names are."""
    names = [f"c{i}" for i in range(len(df.columns))]
    schema = StructType([StructField(n, f.dataType, True) for n, f in zip(names, df.schema.fields, strict=True)])
    return df.toDF(*names).mapInArrow(run, schema).toDF(*df.columns)


def slices(batches, rows: int = 256):
    """Smaller record batches, so that Python holds few texts at a time however large Spark's batches are."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def texts(column: pa.Array) -> list[bytes]:
    """The strings of an Arrow column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
