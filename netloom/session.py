"""Sessions: a local one for tests and benches, and the package itself for the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

#: Bytes of an Arrow batch on its way to a Python worker, where the session does not set them. Spark's own 64 MB are held by
#: each task's worker, and several times outside the JVM's heap, since buffers double as they grow.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def ship(spark: SparkSession) -> SparkSession:
    """Hand this package to the Python workers once per application, through Spark's own file server; bound their batches."""
    if BATCH[0] not in spark.conf.getAll:
        spark.conf.set(*BATCH)
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        here = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="netloom-py-"), "netloom.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(here.rglob("*.py")):
                z.write(f, f.relative_to(here.parent))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, whose executors are the
    driver, gets a folder of its own where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="netloom-"))
    return sc.getCheckpointDir()


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the application ends."""
    root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return root


def cut(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read back: lineage ends there, and lost executors cost nothing."""
    path = own_folder(df.sparkSession, "netloom-cut") + "/t"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    return ship(
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
