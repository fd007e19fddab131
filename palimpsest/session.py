"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch holds at most: texts may be long, so batches stay small.
ARROW_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors and keep Arrow batches small.

    The package is zipped once per Spark application and sent through Spark's own file server, so it
    does not matter how the driver found it.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_palimpsest_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):
        folder = tempfile.mkdtemp()
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        target = os.path.join(folder, "palimpsest_code.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for base, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(base, name)
                        z.write(path, os.path.join("palimpsest", os.path.relpath(path, root)))
        sc.addPyFile(target)
    sc._palimpsest_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables beside each other under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, each: int = 1) -> DataFrame:
    """``df`` over no fewer partitions than ``each`` a core: a small table comes in few file splits, a large one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism * each
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    All folders of an application stand in one, which goes when the application ends. Only local masters
    may do without the setting (tests): a temporary folder takes its place there.
    """
    sc = spark.sparkContext
    home = getattr(sc, "_palimpsest_dir", None)
    if home is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base:
            home = f"{base.rstrip('/')}/palimpsest-{uuid.uuid4().hex}"
            path = sc._jvm.org.apache.hadoop.fs.Path(home)
            files = path.getFileSystem(sc._jsc.hadoopConfiguration())
            files.mkdirs(path)
            files.deleteOnExit(path)
        elif sc.master.startswith("local"):
            home = tempfile.mkdtemp(prefix="palimpsest-")
            atexit.register(shutil.rmtree, home, ignore_errors=True)
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc._palimpsest_dir = home
    return f"{home}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends in files that survive executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gone(spark: SparkSession, path: str) -> None:
    """Delete a folder whose rows are no longer asked for."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def in_order(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``place``: the number of each row, from 0, by ``order``.

    Rows are sorted by ranges and numbered within partitions; partitions begin after the rows of those before
    them, so that no task sees all rows.
    """
    n = F.monotonically_increasing_id()
    held = cut(df.orderBy(*order).select("*", F.shiftright(n, 33).alias("part"), n.bitwiseAND((1 << 33) - 1).alias("within")))
    sizes = held.groupBy("part").agg(F.count("*").alias("n")).collect()  # a row a partition
    begins, total = [], 0
    for r in sorted(sizes):
        begins.append((r.part, total))
        total += r.n
    starts = df.sparkSession.createDataFrame(begins, "part long, begin long")
    return held.join(F.broadcast(starts), "part").withColumn("place", F.col("begin") + F.col("within")).drop("part", "within", "begin")
