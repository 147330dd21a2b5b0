"""Session helpers: the UTC clock, the shared folder and intermediate tables in it."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("barloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="barloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """``df`` written once as Parquet below the shared folder and read again: a lost executor replays nothing before it.

    Unlike an RDD checkpoint the copy is columnar, so later reads prune columns and the planner knows its size.
    The folder is deleted by Hadoop when the driver's JVM ends, or earlier by ``unstage``.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Deletes the files of a frame returned by ``stage`` that nothing reads any more (rounds of a loop)."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """One partition per core for heavy row work on an input too small to fill the cores by its splits.

    The planner's size estimate decides, so nothing runs while the plan is built. The shuffle moves at most a split per
    core; every larger input passes through.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * split else df


#: Stored bytes of input per part; small rows pack some hundred thousand into this.
PART_BYTES = 8 << 20


def parted(df: DataFrame, source: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` into parts whose number follows the stored size of ``source``, so a task's hash table does not grow with the input.

    Adaptive parts are cut by compressed bytes, of which short rows pack very many. Inputs of no more parts than cores pass through.
    """
    size = int(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = math.ceil(size / PART_BYTES)
    return df.repartition(parts, *keys) if parts > df.sparkSession.sparkContext.defaultParallelism else df
