"""Session settings and the shared folder used for checkpoints and staged tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def builder(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession.Builder:
    """A local session for tests and the bench. On a cluster use the session you are given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("leadq")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.codegen.hugeMethodLimit", "8000")  # the JVM only interprets longer methods
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that
    setting gets a temporary folder of its own.
    """
    local = spark.sparkContext.master.split("[")[0] == "local"
    path = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
        if path:
            path = path.rsplit("/", 1)[0]  # Spark appends a folder per application
    if not path:
        if not local:
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
        path = "file:" + tempfile.mkdtemp(prefix="leadq-")
        spark.conf.set(CHECKPOINT_CONF, path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/leadq-{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage of a loop and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_open: list[list[str]] = []


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What is staged inside is deleted at the end, unless it is staged to be kept."""
    _open.append([])
    try:
        yield
    finally:
        for folder in _open.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def open_files(spark: SparkSession, files: int) -> Iterator[None]:
    """A task that writes inside keeps that many files open before it sorts its rows by folder."""
    conf, name = spark.conf, "spark.sql.maxConcurrentOutputFileWriters"
    was = conf.get(name)
    if files:
        conf.set(name, str(files))
    try:
        yield
    finally:
        conf.set(name, was)


#: Tasks for each core that a stage is cut into, where it has rows enough.
TASKS_PER_CORE = 3


@contextlib.contextmanager
def balanced(*sessions: SparkSession) -> Iterator[None]:
    """Stages inside have several tasks for each core, so that their last ones don't leave most cores idle, and a join whose smaller side
    is small in every task is made by hash, without sorting the rows of the other side."""
    was = []
    for spark in {id(s._jsparkSession): s for s in sessions}.values():
        tasks = str(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
        names = {
            "spark.sql.files.minPartitionNum": tasks,
            "spark.sql.adaptive.coalescePartitions.minPartitionNum": tasks,
            "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"),
        }
        was += [(spark, name, spark.conf.get(name, None)) for name in names]
        for name, value in names.items():
            spark.conf.set(name, value)
    try:
        yield
    finally:
        for spark, name, value in was:
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None, keep: bool = False, folders: int = 0) -> DataFrame:
    """Write `df` to the shared folder and read it back, so that later passes over it read
    only the columns they need and never repeat the work that produced it. Rows of up to `folders` folders are not sorted for them."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    if _open and not keep:
        _open[-1].append(path)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with open_files(spark, folders):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
