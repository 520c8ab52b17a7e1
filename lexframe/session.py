"""Session helpers: building a session for local runs and finding the shared scratch folder.

On a cluster the session is created by the platform; the library only reads
``spark.checkpoint.dir`` from it. A directory is chosen here only when that setting
is unset, which happens in local tests.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"
_SHUFFLES_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app: str = "lexframe", driver_memory: str = "16g") -> SparkSession:
    """Session for tests, the bench and local use (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    When a local session has none (tests), a fresh temporary folder is set so that
    ``DataFrame.checkpoint()`` and written intermediate tables work. On a cluster the
    setting is required: a folder of one machine would not be seen by the others.
    """
    path = spark.conf.get(_CKPT_KEY, None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set {_CKPT_KEY} to a shared folder (master is {master})")
        path = tempfile.mkdtemp(prefix="lexframe-ckpt-")
        spark.conf.set(_CKPT_KEY, path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique table location under the shared checkpoint folder."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _scratch_root(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/lexframe/{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> int:
    """Remove the intermediate tables that this application has written with ``scratch_path``; returns how many. To be
    called once the results are written: frames that still read such a table cannot be used afterwards."""
    root = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return 0
    tables = len(fs.listStatus(root))
    fs.delete(root, True)
    return tables


@contextmanager
def dropping_shuffles(spark: SparkSession):
    """Statements of this block (writes, not frames that are used again) remove their shuffle files when they end, instead of
    leaving them until the driver happens to collect its garbage."""
    before = spark.conf.get(_SHUFFLES_KEY, None)
    spark.conf.set(_SHUFFLES_KEY, "true")
    try:
        yield
    finally:
        spark.conf.unset(_SHUFFLES_KEY) if before is None else spark.conf.set(_SHUFFLES_KEY, before)


@contextmanager
def scratch_table(df, name: str = "held"):
    """``df`` computed once, as a compressed table of the shared scratch folder that lasts as long as the block. For rows
    with long texts: a checkpoint holds them uncompressed, and for an unknown time."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    try:
        with dropping_shuffles(spark):
            df.write.option("compression", "zstd").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut_lineage(df):
    """Materialise ``df`` with a reliable checkpoint in the shared checkpoint folder
    (survives executor loss; never a local checkpoint) and return the checkpointed frame."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
