"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "kartlane") -> SparkSession:
    """Return (or create) a session tuned for the engine.

    On a cluster the session already exists and is returned untouched except
    for SQL confs that only steer planning.  Locally (tests, bench) we build a
    ``local[N]`` session with the UI off.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = (SparkSession.builder
         .master(master or f"local[{cpus}]")
         .appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", "16g")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.sql.parquet.datetimeRebaseModeInRead", "CORRECTED"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


BYTES_A_TASK = 8 << 20   # of Parquet input to one shuffle task; aggregates hold some 30 times that in memory


def shuffle_by_size(spark: SparkSession, size: int) -> None:
    """As many shuffle partitions as a table of ``size`` bytes calls for, so that a task's memory does not grow with the input.

    A session's larger number and its smaller advisory size stay, and AQE merges what turns out
    small. The settings only ever get finer, since lazy frames are planned when they run.
    """
    tasks, advisory = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    wanted = min(-(-size // BYTES_A_TASK), 4000)
    if wanted > int(spark.conf.get(tasks)):
        spark.conf.set(tasks, str(wanted))
    if wanted > 1 and _bytes(spark.conf.get(advisory)) > BYTES_A_TASK:   # else AQE merges up to 64 MB of compressed rows
        spark.conf.set(advisory, f"{BYTES_A_TASK}b")


def _bytes(text: str) -> int:
    """Bytes of a size as Spark writes it (``64MB``, ``16m``, ``1024``)."""
    number = text.strip().lower().rstrip("b")
    unit = number[-1] if number[-1:].isalpha() else ""
    return int(number.removesuffix(unit)) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """A table written inside takes the shuffle files of its job with it, which else stay until the driver collects garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet below the shared checkpoint folder: for large tables, of which readers take few columns."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables of which all readers have been written."""
    for t in tables:
        remove(t.sparkSession, t._folder)


@contextlib.contextmanager
def scratch():
    """``written`` for tables that are deleted at the end: what is made of them inside must have been written by then."""
    made = []
    try:
        yield lambda df: made.append(written(df)) or made[-1]
    finally:
        discard(*made)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder for cutting lineage.

    The cluster names it in ``spark.checkpoint.dir``; we only invent one when
    it is unset (local tests), and then under this process's own scratch dir.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="kartlane-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf
