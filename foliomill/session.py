"""Session defaults and the few helpers that every operator shares."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a measured lookup table may be sent to every executor.
BROADCAST_ROWS = 300_000


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("foliomill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables (a file or a directory of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.  Where it is unset, a local master gets a temporary
    folder (kept for the session); on a cluster that is an error, as no such folder is shared."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = "file://" + tempfile.mkdtemp(prefix="spark-foliomill-")
    return _folders[app]


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut the lineage: write ``df`` as a table into the shared folder and read it back.

    The copy survives the loss of executors and is removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliomill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    found = spark.read.schema(df.schema).parquet(path)
    found.step_path = path
    return found


def release(spark: SparkSession, *steps: DataFrame) -> None:
    """Remove tables of ``materialize`` that nothing reads any more, and the shuffle files of all queries that have ended.

    Spark removes shuffle files when the driver's JVM collects its garbage, which may be long after the last use.
    """
    jvm = spark.sparkContext._jvm
    for step in steps:
        target = jvm.org.apache.hadoop.fs.Path(step.step_path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    gc.collect()  # the driver's Python holds on to plans
    jvm.System.gc()


def lookup_side(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast only if its counted rows stay within ``limit``; beyond it the join shuffles."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def tasks(spark: SparkSession) -> int:
    """How many tasks the cluster runs at once, as far as Spark knows."""
    return max(1, spark.sparkContext.defaultParallelism)
