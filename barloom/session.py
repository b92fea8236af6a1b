"""Session defaults, and the shared folder used to cut lineage or to write scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "barloom", shuffle_partitions: int | None = None) -> SparkSession:
    """A session for local runs. On a cluster, pass the session that the cluster made instead."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master).config("spark.driver.memory", "16g")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors see: `spark.checkpoint.dir`, else the checkpoint folder in use.

    Where neither is set, a machine-local folder stands in if the master is local, and elsewhere it is an error: what one
    executor wrote to its own disk, the others could not read.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="barloom-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def application_root(spark: SparkSession) -> str:
    """This application's folder in the shared one. The driver removes it when it ends."""
    root = f"{shared_root(spark)}/barloom-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _ROOTS.add(root)
    return root


_ROOTS: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in this application's folder."""
    return f"{application_root(spark)}/{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame) -> DataFrame:
    """Materialise `df` as a table in the shared folder and read that instead.

    Several consumers then share one computation, each reads only its columns, the planner knows the true size, and
    a lost executor costs no more than the tasks after this point.
    """
    path = scratch_path(df.sparkSession, "staged")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
