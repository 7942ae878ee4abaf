"""Session and scratch-folder helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Temporary folders of applications on one machine that were started without spark.checkpoint.dir.
_OWN: dict[str, str] = {}


def session(app: str = "brindle", master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine expects: UTC, adaptive execution."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
    )
    return (b.master(master) if master else b).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder. Only Spark opens the path, so any Hadoop file system will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset on one machine (tests) a temporary folder is made, one for each application; a cluster
    without one is an error, as its executors can't see the driver's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(spark.sparkContext.applicationId)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="brindle-")
        _OWN[spark.sparkContext.applicationId] = found  # the setting itself can only be given to a new session
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/brindle-{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def materialize(df: DataFrame, name: str, kept: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts lineage: a lost executor repeats no earlier stage, as the rows lie in the
    shared folder. Nothing is kept on executors. The path is added to ``kept``, for ``release``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if kept is not None:
        kept.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, kept: list[str]) -> None:
    """Remove written tables that nothing reads any more, and let Spark drop the shuffle files of their jobs."""
    for path in kept:
        drop_path(spark, path)
    kept.clear()
    gc.collect()
    spark._jvm.System.gc()


def few(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; else the planner chooses."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame, *by: str, rows: int = 50_000) -> DataFrame:
    """``df`` dealt by the columns ``by`` into parts of about ``rows`` rows, so that a task's share doesn't grow with the input or with how its files are cut."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(n, *by)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder as soon as nothing reads it any more."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
