"""Session helpers: one place for settings, the shared work folder and materialised tables."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[int, str] = {}
_SCRATCH: set[str] = set()


def local_session(cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and Spark runs inside one local
    process is a temporary folder used instead; on a cluster an unset folder is an error, never a guess.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = id(sc)
    if key not in _OWN:
        _OWN[key] = "file://" + tempfile.mkdtemp(prefix="cliploom-")
        sc.setCheckpointDir(_OWN[key])
    return _OWN[key]


def scratch_dir(spark: SparkSession) -> str:
    """The folder of this application's own tables, below ``shared_dir``. They are what queries are computed from, so they
    stay while the driver's process lives and are removed when it ends, or by ``drop_scratch``."""
    path = f"{shared_dir(spark)}/cliploom-{spark.sparkContext.applicationId}"
    if path not in _SCRATCH:
        _SCRATCH.add(path)
        jpath, conf = spark._jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._jsc.hadoopConfiguration()

        def remove() -> None:
            try:
                jpath.getFileSystem(conf).delete(jpath, True)
            except Exception:  # the JVM may have ended before; then the folder is left to whoever owns the shared one
                pass

        atexit.register(remove)
    return path


def drop_scratch(spark: SparkSession) -> None:
    """Remove all tables that queries of this application have stored. Results that were not computed yet are lost."""
    drop_path(spark, scratch_dir(spark))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own for a table that lives as long as the driver's process."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there and the loss of an executor costs
    no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, for costly work on a stored table that comes in fewer pieces than there are cores. A table in
    more pieces is left as it is, so at scale nothing is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark remove shuffle files of plans that nothing refers to any more; it does so when the driver's JVM collects
    garbage, which a mostly idle driver would put off until the disk is full."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
