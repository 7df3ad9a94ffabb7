"""Session helpers: a test session, and reliable checkpoints in the cluster's shared folder."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table (bytes) that is broadcast after its size was measured.
BROADCAST_BYTES = 64 * 1024 * 1024


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spectrafold")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder. Where the session names none, a local session gets a temporary one; on a cluster that
    is an error, as executors and driver would each write to their own disks."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spectrafold-ckpt-")
    sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Compute *df* once and cut its lineage with a reliable checkpoint (survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def measured_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """*df* (materialized) with a broadcast hint if it was measured to have at most *limit* bytes; else without, and a join
    with it is a shuffle join whose skewed partitions adaptive execution splits."""
    size = df.select(F.length(F.to_json(F.struct("*"))).cast("long").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= limit else df


def one_of(what: str, value, known: Sequence) -> None:
    """Raises unless *value* is one of *known*."""
    if value not in known:
        raise ValueError(f"{what}: {value!r} is none of {', '.join(map(str, sorted(known)))}")
