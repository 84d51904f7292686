"""SparkSession helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC so timestamp_ntz arithmetic and month
# truncation agree with the SQL oracle; AQE so shuffle partitions coalesce
# and skewed joins split at run time.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "cargolens") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if master and master.startswith("local"):
        # In local mode the executors live in the driver JVM: its heap is the
        # only memory there is (default 1 GB). Set before the JVM starts.
        builder = builder.config("spark.driver.memory",
                                 os.environ.get("CARGOLENS_DRIVER_MEMORY", "12g"))
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the session settings the queries depend on (idempotent)."""
    for k, v in REQUIRED_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the deployment sets it to a shared filesystem. Where it is
    unset, a local session (one machine, so a local folder is shared) gets a
    fresh scratch folder, which its context remembers; any other is an error.
    """
    context, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not named and context.master.split("[")[0] != "local":
        raise ValueError(f"spark.checkpoint.dir is not set: on {context.master} intermediate tables need a folder "
                         "that the driver and all executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="cargolens-ckpt-"))
    return named or context.getCheckpointDir()


def size_for_input(spark: SparkSession, input_bytes: int, target_partition_bytes: int = 256 << 20) -> int:
    """Size shuffles for an input of ``input_bytes`` (e.g. 100 TB).

    The initial shuffle partition count is input / target (AQE then coalesces
    small partitions and splits skewed ones at run time), and scan splits
    match the target, so a task's share fits in executor memory with room to
    spill. Returns the partition count it set.
    """
    n = max(1, -(-input_bytes // target_partition_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(target_partition_bytes))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_partition_bytes // 2))
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
                   str(target_partition_bytes * 2))
    return n
