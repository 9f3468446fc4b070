"""Session settings the library expects."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile

from pyspark.sql import SparkSession

# Runtime settings every plan here relies on. AQE sizes the shuffles, turns a
# shuffle join into a broadcast one when the *measured* side is small, and
# splits skewed join partitions.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    # Sums that leave their type's range are errors, never wrapped or NULL.
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A broadcast may have to wait for the aggregation of a large table that feeds it.
    "spark.sql.broadcastTimeout": "3600",
    # The JVM never compiles a method above 8000 bytes of bytecode. A wide projection
    # (a normalized row) fused into one such method would run interpreted; beyond the
    # limit Spark generates it as several smaller ones instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

TARGET_PARTITION_BYTES = 256 * 1024 * 1024


def shuffle_partitions_for(input_bytes: int, floor: int = 8) -> int:
    """Number of initial shuffle partitions so that one holds about 256 MB.

    AQE coalesces downwards but never splits an ordinary aggregation
    partition, so the initial number has to fit the largest shuffle.
    """
    return max(floor, -(-input_bytes // TARGET_PARTITION_BYTES))


def build_session(app_name: str = "backhaul", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or get) a session; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**RUNTIME, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_runtime(spark: SparkSession) -> SparkSession:
    """Set the runtime options on a session somebody else created."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for written intermediates, as named by the session.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (tests, a laptop) does a local folder serve.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_scratch(spark.sparkContext.applicationId)


@functools.cache
def _local_scratch(application: str) -> str:
    """One folder per application, which goes when this process ends."""
    folder = tempfile.mkdtemp(prefix="backhaul-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder
