"""Session helpers: local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on.  Duplicate JSON keys resolve to the last value
# (the behaviour of the standard JSON decoder the reference used).
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "riskflow") -> SparkSession:
    """Session for tests and the local bench (never used on a cluster)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_conf(spark)
    ship_package(spark)
    return spark


def ensure_conf(spark: SparkSession) -> SparkSession:
    """Apply the session settings the operators depend on (idempotent)."""
    for k, v in REQUIRED_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a running session: leave as configured
            pass
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (spark.checkpoint.dir).

    Only when it is unset (tests, local bench) a fresh folder under /tmp is
    created and registered; on a cluster the configured shared folder is used.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="riskflow-ckpt-", dir=os.environ.get("RISKFLOW_LOCAL_TMP", "/tmp"))
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers (once a session), for clusters on which it is not installed."""
    import riskflow

    sc = spark.sparkContext
    if getattr(sc, "_riskflow_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(riskflow.__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="riskflow-ship-", dir=os.environ.get("RISKFLOW_LOCAL_TMP")), "riskflow")
    sc.addPyFile(shutil.make_archive(base, "zip", root, "riskflow"))  # served by the driver to every executor
    sc._riskflow_shipped = True


TARGET_PARTITION_BYTES = 256 * 1024 * 1024


def target_partitions(df, bytes_per_partition: int = TARGET_PARTITION_BYTES) -> int:
    """Partition count for a full-data shuffle, never fewer than ``spark.sql.shuffle.partitions``.

    It follows the bytes of the tables that the plan reads (the estimate of the
    whole plan would multiply the sides of a join).  A leaf that is an RDD (a
    checkpoint, or rows from the driver) has no size: its partition count stands.
    """
    n, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 0
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    for i in range(leaves.length()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() in ("LogicalRDD", "ExternalRDD"):
            n = max(n, leaf.rdd().getNumPartitions())
        else:
            size += int(str(leaf.stats().sizeInBytes()))
    return max(n, -(-size // bytes_per_partition))


# Settings for large clusters (applied by the deployment, not by library code):
# AQE coalesces small shuffle partitions and splits skewed join partitions at
# run time; file splits of 256 MB keep scan tasks large.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TARGET_PARTITION_BYTES),
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.maxPartitionBytes": str(TARGET_PARTITION_BYTES),
    "spark.sql.shuffle.partitions": "8000",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.session.timeZone": "UTC",
}
