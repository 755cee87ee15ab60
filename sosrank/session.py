"""SparkSession helpers.

Library code never creates a session itself; these helpers are for tests,
``bench.py`` and command-line use.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # checkpointed intermediates (materialised stats) are removed once their DataFrame is garbage-collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None,
                  driver_memory: str = "8g", app: str = "sosrank",
                  extra: dict | None = None) -> SparkSession:
    """A local session sized for ``cores`` threads."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cores)
    conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


MB = 1024 * 1024


def cluster_conf(shuffle_bytes: int, executors: int, cores_per_executor: int,
                 target_partition_bytes: int = 200 * MB, scan_split_bytes: int = 256 * MB) -> dict[str, str]:
    """Session settings for a cluster run, sized from the expected shuffle volume.

    Shuffle partitions are the larger of the total core count and
    ``shuffle_bytes / target_partition_bytes``, so each reducer holds about
    ``target_partition_bytes`` (AQE coalesces smaller ones at run time and splits
    skewed join partitions). The checkpoint folder is not set here: it must name
    shared storage and is read from the cluster's configuration.
    """
    cores = max(1, executors * cores_per_executor)
    partitions = max(cores, -(-shuffle_bytes // target_partition_bytes))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(scan_split_bytes),
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.showConsoleProgress": "false",
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a scratch one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS, object
    store); it is read from the session and never overridden. Only when it is
    missing (local tests) is a fresh scratch folder created.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: checkpoints use the server's spark.checkpoint.dir
        if not base:
            raise ValueError("spark.checkpoint.dir is not set on the server")
        return base
    if base:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(base)
        return base
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: name a shared folder (e.g. on HDFS or an object "
                         "store) for checkpoints and intermediate tables")
    base = tempfile.mkdtemp(prefix="sosrank-ckpt-")
    sc.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A location under the shared checkpoint folder for written intermediate tables."""
    return os.path.join(ensure_checkpoint_dir(spark), name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: every later use sees the same rows, and a lost
    executor re-reads files."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
