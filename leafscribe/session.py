"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Bytes of one Arrow batch handed to Python, where the session sets no bound.
BATCH_BYTES = 16 << 20
LOCAL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Checkpoint files go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int = 8, **extra: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("leafscribe")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "12g")
    )
    for key, value in {**LOCAL_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches in bytes, so that very long texts do not pile up, unless the user did."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "-1", str(2**63 - 1)):
        spark.conf.set(key, str(BATCH_BYTES))


def use_shared_checkpoints(spark: SparkSession) -> None:
    """Point checkpoints at `spark.checkpoint.dir`; a private folder only on a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="leafscribe-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def pin(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder, so that later steps all see the same rows."""
    use_shared_checkpoints(df.sparkSession)
    return df.checkpoint()
