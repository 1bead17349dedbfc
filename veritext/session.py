"""Session construction and shared run-time settings."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Default knobs for local runs. On a cluster the session is supplied by the
# caller and none of these are forced on it.
LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Explicit size-checked broadcasts only; the planner's own guess is kept
    # small so that it never broadcasts a side that grows with the corpus.
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
}


def default_driver_memory(share: float = 0.6, cap_gb: int = 16, floor_gb: int = 2) -> str:
    """A local-mode heap that fits the machine: a share of RAM, capped."""
    try:
        with open("/proc/meminfo") as f:
            kb = int(next(line for line in f if line.startswith("MemTotal")).split()[1])
        gb = int(kb / 1024 / 1024 * share)
    except (OSError, StopIteration, ValueError):
        gb = cap_gb // 2
    return f"{max(floor_gb, min(cap_gb, gb))}g"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "veritext", driver_memory: str | None = None) -> SparkSession:
    driver_memory = driver_memory or default_driver_memory()
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory))
    for k, v in LOCAL_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is taken as is.
    Only when it is unset on a local master (tests) is a scratch folder
    created; on several machines each would see a folder of its own.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder there that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="veritext-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for intermediate tables under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}"


#: Whether the shuffle files of a query are removed when it ends, and not when the driver happens to collect its plan.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Queries begun in this block remove their shuffle files when they end."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame below the shared checkpoint folder and read it back:
    later steps reuse it without recomputing, and nothing stays cached.  The
    shuffles behind the frame go with the write."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# A side of a join is broadcast up to this size, else both sides are shuffled.
BROADCAST_BYTES = 64 << 20


def side(df: DataFrame, row_bytes: int = 100) -> DataFrame:
    """``df`` marked for broadcast if its rows times ``row_bytes`` are few enough."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
