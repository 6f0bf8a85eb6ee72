"""SparkSession construction and cluster-shared settings."""

from __future__ import annotations

import contextlib
import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on.  AQE re-plans joins and partition counts from
# the real shuffle sizes, which is what keeps broadcast decisions size-checked
# at runtime; the session zone is pinned so NTZ <-> instant casts are stable.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Settings for large runs, on top of BASE_CONF.  Streaming state goes to RocksDB
# (off-heap; the default provider keeps every key's state on the JVM heap, which is
# faster for small state, as in the tests, and fails for large state).  Shuffle
# partitions start at the count the caller gives and are merged by AQE to the advisory size.
CLUSTER_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
    "spark.sql.files.maxPartitionBytes": str(256 << 20),
}


def build_session(master: str = "local[*]", app: str = "tollgate", shuffle_partitions: int | None = None,
                  extra: dict | None = None, cluster: bool = False) -> SparkSession:
    """Session for tests and local runs (``cluster=True`` adds CLUSTER_CONF).

    ``shuffle_partitions`` must be given for a cluster (about the shuffled bytes over
    128 MB); a local session takes 8.  On a cluster, prefer the cluster's session with
    CLUSTER_CONF applied at submit time."""
    if shuffle_partitions is None:
        if cluster:
            raise ValueError("shuffle_partitions must be given for a cluster: it depends on the data")
        shuffle_partitions = 8
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(BASE_CONF)
    if cluster:
        conf.update(CLUSTER_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_query_conf(spark: SparkSession) -> None:
    """Pin the settings the queries depend on for exact results."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.ansi.enabled", "true")  # an overflow is an error, never a wrong number


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names it; only a local session may leave it unset and gets one of its own.
    The SparkContext is pointed at it once (each call to setCheckpointDir would
    make a new sub-folder).
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        current = sc.getCheckpointDir()
        if not current and not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = current.rsplit("/", 1)[0] if current else tempfile.mkdtemp(prefix="tollgate-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


# Shuffled bytes a task reads inside small_tasks(), the most tasks that AQE may keep apart for that, and
# the file bytes a task scans (and aggregates before the shuffle).
SMALL_TASKS = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": str(8 << 20),
               "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "2000",
               "spark.sql.files.maxPartitionBytes": str(32 << 20)}


@contextlib.contextmanager
def small_tasks(spark: SparkSession):
    """What runs inside is scanned and, by AQE, shuffled in tasks of a fixed size, as many as the data needs.

    For steps that sort and aggregate several large inputs by one key in the same task: with a fixed number of
    partitions a task's memory would grow with the data."""
    before = {c: spark.conf.get(c, None) for c in SMALL_TASKS}
    for c, v in SMALL_TASKS.items():
        spark.conf.set(c, v)
    try:
        yield
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)


def stable(df):
    """``df`` computed once and kept in the shared checkpoint folder (never on one executor)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder, e.g. for streaming state."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name) if "://" not in base else base.rstrip("/") + "/" + name
