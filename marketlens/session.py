"""Spark session settings and the shared checkpoint folder.

Everything here is plain Spark configuration.  The defaults aim at a large
cluster: adaptive execution re-plans joins and partition counts from real
shuffle statistics, skewed sort-merge partitions are split, and broadcasts
are left to Spark's own size threshold instead of hints on data whose size
grows with the input.
"""

from __future__ import annotations

import atexit
import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on.  Values a cluster operator sets explicitly
# (through spark-defaults or --conf) are left alone.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # Broadcasts: the planner only for inputs whose (compressed) file
    # statistics are under 10 MB; anything larger only when AQE has measured
    # the shuffled side at runtime to be under 64 MB.
    "spark.sql.autoBroadcastJoinThreshold": "10m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str | None = None,
    app_name: str = "marketlens",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the library's settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if not shuffle_partitions and not (master or "").startswith("local"):
        # Start wide; adaptive execution merges what turns out small.
        conf["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = "4000"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("FATAL")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    On a cluster ``spark.checkpoint.dir`` must point at shared storage; it is
    read from the session.  Only a local-mode session without one (tests,
    benchmarks) gets a fresh scratch folder of its own.  Works on classic and
    Spark Connect sessions (the latter have no SparkContext).
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect
        sc = None
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc is not None:
            sc.setCheckpointDir(configured)
            return sc.getCheckpointDir()
        return configured
    master = sc.master if sc is not None else spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; name a shared folder for it"
        )
    scratch = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
    if sc is not None:
        sc.setCheckpointDir(scratch)
        return sc.getCheckpointDir()
    spark.conf.set("spark.checkpoint.dir", scratch)
    return scratch


def _folder(spark: SparkSession, path: str):
    """(file system, Hadoop path) of a folder, wherever it is stored."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    files, folder = _folder(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(folder)) if files.exists(folder) else []


def stored_files(spark: SparkSession, pattern: str) -> list[tuple[str, int, int]]:
    """(path, length, time of change) of the files and folders a pattern names."""
    files, path = _folder(spark, pattern)
    return sorted((f.getPath().toString(), f.getLen(), f.getModificationTime())
                  for f in files.globStatus(path) or [])


def remove_folder(spark: SparkSession, path: str) -> None:
    files, folder = _folder(spark, path)
    files.delete(folder, True)


# Folders written by ``materialize`` that nothing has released yet.
_HELD: set[str] = set()


def _release_held() -> None:
    """At the end of the driver: what its lazy results read is needed no more."""
    from pyspark import SparkContext

    spark = SparkSession.getActiveSession() if SparkContext._active_spark_context is not None else None
    while spark is not None and _HELD:
        remove_folder(spark, _HELD.pop())


atexit.register(_release_held)


def materialize(df, name: str):
    """Cut lineage by writing ``df`` as Parquet under the shared checkpoint
    folder and reading it back (one job; survives the loss of executors).
    The folder goes with ``release``, or else when the driver ends."""
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    _HELD.add(path)
    df.write.parquet(path)
    out = spark.read.parquet(path)
    out._materialized_at = path
    return out


def release(*frames) -> None:
    """Remove the folders of frames returned by ``materialize`` that nothing
    reads any more; other frames are left alone."""
    for df in frames:
        path = getattr(df, "_materialized_at", None)
        if path is None:
            continue
        remove_folder(df.sparkSession, path)
        _HELD.discard(path)
