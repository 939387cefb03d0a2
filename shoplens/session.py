"""SparkSession settings the library relies on.

Every operator assumes: UTC session time zone (naive feed times are UTC wall
clock), ANSI mode on (bad casts raise, so parsers use ``try_*``), and AQE on so
joins against dimensions whose size is only known at runtime can switch to a
broadcast hash join after the size check AQE performs on the shuffle output.
"""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings applied to every session the library builds or is handed.
SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # gbk / gb18030 uploads (see sources.uploads) need the full JVM charset list.
    "spark.sql.legacy.javaCharsets": "true",
    # coalesce to the advisory partition size rather than keeping parallelism:
    # on a large cluster this is what turns many shuffle partitions into
    # right-sized tasks
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    # session windows: merge sessions inside each input partition before the
    # shuffle, so a user with a huge share of events is pre-combined map-side
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}

# Shuffle partitions on a cluster where the setting was left at Spark's default
# (200 partitions cannot hold a 100 TB shuffle).  AQE coalesces the surplus.
MIN_CLUSTER_SHUFFLE_PARTITIONS = 4000


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to an existing session.

    On a non-local master whose ``spark.sql.shuffle.partitions`` is still the
    default, raise it to ``max(MIN_CLUSTER_SHUFFLE_PARTITIONS, 3 x default
    parallelism)``; an explicitly chosen value is left alone.
    """
    for k, v in SQL_CONF.items():
        spark.conf.set(k, v)
    sc = _context(spark)
    master = (sc.master if sc is not None else spark.conf.get("spark.master", "")) or ""
    if not master.startswith("local") and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        n = max(MIN_CLUSTER_SHUFFLE_PARTITIONS, 3 * (sc.defaultParallelism if sc is not None else 0))
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
    return spark


def _context(spark: SparkSession):
    """The SparkContext, or None where there is none (Spark Connect)."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect sessions have no context
        return None


def app_id(spark: SparkSession) -> str:
    """Application id (session-scoped caches key on it)."""
    sc = _context(spark)
    return sc.applicationId if sc is not None else spark.conf.get("spark.app.id", "session")


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts, streaming checkpoints and staged tables.

    Reads ``spark.checkpoint.dir`` from the session (on a cluster it names a
    shared file system), else the context's checkpoint directory.  Where both
    are unset, a local session gets a temporary folder; on a cluster that is
    an error, as executors do not share machine-local folders.
    """
    sc = _context(spark)
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d and sc is not None:
        d = sc.getCheckpointDir()
    if not d:
        master = sc.master if sc is not None else "remote"
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir (or SparkContext.setCheckpointDir) to a folder all executors share")
        d = tempfile.mkdtemp(prefix="shoplens-ckpt-")
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


@contextmanager
def shuffles_freed(*sessions: SparkSession):
    """What is written in here leaves no shuffle files behind: Spark removes them
    as the write ends, where it would otherwise wait for the driver to collect
    its garbage, while later steps fill the disks.  For writes alone: a frame
    that is run a second time would have to shuffle again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = [s.conf.get(name) for s in sessions]
    for s in sessions:
        s.conf.set(name, "true")
    try:
        yield
    finally:
        for s, v in zip(sessions, before, strict=True):
            s.conf.set(name, v)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote and nothing reads any more."""
    sc = _context(spark)
    if sc is not None:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "shoplens") -> SparkSession:
    """Session for tests and the local bench (``local[cores]``, UI off)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("SHOPLENS_DRIVER_MEM", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in SQL_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
