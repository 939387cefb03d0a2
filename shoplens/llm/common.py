"""Helpers the operators of this subpackage share: reading tables, the shared
scratch folder, word and shingle expressions, and row order over a whole table.
"""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The white space that separates words.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_REGEX = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans(UPPER, LOWER)

SHINGLE_WORDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``.

    A local session without the setting (tests) gets a temporary folder; on a
    cluster a missing setting is an error, as machine-local folders lose data.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="shoplens-llm-")
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and
    makes the rows the same for every later job, whatever executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """Words of a text as an array; null or blank text gives an empty array."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(F.length(t) > 0, F.split(t, SPACE_REGEX)).otherwise(F.array().cast("array<string>"))


def shingle_hashes(text: Column, n: int = SHINGLE_WORDS) -> Column:
    """64-bit hashes of the ``n``-word shingles in order, lower-cased; a text of
    fewer words is one shingle, a text without words none."""
    hashed = F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))
    return F.transform(F.array(hashed), lambda h: F.when(
        F.size(h) >= n,
        F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[h[i + k] for k in range(n)])),
    ).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>")))[0]


def text_key(text: Column) -> Column:
    """128 bits that tell texts apart; rows equal in id and text share them."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit(29), t, F.length(t)).alias("b"))


def ranged(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` (narrow rows) in range partitions of ``order``, stored, with the
    partition's number as ``pid`` and a ``salt`` that orders equal rows, so a
    group of equal rows of any size is split over partitions too."""
    n = n_partitions(df.sparkSession)
    out = (df.withColumn("salt", F.monotonically_increasing_id())
           .repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in order], F.col("salt"))
           .withColumn("pid", F.spark_partition_id()))
    return stored(out, name)


def row_numbers(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """Rows numbered 0, 1, ... in ``order`` (nulls first) without a global
    window, as column ``row``; and the number of rows.

    Only the row count of each range partition comes to the driver.
    """
    spark = df.sparkSession
    parts = ranged(df, order, name)
    starts, total = [], 0
    for r in sorted(parts.groupBy("pid").count().collect()):
        starts.append((r["pid"], total))
        total += r["count"]
    if not starts:
        return parts.withColumn("row", F.lit(0).cast("bigint")).drop("pid", "salt"), 0
    start = F.element_at(F.create_map(*[F.lit(x).cast("bigint") for p in starts for x in p]), F.col("pid").cast("bigint"))
    w = Window.partitionBy("pid").orderBy(*[F.col(c).asc_nulls_first() for c in order], "salt")
    return parts.withColumn("row", F.row_number().over(w) - 1 + start).drop("pid", "salt"), total


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once per row."""
    return F.transform(F.array(value), body)[0]


def broadcast_if(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` (a stored table) with a broadcast hint if it has ``max_rows`` rows
    at most; a larger one is left to a shuffled join."""
    return F.broadcast(df) if df.count() <= max_rows else df


def kept(name: str, make):
    """An object that a Python worker keeps from task to task (its own module
    is sent by value and starts anew with each)."""
    store = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def lean(run):
    """``run`` (a function from iterator to iterator), giving the memory that it
    freed back to the system at the end: Python workers outlive their tasks, and
    an idle one would keep it from the stages that follow."""

    def leaner(rows):
        try:
            yield from run(rows)
        finally:
            import pyarrow as pa
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
            if trim:
                trim(0)

    return leaner
