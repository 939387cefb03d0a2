"""Ranking helpers that stay distributed.

``global_rank`` numbers the rows of a frame 1..n in a total order without a
single-partition window: ``orderBy`` range-partitions and sorts the data, each
row then gets its index inside its partition from
``monotonically_increasing_id`` (partition id in the upper bits, position in
the lower 33), and a per-partition row count -- one row per partition, a size
bounded by the partition count -- supplies the offset of every partition.
The numbered rows are checkpointed (reliably, to ``spark.checkpoint.dir``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LOW_BITS = (1 << 33) - 1


def global_rank(df: DataFrame, order_cols, out: str = "rank") -> DataFrame:
    """Add ``out`` = 1-based position of each row in ``order_cols`` order.

    The order must be total (include a unique tie-break key) for the result
    to be deterministic.
    """
    from shoplens.session import checkpoint_root
    checkpoint_root(df.sparkSession)  # make sure a shared checkpoint folder is set
    s = (df.orderBy(*order_cols)
           .withColumn("_mid", F.monotonically_increasing_id())
           .withColumn("_pid", F.shiftright(F.col("_mid"), 33))
           .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit(LOW_BITS))))
    # reliable checkpoint (files under spark.checkpoint.dir): both branches
    # below read the same numbered partitions, and a lost executor recovers
    # them from files instead of re-sorting
    s = s.checkpoint(eager=True)
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a global window here sees at most #partitions rows
    offs = counts.select("_pid", (F.sum("_n").over(W.orderBy("_pid")) - F.col("_n")).alias("_off"))
    return (s.join(F.broadcast(offs), "_pid")
             .withColumn(out, F.col("_off") + F.col("_pos") + 1)
             .drop("_mid", "_pid", "_pos", "_off"))


def exact_quantile(df: DataFrame, column: str, q: float = 0.5, out: str = "quantile") -> DataFrame:
    """One row with the exact ``q`` quantile of ``column`` (linear between the
    two nearest ranks; nulls are skipped; null without values).

    Selection by running counts: equal values are counted first, so a value that
    a third of all rows hold is one row; the distinct values are range
    partitioned in order, and of the per-partition totals (one row each) follows
    which partition holds the ranks sought.  Only that partition's values are
    numbered -- no task holds a map of all values."""
    from shoplens.session import checkpoint_root
    if not 0 <= q <= 1:
        raise ValueError("q must lie in [0, 1]")
    checkpoint_root(df.sparkSession)
    counts = (df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
              .groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy("v").withColumn("pid", F.spark_partition_id())
              .checkpoint(eager=True))  # both passes below read the same partitions
    parts = counts.groupBy("pid").agg(F.sum("n").alias("held"))
    # one row per partition
    upto = parts.select("pid", (F.sum("held").over(W.orderBy("pid")) - F.col("held")).alias("before"), "held",
                        F.sum("held").over(W.partitionBy(F.lit(0))).alias("total"))
    at = F.lit(q) * (F.col("total") - 1)  # position from 0
    lo, hi = F.floor(at), F.ceil(at)
    near = upto.where((F.col("before") <= hi) & (F.col("before") + F.col("held") > lo))
    numbered = counts.join(F.broadcast(near), "pid").withColumn(
        "last", F.col("before") + F.sum("n").over(W.partitionBy("pid").orderBy("v")) - 1)
    first = F.col("last") - F.col("n") + 1
    ends = numbered.agg(F.max(F.when((first <= lo) & (F.col("last") >= lo), F.col("v"))).alias("a"),
                        F.max(F.when((first <= hi) & (F.col("last") >= hi), F.col("v"))).alias("b"),
                        F.max(at - lo).alias("part"))
    return ends.select((F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias(out))
