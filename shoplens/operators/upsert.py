"""Keyed upserts and write-side operators.

Without a transactional table format an upsert is a rewrite: the new table is
``target rows whose key is not in the batch`` + ``the latest batch row per
key``, written to a fresh directory and then published (``publish``).

Scale notes
-----------
* "Latest row per key" is a ``groupBy(key).agg(max(struct(order..., row)))``:
  partial aggregation keeps one row per key per task before the shuffle, so a
  key repeated across a third of the batch costs one row per task, not a
  third of the batch in one task (a ``row_number`` window would sort the whole
  group in one task).
* An upsert compares the target with the batch's keys alone; a batch of few
  keys is broadcast and the target is not shuffled.  A table that is kept by
  key over many batches belongs in ``sources.keyed_table``, which reads and
  rewrites only the key buckets that a batch touches.
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoplens.functions.exprs import attach
from shoplens.session import checkpoint_root, shuffles_freed


# Longer key lists are joined by a shuffle (or as the planner finds).
MAX_BROADCAST_KEYS = 100_000


def latest_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """W4 / dedup: the row with the greatest ``order`` tuple per key (ties must
    be broken by ``order`` itself for a deterministic result)."""
    oc = [F.col(c) if isinstance(c, str) else c for c in order]
    payload = [c for c in df.columns if c not in keys]
    win = F.max(F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(oc)], F.struct(*payload).alias("_row"))).alias("_w")
    return df.groupBy(*keys).agg(win).select(*keys, "_w._row.*")


def valid_key(keys: list[str]) -> Column:
    c = F.lit(True)
    for k in keys:
        c = c & F.col(k).isNotNull() & (F.col(k).cast("string") != "")
    return c


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str | Column],
           keep_newer_target: bool = True, keyed_batch: bool = False) -> DataFrame:
    """K1/K3: every target column overwritten by the batch's latest row per key;
    rows with an empty key are skipped.  A target row whose ``order`` tuple is
    greater survives an older delivery that arrives later (at a tie the batch
    wins); ``keep_newer_target=False`` lets the order of arrival decide.

    ``target`` has one row per key at most.  The batch is reduced to its latest
    rows and written once (a batch that is stored so already: ``keyed_batch``).
    Up to ``MAX_BROADCAST_KEYS`` of its keys and order values are broadcast, and
    then no target row is shuffled; more batch rows meet the target in one
    shuffle of both (joins took each twice and the target's plan as well).
    """
    spark, columns = target.sparkSession, target.columns
    oc = [F.col(c) if isinstance(c, str) else c for c in order]
    if not keyed_batch:
        path = staging_path(spark, "upsert-batch")
        with shuffles_freed(spark, batch.sparkSession):
            latest_per_key(batch.where(valid_key(keys)).select(*columns), keys, order).select(*columns).write.parquet(path)
        batch = spark.read.schema(target.schema).parquet(path)
    small = batch.count() <= MAX_BROADCAST_KEYS
    near = (lambda d: F.broadcast(d)) if small else (lambda d: d)
    stamp = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(oc)])
    if not keep_newer_target:
        return target.join(near(batch.select(*keys)), keys, "left_anti").unionByName(batch.select(*columns))
    if not small:
        rows = (target.withColumn("_in_batch", F.lit(False)).unionByName(batch.select(*columns).withColumn("_in_batch", F.lit(True)))
                .withColumn("_order", stamp))
        of_key = lambda which: F.max(F.when(which, F.col("_order"))).over(Window.partitionBy(*keys))
        met = rows.withColumn("_batch_order", of_key(F.col("_in_batch"))).withColumn("_stored_order", of_key(~F.col("_in_batch")))
        return met.where("IF(_in_batch, _stored_order IS NULL OR NOT _stored_order > _batch_order, "
                         "_batch_order IS NULL OR _order > _batch_order)").select(*columns)
    stamped = batch.select(*keys, stamp.alias("_batch_order"))
    # stored rows: those without a batch row, or later than it
    marked = target.withColumn("_stored_order", stamp).join(near(stamped), keys, "left")
    kept = marked.where("_batch_order IS NULL OR _stored_order > _batch_order").select(*columns)
    # batch rows: those that no later stored row beats
    beaten = (target.select(*keys, stamp.alias("_stored_order")).join(near(stamped), keys)
              .where("_stored_order > _batch_order").select(*keys))
    return kept.unionByName(batch.select(*columns).join(near(beaten), keys, "left_anti"))


def upsert_outcomes(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """K5: counters per outcome -- inserted / updated keys and skipped rows
    (empty key) -- as one row (fetched, inserted, updated, skipped)."""
    ok = valid_key(keys)
    bk = batch.where(ok).select(*keys).distinct()
    tk = target.select(*keys).distinct().withColumn("_hit", F.lit(True))
    o = bk.join(tk, keys, "left").groupBy().agg(
        F.count_if(F.col("_hit").isNull()).alias("inserted"), F.count_if(F.col("_hit")).alias("updated"))
    s = batch.agg(F.count(F.lit(1)).alias("fetched"), F.count_if(~ok).alias("skipped"))
    return attach(s, o).select(
        F.col("fetched").cast("bigint"), F.col("inserted").cast("bigint"), F.col("updated").cast("bigint"),
        F.col("skipped").cast("bigint"))


def product_upsert(target: DataFrame, batch: DataFrame, keys=("product_id", "platform"),
                   preserved=("total_gmv",), order: list[str | Column] = ()) -> DataFrame:
    """K2: product upsert keeping ``total_gmv`` of existing rows; batch rows
    overwrite every other column; new rows take the batch values.  Of several
    batch rows of a key the one with the greatest ``order`` tuple counts
    (columns of the batch, e.g. its sequence number; rows that tie in it are
    told apart by their values)."""
    keys = list(keys)
    rest = [c for c in target.columns if c not in keys]
    valid = batch.where(valid_key(keys))
    b = latest_per_key(valid, keys, [*order, F.struct(*rest)]).select(*target.columns)
    b = b.withColumn("_in_b", F.lit(True))
    t = target.withColumn("_in_t", F.lit(True))
    tb = t.select(*keys, "_in_t", *[F.col(c).alias(f"t__{c}") for c in target.columns if c not in keys])
    bb = b.select(*keys, "_in_b", *[F.col(c).alias(f"b__{c}") for c in target.columns if c not in keys])
    j = tb.join(bb, keys, "full_outer")
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in preserved:
            out.append(F.when(F.col("_in_t"), F.col(f"t__{c}")).otherwise(F.col(f"b__{c}")).alias(c))
        else:
            out.append(F.when(F.col("_in_b"), F.col(f"b__{c}")).otherwise(F.col(f"t__{c}")).alias(c))
    return j.select(*out)


def product_rollup(products: DataFrame, orders: DataFrame, platform: str = "tiktok") -> DataFrame:
    """K4 + J7: products of ``platform`` get total_gmv / total_sold from their
    non-refunded orders; products without orders keep their values; orders
    never create products (left join from the product side)."""
    o = orders.where((F.col("platform") == platform) & (F.col("status") != "refunded"))
    agg = o.groupBy("product_id", "platform").agg(F.sum("gmv").alias("_g"), F.sum("quantity").alias("_q"))
    j = products.join(agg, ["product_id", "platform"], "left")
    return j.select(*[
        (F.coalesce(F.col("_g").cast("decimal(38,2)"), F.col("total_gmv")).alias("total_gmv") if c == "total_gmv" else
         F.coalesce(F.col("_q").cast("bigint"), F.col("total_sold")).alias("total_sold") if c == "total_sold" else F.col(c))
        for c in products.columns])


def merge_keep_old(target: DataFrame, batch: DataFrame, key: str, order: list[str | Column] = (),
                   always_new: tuple[str, ...] = ("error",)) -> DataFrame:
    """K8: per column ``coalesce(new, old)`` -- absent (null) fields keep the
    stored value, but ``always_new`` columns of a batch that has them take the
    new value, null or not; new keys are inserted.  Of several batch rows of a
    key the one with the greatest ``order`` tuple counts (ties: by values)."""
    cols = [c for c in target.columns if c != key]
    tb = target.select(key, *[F.col(c).alias(f"o__{c}") for c in cols])
    rest = [c for c in batch.columns if c != key]
    last = latest_per_key(batch, [key], [*order, F.struct(*rest)])
    bb = last.select(key, F.lit(True).alias("_new"), *[(F.col(c) if c in batch.columns else F.lit(None)).alias(f"n__{c}") for c in cols])
    j = tb.join(bb, key, "full_outer")
    return j.select(key, *[
        F.when(F.col("_new"), F.col(f"n__{c}")).otherwise(F.col(f"o__{c}")).alias(c) if c in always_new and c in batch.columns
        else F.coalesce(F.col(f"n__{c}"), F.col(f"o__{c}")).alias(c) for c in cols])


def widen(df: DataFrame, schema, defaults: dict | None = None) -> DataFrame:
    """Add every column of ``schema`` missing from ``df`` (typed null or
    the given default); existing columns untouched; idempotent."""
    defaults = defaults or {}
    have = set(df.columns)
    out = df
    for f in schema.fields:
        if f.name not in have:
            v = defaults.get(f.name)
            out = out.withColumn(f.name, F.lit(v).cast(f.dataType))
    return out


def utc_migration(orders: DataFrame, platform: str = "tiktok", hours: int = 8,
                  columns=("paid_at", "rts_time", "delivery_time", "update_time"),
                  version_col: str = "tz_version") -> DataFrame:
    """Shift the time columns of ``platform`` rows back by ``hours``
    (local wall clock -> UTC).  A ``tz_version`` column makes it idempotent:
    rows already at version 1 are left alone."""
    done = F.coalesce(F.col(version_col), F.lit(0)) >= 1 if version_col in orders.columns else F.lit(False)
    todo = (F.col("platform") == platform) & ~done
    shift = F.expr(f"INTERVAL {int(hours)} HOURS")
    ver = F.when(todo, F.lit(1)).otherwise(F.col(version_col) if version_col in orders.columns else F.lit(0))
    return orders.select(*[
        F.when(todo & F.col(c).isNotNull(), F.col(c) - shift).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        for c in orders.columns if c != version_col], ver.cast("int").alias(version_col))


# ---------------------------------------------------------------- storage
def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh directory under the shared checkpoint folder."""
    return os.path.join(checkpoint_root(spark), "tables", f"{name}-{uuid.uuid4().hex}")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> str:
    """Write parquet (optionally partitioned, e.g. by paid month for pruning)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def publish(spark: SparkSession, df: DataFrame, table_dir: str, partition_by: list[str] | None = None) -> str:
    """Commit of a new table version: it is written to a fresh directory and
    then named by a further line under ``<table_dir>/_CURRENT``.  Lines are only
    ever added (a commit of Spark's file writer), so there is no moment without
    a valid version; readers take the line with the highest number."""
    version = os.path.join(table_dir, f"v-{uuid.uuid4().hex}")
    write_table(df, version, partition_by)
    mark_current(spark, table_dir, version)
    return version


def _marker(spark: SparkSession, table_dir: str) -> tuple[int, str] | None:
    """(number, path) of the newest version; None only where no marker exists.
    An unreadable or empty marker is an error: taking it for "no version yet"
    would replace the table by the next batch alone."""
    try:
        row = spark.read.text(os.path.join(table_dir, "_CURRENT")).agg(F.max("value")).first()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    if row is None or not row[0] or " " not in row[0]:
        raise RuntimeError(f"{table_dir}/_CURRENT names no version")
    number, _, path = row[0].partition(" ")
    return int(number), path


def mark_current(spark: SparkSession, table_dir: str, version: str) -> None:
    last = _marker(spark, table_dir)
    line = f"{(last[0] if last else 0) + 1:012d} {version}"
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(os.path.join(table_dir, "_CURRENT"))


def current_version(spark: SparkSession, table_dir: str) -> str | None:
    last = _marker(spark, table_dir)
    return last[1] if last else None


def read_current(spark: SparkSession, table_dir: str) -> DataFrame | None:
    v = current_version(spark, table_dir)
    return spark.read.parquet(v) if v else None


def append_record(spark: SparkSession, rows: list[tuple], schema, path: str) -> None:
    """K6/K9: append registry / report rows (small, one file per call)."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def newest(df: DataFrame, ts: str = "created_at", n: int = 50, where: Column | None = None) -> DataFrame:
    """K7/K9/L3: the ``n`` newest rows (optionally filtered); equal times are
    ordered by the other columns."""
    d = df if where is None else df.where(where)
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    return d.orderBy(F.col(ts).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in df.columns
                                                    if c != ts and kinds[c] not in ("map", "variant")]).limit(n)


def delete_by_key(df: DataFrame, key: str, values: list) -> DataFrame:
    """K9 delete: the table without the given keys (rewrite + publish)."""
    drop = df.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    if len(values) <= MAX_BROADCAST_KEYS:
        drop = F.broadcast(drop)
    return df.join(drop, df[key].cast("string") == drop[key], "left_anti")


def export_json(df: DataFrame, path: str) -> None:
    """JSON lines export of a page payload."""
    df.write.mode("overwrite").json(path)
