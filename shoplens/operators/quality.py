"""Data-quality and reconciliation aggregates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens import constants as K
from shoplens.functions import exprs as X
from shoplens.functions.periods import Window
from shoplens.operators.ranking import global_rank

def _zero():
    return F.lit(0).cast("decimal(14,2)")


def row_counts(orders: DataFrame, products: DataFrame, influencers: DataFrame) -> DataFrame:
    """Rows per standard table and suspicious influencers, as (table, rows)."""
    o = orders.agg(F.count(F.lit(1)).alias("n")).select(F.lit("orders").alias("table"), "n")
    p = products.agg(F.count(F.lit(1)).alias("n")).select(F.lit("products").alias("table"), "n")
    i = influencers.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("is_suspicious", F.lit(False))).alias("s"))
    return (o.unionByName(p)
            .unionByName(i.select(F.lit("influencers").alias("table"), "n"))
            .unionByName(i.select(F.lit("suspicious_influencers").alias("table"), F.col("s").alias("n")))
            .select("table", F.col("n").cast("bigint").alias("rows")))


def window_timezone_diff(orders: DataFrame, window: Window, offset_hours: int = 8) -> DataFrame:
    """A25 + J9: orders, units, gmv excluding / including refunds for the UTC
    window and for the same local-calendar window at UTC+offset (shifted back
    by ``offset_hours`` in UTC), in one pass; differences and % change."""
    sh = dt.timedelta(hours=offset_hours)
    a0, a1, b0, b1 = window.start, window.end, window.start - sh, window.end - sh
    ts = F.col("paid_at")
    in_a = (ts >= F.lit(a0)) & (ts < F.lit(a1))
    in_b = (ts >= F.lit(b0)) & (ts < F.lit(b1))
    lo, hi = min(a0, b0), max(a1, b1)
    o = orders.where((ts >= F.lit(lo)) & (ts < F.lit(hi)))
    nr = F.col("status") != K.REFUNDED
    m = o.agg(*[e for p, cond in (("utc", in_a), ("local", in_b)) for e in (
        F.count_if(cond).alias(f"{p}_orders"),
        F.coalesce(F.sum(F.when(cond, F.col("quantity"))), F.lit(0)).alias(f"{p}_units"),
        X.sum0(F.when(cond & nr, F.col("gmv"))).alias(f"{p}_gmv_valid"),
        X.sum0(F.when(cond, F.col("gmv"))).alias(f"{p}_gmv_all"))])
    rows = F.explode(F.array(*[
        F.struct(F.lit(k).alias("metric"), F.col(f"utc_{k}").cast("double").alias("utc"), F.col(f"local_{k}").cast("double").alias("local"))
        for k in ("orders", "units", "gmv_valid", "gmv_all")]))
    return m.select(rows.alias("r")).select(
        "r.metric", F.round("r.utc", 2).alias("utc"), F.round("r.local", 2).alias("local"),
        F.round(F.col("r.local") - F.col("r.utc"), 2).alias("diff"),
        F.round(X.ratio((F.col("r.local") - F.col("r.utc")) * 100, "r.utc"), 2).alias("diff_pct"))


ORDER_ID_RE = r"^5[78].{16}$"


def id_compliance(orders: DataFrame, products: DataFrame, platform: str = "tiktok") -> DataFrame:
    """A26 + F18 for one platform: order ids of 18 chars starting 57/58, product
    ids of 17 chars in the products and on the orders -- compliant count and %
    per check."""
    orders, products = (d.where(F.col("platform") == platform) for d in (orders, products))
    by_length = F.count_if(F.length("product_id") == 17).alias("ok")
    o = orders.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("order_id").rlike(ORDER_ID_RE)).alias("ok"))
    p = products.agg(F.count(F.lit(1)).alias("n"), by_length)
    q = orders.where(F.col("product_id").isNotNull()).agg(F.count(F.lit(1)).alias("n"), by_length)
    out = (o.select(F.lit("order_id_format").alias("check"), "n", "ok")
           .unionByName(p.select(F.lit("product_id_length").alias("check"), "n", "ok"))
           .unionByName(q.select(F.lit("order_product_id_length").alias("check"), "n", "ok")))
    return out.select("check", F.col("n").cast("bigint").alias("total"), F.col("ok").cast("bigint").alias("compliant"),
                      F.coalesce(F.round(X.ratio(F.col("ok") * 100.0, "n"), 2), F.lit(0.0)).alias("pct"))


def update_month_hist(orders: DataFrame, ts: str = "update_time") -> DataFrame:
    """Rows per month of ``ts`` and the overall latest value on every row."""
    g = orders.where(F.col(ts).isNotNull()).groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), F.max(ts).alias("m"))
    mx = g.agg(F.max("m")).scalar()
    return (g.withColumn("latest", mx)
             .select("month", F.col("rows").cast("bigint").alias("rows"),
                     F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("latest")))


def head_concentration(orders: DataFrame, share: float = 0.2, key: str = "product_id") -> DataFrame:
    """A28 + W6: share of non-refunded gmv held by the top ``share`` of keys
    (at least one), ranked by gmv desc then key -- a distributed global rank."""
    per = orders.groupBy(key).agg(X.sum0(X.valid_gmv()).alias("g"))
    ranked = global_rank(per, [F.col("g").desc(), F.col(key)], "rk")
    n = per.agg(F.count(F.lit(1)).alias("n"), F.sum("g").alias("tot"))
    j = X.attach(ranked, n)
    k = F.greatest(F.lit(1), F.floor(F.col("n") * share))
    head = j.where(F.col("rk") <= k).agg(F.sum("g").alias("head"), F.first("n").alias("n"), F.first("tot").alias("tot"),
                                        F.count(F.lit(1)).alias("k"))
    return head.select(F.col("n").cast("bigint").alias("keys"), F.col("k").cast("bigint").alias("head_keys"),
                       X.money_out("head").alias("head_gmv"), X.money_out("tot").alias("total_gmv"),
                       F.round(X.ratio(F.col("head") * 100, "tot"), 2).alias("head_share_pct"))
