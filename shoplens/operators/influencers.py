"""Influencer analytics.

Joins against the order fact always pre-aggregate the orders to one row per
join key first (sums and counts are additive), so a creator who owns a third
of all orders is combined map-side instead of being shuffled as raw lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens import constants as K
from shoplens.functions import exprs as X
from shoplens.functions.periods import Window

def _zero():
    return F.lit(0).cast("decimal(14,2)")

METRIC_COLS = ["creator_id", "name", "category", "gmv", "orders", "roi", "followers",
               "engagement_rate", "conversion_rate", "is_suspicious"]


def _metric_view(df: DataFrame) -> DataFrame:
    return df.select(
        "creator_id", "name", "category", X.money_out("gmv").alias("gmv"),
        F.col("orders").cast("bigint").alias("orders"), F.round("roi", 2).alias("roi"),
        F.coalesce("followers", F.lit(0)).cast("bigint").alias("followers"),
        "engagement_rate", "conversion_rate", F.coalesce("is_suspicious", F.lit(False)).alias("is_suspicious"))


def influencer_metrics(influencers: DataFrame, creator_name: str | None = None, top_n: int = 10) -> DataFrame:
    """A14 + J6 + D2: exact-name match (F12), or the top ``top_n`` by gmv plus
    every flagged influencer not already listed.  ``source`` says which."""
    if creator_name:
        hit = influencers.where(F.col("name") == creator_name).orderBy(F.col("gmv").desc(), "creator_id").limit(top_n)
        return _metric_view(hit).withColumn("source", F.lit("name"))
    top = influencers.orderBy(F.col("gmv").desc(), "creator_id").limit(top_n)
    flagged = (influencers.where(F.coalesce("is_suspicious", F.lit(False)))
                          .join(top.select("creator_id"), "creator_id", "left_anti"))
    return (_metric_view(top).withColumn("source", F.lit("top"))
            .unionByName(_metric_view(flagged).withColumn("source", F.lit("flagged"))))


def influencer_product(orders: DataFrame, influencers: DataFrame, products: DataFrame, window: Window,
                       limit: int = 20) -> DataFrame:
    """A15 + J2: per (influencer, product) sales (refunds included), orders,
    mean order value, units, the influencer's conversion (r4) and roi (r2);
    top ``limit`` by sales."""
    o = orders.where(window.contains("paid_at") & F.col("creator_id").isNotNull())
    pre = o.groupBy("creator_id", "product_id", "platform").agg(
        F.sum("gmv").alias("s"), F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("u"))
    j = (pre.join(influencers.select("creator_id", F.col("name").alias("influencer_name"), "conversion_rate", "roi"), "creator_id")
            .join(products.select("product_id", "platform", F.col("name").alias("product_name")), ["product_id", "platform"]))
    g = j.groupBy("creator_id", "influencer_name", "product_id", "product_name", "conversion_rate", "roi").agg(
        F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("u").alias("u"))
    top = g.orderBy(F.col("s").desc(), "creator_id", "product_id").limit(limit)
    return top.select(
        F.col("creator_id").alias("influencer_id"), "influencer_name", "product_id", "product_name",
        X.money_out("s").alias("total_sales"), F.col("n").cast("bigint").alias("total_orders"),
        F.round(F.col("s").cast("double") / F.col("n"), 2).alias("avg_order_value"),
        F.col("u").cast("bigint").alias("total_units"),
        F.round(F.coalesce("conversion_rate", F.lit(0.0)), 4).alias("conversion_rate"),
        F.round(F.coalesce("roi", F.lit(0.0)), 2).alias("roi"))


def influencer_performance(orders: DataFrame, influencers: DataFrame, window: Window, limit: int = 10,
                           ever: str | None = None) -> DataFrame:
    """A18 + J4: influencers with their in-range sales and order count.

    Reference semantics of the left join + post-filter: an influencer with no
    orders at all is kept (sales null, orders 0); one whose orders all fall
    outside the window disappears.  Sorted by sales desc, nulls last.

    ``ever`` names a column of ``influencers`` that holds the number of orders
    ever attributed (the stored roll-up).  With it only the window's orders are
    read, so a table partitioned by month is pruned; without it the roll-up is
    made from all ``orders``.
    """
    o = orders.where(F.col("creator_id").isNotNull())
    inr = window.contains("paid_at")
    if ever is not None:
        agg = o.where(inr).groupBy("creator_id").agg(F.sum("gmv").alias("s"), F.count(F.lit(1)).alias("n_in"))
        kept = (F.col("n_in") > 0) | (F.coalesce(F.col(ever), F.lit(0)) == 0)
    else:
        agg = o.groupBy("creator_id").agg(
            F.sum(F.when(inr, F.col("gmv"))).alias("s"), F.count_if(inr).alias("n_in"),
            F.count(F.lit(1)).alias("n_all"))
        kept = (F.col("n_in") > 0) | F.col("n_all").isNull()
    j = influencers.join(agg, "creator_id", "left").where(kept)
    top = j.orderBy(F.col("s").desc_nulls_last(), "creator_id").limit(limit)
    return top.select(
        F.col("creator_id").alias("influencer_id"), F.col("name").alias("influencer_name"),
        F.coalesce("followers", F.lit(0)).cast("bigint").alias("follower_count"),
        F.round(F.coalesce("engagement_rate", F.lit(0.0)), 4).alias("engagement_rate"),
        F.round(F.coalesce("conversion_rate", F.lit(0.0)), 4).alias("conversion_rate"),
        F.round(F.coalesce("roi", F.lit(0.0)), 2).alias("roi"),
        F.coalesce("is_suspicious", F.lit(False)).alias("is_suspicious"),
        X.money_out(F.coalesce("s", _zero())).alias("total_sales"),
        F.coalesce("n_in", F.lit(0)).cast("bigint").alias("total_orders"))


def red_list(performance: DataFrame, n: int = 5) -> DataFrame:
    """not suspicious and sales > 0, first ``n`` in sales order."""
    return (performance.where(~F.col("is_suspicious") & (F.col("total_sales") > 0))
            .orderBy(F.col("total_sales").desc(), "influencer_id").limit(n))


def suspicious_top(influencers: DataFrame, n: int = 5, **rule) -> DataFrame:
    """A20 (second half): influencers matching F9, highest engagement first; the
    stored ``suspicious_reason`` where there is one."""
    reason = F.col("suspicious_reason") if "suspicious_reason" in influencers.columns else F.lit(None).cast("string")
    s = influencers.where(X.suspicious(**rule))
    return s.orderBy(F.col("engagement_rate").desc_nulls_last(), "creator_id").limit(n).select(
        F.col("creator_id").alias("influencer_id"), F.col("name").alias("influencer_name"),
        F.coalesce("followers", F.lit(0)).cast("bigint").alias("follower_count"),
        F.coalesce("engagement_rate", F.lit(0.0)).alias("engagement_rate"),
        F.coalesce("conversion_rate", F.lit(0.0)).alias("conversion_rate"),
        F.coalesce(reason, F.lit("互动多而成交极少")).alias("risk_reason"))


# ---------------------------------------------------------------- influencer cards (webhook dashboard)
def cards(influencers: DataFrame) -> DataFrame:
    """Card projection; zero rates become null."""
    return influencers.select(
        F.coalesce("creator_id", "name").alias("influencer_id"), "name", "platform",
        F.col("followers").cast("bigint").alias("followers"),
        F.nullif("engagement_rate", F.lit(0.0)).alias("engagement_rate"),
        F.nullif("conversion_rate", F.lit(0.0)).alias("conversion_rate"),
        F.nullif("roi", F.lit(0.0)).alias("roi"),
        F.coalesce("is_suspicious", F.lit(False)).alias("is_suspicious"),
        F.col("category").alias("niche"))


def card_summary(cards_df: DataFrame) -> DataFrame:
    """Count, follower total, mean non-null roi (r2, 0 if none), suspicious count."""
    return cards_df.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum(F.coalesce("followers", F.lit(0))), F.lit(0)).cast("bigint").alias("total_followers"),
        F.coalesce(F.round(F.avg("roi"), 2), F.lit(0.0)).alias("avg_roi"),
        F.count_if(F.coalesce("is_suspicious", F.lit(False))).alias("suspicious"))


def platform_mix(cards_df: DataFrame) -> DataFrame:
    """Count per platform (null -> unknown), descending."""
    return (cards_df.groupBy(F.coalesce("platform", F.lit(K.UNKNOWN_PLATFORM)).alias("platform"))
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "platform"))


def roi_buckets(cards_df: DataFrame, edges=K.ROI_BUCKETS, value: str = "roi") -> DataFrame:
    """Counts per roi bucket, null roi skipped, all buckets present."""
    spark = cards_df.sparkSession
    b = (cards_df.where(F.col(value).isNotNull()).groupBy(X.bucket(value, edges).alias("range"))
         .agg(F.count(F.lit(1)).alias("n")))
    names = spark.createDataFrame([(i, n) for i, (n, _, _) in enumerate(edges)], "idx int, range string")
    return F.broadcast(names).join(b, "range", "left").select(
        "idx", "range", F.coalesce("n", F.lit(0)).cast("bigint").alias("count"))


def top_followers(cards_df: DataFrame, n: int = 10) -> DataFrame:
    """Top ``n`` by followers (null -> 0)."""
    f = F.coalesce("followers", F.lit(0))
    return cards_df.orderBy(f.desc(), "influencer_id").limit(n).select("influencer_id", "name", "platform", f.cast("bigint").alias("followers"))


def influencer_stats(influencers: DataFrame) -> DataFrame:
    """Suspicious rate % and means of positive engagement / conversion (r1)."""
    pos = lambda c: F.when(F.col(c) > 0, F.col(c))  # noqa: E731 - F21
    return influencers.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.round(X.ratio(F.count_if(F.coalesce("is_suspicious", F.lit(False))) * 100.0, F.count(F.lit(1))), 1), F.lit(0.0)).alias("suspicious_rate"),
        F.round(F.avg(pos("engagement_rate")), 1).alias("avg_engagement"),
        F.round(F.avg(pos("conversion_rate")), 1).alias("avg_conversion"))


def flagged(influencers: DataFrame, min_engagement: float = K.SUSPICIOUS_MIN_ENGAGEMENT,
            max_conversion: float = K.SUSPICIOUS_MAX_CONVERSION) -> DataFrame:
    """F9 as a column: ``flagged`` = stored flag OR the engagement/conversion rule."""
    return influencers.withColumn("flagged", X.suspicious(min_engagement=min_engagement, max_conversion=max_conversion))


def creator_rollup(orders: DataFrame, influencers: DataFrame) -> DataFrame:
    """Influencer gmv (refunded excluded) / orders from attributed orders,
    roi = gmv / cost (null when cost is 0)."""
    roll = (orders.where(F.col("creator_id").isNotNull()).groupBy("creator_id")
            .agg(X.sum0(X.valid_gmv()).alias("g"), F.count(F.lit(1)).alias("n")))
    j = influencers.select("creator_id", "name", "cost").join(roll, "creator_id", "left")
    g = F.coalesce("g", _zero())
    return j.select("creator_id", "name", X.money_out(g).alias("gmv"), F.coalesce("n", F.lit(0)).cast("bigint").alias("orders"),
                    X.money_out("cost").alias("cost"),
                    F.when(F.col("cost") > 0, F.round(g.cast("double") / F.col("cost").cast("double"), 2)).alias("roi"))


def product_rollup_totals(orders: DataFrame) -> DataFrame:
    """A33 (product half): total gmv (refunded excluded) and units per product."""
    return (orders.groupBy("product_id", "platform")
            .agg(X.sum0(X.valid_gmv()).alias("total_gmv"),
                 F.coalesce(F.sum(F.when(F.col("status") != K.REFUNDED, F.col("quantity"))), F.lit(0)).cast("bigint").alias("total_sold")))


def match_scores(requests: DataFrame, influencers: DataFrame) -> DataFrame:
    """A34 + T16: rule score per request (record_id, influencer_name, followers).

    Unknown name -> 72.  Known -> clamp(int(roi*30 + min(followers,1e6)/1e6*40),
    20, 98) with roi null/0 -> 1.0 and followers from the request; a suspicious
    influencer scores 25.  A name matching several influencers uses the one
    with the highest gmv (the source system takes the first of its top-N list).
    """
    best = (influencers.groupBy("name")
            .agg(F.max(F.struct("gmv", F.col("creator_id"), "roi", F.col("is_suspicious"))).alias("b"))
            .select("name", "b.roi", "b.is_suspicious"))
    j = requests.join(best, requests.influencer_name == best.name, "left")
    roi = F.coalesce(F.nullif(F.col("roi"), F.lit(0.0)), F.lit(1.0))
    f = F.least(F.coalesce(F.col("followers").cast("double"), F.lit(0.0)), F.lit(1e6))
    raw = (roi * 30 + f / 1e6 * 40)
    clamp = F.greatest(F.lit(20), F.least(F.lit(98), F.when(raw >= 0, F.floor(raw)).otherwise(F.ceil(raw)).cast("int")))
    score = (F.when(F.col("name").isNull(), F.lit(72))
              .when(F.coalesce("is_suspicious", F.lit(False)), F.lit(25))
              .otherwise(clamp))
    return j.select("record_id", "influencer_name", score.alias("ai_match_score"),
                    X.score_band(score).alias("band"))


def benchmark_flag(c, lo_hi) -> "F.Column":
    """Below / within / above a benchmark range."""
    lo, hi = lo_hi
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x.isNull(), None).when(x < lo, "below").when(x > hi, "above").otherwise("within")


def sort_nulls_last(df: DataFrame, column: str, descending: bool = True, ties: tuple[str, ...] = ()) -> DataFrame:
    """User-chosen sort column and direction (of influencers or
    products), nulls always last, equal values in ascending order of ``ties``."""
    c = F.col(column)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), *[F.col(t) for t in ties])


def top_by_roi(influencers: DataFrame, n: int = 3) -> DataFrame:
    """Top ``n`` influencers by roi (null reads as 0), ties by id."""
    r = F.coalesce(F.col("roi"), F.lit(0.0))
    return influencers.orderBy(r.desc(), "creator_id").limit(n).select(
        "creator_id", "name", F.round(r, 2).alias("roi"), X.money_out("gmv").alias("gmv"))
