"""Group-by breakdowns of the order fact.

Scale notes
-----------
* Products are joined to orders *after* the orders are pre-aggregated to one
  row per (product_name, product_id, platform): the sums are additive and the
  joined attributes are per-product, so the result equals joining raw lines
  while the join input shrinks from order lines to distinct products.
* Share-of-total on outputs whose group count grows with the data (providers,
  categories) reads the total as a scalar subquery; a global ``over ()``
  window is used only where the group count is fixed (statuses, order types,
  bands).
* Top-k is ``orderBy(...).limit(k)`` -> ``TakeOrderedAndProject``: each task
  keeps k rows, so no task sees more than k rows per input partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoplens import constants as K
from shoplens.functions import exprs as X
from shoplens.functions.periods import Window
from shoplens.operators.kpi import _scope

def _zero():
    return F.lit(0).cast("decimal(14,2)")


def with_share(df: DataFrame, value: str, out: str, digits: int = 1) -> DataFrame:
    """Add ``out = value / sum(value) * 100``; the total is a scalar subquery
    (computed once, read as a value), so any group count is fine."""
    tot = df.agg(F.sum(value)).scalar()
    return df.withColumn(out, F.round(X.ratio(F.col(value) * 100.0, tot), digits))


def _fixed_share(value: str, digits: int = 1) -> Column:
    """Share of total for frames with a fixed, small number of rows."""
    return F.round(X.ratio(F.col(value) * 100.0, F.sum(value).over(W.partitionBy())), digits)


# ---------------------------------------------------------------- products
def product_stats(orders: DataFrame, products: DataFrame, window: Window | None, shop_ids=None) -> DataFrame:
    """Per product name: non-refunded gmv and units, max(category), max(price)
    from the product dimension (J1 left join on product_id + platform)."""
    o = _scope(orders, window, shop_ids)
    pre = o.groupBy("product_name", "product_id", "platform").agg(
        X.sum0(X.valid_gmv()).alias("gmv"),
        F.coalesce(F.sum(F.when(F.col("status") != K.REFUNDED, F.col("quantity")).otherwise(0)), F.lit(0)).alias("units"),
        F.count(F.lit(1)).alias("lines"))
    dim = products.select("product_id", "platform", "category", "price")
    j = pre.join(dim, ["product_id", "platform"], "left")
    return j.groupBy(F.col("product_name").alias("product")).agg(
        F.sum("gmv").alias("gmv"), F.sum("units").cast("bigint").alias("units"),
        F.sum("lines").cast("bigint").alias("lines"),
        F.max("category").alias("category"), F.max("price").alias("price"))


def top_products(orders: DataFrame, products: DataFrame, window: Window, limit: int = 10, shop_ids=None) -> DataFrame:
    """A5 + W1 + T13: top ``limit`` product names by non-refunded gmv.

    ``rank_no`` 1 = best (ties broken by name), ``is_top3`` highlights the first
    three, ``bar_pct`` = max(4, round(gmv / max gmv * 100)).  For charts drawn
    from the bottom up see ``display_order``.
    """
    s = product_stats(orders, products, window, shop_ids)
    top = s.orderBy(F.col("gmv").desc(), F.col("product")).limit(limit)
    # at most ``limit`` rows below: the rank window is bounded
    r = F.row_number().over(W.orderBy(F.col("gmv").desc(), F.col("product")))
    return top.select(
        r.cast("bigint").alias("rank_no"), "product", X.money_out("gmv").alias("gmv"), F.col("units").alias("orders"),
        "category", F.col("price").cast("double").alias("price"),
        (r <= 3).alias("is_top3"),
        F.greatest(F.lit(4.0), F.round(X.ratio(F.col("gmv") * 100, F.max("gmv").over(W.partitionBy())), 0)).alias("bar_pct"))


def display_order(top: DataFrame) -> DataFrame:
    """A top list (with ``rank_no``) reversed for display: ``display_no`` 1
    is the last rank.  ``top`` is bounded by its limit."""
    last = F.max("rank_no").over(W.partitionBy())
    return top.withColumn("display_no", last - F.col("rank_no") + 1).orderBy("display_no")


def priced_products(stats: DataFrame) -> DataFrame:
    """price = price, else gmv / orders, else 0."""
    return stats.withColumn("unit_price", F.coalesce(
        F.col("price").cast("double"), X.ratio("gmv", "units"), F.lit(0.0)))


def sell_through(orders: DataFrame, products: DataFrame, window: Window, shop_ids=None, hot_per_day: float = 50.0) -> DataFrame:
    """T5: products listed, products sold (units > 0), sell-through %, hot
    products (units per window day > ``hot_per_day``)."""
    s = product_stats(orders, products, window, shop_ids)
    return s.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("units") > 0).alias("sold"),
                 F.count_if(F.col("units") / F.lit(window.days) > hot_per_day).alias("hot")).select(
        "total", "sold", F.coalesce(F.round(X.ratio(F.col("sold") * 100.0, "total"), 1), F.lit(0.0)).alias("sell_through_pct"), "hot")


def _band_frame(spark, bands) -> DataFrame:
    return spark.createDataFrame([(i, n) for i, (n, _, _) in enumerate(bands)], "band_idx int, band string")


def price_bands(orders: DataFrame, products: DataFrame, window: Window, shop_ids=None, metric: str = "gmv") -> DataFrame:
    """[0,10) [10,20) [20,50) [50,inf) by unit price: units, gmv and product
    count; every band present; ``is_main`` on the first band with max ``metric``."""
    s = priced_products(product_stats(orders, products, window, shop_ids))
    b = s.withColumn("band", X.bucket("unit_price", K.PRICE_BANDS)).groupBy("band").agg(
        F.sum("units").alias("orders"), F.sum("gmv").alias("gmv"), F.count(F.lit(1)).alias("products"))
    full = F.broadcast(_band_frame(orders.sparkSession, K.PRICE_BANDS)).join(b, "band", "left").select(
        "band_idx", "band", F.coalesce("orders", F.lit(0)).cast("bigint").alias("orders"),
        X.money_out(F.coalesce("gmv", _zero())).alias("gmv"), F.coalesce("products", F.lit(0)).cast("bigint").alias("products"))
    first_max = F.row_number().over(W.orderBy(F.col(metric).desc(), "band_idx"))
    return full.withColumn("is_main", (first_max == 1) & (F.col(metric) > 0))


def price_distribution(products: DataFrame, price_col: str = "price") -> DataFrame:
    """Product count per price range [0,500) [500,1000) [1000,2000) [2000,inf);
    every range present; ``is_main`` on the first range with the most products."""
    b = products.withColumn("band", X.bucket(F.coalesce(F.col(price_col).cast("double"), F.lit(0.0)), K.PRICE_DISTRIBUTION)) \
                .groupBy("band").agg(F.count(F.lit(1)).alias("products"))
    full = F.broadcast(_band_frame(products.sparkSession, K.PRICE_DISTRIBUTION)).join(b, "band", "left").select(
        "band_idx", "band", F.coalesce("products", F.lit(0)).cast("bigint").alias("products"))
    first_max = F.row_number().over(W.orderBy(F.col("products").desc(), "band_idx"))
    return full.withColumn("is_main", (first_max == 1) & (F.col("products") > 0))


def category_share(orders: DataFrame, products: DataFrame, window: Window, shop_ids=None) -> DataFrame:
    """Gmv per category (null -> uncategorised) with % of total, desc."""
    s = product_stats(orders, products, window, shop_ids)
    g = s.groupBy(F.coalesce("category", F.lit(K.UNCATEGORISED)).alias("category")).agg(F.sum("gmv").alias("gmv_d"))
    return (with_share(g, "gmv_d", "pct", 1).select("category", X.money_out("gmv_d").alias("gmv"), "pct")
            .orderBy(F.col("gmv").desc(), "category"))


def category_list(products: DataFrame) -> DataFrame:
    """Distinct non-null categories, sorted."""
    return products.where(F.col("category").isNotNull()).select("category").distinct().orderBy("category")


# ---------------------------------------------------------------- shops / geo / status / types / shipping
def shop_list(orders: DataFrame) -> DataFrame:
    """Per shop (null -> '' / default label): order count and gmv
    *including* refunded, all time.  One default row when there are no orders."""
    g = orders.groupBy("shop_id").agg(F.count(F.lit(1)).alias("order_count"), X.sum0(F.col("gmv")).alias("g"))
    shops = g.select(F.coalesce("shop_id", F.lit("")).alias("shop_id"),
                     F.coalesce("shop_id", F.lit(K.DEFAULT_SHOP_NAME)).alias("name"),
                     F.col("order_count").cast("bigint").alias("order_count"), X.money_out("g").alias("gmv"))
    spark = orders.sparkSession
    default = spark.createDataFrame([("", K.DEFAULT_SHOP_NAME, 0, 0.0)],
                                    "shop_id string, name string, order_count bigint, gmv double")
    fallback = default.where(~X.exists(g))
    return shops.unionByName(fallback)


def geo_top(orders: DataFrame, window: Window, limit: int = 20, shop_ids=None) -> DataFrame:
    """Top provinces by non-refunded gmv (null province excluded)."""
    o = _scope(orders, window, shop_ids).where(F.col("province").isNotNull())
    g = o.groupBy("province").agg(F.count(F.lit(1)).alias("orders"), X.sum0(X.valid_gmv()).alias("g"))
    return g.orderBy(F.col("g").desc(), "province").limit(limit).select(
        "province", F.col("orders").cast("bigint").alias("orders"), X.money_out("g").alias("gmv"))


def status_mix(orders: DataFrame, window: Window, shop_ids=None) -> DataFrame:
    """A8 + P13: orders, non-refunded gmv, label and % of orders per status."""
    o = _scope(orders, window, shop_ids)
    g = o.groupBy("status").agg(F.count(F.lit(1)).alias("orders"), X.sum0(X.valid_gmv()).alias("g"))
    return g.select("status", X.label("status", K.STATUS_LABELS).alias("label"),
                    F.col("orders").cast("bigint").alias("orders"), X.money_out("g").alias("gmv"),
                    _fixed_share("orders", 1).alias("pct"))


def order_type() -> Column:
    """sample > cod > normal."""
    return F.when(F.col("is_sample_order"), "sample").when(F.col("is_cod"), "cod").otherwise("normal")


def order_type_mix(orders: DataFrame, window: Window, shop_ids=None) -> DataFrame:
    """A9 + T11: sample > cod > normal; orders, non-refunded gmv, label, share %."""
    o = _scope(orders, window, shop_ids)
    g = o.groupBy(order_type().alias("type")).agg(F.count(F.lit(1)).alias("orders"), X.sum0(X.valid_gmv()).alias("g"))
    return g.select("type", X.label("type", K.ORDER_TYPE_LABELS).alias("label"),
                    F.col("orders").cast("bigint").alias("orders"), X.money_out("g").alias("gmv"),
                    _fixed_share("orders", 1).alias("pct"))


def shipping_providers(orders: DataFrame, window: Window, shop_ids=None) -> DataFrame:
    """A10 + T11: order count per provider (grouped first, null labelled
    afterwards), share %, descending."""
    o = _scope(orders, window, shop_ids)
    g = o.groupBy("shipping_provider").agg(F.count(F.lit(1)).cast("bigint").alias("orders"))
    g = g.select(F.coalesce("shipping_provider", F.lit(K.UNKNOWN_PROVIDER)).alias("name"), "orders")
    return with_share(g, "orders", "pct", 1).orderBy(F.col("orders").desc(), "name")


def delivery_hours(orders: DataFrame, window: Window, shop_ids=None) -> DataFrame:
    """Mean (delivery_time - rts_time) in hours over orders having both, r1; 0 if none."""
    o = _scope(orders, window, shop_ids).where(F.col("rts_time").isNotNull() & F.col("delivery_time").isNotNull())
    return o.agg(F.coalesce(F.round(F.avg(X.hours_between("rts_time", "delivery_time")), 1), F.lit(0.0)).alias("avg_delivery_hours"),
                 F.count(F.lit(1)).alias("orders_measured"))


def site_breakdown(orders: DataFrame, window: Window) -> DataFrame:
    """A19 + T14: gmv (refunds included), orders, mean order value per
    (site, currency); a null currency reads USD after grouping."""
    o = orders.where(window.contains("paid_at"))
    g = o.groupBy("site_code", "currency").agg(X.sum0(F.col("gmv")).alias("g"), F.count(F.lit(1)).alias("orders"),
                                               F.avg("gmv").alias("a"))
    return g.select("site_code", F.coalesce("currency", F.lit("USD")).alias("currency"),
                    X.money_out("g").alias("total_gmv"), F.col("orders").cast("bigint").alias("total_orders"),
                    X.money_out("a").alias("avg_order_value")).orderBy(F.col("total_gmv").desc(), "site_code", "currency")


# ---------------------------------------------------------------- influencer scatter
def influencer_scatter(influencers: DataFrame) -> DataFrame:
    """P10: scatter points (gmv r2, roi r2, followers) with the suspicious total
    on every row (a scalar subquery)."""
    pts = influencers.select(
        "creator_id", "name", "category", "engagement_rate", "conversion_rate",
        X.money_out("gmv").alias("gmv"), F.round("roi", 2).alias("roi"),
        F.coalesce("followers", F.lit(0)).cast("bigint").alias("followers"),
        F.coalesce("is_suspicious", F.lit(False)).alias("is_suspicious"))
    tot = influencers.agg(F.count_if(F.coalesce("is_suspicious", F.lit(False))).alias("suspicious_count"))
    return X.attach(pts, tot)


def filter_products(stats: DataFrame, category: str | None = None, min_price: float | None = None,
                    max_price: float | None = None, price_col: str = "unit_price") -> DataFrame:
    """category equality (null category reads as uncategorised) and a
    ``[min_price, max_price)`` price band on the product frame."""
    out = stats
    if category is not None:
        out = out.where(F.coalesce(F.col("category"), F.lit(K.UNCATEGORISED)) == category)
    if min_price is not None:
        out = out.where(F.col(price_col) >= min_price)
    if max_price is not None:
        out = out.where(F.col(price_col) < max_price)
    return out
