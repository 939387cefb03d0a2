"""Registered upload-path queries (phase 4).

The uploaded tables are derived from the driver tables on Spark: clean columns
are formatted the way shop exports write them (Chinese headers, ``¥`` and
thousands separators, ``万`` and ``%`` suffixes, junk cells), then mapped,
cleaned, parsed and summarised by the upload operators.  The oracle computes
the same summaries from the clean values directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.functions import exprs as X
from shoplens.operators import upload_summary as U
from shoplens.plans.catalog import register
from shoplens.plans.oracle import with_std
from shoplens.sources import uploads
from shoplens.sources.tables import ORDER_SOURCES
from shoplens.sources.tables import landed as land


# Rows of an exported file, at most: files stay well below the upload limit.
ROWS_PER_EXPORT = 200_000


def dirty_shop_upload(m) -> DataFrame:
    """A shop export: refunded rows carry an unparseable date, COD rows an
    unparseable amount; visitors use thousands separators."""
    o = m.orders
    return o.select(
        F.when(F.col("status") == "refunded", F.lit("N/A")).otherwise(X.day_str("paid_at")).alias(" 日期 "),
        F.col("product_name").alias("商品名称"),
        F.when(F.col("is_cod"), F.lit("-")).otherwise(F.concat(F.lit("¥"), F.format_number("gmv", 2))).alias("销售额"),
        F.col("quantity").cast("string").alias("订单数"),
        F.format_number(F.col("quantity") * 40, 0).alias("访客数"),
        F.col("creator_id").alias("达人昵称"),
        F.lit(None).cast("string").alias("备注"))


def dirty_creator_upload(m) -> DataFrame:
    """A creator export: followers in 万, amounts with ¥, rates with %."""
    i = m.influencers
    return i.select(
        F.col("name").alias("达人昵称"),
        F.concat(F.format_number(F.col("followers") / 10000.0, 1), F.lit("万")).alias("粉丝数"),
        F.col("orders").cast("string").alias("视频数"),
        F.concat(F.lit("￥"), F.format_number("gmv", 2)).alias("销售额"),
        F.col("roi").cast("string").alias("投产比"),
        F.concat(F.format_number("conversion_rate", 2), F.lit("%")).alias("转化率"))


def exported(m, name: str, df: DataFrame, encoding: str) -> DataFrame:
    """The export written as CSV part files in ``encoding`` (once per data
    set, under the shared checkpoint folder), then read back through S1: each
    file under its own encoding and header."""
    def write(path):
        (df.write.option("header", "true").option("encoding", encoding).option("maxRecordsPerFile", ROWS_PER_EXPORT)
         .mode("overwrite").csv(path))
    path = land(m.spark, m.sf_dir, f"upload-{name}", write, ORDER_SOURCES + ["events"])
    return uploads.load_upload(m.spark, path)


def shop_export(m) -> DataFrame:
    return exported(m, "shop", dirty_shop_upload(m), "UTF-8")


def creator_export(m) -> DataFrame:
    return exported(m, "creator", dirty_creator_upload(m), "GBK")


def prepared(df: DataFrame) -> tuple[DataFrame, dict]:
    """F15 clean -> P1 map -> S12 validate -> canonical column names."""
    c = uploads.clean(df)
    mapping = uploads.map_columns(c.columns)
    return uploads.standardize(c, mapping), mapping


SHOP_CTE = """
, up AS (
  SELECT DISTINCT CASE WHEN status = 'refunded' THEN NULL ELSE CAST(paid_at AS DATE) END AS day, product_name,
         CASE WHEN is_cod THEN NULL ELSE gmv END AS gmv, quantity, quantity * 40 AS visitors, creator_id
  FROM std_orders
)"""


@register("shop_upload_summary", with_std(SHOP_CTE + """
, t AS (SELECT round(CAST(coalesce(sum(gmv), 0) AS DOUBLE), 2) AS tg, CAST(sum(quantity) AS BIGINT) AS tor,
               CAST(sum(visitors) AS BIGINT) AS tv, count(*) AS n FROM up),
d AS (SELECT day, CAST(coalesce(sum(gmv), 0) AS DOUBLE) AS g FROM up WHERE day IS NOT NULL GROUP BY day),
ds AS (SELECT min(day) AS s, max(day) AS e, avg(g) AS a, arg_max(day, g ORDER BY g DESC, day ASC) AS unused FROM d),
best AS (SELECT day, g FROM d ORDER BY g DESC, day ASC LIMIT 1),
worst AS (SELECT day, g FROM d ORDER BY g ASC, day ASC LIMIT 1)
SELECT tg AS total_gmv, tor AS total_orders,
       CASE WHEN tor <> 0 THEN round(tg / tor, 2) END AS avg_order_value,
       tv AS total_visitors,
       CASE WHEN tv <> 0 THEN round(CAST(tor AS DOUBLE) / tv * 100, 2) END AS overall_conversion_rate,
       CAST(n AS BIGINT) AS row_count,
       CASE WHEN tv = 0 THEN NULL WHEN round(CAST(tor AS DOUBLE) / tv * 100, 2) < 1.5 THEN 'below'
            WHEN round(CAST(tor AS DOUBLE) / tv * 100, 2) > 3.0 THEN 'above' ELSE 'within' END AS conversion_benchmark,
       strftime(ds.s, '%Y-%m-%d') AS date_start, strftime(ds.e, '%Y-%m-%d') AS date_end, round(ds.a, 2) AS avg_daily_gmv,
       strftime(best.day, '%Y-%m-%d') AS best_day, round(best.g, 2) AS best_day_gmv,
       strftime(worst.day, '%Y-%m-%d') AS worst_day, round(worst.g, 2) AS worst_day_gmv
FROM t, ds, best, worst
""".replace(", arg_max(day, g ORDER BY g DESC, day ASC) AS unused", "")))
def shop_upload_summary(m):
    """U1-U4 + U6 + A35: shop upload totals, day stats and conversion benchmark."""
    df, _ = prepared(shop_export(m))
    return X.attach(U.shop_totals(df), U.shop_day_stats(df))


@register("shop_upload_top_products", with_std(SHOP_CTE + """
SELECT product_name AS product, round(CAST(coalesce(sum(gmv), 0) AS DOUBLE), 2) AS gmv
FROM up WHERE product_name IS NOT NULL GROUP BY product_name
ORDER BY coalesce(sum(gmv), 0) DESC, product_name LIMIT 10
"""))
def shop_upload_top_products(m):
    """Top-10 uploaded products."""
    df, _ = prepared(shop_export(m))
    return U.shop_top_products(df)


@register("shop_upload_daily", with_std(SHOP_CTE + """
SELECT strftime(day, '%Y-%m-%d') AS date, round(CAST(coalesce(sum(gmv), 0) AS DOUBLE), 2) AS gmv
FROM up WHERE day IS NOT NULL GROUP BY day
"""))
def shop_upload_daily(m):
    """U6 + F16: daily gmv of rows whose date parses."""
    df, _ = prepared(shop_export(m))
    return U.shop_daily(df)


CREATOR_CTE = """
, up AS (
  SELECT DISTINCT name, orders, gmv, roi FROM std_influencers
)"""


@register("creator_upload_summary", with_std(CREATOR_CTE + """
SELECT CAST(count(DISTINCT name) AS BIGINT) AS creator_count,
       round(CAST(coalesce(sum(gmv), 0) AS DOUBLE), 2) AS total_gmv,
       CAST(count(*) FILTER (WHERE coalesce(gmv, 0) > 0) AS BIGINT) AS producing_creators,
       CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE coalesce(gmv, 0) > 0) * 100.0 / count(*), 2) END AS producing_rate,
       round(avg(roi), 2) AS avg_roi, round(median(roi), 2) AS median_roi,
       CASE WHEN avg(roi) IS NOT NULL THEN CAST(count(*) FILTER (WHERE roi < 1) AS BIGINT) END AS roi_bucket_0,
       CASE WHEN avg(roi) IS NOT NULL THEN CAST(count(*) FILTER (WHERE roi >= 1 AND roi < 3) AS BIGINT) END AS roi_bucket_1,
       CASE WHEN avg(roi) IS NOT NULL THEN CAST(count(*) FILTER (WHERE roi >= 3 AND roi < 5) AS BIGINT) END AS roi_bucket_2,
       CASE WHEN avg(roi) IS NOT NULL THEN CAST(count(*) FILTER (WHERE roi >= 5) AS BIGINT) END AS roi_bucket_3,
       CAST(sum(orders) AS BIGINT) AS total_videos, CAST(count(*) AS BIGINT) AS row_count,
       CASE WHEN count(*) = 0 THEN NULL
            WHEN round(count(*) FILTER (WHERE coalesce(gmv, 0) > 0) * 100.0 / count(*), 2) < 10 THEN 'below'
            WHEN round(count(*) FILTER (WHERE coalesce(gmv, 0) > 0) * 100.0 / count(*), 2) > 20 THEN 'above'
            ELSE 'within' END AS producing_benchmark
FROM up
""", influencers=True))
def creator_upload_summary(m):
    """U7-U10 + A35: creator upload totals, roi stats and buckets."""
    df, _ = prepared(creator_export(m))
    return U.creator_totals(df)


@register("creator_upload_top", with_std(CREATOR_CTE + """
SELECT substr(name, 1, 40) AS creator, round(CAST(coalesce(sum(gmv), 0) AS DOUBLE), 2) AS gmv,
       round(avg(roi), 2) AS roi, CAST(coalesce(sum(orders), 0) AS BIGINT) AS videos
FROM up WHERE name IS NOT NULL GROUP BY name ORDER BY coalesce(sum(gmv), 0) DESC, name LIMIT 10
""", influencers=True))
def creator_upload_top(m):
    """Top-10 uploaded creators."""
    df, _ = prepared(creator_export(m))
    return U.creator_top(df)


@register("parse_dirty_numbers", with_std("""
SELECT order_id, CASE WHEN is_cod THEN NULL ELSE CAST(gmv AS DOUBLE) END AS gmv_parsed,
       CAST(quantity * 40 AS DOUBLE) AS visitors_parsed
FROM std_orders
"""))
def parse_dirty_numbers(m):
    """Parse formatted amounts (¥, thousands separators, junk) back to numbers."""
    d = m.orders.select("order_id", "gmv", "quantity", "is_cod").select(
        "order_id",
        F.when(F.col("is_cod"), F.lit("-")).otherwise(F.concat(F.lit(" ¥"), F.format_number("gmv", 2), F.lit(" "))).alias("g"),
        F.format_number(F.col("quantity") * 40, 0).alias("v"))
    return d.select("order_id", X.parse_dirty_number("g").alias("gmv_parsed"),
                    X.parse_dirty_number("v").alias("visitors_parsed"))


@register("clean_dedup", with_std(SHOP_CTE + """
SELECT CAST(count(*) AS BIGINT) AS rows_after_clean FROM up
"""))
def clean_dedup(m):
    """F15 + D1: rows left after dropping empty rows/columns and exact duplicates."""
    df = uploads.clean(shop_export(m))
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("rows_after_clean"))
