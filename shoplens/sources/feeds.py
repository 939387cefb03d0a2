"""Landed platform feeds.

HTTP paging is not built: feed pages are landed as JSON files and read with an
explicit schema whose scalars are all STRING (a JSON number or a quoted number
both arrive intact; ``from_json`` with a numeric field would null out "12").
Each page holds an array (``orders`` / ``products`` / ``items``) exploded to one
row per record.  The adapter registry (S8) maps each platform's rows to the
standard schema and unions them by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.functions import exprs as X

S = T.StringType()


def _st(*names: str, **nested: T.DataType) -> T.StructType:
    fields = [T.StructField(n, S) for n in names]
    fields += [T.StructField(k, v) for k, v in nested.items()]
    return T.StructType(fields)


# ---------------------------------------------------------------- raw schemas (all scalars STRING)
A_LINE_ITEM = _st("product_id", "product_name", "sku_id", "seller_sku", "sku_name", "sale_price", "quantity",
                  "original_price", "currency", "display_status", "tracking_number")
A_PAYMENT = _st("total_amount", "original_total_product_price", "currency", "platform_discount",
                "seller_discount", "shipping_fee", "original_shipping_fee")
A_ADDRESS = _st("region", "province",
                district_info=T.ArrayType(_st("address_level_name", "address_name")))
PLATFORM_A_ORDER = _st(
    "id", "order_id", "status", "order_status", "create_time", "paid_time", "order_create_time", "update_time",
    "rts_time", "delivery_time", "buyer_email", "user_id", "customer_id", "creator_id", "influencer_id",
    "is_cod", "is_sample_order", "delivery_type", "shipping_provider", "tracking_number",
    "product_id", "product_name", "total_amount", "order_amount", "quantity",
    payment=A_PAYMENT, recipient_address=A_ADDRESS, shipping_address=A_ADDRESS,
    line_items=T.ArrayType(A_LINE_ITEM), items=T.ArrayType(A_LINE_ITEM))
PLATFORM_A_PRODUCT = _st(
    "id", "product_id", "title", "product_name", "name", "category", "category_name", "price", "original_price",
    "sales_volume", "sold_count", "sales",
    categories=T.ArrayType(_st("name")), recommended_categories=T.ArrayType(_st("name")),
    skus=T.ArrayType(_st(price=_st("tax_exclusive_price", "original_price", "price"))))
PLATFORM_B_ORDER = _st(
    "order_id", "order_status", "pay_amount", "post_pay_time", "pay_time", "province_name", "province",
    "shop_id", "buyer_id", "user_id", "product_name",
    author_info=_st("open_id", "author_id", "author_name"),
    sku_order_list=T.ArrayType(_st("sku_id", "product_id", "product_name", "item_num", "sku_pay_amount")))
INFLUENCER_FEED = _st(
    "influencer_id", "id", "uid", "site_code", "site", "siteId", "country", "region", "platform", "channel",
    "platformId", "name", "username", "nickname", "avatar", "avatar_url", "profile_picture", "thumbnailUrl",
    "followers", "follower_count", "followerCount", "fans", "engagement_rate", "engagement", "likeRate",
    "conversion_rate", "conversion", "fulfillmentRate", "roi", "return_on_investment", "is_suspicious",
    "suspicious", "status", "suspicious_reason", "risk_reason", "language", "lang", "niche", "category",
    "vertical", "total_posts", "posts", "content_count", "viewCount", "avg_likes", "average_likes", "likes",
    "likeCount", "avg_comments", "average_comments", "comments", "commentCount", "avg_shares",
    "average_shares", "shares", "createdAt", "created_at", "createTime", "updatedAt", "updated_at")
WEBHOOK_PAYLOAD = _st(
    "record_id", "id", "rec_id", "recordId", "influencer_name", "name", "creator_name", "creatorName",
    "influencerName", "platform", "plat", "followers", "fans", "fan_count", "follower_count", "fanCount",
    "target_product", "targetProduct", "product", "product_name", "goods", "item")

PAGE_SCHEMAS = {
    "platform_a_orders": ("orders", PLATFORM_A_ORDER),
    "platform_a_products": ("products", PLATFORM_A_PRODUCT),
    "platform_b_orders": ("orders", PLATFORM_B_ORDER),
    "influencer_feed": ("items", INFLUENCER_FEED),
}


def page_schema(kind: str) -> T.StructType:
    key, rec = PAGE_SCHEMAS[kind]
    data = T.StructField("data", _st(**{key: T.ArrayType(rec), "total": S}))
    return T.StructType([T.StructField(key, T.ArrayType(rec)), T.StructField("total", S), data])


def explode_pages(pages: DataFrame, kind: str) -> DataFrame:
    """S4-S7 + D3: one row per record from pages parsed with ``page_schema``;
    the array may sit at the top level or under ``data``."""
    key, _ = PAGE_SCHEMAS[kind]
    arr = F.coalesce(F.col(key), F.col(f"data.{key}"))
    return pages.select(F.explode(arr).alias("r")).select("r.*")


def read_pages(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Landed JSON pages (one JSON document per line) -> one row per record."""
    return explode_pages(spark.read.schema(page_schema(kind)).json(path), kind)


def told_pages(text: DataFrame, kind: str, col: str = "body") -> DataFrame:
    """(page, body, records) of every page, in one parse.  ``page`` is
    ``data``, ``html``, ``unparsable``, ``no_list`` (JSON without the list) or
    ``empty``."""
    key, _ = PAGE_SCHEMAS[kind]
    schema = T.StructType([*page_schema(kind).fields, T.StructField("_broken", S)])
    blank = F.trim(F.coalesce(F.col(col), F.lit(""))) == ""
    p = F.from_json(F.when(~blank & ~X.is_html(col), F.col(col)), schema, {"columnNameOfCorruptRecord": "_broken"})
    parsed = text.select(F.col(col).alias("body"), blank.alias("blank"), X.is_html(col).alias("html"), p.alias("p"))
    records = F.coalesce(F.col(f"p.{key}"), F.col(f"p.data.{key}"))
    page = (F.when(F.col("blank"), "empty").when(F.col("html"), "html").when(F.col("p").isNull() | F.col("p._broken").isNotNull(), "unparsable")
            .when(records.isNull(), "no_list").otherwise("data"))
    return parsed.select(page.alias("page"), "body", records.alias("records"))


def split_pages(text: DataFrame, kind: str, col: str = "body") -> DataFrame:
    """S9 + D3: one row per record ``r`` of every data page (one with a null
    ``r`` for an empty list), and one with its ``body`` for every other page."""
    told = told_pages(text, kind, col)
    return told.select("page", F.when(F.col("page") != "data", F.col("body")).alias("body"),
                       F.explode_outer(F.when(F.col("page") == "data", F.col("records"))).alias("r"))


def page_records(split: DataFrame) -> DataFrame:
    """The records of ``split_pages``; only data pages have any.  A condition on
    ``page`` would be pushed below the parse, which would run again for it."""
    return split.where("r IS NOT NULL").select("r.*")


def quarantined(split: DataFrame) -> DataFrame:
    """The pages of ``split_pages`` that hold no data: (page, body)."""
    return split.where("page <> 'data'").select("page", "body")


def page_counts(text: DataFrame, kind: str, col: str = "body") -> DataFrame:
    """Pages and records of each kind of page."""
    return told_pages(text, kind, col).groupBy("page").agg(
        F.count("*").alias("pages"), F.sum(F.when(F.col("page") == "data", F.size("records")).otherwise(0)).cast("bigint").alias("records"))


def parse_pages(text: DataFrame, kind: str, col: str = "body") -> DataFrame:
    """The records of page bodies held in a string column; pages that are HTML
    or no data (S9) give none -- ``split_pages`` tells which."""
    return page_records(split_pages(text, kind, col))


# ---------------------------------------------------------------- S8 adapter registry
class AdapterRegistry:
    """Platform name -> mapper ``DataFrame -> standard DataFrame``."""

    def __init__(self) -> None:
        self._m: dict[str, Callable[..., DataFrame]] = {}

    def register(self, platform: str, mapper: Callable[..., DataFrame]) -> None:
        self._m[platform] = mapper

    def get(self, platform: str) -> Callable[..., DataFrame]:
        if platform not in self._m:
            raise KeyError(f"no adapter for platform {platform!r}")
        return self._m[platform]

    def available(self) -> list[str]:
        return sorted(self._m)

    def map_all(self, frames: dict[str, DataFrame], **kw) -> DataFrame:
        """Map every platform's raw rows and union them by column name."""
        out = None
        for plat, df in frames.items():
            m = self.get(plat)(df, **kw.get(plat, {}))
            out = m if out is None else out.unionByName(m, allowMissingColumns=True)
        return out


def default_registry() -> AdapterRegistry:
    from shoplens.operators import mappers
    r = AdapterRegistry()
    r.register("tiktok", mappers.map_platform_a_order)
    r.register("douyin", mappers.map_platform_b_order)
    return r


# ---------------------------------------------------------------- S10 source fallback
def with_fallback(remote: DataFrame, local: DataFrame, configured: bool = True) -> DataFrame:
    """Remote rows when there are any, else local rows; ``source`` and
    ``configured`` columns say which.  No driver-side count: the local side
    is filtered by a scalar existence probe that reads at most one row per task."""
    loc = local.where(~X.exists(remote))
    return (remote.withColumn("source", F.lit("remote"))
            .unionByName(loc.withColumn("source", F.lit("local")), allowMissingColumns=True)
            .withColumn("configured", F.lit(bool(configured))))
