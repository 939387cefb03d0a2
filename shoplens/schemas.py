"""StructTypes of the standard commerce model (orders, products, influencers,
influencer feed, analysis records, dataset registry, reports)."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, B, TS, D = T.StringType(), T.IntegerType(), T.BooleanType(), T.TimestampType(), T.DoubleType()
M14, M12 = T.DecimalType(14, 2), T.DecimalType(12, 2)


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


STANDARD_ORDERS = T.StructType([
    _f("order_id", S, False), _f("shop_id", S), _f("platform", S, False), _f("product_id", S, False),
    _f("product_name", S, False), _f("gmv", M14, False), _f("quantity", I), _f("customer_id", S),
    _f("creator_id", S), _f("status", S), _f("paid_at", TS), _f("province", S), _f("sku_id", S),
    _f("seller_sku", S), _f("sku_name", S), _f("currency", S), _f("original_price", M14),
    _f("platform_discount", M14), _f("seller_discount", M14), _f("shipping_fee", M14), _f("is_cod", B),
    _f("is_sample_order", B), _f("delivery_type", S), _f("shipping_provider", S), _f("tracking_number", S),
    _f("rts_time", TS), _f("delivery_time", TS), _f("update_time", TS),
])
ORDER_KEY = ["order_id", "platform"]

STANDARD_PRODUCTS = T.StructType([
    _f("product_id", S, False), _f("platform", S, False), _f("name", S, False), _f("category", S),
    _f("price", M12), _f("total_gmv", T.DecimalType(38, 2)), _f("total_sold", T.LongType()), _f("created_at", TS),
])
PRODUCT_KEY = ["product_id", "platform"]

STANDARD_INFLUENCERS = T.StructType([
    _f("creator_id", S, False), _f("platform", S, False), _f("name", S, False), _f("category", S),
    _f("followers", T.LongType()), _f("gmv", M14), _f("orders", T.LongType()), _f("cost", M14), _f("roi", D),
    _f("engagement_rate", D), _f("conversion_rate", D), _f("avg_views", T.LongType()), _f("is_suspicious", B),
    _f("created_at", TS),
])

INFLUENCER_FEED = T.StructType([
    _f("influencer_id", S), _f("site_code", S), _f("platform", S), _f("influencer_name", S), _f("avatar_url", S),
    _f("follower_count", T.LongType()), _f("engagement_rate", D), _f("conversion_rate", D), _f("roi", D),
    _f("is_suspicious", B), _f("suspicious_reason", S), _f("country", S), _f("language", S), _f("niche", S),
    _f("total_posts", T.LongType()), _f("avg_likes", T.LongType()), _f("avg_comments", T.LongType()),
    _f("avg_shares", T.LongType()), _f("created_at", S), _f("updated_at", S), _f("status", S),
])

INFLUENCER_ANALYSIS = T.StructType([
    _f("record_id", S, False), _f("influencer_name", S), _f("platform", S), _f("followers", T.LongType()),
    _f("target_product", S), _f("ai_match_score", I), _f("ai_risk_warning", S), _f("ai_outreach_script", S),
    _f("fit_analysis", S),
    _f("radar", T.ArrayType(T.StructType([_f("dimension", S), _f("key", S), _f("value", I)]))),
    _f("multilingual", T.MapType(S, S)), _f("report_url", S), _f("status", S), _f("error", S),
    _f("created_at", TS), _f("updated_at", TS),
])

DATASETS = T.StructType([
    _f("dataset_id", S, False), _f("filename", S), _f("data_type", S), _f("row_count", T.LongType()),
    _f("columns", T.ArrayType(S)), _f("summary", S), _f("created_at", TS),
])

REPORTS = T.StructType([
    _f("report_id", S, False), _f("report_type", S), _f("dataset_id", S), _f("status", S),
    _f("content", S), _f("created_at", TS),
])
