"""Registered feed-mapping, upsert and source queries (phase 5).

Raw feed pages are built on Spark from the driver tables (``to_json`` of nested
structs, one page per record, with the raw web pages of ``pages.html`` mixed
in as non-data bodies), parsed back with the all-STRING page schemas and run
through the mappers.  The oracle states the expected mapped values directly
from the clean tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.functions import exprs as X
from shoplens.operators import influencers as inf
from shoplens.operators import mappers, upsert
from shoplens.plans.catalog import register
from shoplens.plans.oracle import with_std
from shoplens.session import shuffles_freed
from shoplens.sources import feeds
from shoplens.sources.tables import ORDER_SOURCES, land_pages, std_orders, std_products
from shoplens.sources.tables import landed as land

TS = "yyyy-MM-dd HH:mm:ss"
CUTOFF = "1998-01-01"


def _ts(c: str | Column) -> Column:
    return F.date_format(X.col(c), TS)


def _epoch(c: str) -> Column:
    return F.unix_seconds(F.col(c))


def _html_bodies(m) -> DataFrame:
    return m.raw("pages").select(F.col("html").alias("body"))


def landed(m, name: str, bodies: DataFrame) -> DataFrame:
    """Generated feed pages landed as text files (one page per line) under the
    shared checkpoint folder, once per data set, and read back -- the path a
    feed sync takes, and a lineage cut between page generation and parsing."""
    def write(path):
        land_pages(bodies, path, "overwrite")
    path = land(m.spark, m.sf_dir, f"feed-{name}", write, ORDER_SOURCES + ["events", "pages"])
    return m.spark.read.text(path).select(F.col("value").alias("body"))


# ---------------------------------------------------------------- platform A orders
def platform_a_pages(m, orders: DataFrame | None = None) -> DataFrame:
    """Platform A order pages built from (a slice of) the standard orders."""
    o = (m.orders if orders is None else orders).where(F.col("platform") == "tiktok")
    return o.select(F.to_json(F.struct(F.array(platform_a_record()).alias("orders"))).alias("body")).unionByName(_html_bodies(m))


def platform_a_record() -> Column:
    """A standard order as a platform A record."""
    raw_status = (F.when(F.col("is_sample_order"), "PARTIAL_SHIP").when(F.col("status") == "refunded", "CANCELLED")
                   .when(F.col("status") == "completed", "delivered").when(F.col("status") == "shipped", "IN_TRANSIT")
                   .otherwise("AWAITING_SHIPMENT"))
    # seconds: the data's 1995-2001 dates in ms fall below the 1e12 ms threshold
    paid = _epoch("paid_at").cast("string")
    total = F.when(F.col("quantity") % 5 == 0, F.lit("0.00")).otherwise(F.col("gmv").cast("string"))
    item = F.struct(F.col("product_id"), F.col("product_name"), F.col("sku_id"),
                    F.col("gmv").cast("string").alias("sale_price"), F.col("quantity").cast("string").alias("quantity"),
                    F.col("currency"))
    levels = F.when(F.col("province").isNotNull(), F.array(
        F.struct(F.lit("country").alias("address_level_name"), F.col("site_code").alias("address_name")),
        F.struct(F.lit("province").alias("address_level_name"), F.col("province").alias("address_name"))))
    return F.struct(
        F.col("order_id").alias("id"), raw_status.alias("status"), paid.alias("paid_time"),
        _ts("update_time").alias("update_time"), _epoch("rts_time").cast("string").alias("rts_time"),
        F.date_format("delivery_time", "yyyy-MM-dd'T'HH:mm:ss").alias("delivery_time"),
        F.col("customer_id").alias("user_id"), F.col("creator_id"),
        F.when(F.col("is_cod"), "true").otherwise("false").alias("is_cod"), F.col("shipping_provider"),
        F.struct(total.alias("total_amount"), F.col("currency")).alias("payment"),
        F.struct(F.col("site_code").alias("region"), levels.alias("district_info")).alias("recipient_address"),
        F.array(item).alias("line_items"))


def mapped_platform_a(m) -> DataFrame:
    rows = feeds.parse_pages(landed(m, "a-orders", platform_a_pages(m)), "platform_a_orders")
    return mappers.map_platform_a_order(rows, shop_id="SHOP_A")


@register("map_platform_a_orders", with_std(f"""
SELECT order_id, 'SHOP_A' AS shop_id, product_id, product_name,
       CAST(CASE WHEN (CASE WHEN is_sample_order THEN 'paid' ELSE status END) = 'refunded' THEN 0
                 WHEN quantity % 5 = 0 THEN round(gmv * quantity, 2) ELSE gmv END AS DOUBLE) AS gmv,
       quantity, customer_id, creator_id, CASE WHEN is_sample_order THEN 'paid' ELSE status END AS status,
       strftime(paid_at, '%Y-%m-%d %H:%M:%S') AS paid_at,
       substr(coalesce(province, site_code), 1, 32) AS province,
       sku_id, currency, is_cod, shipping_provider,
       strftime(rts_time, '%Y-%m-%d %H:%M:%S') AS rts_time, strftime(delivery_time, '%Y-%m-%d %H:%M:%S') AS delivery_time,
       strftime(update_time, '%Y-%m-%d %H:%M:%S') AS update_time
FROM std_orders WHERE platform = 'tiktok'
"""))
def map_platform_a_orders(m):
    """S4 + S9 + P2 + P3 + P8 + X4/X5/X8/X10: platform A order pages -> standard rows."""
    r = mapped_platform_a(m)
    return r.select("order_id", "shop_id", "product_id", "product_name", F.col("gmv").cast("double").alias("gmv"),
                    "quantity", "customer_id", "creator_id", "status", _ts("paid_at").alias("paid_at"), "province",
                    "sku_id", "currency", "is_cod", "shipping_provider", _ts("rts_time").alias("rts_time"),
                    _ts("delivery_time").alias("delivery_time"), _ts("update_time").alias("update_time"))


# ---------------------------------------------------------------- platform B orders
def platform_b_pages(m) -> DataFrame:
    o = m.orders.where(F.col("platform") == "douyin")
    raw_status = (F.when(F.col("status") == "refunded", F.when(F.col("is_cod"), "CANCEL").otherwise("REFUND"))
                   .when(F.col("status") == "completed", F.when(F.col("is_sample_order"), "SETTLEMENT").otherwise("COMPLETED"))
                   .when(F.col("status") == "shipped", "DELIVERING").otherwise("PAID"))
    fen = (F.col("gmv") * 100).cast("bigint").cast("string")
    paid = _epoch("paid_at").cast("string")
    sku = F.struct(F.col("sku_id"), F.col("product_id"), F.col("product_name"),
                   F.col("quantity").cast("string").alias("item_num"), fen.alias("sku_pay_amount"))
    rec = F.struct(
        F.col("order_id"), raw_status.alias("order_status"),
        F.when(F.col("quantity") % 4 != 0, fen).alias("pay_amount"), paid.alias("post_pay_time"),
        F.col("province").alias("province_name"), F.col("shop_id"), F.col("customer_id").alias("buyer_id"),
        F.when(F.col("creator_id").isNotNull(), F.struct(F.col("creator_id").alias("open_id"))).alias("author_info"),
        F.array(sku).alias("sku_order_list"))
    return o.select(F.to_json(F.struct(F.struct(F.array(rec).alias("orders")).alias("data"))).alias("body")).unionByName(_html_bodies(m))


@register("map_platform_b_orders", with_std("""
SELECT order_id, shop_id, sku_id AS product_id, product_name, CAST(gmv AS DOUBLE) AS gmv, quantity, customer_id,
       creator_id, status, strftime(paid_at, '%Y-%m-%d %H:%M:%S') AS paid_at, province
FROM std_orders WHERE platform = 'douyin'
"""))
def map_platform_b_orders(m):
    """S6 + P5 + P8 + X3/X4: platform B order pages (nested under data) -> standard rows."""
    rows = feeds.parse_pages(landed(m, "b-orders", platform_b_pages(m)), "platform_b_orders")
    r = mappers.map_platform_b_order(rows)
    return r.select("order_id", "shop_id", "product_id", "product_name", F.col("gmv").cast("double").alias("gmv"),
                    "quantity", "customer_id", "creator_id", "status", _ts("paid_at").alias("paid_at"), "province")


@register("adapter_union", with_std("""
SELECT platform, CAST(count(*) AS BIGINT) AS orders,
       CAST(round(sum(CASE WHEN platform = 'tiktok' AND (CASE WHEN is_sample_order THEN 'paid' ELSE status END) = 'refunded' THEN 0
                           WHEN platform = 'tiktok' AND quantity % 5 = 0 THEN round(gmv * quantity, 2) ELSE gmv END), 2) AS DOUBLE) AS gmv
FROM std_orders WHERE platform IN ('tiktok', 'douyin') GROUP BY platform
"""))
def adapter_union(m):
    """S8 + D3: both platforms through the adapter registry, unioned by name."""
    reg = feeds.default_registry()
    frames = {"tiktok": feeds.parse_pages(landed(m, "a-orders", platform_a_pages(m)), "platform_a_orders"),
              "douyin": feeds.parse_pages(landed(m, "b-orders", platform_b_pages(m)), "platform_b_orders")}
    u = reg.map_all(frames, tiktok={"shop_id": "SHOP_A"})
    return u.groupBy("platform").agg(F.count(F.lit(1)).cast("bigint").alias("orders"),
                                     X.money_out(F.sum("gmv")).alias("gmv"))


# ---------------------------------------------------------------- products
def product_pages(m) -> DataFrame:
    p = m.raw("part")
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    cats = F.when(F.col("p_size") % 4 == 0, F.array().cast("array<struct<name:string>>")).otherwise(
        F.array(F.struct(F.col("p_brand").alias("name")), F.struct(F.col("p_type").alias("name"))))
    sku_price = F.when(F.col("p_size") % 3 == 0, F.lit("0")).otherwise(price)
    rec = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), cats.alias("categories"),
                   F.col("p_brand").alias("category_name"),
                   F.array(F.struct(F.struct(sku_price.alias("tax_exclusive_price")).alias("price"))).alias("skus"),
                   price.alias("price"), F.col("p_size").cast("string").alias("sales_volume"))
    return p.select(F.to_json(F.struct(F.array(rec).alias("products"))).alias("body"))


@register("map_products", """
SELECT CAST(p_partkey AS VARCHAR) AS product_id, 'tiktok' AS platform, substr(p_name, 1, 255) AS name,
       substr(CASE WHEN p_size % 4 = 0 THEN p_brand ELSE p_type END, 1, 64) AS category,
       CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS price, CAST(0 AS DOUBLE) AS total_gmv, CAST(p_size AS BIGINT) AS total_sold
FROM part
""")
def map_products(m):
    """S5 + P4: product pages -> standard products (last category, sku price chain)."""
    r = mappers.map_platform_a_product(feeds.parse_pages(landed(m, "products", product_pages(m)), "platform_a_products"))
    return r.select("product_id", "platform", "name", "category", F.col("price").cast("double").alias("price"),
                    F.col("total_gmv").cast("double").alias("total_gmv"), "total_sold")


# ---------------------------------------------------------------- influencer feed
def influencer_pages(m) -> DataFrame:
    i = m.influencers
    uid = F.col("creator_id").cast("int")
    rec = F.struct(
        F.col("creator_id").alias("id"), F.col("name"),
        F.concat((F.col("followers") / 1000).cast("int").cast("string"), F.lit("k")).alias("followers"),
        F.col("engagement_rate").cast("string").alias("engagement_rate"),
        F.concat(F.col("conversion_rate").cast("string"), F.lit("%")).alias("conversion"),
        F.col("roi").cast("string").alias("roi"),
        F.when(uid % 3 == 1, "th").when(uid % 3 == 2, "MY").alias("site"),
        F.when(uid % 3 == 1, "Thai").when(uid % 3 == 2, "Indonesian").alias("language"),
        F.when(F.col("is_suspicious"), "rejected").otherwise("active").alias("status"),
        F.col("category").alias("niche"), F.col("platform"),
        F.when(uid % 5 == 0, F.lit("unknown"))
         .when(uid % 5 == 1, F.format_string("2024-01-%02d 08:00:00", uid % 28 + 1))
         .otherwise(F.format_string("2024-01-%02dT08:00:00Z", uid % 28 + 1)).alias("createdAt"))
    return i.select(F.to_json(F.struct(F.array(rec).alias("items"), F.lit("1").alias("total"))).alias("body")).unionByName(_html_bodies(m))


def mapped_feed(m) -> DataFrame:
    return mappers.map_influencer_feed(feeds.parse_pages(landed(m, "influencers", influencer_pages(m)), "influencer_feed"))


FEED_SQL = """
SELECT creator_id AS influencer_id,
       CASE CAST(creator_id AS INTEGER) % 3 WHEN 1 THEN 'TH' WHEN 2 THEN 'MY' ELSE 'US' END AS site_code,
       platform, name AS influencer_name, CAST(followers AS BIGINT) AS follower_count,
       engagement_rate, conversion_rate, coalesce(roi, 0.0) AS roi, is_suspicious,
       CASE CAST(creator_id AS INTEGER) % 3 WHEN 1 THEN 'th' WHEN 2 THEN 'id' ELSE 'en' END AS language,
       category AS niche, CASE WHEN is_suspicious THEN 'rejected' ELSE 'active' END AS status
FROM std_influencers"""


@register("map_influencers", with_std(FEED_SQL, influencers=True))
def map_influencers(m):
    """S7 + P6 + X2 + X14 + X15: influencer feed pages -> feed rows."""
    return mapped_feed(m).select("influencer_id", "site_code", "platform", "influencer_name", "follower_count",
                                 "engagement_rate", "conversion_rate", "roi", "is_suspicious", "language", "niche", "status")


@register("feed_created_range", with_std("""
SELECT creator_id AS influencer_id FROM std_influencers
WHERE CAST(creator_id AS INTEGER) % 5 <> 0 AND CAST(creator_id AS INTEGER) % 28 + 1 BETWEEN 10 AND 20
""", influencers=True))
def feed_created_range(m):
    """F10 + X6: createdAt range (Z / naive times; unparseable dropped)."""
    f = mappers.created_between(mapped_feed(m), "2024-01-10T00:00:00Z", "2024-01-20T23:59:59")
    return f.select("influencer_id")


CARD_COLS = ["influencer_id", "name", "platform", "followers", "is_suspicious"]


@register("source_fallback", with_std("""
SELECT creator_id AS influencer_id, name, platform, CAST(followers AS BIGINT) AS followers, is_suspicious,
       'remote' AS source, true AS configured
FROM std_influencers
""", influencers=True))
def source_fallback(m):
    """Remote feed rows when present (here: present), else local cards."""
    f = mapped_feed(m)
    remote = f.select("influencer_id", F.col("influencer_name").alias("name"), "platform",
                      F.col("follower_count").alias("followers"), "is_suspicious")
    local = inf.cards(m.influencers).select(*CARD_COLS)
    return feeds.with_fallback(remote, local)


@register("source_fallback_local", with_std("""
SELECT coalesce(creator_id, name) AS influencer_id, name, platform, CAST(followers AS BIGINT) AS followers,
       coalesce(is_suspicious, false) AS is_suspicious, 'local' AS source, true AS configured
FROM std_influencers
""", influencers=True))
def source_fallback_local(m):
    """An empty remote result (createdAt window with no rows) falls back to local cards."""
    f = mappers.created_between(mapped_feed(m), "2030-01-01T00:00:00Z", None)
    remote = f.select("influencer_id", F.col("influencer_name").alias("name"), "platform",
                      F.col("follower_count").alias("followers"), "is_suspicious")
    local = inf.cards(m.influencers).select(*CARD_COLS)
    return feeds.with_fallback(remote, local)


@register("html_guard", """
WITH t AS (SELECT 'pages' AS source, html AS body FROM pages UNION ALL SELECT 'documents', text FROM documents),
f AS (SELECT source, lower(regexp_replace(body, '^\\s+|\\s+$', '', 'g')) AS b FROM t)
SELECT source, CAST(count(*) AS BIGINT) AS bodies,
       CAST(count(*) FILTER (WHERE coalesce(starts_with(b, '<!doctype') OR starts_with(b, '<html') OR starts_with(b, '<head')
                                    OR starts_with(b, '<body'), false)) AS BIGINT) AS html
FROM f GROUP BY source
""")
def html_guard(m):
    """Payloads that are HTML pages, not data, per source table."""
    t = (m.raw("pages").select(F.lit("pages").alias("source"), F.col("html").alias("body"))
         .unionByName(m.raw("documents").select(F.lit("documents").alias("source"), F.col("text").alias("body"))))
    return t.groupBy("source").agg(F.count(F.lit(1)).cast("bigint").alias("bodies"),
                                   F.count_if(X.is_html("body")).cast("bigint").alias("html"))


# ---------------------------------------------------------------- webhook payloads
@register("map_webhook_payloads", """
SELECT CAST(c_custkey AS VARCHAR) AS record_id, 'KOL' || lpad(CAST(c_custkey // 5 AS VARCHAR), 5, '0') AS influencer_name,
       CAST(NULL AS VARCHAR) AS platform,
       CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE CAST(floor(abs(c_acctbal) * 100) AS BIGINT) END AS followers,
       c_mktsegment AS target_product
FROM customer
""")
def map_webhook_payloads(m):
    """P7 + X9: webhook payloads with aliased keys -> request rows."""
    c = m.raw("customer")
    even = F.col("c_custkey") % 2 == 0
    name = F.concat(F.lit("KOL"), F.lpad((F.col("c_custkey") / 5).cast("bigint").cast("string"), 5, "0"))
    rec = F.struct(
        F.when(even, F.col("c_custkey").cast("string")).alias("recordId"),
        F.when(~even, F.col("c_custkey").cast("string")).alias("record_id"),
        F.lit("").alias("name"),
        F.when(even, name).alias("creatorName"), F.when(~even, name).alias("influencer_name"),
        F.when(F.col("c_custkey") % 7 == 0, F.lit("n/a"))
         .otherwise(F.floor(F.abs(F.col("c_acctbal")) * 100).cast("string")).alias("fans"),
        F.col("c_mktsegment").alias("product_name"))
    raw = c.select(F.from_json(F.to_json(rec), feeds.WEBHOOK_PAYLOAD).alias("p")).select("p.*")
    return mappers.map_webhook_payload(raw).select(
        "record_id", "influencer_name", F.col("platform").cast("string"), F.col("followers").cast("bigint"), "target_product")


# ---------------------------------------------------------------- upserts
def order_feed(m) -> DataFrame:
    """The raw order feed as standard rows, repeated deliveries included
    (the binding without the dedup), landed once per data set."""
    def write(path):
        std_orders(m.spark, m.sf_dir, dedup=False).write.mode("overwrite").parquet(path)
    return m.spark.read.parquet(land(m.spark, m.sf_dir, "order-feed", write, ORDER_SOURCES))


def _split_feed(m):
    """Target = deliveries shipped before the cutoff, deduplicated (the table
    as it stood); batch = the raw later deliveries."""
    feed = order_feed(m)
    cut = F.lit(CUTOFF).cast("timestamp")
    target = upsert.latest_per_key(feed.where(F.col("update_time") < cut), ORDER_KEY, order_tiebreak())
    batch = feed.where(F.col("update_time") >= cut)
    return target.select(*feed.columns), batch


ORDER_KEY = ["order_id", "platform"]
def order_tiebreak():
    """update_time, then the binding's tie-break (part key, supplier key, price)."""
    return [F.col("update_time"), F.col("product_id").cast("bigint"),
            F.regexp_extract("sku_id", r"-(\d+)$", 1).cast("bigint"), F.col("original_price")]


@register("orders_upsert", with_std("""
SELECT order_id, platform, product_id, CAST(gmv AS DOUBLE) AS gmv, quantity, status,
       strftime(paid_at, '%Y-%m-%d %H:%M:%S') AS paid_at, strftime(update_time, '%Y-%m-%d %H:%M:%S') AS update_time
FROM std_orders
"""))
def orders_upsert(m):
    """K1 + J5 + W4: target (lines shipped before the cutoff, deduplicated)
    upserted with the raw later deliveries = the fully deduplicated table."""
    target, batch = _split_feed(m)
    # the table as it stood, stored: the upsert reads it more than once
    path = upsert.staging_path(m.spark, "orders-before")
    with shuffles_freed(m.spark):
        target.write.parquet(path)
    target = m.spark.read.schema(target.schema).parquet(path)
    u = upsert.upsert(target, batch, ORDER_KEY, order_tiebreak())
    return u.select("order_id", "platform", "product_id", F.col("gmv").cast("double").alias("gmv"), "quantity", "status",
                    _ts("paid_at").alias("paid_at"), _ts("update_time").alias("update_time"))


@register("sync_counters", f"""
WITH b AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '{CUTOFF} 00:00:00'),
t AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate < TIMESTAMP '{CUTOFF} 00:00:00'),
k AS (SELECT DISTINCT l_orderkey, l_linenumber FROM b)
SELECT (SELECT CAST(count(*) AS BIGINT) FROM b) AS fetched,
       (SELECT CAST(count(*) AS BIGINT) FROM k ANTI JOIN t USING (l_orderkey, l_linenumber)) AS inserted,
       (SELECT CAST(count(*) AS BIGINT) FROM k SEMI JOIN t USING (l_orderkey, l_linenumber)) AS updated,
       CAST(0 AS BIGINT) AS skipped
""")
def sync_counters(m):
    """K5: fetched / inserted / updated / skipped counters of the order upsert."""
    target, batch = _split_feed(m)
    return upsert.upsert_outcomes(target, batch, ORDER_KEY)


ROLLUP_CTE = """
, agg AS (SELECT product_id, platform, sum(gmv) AS g, sum(quantity) AS q FROM std_orders
          WHERE platform = 'tiktok' AND status <> 'refunded' GROUP BY 1, 2),
rolled AS (SELECT p.product_id, p.platform, p.name, p.category, p.price,
                  CAST(coalesce(agg.g, p.total_gmv) AS DECIMAL(38,2)) AS total_gmv,
                  CAST(coalesce(agg.q, p.total_sold) AS BIGINT) AS total_sold
           FROM std_products p LEFT JOIN agg USING (product_id, platform))"""


@register("product_rollup", with_std(ROLLUP_CTE + """
SELECT product_id, platform, CAST(total_gmv AS DOUBLE) AS total_gmv, total_sold FROM rolled
""", products=True))
def product_rollup(m):
    """K4 + J7: roll non-refunded platform-A order gmv / units into products."""
    r = upsert.product_rollup(m.products, m.orders)
    return r.select("product_id", "platform", F.col("total_gmv").cast("double").alias("total_gmv"), "total_sold")


@register("products_upsert", with_std(ROLLUP_CTE + """
SELECT product_id, platform, name, CAST(CASE WHEN platform = 'tiktok' THEN price + 1 ELSE price END AS DOUBLE) AS price,
       CAST(total_gmv AS DOUBLE) AS total_gmv
FROM rolled
UNION ALL
SELECT product_id, 'taobao', name, CAST(price AS DOUBLE), 0.0 FROM std_products WHERE platform = 'tiktok'
""", products=True))
def products_upsert(m):
    """K2: product upsert that keeps the stored total_gmv; new keys inserted; of
    two deliveries of a key in the batch the later one counts."""
    target = upsert.product_rollup(m.products, m.orders)
    base = std_products(m.spark, m.sf_dir).where(F.col("platform") == "tiktok")
    priced = lambda plus, seq: base.withColumn("price", (F.col("price") + plus).cast("decimal(12,2)")).withColumn("seq", F.lit(seq))
    stale = priced(9, 1).withColumn("name", F.lit("ZZ stale"))
    new = base.withColumn("platform", F.lit("taobao")).withColumn("seq", F.lit(1))
    r = upsert.product_upsert(target, priced(1, 2).unionByName(stale).unionByName(new), order=["seq"])
    return r.select("product_id", "platform", "name", F.col("price").cast("double").alias("price"),
                    F.col("total_gmv").cast("double").alias("total_gmv"))


@register("schema_widen", with_std("""
SELECT order_id, platform, CAST(gmv AS DOUBLE) AS gmv, 1 AS quantity, false AS is_cod, false AS is_sample_order,
       CAST(NULL AS VARCHAR) AS delivery_type, CAST(NULL AS VARCHAR) AS tracking_number
FROM std_orders
"""))
def schema_widen(m):
    """An old narrow order table widened to the full schema with defaults."""
    from shoplens import schemas
    old = m.orders.select("order_id", "platform", "gmv")
    w = upsert.widen(old, schemas.STANDARD_ORDERS, {"quantity": 1, "is_cod": False, "is_sample_order": False})
    w2 = upsert.widen(w, schemas.STANDARD_ORDERS)  # idempotent
    return w2.select("order_id", "platform", F.col("gmv").cast("double").alias("gmv"), "quantity", "is_cod",
                     "is_sample_order", "delivery_type", "tracking_number")


@register("utc_migration", with_std("""
SELECT order_id, platform,
       strftime(CASE WHEN platform = 'tiktok' THEN paid_at - INTERVAL 8 HOUR ELSE paid_at END, '%Y-%m-%d %H:%M:%S') AS paid_at,
       strftime(CASE WHEN platform = 'tiktok' THEN delivery_time - INTERVAL 8 HOUR ELSE delivery_time END, '%Y-%m-%d %H:%M:%S') AS delivery_time,
       CASE WHEN platform = 'tiktok' THEN 1 ELSE 0 END AS tz_version
FROM std_orders
"""))
def utc_migration(m):
    """Tiktok times shifted -8 h once; a second run changes nothing."""
    once = upsert.utc_migration(m.orders.select("order_id", "platform", "paid_at", "rts_time", "delivery_time", "update_time"))
    twice = upsert.utc_migration(once)
    return twice.select("order_id", "platform", _ts("paid_at").alias("paid_at"), _ts("delivery_time").alias("delivery_time"),
                        "tz_version")


@register("analysis_merge", with_std("""
, req AS (
  SELECT c_custkey AS record_id, 'KOL' || lpad(CAST(c_custkey // 5 AS VARCHAR), 5, '0') AS influencer_name,
         CAST(floor(abs(c_acctbal) * 100) AS BIGINT) AS followers
  FROM customer
), best AS (
  SELECT name, roi, is_suspicious FROM (
    SELECT *, row_number() OVER (PARTITION BY name ORDER BY gmv DESC, creator_id DESC) AS rn FROM std_influencers) WHERE rn = 1
), s AS (
  SELECT r.record_id, r.influencer_name,
         CASE WHEN b.name IS NULL THEN 72 WHEN coalesce(b.is_suspicious, false) THEN 25
              ELSE greatest(20, least(98, CAST(floor(coalesce(nullif(b.roi, 0), 1.0) * 30
                   + least(CAST(coalesce(r.followers, 0) AS DOUBLE), 1e6) / 1e6 * 40) AS INTEGER))) END AS ai_match_score
  FROM req r LEFT JOIN best b ON r.influencer_name = b.name
), sc AS (SELECT *, CASE WHEN ai_match_score >= 80 THEN 'high' WHEN ai_match_score >= 60 THEN 'medium' ELSE 'low' END AS band FROM s)
SELECT sc.record_id, sc.influencer_name,
       CASE WHEN b.name IS NOT NULL THEN least(sc.ai_match_score + 1, 98) ELSE sc.ai_match_score END AS ai_match_score,
       sc.band, CASE WHEN b.name IS NOT NULL THEN 'done' ELSE 'processing' END AS status
FROM sc LEFT JOIN best b ON sc.influencer_name = b.name
""", influencers=True))
def analysis_merge(m):
    """K8: analysis records updated field-wise; absent (null) fields keep the
    stored value.  The update batch = analyses whose creator was found (they
    complete); the others stay 'processing'."""
    from shoplens.plans.queries_reports import _requests
    req = _requests(m)
    scores = inf.match_scores(req, m.influencers).withColumn("status", F.lit("processing"))
    found = req.join(m.influencers.select(F.col("name").alias("influencer_name")).distinct(), "influencer_name", "left_semi")
    upd = scores.join(found.select("record_id"), "record_id", "left_semi").select(
        "record_id", F.lit(None).cast("string").alias("influencer_name"),
        F.least(F.col("ai_match_score") + 1, F.lit(98)).alias("ai_match_score"),
        F.lit(None).cast("string").alias("band"), F.lit("done").alias("status"))
    stale = upd.withColumn("ai_match_score", F.lit(0)).withColumn("status", F.lit("zz stale")).withColumn("seq", F.lit(1))
    return upsert.merge_keep_old(scores, stale.unionByName(upd.withColumn("seq", F.lit(2))), "record_id", order=["seq"])
