"""Raw feed records -> standard rows.

Inputs are the all-STRING records of ``sources.feeds``.  "First truthy" (X8)
is applied per field kind: text fields (ids, names, codes) skip null and '';
numeric fields also skip a zero number -- with STRING-typed JSON a number 0
arrives as "0", while "0.00" stays a truthy text, as in the source system.  Boolean fields accept
true/1/yes; "false", "0" and '' are false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens import constants as K
from shoplens.functions import exprs as X

UNKNOWN_PRODUCT = "未知商品"
def _zero():
    return F.lit(0).cast("decimal(14,2)")


def _num(c: Column) -> Column:
    """Numeric text -> double; anything else -> null."""
    s = F.trim(c.cast("string"))
    return F.when(s.rlike(X.NUM_RE), s.cast("double"))


def _int(c: Column) -> Column:
    s = F.trim(c.cast("string"))
    return F.when(s.rlike(r"^[+-]?\d+$"), s.cast("bigint"))


def _flag(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("true", "1", "yes"), F.lit(False))


def _nonempty(c: Column) -> Column:
    return F.when(c.cast("string") != "", c.cast("string"))


def platform_a_time(c: Column) -> Column:
    """X4/X5 for platform A: digits = epoch seconds, or ms above 1e12 (floor);
    else the first of four text formats; '' / 0 -> null."""
    s = F.trim(c.cast("string"))
    digits = s.rlike(r"^\d+$")
    v = F.when(digits, s.cast("decimal(20,0)"))
    secs = F.when(v > 1000000000000, F.floor(v / 1000)).otherwise(v).cast("bigint")
    text = X.text_to_ts(s)  # shape-guarded: date, date time, date time.fraction
    return F.when((s == "") | (s == "0") | s.isNull(), None).when(digits, F.timestamp_seconds(secs)).otherwise(text)


def platform_b_time(c: Column) -> Column:
    """X4 for platform B: epoch seconds, or ms above 1e12 kept fractional."""
    v = _num(c)
    return F.when(v.isNull(), None).when(v > 1e12, F.timestamp_millis(v.cast("bigint"))).otherwise(F.timestamp_seconds(v.cast("bigint")))


def extract_province(addr: Column) -> Column:
    """First district level named 'province' (cut 32, '' -> null); else
    region, else province."""
    hit = F.filter(addr["district_info"], lambda d: d["address_level_name"] == "province")
    first = F.try_element_at(hit, F.lit(1))
    from_levels = F.when(F.size(hit) > 0, _nonempty(F.substring(F.coalesce(first["address_name"], F.lit("")), 1, 32)))
    fallback = _nonempty(F.substring(F.coalesce(X.first_truthy(addr["region"], addr["province"]), F.lit("")), 1, 32))
    return F.when(F.coalesce(F.size(hit), F.lit(0)) > 0, from_levels).otherwise(fallback)


def map_platform_a_order(raw: DataFrame, shop_id: str | None = None) -> DataFrame:
    """Platform A order record -> standard order row (Appendix A rules)."""
    from shoplens.sources.feeds import A_LINE_ITEM
    empty = F.array().cast(f"array<{A_LINE_ITEM.simpleString()}>")
    items = F.coalesce(F.when(F.size("line_items") > 0, F.col("line_items")), F.col("items"), empty)
    first = F.try_element_at(items, F.lit(1))
    n_items = F.size(items)
    pay = F.col("payment")
    product_id = F.coalesce(X.first_truthy(first["product_id"], F.col("product_id")), F.lit(""))
    name = X.first_truthy(first["product_name"], F.col("product_name"), first["sku_name"],
                          F.when(product_id != "", product_id), default=F.lit(UNKNOWN_PRODUCT))
    amount = F.coalesce(_num(X.first_truthy_num(pay["total_amount"], pay["original_total_product_price"],
                                            F.col("total_amount"), F.col("order_amount"))), F.lit(0.0))
    item_qty = lambda it: F.coalesce(F.nullif(_int(it["quantity"]), F.lit(0)), F.lit(1))
    item_sum = F.aggregate(items, F.lit(0.0),
                           lambda acc, it: acc + F.coalesce(_num(X.first_truthy_num(it["sale_price"])), F.lit(0.0)) * item_qty(it))
    gmv = F.when((amount == 0) & (n_items > 0), item_sum).otherwise(amount)
    qty = F.when(n_items > 0, F.aggregate(items, F.lit(0).cast("bigint"), lambda acc, it: acc + item_qty(it))) \
           .otherwise(F.coalesce(F.nullif(_int(F.col("quantity")), F.lit(0)), F.nullif(_int(first["quantity"]), F.lit(0)), F.lit(1)))
    status = X.status_platform_a(F.coalesce(X.first_truthy(first["display_status"], F.col("status"), F.col("order_status")), F.lit("")))
    gmv = F.when(status == K.REFUNDED, F.lit(0.0)).otherwise(gmv)
    money = lambda c: F.nullif(F.coalesce(_num(c), F.lit(0.0)), F.lit(0.0)).cast("decimal(14,2)")  # noqa: E731 - X11
    addr = F.coalesce(F.col("recipient_address"), F.col("shipping_address"))
    return raw.select(
        F.coalesce(X.first_truthy(F.col("id"), F.col("order_id")), F.lit("")).alias("order_id"),
        F.lit(shop_id).cast("string").alias("shop_id"),
        F.lit("tiktok").alias("platform"),
        product_id.alias("product_id"),
        F.substring(name, 1, 255).alias("product_name"),
        F.round(gmv, 2).cast("decimal(14,2)").alias("gmv"),
        qty.cast("int").alias("quantity"),
        X.first_truthy(F.col("buyer_email"), F.col("user_id"), F.col("customer_id")).alias("customer_id"),
        X.first_truthy(F.col("creator_id"), F.col("influencer_id")).alias("creator_id"),
        status.alias("status"),
        platform_a_time(X.first_truthy_num(F.col("paid_time"), F.col("create_time"), F.col("order_create_time"))).alias("paid_at"),
        extract_province(addr).alias("province"),
        X.first_truthy(first["sku_id"]).alias("sku_id"),
        X.first_truthy(first["seller_sku"]).alias("seller_sku"),
        _nonempty(F.substring(F.coalesce(first["sku_name"], F.lit("")), 1, 255)).alias("sku_name"),
        X.first_truthy(pay["currency"], first["currency"]).alias("currency"),
        money(X.first_truthy_num(first["original_price"], pay["original_total_product_price"])).alias("original_price"),
        money(X.first_truthy_num(pay["platform_discount"])).alias("platform_discount"),
        money(X.first_truthy_num(pay["seller_discount"])).alias("seller_discount"),
        money(X.first_truthy_num(pay["shipping_fee"], pay["original_shipping_fee"])).alias("shipping_fee"),
        _flag(F.col("is_cod")).alias("is_cod"),
        _flag(F.col("is_sample_order")).alias("is_sample_order"),
        X.first_truthy(F.col("delivery_type")).alias("delivery_type"),
        X.first_truthy(F.col("shipping_provider")).alias("shipping_provider"),
        X.first_truthy(F.col("tracking_number"), first["tracking_number"]).alias("tracking_number"),
        platform_a_time(F.col("rts_time")).alias("rts_time"),
        platform_a_time(F.col("delivery_time")).alias("delivery_time"),
        platform_a_time(F.col("update_time")).alias("update_time"),
    )


def map_platform_a_product(raw: DataFrame) -> DataFrame:
    """Platform A product -> standard product (last category, first sku's
    price chain, product price fallback; total_gmv 0 on insert)."""
    cats = F.coalesce(F.when(F.size("categories") > 0, F.col("categories")),
                      F.when(F.size("recommended_categories") > 0, F.col("recommended_categories")))
    # a non-empty category list decides, even when its last entry has no name
    cat = F.when(cats.isNotNull(), F.try_element_at(cats, F.lit(-1))["name"]).otherwise(
        X.first_truthy(F.col("category"), F.col("category_name")))
    sku = F.try_element_at(F.col("skus"), F.lit(1))["price"]
    p1 = F.coalesce(_num(X.first_truthy_num(sku["tax_exclusive_price"], sku["original_price"], sku["price"])), F.lit(0.0))
    p2 = F.coalesce(_num(X.first_truthy_num(F.col("price"), F.col("original_price"))), F.lit(0.0))
    price = F.when(p1 == 0, p2).otherwise(p1)
    return raw.select(
        F.coalesce(X.first_truthy(F.col("product_id"), F.col("id")), F.lit("")).alias("product_id"),
        F.lit("tiktok").alias("platform"),
        F.substring(F.coalesce(X.first_truthy(F.col("product_name"), F.col("title"), F.col("name")), F.lit("")), 1, 255).alias("name"),
        _nonempty(F.substring(F.coalesce(cat, F.lit("")), 1, 64)).alias("category"),
        price.cast("decimal(12,2)").alias("price"),
        _zero().alias("total_gmv"),
        F.coalesce(_int(X.first_truthy_num(F.col("sales_volume"), F.col("sold_count"), F.col("sales"))), F.lit(0)).cast("bigint").alias("total_sold"),
    )


def map_platform_b_order(raw: DataFrame) -> DataFrame:
    """P5: platform B order -> standard order.  Rows without an order id are
    rejected (the source would store the text 'None')."""
    sku = F.try_element_at(F.col("sku_order_list"), F.lit(1))
    author = F.col("author_info")
    fen = X.first_truthy_num(F.col("pay_amount"), sku["sku_pay_amount"])
    return raw.where(F.col("order_id").isNotNull() & (F.col("order_id") != "")).select(
        F.col("order_id"),
        _nonempty(F.col("shop_id")).alias("shop_id"),
        F.lit("douyin").alias("platform"),
        F.coalesce(X.first_truthy(sku["sku_id"], sku["product_id"]), F.lit("")).alias("product_id"),
        F.coalesce(X.first_truthy(sku["product_name"], F.col("product_name")), F.lit("")).alias("product_name"),
        X.fen_to_yuan(fen).alias("gmv"),
        F.coalesce(F.nullif(_int(sku["item_num"]), F.lit(0)), F.lit(1)).cast("int").alias("quantity"),
        X.first_truthy(F.col("buyer_id"), F.col("user_id")).alias("customer_id"),
        X.first_truthy(author["open_id"], author["author_id"]).alias("creator_id"),
        X.status_platform_b(F.coalesce(F.col("order_status"), F.lit("PAID"))).alias("status"),
        platform_b_time(X.first_truthy_num(F.col("post_pay_time"), F.col("pay_time"))).alias("paid_at"),
        X.first_truthy(F.col("province_name"), F.col("province")).alias("province"),
    )


def map_influencer_feed(raw: DataFrame, legacy_int: bool = False) -> DataFrame:
    """Influencer feed record -> feed row (21 fields).  Numbers use X2;
    ``legacy_int=True`` truncates rates and roi to integers like the source."""
    out = "int" if legacy_int else "double"
    num = lambda *cs: X.parse_feed_number(X.first_truthy_num(*[F.col(c) for c in cs]), out)
    cnt = lambda *cs: X.parse_feed_number(X.first_truthy_num(*[F.col(c) for c in cs]), "int")
    site_key = X.first_truthy(F.col("site_code"), F.col("site"), F.col("siteId"), F.col("country"))
    lang_key = X.first_truthy(F.col("language"), F.col("lang"))
    return raw.select(
        X.first_truthy(F.col("influencer_id"), F.col("id"), F.col("uid")).alias("influencer_id"),
        F.coalesce(X.lit_map(K.SITE_CODES)[site_key], F.lit(K.DEFAULT_SITE)).alias("site_code"),
        X.first_truthy(F.col("platform"), F.col("channel"), F.col("platformId"), default=F.lit("TikTok")).alias("platform"),
        X.first_truthy(F.col("name"), F.col("username"), F.col("nickname"), default=F.lit("Unknown")).alias("influencer_name"),
        X.first_truthy(F.col("avatar"), F.col("avatar_url"), F.col("profile_picture"), F.col("thumbnailUrl"), default=F.lit("")).alias("avatar_url"),
        cnt("followers", "follower_count", "followerCount", "fans").alias("follower_count"),
        num("engagement_rate", "engagement", "likeRate").alias("engagement_rate"),
        num("conversion_rate", "conversion", "fulfillmentRate").alias("conversion_rate"),
        num("roi", "return_on_investment").alias("roi"),
        (_flag(F.col("is_suspicious")) | _flag(F.col("suspicious")) | F.coalesce(F.col("status") == "rejected", F.lit(False))).alias("is_suspicious"),
        X.first_truthy(F.col("suspicious_reason"), F.col("risk_reason"), default=F.lit("")).alias("suspicious_reason"),
        X.first_truthy(F.col("country"), F.col("region"), F.col("siteId"), default=F.lit("")).alias("country"),
        F.coalesce(X.lit_map(K.LANGUAGES)[lang_key], F.lit(K.DEFAULT_LANGUAGE)).alias("language"),
        X.first_truthy(F.col("niche"), F.col("category"), F.col("vertical"), default=F.lit("General")).alias("niche"),
        cnt("total_posts", "posts", "content_count", "viewCount").alias("total_posts"),
        cnt("avg_likes", "average_likes", "likes", "likeCount").alias("avg_likes"),
        cnt("avg_comments", "average_comments", "comments", "commentCount").alias("avg_comments"),
        cnt("avg_shares", "average_shares", "shares").alias("avg_shares"),
        X.first_truthy(F.col("createdAt"), F.col("created_at"), F.col("createTime")).alias("created_at"),
        X.first_truthy(F.col("updatedAt"), F.col("updated_at")).alias("updated_at"),
        X.first_truthy(F.col("status"), default=F.lit("active")).alias("status"),
    )


def filter_feed(feed: DataFrame, site: str | None = None, platform: str | None = None, status: str | None = None,
                keyword: str | None = None, category: str | None = None) -> DataFrame:
    """S7 query parameters (siteId, platformId, status, keyword, category)
    applied to mapped feed rows: equality on site code, platform, status and
    niche; keyword = case-insensitive substring of the name.  Unset = no filter."""
    conds = []
    if site:
        conds.append(F.col("site_code") == site.upper())
    if platform:
        conds.append(F.lower(F.col("platform")) == platform.lower())
    if status:
        conds.append(F.col("status") == status)
    if keyword:
        conds.append(F.lower(F.col("influencer_name")).contains(keyword.lower()))
    if category:
        conds.append(F.col("niche") == category)
    c = X.all_of(conds)
    return feed if c is None else feed.where(c)


def created_between(feed: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """createdAt within [start, end] (ISO; naive = UTC).  With any valid
    bound, rows whose time is missing or unparseable are dropped; an
    unparseable bound is ignored."""
    import datetime as dt

    def bound(s):
        if not s:
            return None
        try:
            v = dt.datetime.fromisoformat(str(s).replace("Z", "+00:00"))
        except ValueError:
            return None
        if v.tzinfo is not None:
            v = v.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return v

    lo, hi = bound(start), bound(end)
    if lo is None and hi is None:
        return feed
    t = X.iso_to_ts(F.col("created_at"))
    cond = t.isNotNull()
    if lo is not None:
        cond = cond & (t >= F.lit(lo))
    if hi is not None:
        cond = cond & (t <= F.lit(hi))
    return feed.where(cond)


def epoch_window(orders: DataFrame, start: str, end: str, ts: str = "paid_at") -> DataFrame:
    """keep rows in [start 00:00:00, end 23:59:59] and rows with no time."""
    import datetime as dt
    a = dt.datetime.fromisoformat(start)
    b = dt.datetime.fromisoformat(end) + dt.timedelta(hours=23, minutes=59, seconds=59)
    return orders.where(F.col(ts).isNull() | F.col(ts).between(F.lit(a), F.lit(b)))


def map_webhook_payload(raw: DataFrame) -> DataFrame:
    """Webhook payload -> request row, first non-empty alias (X9);
    followers: integer text else 0.  Rows without id or name are rejected."""
    fn = lambda *cs: X.first_nonempty(*[F.col(c) for c in cs])
    fol = fn("followers", "fans", "fan_count", "follower_count", "fanCount")
    out = raw.select(
        fn("record_id", "id", "rec_id", "recordId").alias("record_id"),
        fn("influencer_name", "name", "creator_name", "creatorName", "influencerName").alias("influencer_name"),
        fn("platform", "plat").alias("platform"),
        F.coalesce(_int(fol), F.lit(0)).alias("followers"),
        fn("target_product", "targetProduct", "product", "product_name", "goods", "item").alias("target_product"))
    return out.where(F.col("record_id").isNotNull() & F.col("influencer_name").isNotNull())


def normalize_analysis(args: DataFrame, radar_col: str = "radar") -> DataFrame:
    """Analysis arguments -> stored shape.  ``radar`` (map<string,string>)
    keeps only the six known keys as (dimension label, key, int value);
    multilingual zh falls back to the outreach script."""
    labels = X.lit_map(K.RADAR_LABELS)
    known = F.map_filter(F.col(radar_col), lambda k, v: labels[k].isNotNull())
    radar = F.transform(F.map_entries(known), lambda e: F.struct(
        labels[e["key"]].alias("dimension"), e["key"].alias("key"),
        F.coalesce(_num(e["value"]).cast("int"), F.lit(0)).alias("value")))
    ml = F.col("multilingual_scripts")
    return args.select(
        "record_id",
        F.coalesce(_num(F.col("ai_match_score")).cast("int"), F.lit(0)).alias("ai_match_score"),
        F.coalesce("ai_risk_warning", F.lit("")).alias("ai_risk_warning"),
        F.coalesce("ai_outreach_script", F.lit("")).alias("ai_outreach_script"),
        F.coalesce("fit_analysis", F.lit("")).alias("fit_analysis"),
        radar.alias("radar"),
        F.create_map(F.lit("zh"), F.coalesce(X.first_truthy(ml["zh"], F.col("ai_outreach_script")), F.lit("")),
                     F.lit("en"), F.coalesce(X.first_truthy(ml["en"]), F.lit(""))).alias("multilingual"))


def strip_code_fence_json(text: Column, schema) -> Column:
    """Decode JSON text, retrying once with Markdown code fences removed."""
    direct = F.from_json(text, schema)
    fenced = F.from_json(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(json)?\s*", ""), r"\s*```$", ""), schema)
    # a malformed document parses to a struct of nulls, not null: pick by the fence marker
    return F.when(F.trim(text).startswith("```"), fenced).otherwise(direct)


def to_orm_order(dto: DataFrame, columns: list[str]) -> DataFrame:
    """Project a mapped frame onto the table's column order (missing -> null)."""
    return dto.select(*[F.col(c) if c in dto.columns else F.lit(None).alias(c) for c in columns])
