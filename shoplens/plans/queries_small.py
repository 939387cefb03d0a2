"""Registered queries for the smaller operators: date rules, sorting, lookups,
display text and the write-side helpers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from shoplens.functions import exprs as X
from shoplens.functions import periods
from shoplens.operators import breakdowns, influencers, mappers, reports, upsert
from shoplens.operators.ranking import global_rank
from shoplens.plans import queries_core  # noqa: F401 - registers top_products
from shoplens.plans.catalog import ORACLE, W30, W365, register, ts
from shoplens.plans.oracle import AS_OF, with_std
from shoplens.sources.tables import table

TOTALS = "CAST(count(*) AS BIGINT) AS orders, CAST(coalesce(sum(gmv), 0) AS DOUBLE) AS gmv"


def _totals(df):
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("orders"), F.coalesce(F.sum("gmv").cast("double"), F.lit(0.0)).alias("gmv"))


@register("closed_between", with_std(f"""
SELECT {TOTALS} FROM std_orders WHERE paid_at BETWEEN TIMESTAMP '1998-06-01' AND TIMESTAMP '1998-06-30'
"""))
def closed_between(m):
    """orders paid between two midnights, both included."""
    june = m.orders_between(dt.datetime(1998, 6, 1), dt.datetime(1998, 6, 30, 0, 0, 1))  # prunes months
    return _totals(june.where(periods.between_closed("paid_at", "1998-06-01", "1998-06-30")))


@register("epoch_window", with_std(f"""
SELECT {TOTALS} FROM std_orders
WHERE delivery_time IS NULL OR delivery_time BETWEEN TIMESTAMP '1998-06-01' AND TIMESTAMP '1998-06-30 23:59:59'
"""))
def epoch_window(m):
    """a window that keeps rows without a time."""
    return _totals(mappers.epoch_window(m.orders, "1998-06-01", "1998-06-30", "delivery_time"))


def _midnight(day) -> dt.datetime:
    return dt.datetime.fromisoformat(str(day)[:10])


KINDS = ["weekly", "monthly", "last30", "daily"]


def _kind_sql(kind: str) -> str:
    a, b = periods.report_range(kind, AS_OF)
    return (f"SELECT '{kind}' AS kind, '{a}' AS first_day, '{b}' AS last_day, {TOTALS} FROM std_orders "
            f"WHERE paid_at >= TIMESTAMP '{a}' AND paid_at < TIMESTAMP '{b}' + INTERVAL 1 DAY")


@register("report_ranges", with_std("\n" + "\nUNION ALL\n".join(map(_kind_sql, KINDS))))
def report_ranges(m):
    """totals of the four report ranges."""
    out = None
    for kind in KINDS:
        a, b = periods.report_range(kind, AS_OF)
        within = m.orders_between(_midnight(a), _midnight(b) + dt.timedelta(days=1))  # prunes months
        row = _totals(within.where(periods.in_range("paid_at", a, b))).select(
            F.lit(kind).alias("kind"), F.lit(str(a)).alias("first_day"), F.lit(str(b)).alias("last_day"), "orders", "gmv")
        out = row if out is None else out.unionByName(row)
    return out


PRESETS = {p: periods.preset(p, AS_OF, ("1998-05-03", "1998-05-17")) for p in ("7d", "30d", "90d", "all", "custom")}


@register("period_presets", with_std("\n" + "\nUNION ALL\n".join(
    f"SELECT '{p}' AS preset, {TOTALS} FROM std_orders" + (f" WHERE paid_at >= {ts(w.start)} AND paid_at < {ts(w.end)}" if w else "")
    for p, w in PRESETS.items())))
def period_presets(m):
    """totals of the preset windows."""
    out = None
    for p, w in PRESETS.items():
        row = _totals(m.orders_in(w).where(w.contains("paid_at")) if w else m.orders).select(F.lit(p).alias("preset"), "orders", "gmv")
        out = row if out is None else out.unionByName(row)
    return out


@register("current_week", with_std(f"""
SELECT {TOTALS} FROM std_orders
WHERE paid_at >= date_trunc('week', {ts(W30.end)} - INTERVAL 1 DAY) AND paid_at < {ts(W30.end)}
"""))
def current_week(m):
    """from Monday to the end of the as-of day."""
    days = m.orders_between(W30.end - dt.timedelta(days=7), W30.end)  # prunes months
    return _totals(days.where(periods.current_week("paid_at", AS_OF)))


@register("newest_orders", with_std("""
SELECT order_id, platform, strftime(update_time, '%Y-%m-%d %H:%M:%S') AS update_time, CAST(gmv AS DOUBLE) AS gmv
FROM std_orders ORDER BY std_orders.update_time DESC NULLS LAST, order_id DESC, platform DESC, std_orders.gmv DESC LIMIT 50
"""))
def newest_orders(m):
    """K7 / L3: the 50 newest rows, equal times in a fixed order."""
    n = upsert.newest(m.orders.select("order_id", "platform", "update_time", "gmv"), "update_time", 50)
    return n.select("order_id", "platform", F.date_format("update_time", "yyyy-MM-dd HH:mm:ss").alias("update_time"),
                    F.col("gmv").cast("double").alias("gmv"))


@register("influencers_sorted", with_std("""
SELECT creator_id, name, roi FROM std_influencers ORDER BY roi ASC NULLS LAST, creator_id
""", influencers=True))
def influencers_sorted(m):
    """L4: a user's sort of all rows (with ranks: ``influencers_ranked``)."""
    return influencers.sort_nulls_last(m.influencers.select("creator_id", "name", "roi"), "roi", False, ("creator_id",))


@register("products_sorted", with_std("""
SELECT product_id, platform, CAST(price AS DOUBLE) AS price FROM std_products
ORDER BY std_products.price DESC NULLS LAST, product_id, platform
""", products=True))
def products_sorted(m):
    """The same on products (with ranks: ``products_ranked``)."""
    p = influencers.sort_nulls_last(m.products, "price", True, ("product_id", "platform"))
    return p.select("product_id", "platform", F.col("price").cast("double").alias("price"))


@register("influencers_ranked", with_std("""
SELECT creator_id, name, roi, row_number() OVER (ORDER BY roi ASC NULLS LAST, creator_id) AS rank_no FROM std_influencers
""", influencers=True))
def influencers_ranked(m):
    """L4: a user's sort of the whole list, its order as a rank."""
    i = m.influencers.select("creator_id", "name", "roi")
    return global_rank(i, [F.col("roi").asc_nulls_last(), "creator_id"], "rank_no")


@register("products_ranked", with_std("""
SELECT product_id, platform, CAST(price AS DOUBLE) AS price,
       row_number() OVER (ORDER BY std_products.price DESC NULLS LAST, product_id, platform) AS rank_no
FROM std_products
""", products=True))
def products_ranked(m):
    """The same on products."""
    p = global_rank(m.products.select("product_id", "platform", "price"),
                    [F.col("price").desc_nulls_last(), "product_id", "platform"], "rank_no")
    return p.withColumn("price", F.col("price").cast("double"))


@register("top_products_display", f"""
SELECT product, rank_no, max(rank_no) OVER () - rank_no + 1 AS display_no FROM ({ORACLE["top_products"]}) t
""")
def top_products_display(m):
    """The top list reversed for charts drawn from the bottom up."""
    top = breakdowns.top_products(m.orders_in(W365), m.products, W365, 10)
    return breakdowns.display_order(top).select("product", "rank_no", "display_no")


@register("product_lookup", with_std("""
SELECT product_id, platform, name FROM std_products WHERE product_id = '42'
""", products=True))
def product_lookup(m):
    """point lookup by key."""
    return reports.lookup(m.products, "product_id", "42").select("product_id", "platform", "name")


@register("report_delete", with_std("""
SELECT product_id, platform FROM std_products WHERE product_id NOT IN ('1', '2', '42')
""", products=True))
def report_delete(m):
    """K9: rows without the deleted keys."""
    return upsert.delete_by_key(m.products, "product_id", ["1", "2", "42"]).select("product_id", "platform")


@register("follower_labels", with_std("""
SELECT creator_id, CASE WHEN followers >= 10000 THEN printf('%.1f', followers / 10000.0) || ' 万'
                        ELSE format('{:,}', followers) END AS followers_text
FROM std_influencers
""", influencers=True))
def follower_labels(m):
    """Follower counts as display text."""
    return m.influencers.select("creator_id", X.fmt_followers("followers").alias("followers_text"))


@register("write_back", """
SELECT CAST(c_custkey AS VARCHAR) AS record_id,
       '{' || concat_ws(',', CASE WHEN c_custkey % 5 > 0 THEN '"score":' || c_custkey % 5 END,
                        CASE WHEN c_custkey % 3 > 0 THEN '"band":"b' || c_custkey % 3 || '"' END) || '}' AS payload
FROM customer WHERE c_custkey % 5 > 0 OR c_custkey % 3 > 0
""")
def write_back(m):
    """JSON of the set fields; rows without any are left out."""
    k = F.col("c_custkey")
    a = table(m.spark, m.sf_dir, "customer").select(
        k.cast("string").alias("record_id"), F.nullif(k % 5, F.lit(0)).alias("ai_score"),
        F.when(k % 3 > 0, F.concat(F.lit("b"), (k % 3).cast("string"))).alias("ai_band"))
    return reports.write_back_payload(a, {"ai_score": "score", "ai_band": "band"})


@register("json_fences", """
SELECT c_custkey AS id, CAST(c_custkey % 100 AS INTEGER) AS score, 'n' || c_custkey AS name FROM customer
""")
def json_fences(m):
    """JSON text with and without Markdown code fences."""
    k = F.col("c_custkey")
    body = F.format_string('{"score": %d, "name": "n%d"}', k % 100, k)
    text = (F.when(k % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
            .when(k % 3 == 1, F.concat(F.lit("```\n"), body, F.lit("\n```"))).otherwise(body))
    parsed = mappers.strip_code_fence_json(text, "score int, name string")
    return table(m.spark, m.sf_dir, "customer").select(k.alias("id"), parsed.alias("p")).select("id", "p.score", "p.name")


@register("order_columns", with_std("""
SELECT order_id, CAST(NULL AS VARCHAR) AS remark, platform FROM std_orders
"""))
def order_columns(m):
    """A frame brought onto a table's columns."""
    out = mappers.to_orm_order(m.orders.select("platform", "order_id", "status"), ["order_id", "remark", "platform"])
    return out.withColumn("remark", F.col("remark").cast("string"))
