"""Registered dashboard queries (phase 0-1 of the survey's build plan)."""

from __future__ import annotations


from shoplens.operators import breakdowns, kpi
from shoplens.plans.catalog import W30, W365, register, ts
from shoplens.plans.oracle import with_std

C30, E30, P30 = ts(W30.start), ts(W30.end), ts(W30.prev_start)
C365, E365 = ts(W365.start), ts(W365.end)


def _in30(c="paid_at"):
    return f"{c} >= {C30} AND {c} < {E30}"


def _in365(c="paid_at"):
    return f"{c} >= {C365} AND {c} < {E365}"


KPI_SQL = with_std(f"""
, m AS (
  SELECT
    coalesce(sum(CASE WHEN {_in30()} AND status <> 'refunded' THEN gmv END), 0) AS cur_gmv,
    count(*) FILTER (WHERE {_in30()}) AS cur_n,
    count(*) FILTER (WHERE {_in30()} AND status = 'refunded') AS cur_r,
    coalesce(sum(CASE WHEN paid_at >= {P30} AND paid_at < {C30} AND status <> 'refunded' THEN gmv END), 0) AS prev_gmv,
    count(*) FILTER (WHERE paid_at >= {P30} AND paid_at < {C30}) AS prev_n,
    count(*) FILTER (WHERE paid_at >= {P30} AND paid_at < {C30} AND status = 'refunded') AS prev_r
  FROM std_orders WHERE paid_at >= {P30} AND paid_at < {E30}
), v AS (
  SELECT 'gmv' AS key, 'GMV' AS label, CAST(cur_gmv AS DOUBLE) AS cur, CAST(prev_gmv AS DOUBLE) AS prev,
         true AS higher_is_better, 'currency' AS format FROM m
  UNION ALL SELECT 'orders', '订单数', CAST(cur_n AS DOUBLE), CAST(prev_n AS DOUBLE), true, 'int' FROM m
  UNION ALL SELECT 'aov', '客单价',
         coalesce(CAST(cur_gmv AS DOUBLE) / nullif(CAST(cur_n - cur_r AS DOUBLE), 0), 0),
         coalesce(CAST(prev_gmv AS DOUBLE) / nullif(CAST(prev_n - prev_r AS DOUBLE), 0), 0), true, 'currency' FROM m
  UNION ALL SELECT 'refund_rate', '退款率',
         coalesce(CAST(cur_r * 100 AS DOUBLE) / nullif(CAST(cur_n AS DOUBLE), 0), 0),
         coalesce(CAST(prev_r * 100 AS DOUBLE) / nullif(CAST(prev_n AS DOUBLE), 0), 0), false, 'percent' FROM m
)
SELECT key, label, round(cur, 2) AS value, round(prev, 2) AS prev_value,
       CASE WHEN prev <> 0 THEN round((cur - prev) / prev * 100, 1) END AS delta_pct,
       higher_is_better, format,
       '{W30.label_start}' AS period_start, '{W30.label_end}' AS period_end,
       '{W30.prev_label_start}' AS prev_period_start, '{W30.prev_label_end}' AS prev_period_end,
       CASE WHEN prev = 0 THEN true ELSE ((CASE WHEN prev <> 0 THEN round((cur - prev) / prev * 100, 1) END) >= 0) = higher_is_better END AS good
FROM v
""")


@register("kpi_overview", KPI_SQL)
def kpi_overview(m):
    """A1+A2: 30-day KPIs with previous-period deltas (one scan)."""
    return kpi.kpi_overview(m.orders_in(W30, previous=True), W30)


# ---------------------------------------------------------------- trends
TREND_SQL = with_std(f"""
, daily AS (
  SELECT CAST(paid_at AS DATE) AS day, sum(CASE WHEN status <> 'refunded' THEN gmv ELSE 0 END) AS gmv
  FROM std_orders WHERE {_in30()} GROUP BY 1
), cal AS (
  SELECT CAST(unnest(generate_series(DATE '{W30.start.date()}', DATE '{W30.end.date()}' - 1, INTERVAL 1 DAY)) AS DATE) AS day
)
SELECT strftime(cal.day, '%Y-%m-%d') AS date, CAST(round(coalesce(gmv, 0), 2) AS DOUBLE) AS gmv
FROM cal LEFT JOIN daily USING (day)
""")


@register("gmv_trend", TREND_SQL)
def gmv_trend(m):
    """A4 + J8: 30 days of non-refunded daily gmv, missing days as 0."""
    return kpi.gmv_trend(m.orders_in(W30), W30)


RANGE_SQL = with_std("""
SELECT strftime(min(paid_at), '%Y-%m-%d') AS earliest, strftime(max(paid_at), '%Y-%m-%d') AS latest,
       min(paid_at) IS NOT NULL AS has_data
FROM std_orders WHERE paid_at IS NOT NULL
""")


@register("data_range", RANGE_SQL)
def data_range(m):
    """A3 + T12: actual data range and has-data flag."""
    return kpi.data_range(m.orders)


# ---------------------------------------------------------------- products
PRODUCT_STATS_CTE = f"""
, pre AS (
  SELECT product_name, product_id, platform,
         sum(CASE WHEN status <> 'refunded' THEN gmv ELSE 0 END) AS gmv,
         sum(CASE WHEN status <> 'refunded' THEN quantity ELSE 0 END) AS units,
         count(*) AS lines
  FROM std_orders WHERE {_in365()} GROUP BY 1, 2, 3
), stats AS (
  SELECT product_name AS product, sum(gmv) AS gmv, CAST(sum(units) AS BIGINT) AS units,
         CAST(sum(lines) AS BIGINT) AS lines, max(category) AS category, max(price) AS price
  FROM pre LEFT JOIN std_products USING (product_id, platform) GROUP BY product_name
)"""

TOP_SQL = with_std(PRODUCT_STATS_CTE + """
, t AS (SELECT * FROM stats ORDER BY gmv DESC, product LIMIT 10)
SELECT row_number() OVER (ORDER BY gmv DESC, product) AS rank_no, product,
       CAST(round(gmv, 2) AS DOUBLE) AS gmv, units AS orders, category, CAST(price AS DOUBLE) AS price,
       row_number() OVER (ORDER BY gmv DESC, product) <= 3 AS is_top3,
       greatest(CAST(4 AS DOUBLE), round(CAST(gmv * 100 AS DOUBLE) / CAST(max(gmv) OVER () AS DOUBLE), 0)) AS bar_pct
FROM t
""", products=True)


@register("top_products", TOP_SQL)
def top_products(m):
    """A5 + J1 + W1 + T13: top-10 product names over 365 days."""
    return breakdowns.top_products(m.orders_in(W365), m.products, W365, 10)


SELL_SQL = with_std(PRODUCT_STATS_CTE + f"""
SELECT count(*) AS total, count(*) FILTER (WHERE units > 0) AS sold,
       coalesce(round(CAST(count(*) FILTER (WHERE units > 0) * 100.0 AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE), 0), 1), 0) AS sell_through_pct,
       count(*) FILTER (WHERE units / {W365.days} > 50.0) AS hot
FROM stats
""", products=True)


@register("sell_through", SELL_SQL)
def sell_through(m):
    """T5: product overview (listed, sold, sell-through %, hot)."""
    return breakdowns.sell_through(m.orders_in(W365), m.products, W365)


BANDS_SQL = with_std(PRODUCT_STATS_CTE + """
, priced AS (
  SELECT *, coalesce(CAST(price AS DOUBLE), CAST(gmv AS DOUBLE) / nullif(CAST(units AS DOUBLE), 0), 0) AS unit_price FROM stats
), b AS (
  SELECT CASE WHEN unit_price >= 0 AND unit_price < 10 THEN '0-10' WHEN unit_price >= 10 AND unit_price < 20 THEN '10-20'
              WHEN unit_price >= 20 AND unit_price < 50 THEN '20-50' WHEN unit_price >= 50 THEN '50+' END AS band,
         sum(units) AS orders, sum(gmv) AS gmv, count(*) AS products
  FROM priced GROUP BY 1
), full_ AS (
  SELECT bands.band_idx, bands.band, CAST(coalesce(orders, 0) AS BIGINT) AS orders,
         CAST(round(coalesce(gmv, 0), 2) AS DOUBLE) AS gmv, CAST(coalesce(products, 0) AS BIGINT) AS products
  FROM (VALUES (0, '0-10'), (1, '10-20'), (2, '20-50'), (3, '50+')) AS bands(band_idx, band) LEFT JOIN b USING (band)
)
SELECT *, (row_number() OVER (ORDER BY gmv DESC, band_idx) = 1 AND gmv > 0) AS is_main FROM full_
""", products=True)


@register("price_bands", BANDS_SQL)
def price_bands(m):
    """T6 + P14: price-band aggregation with main band."""
    return breakdowns.price_bands(m.orders_in(W365), m.products, W365)


DIST_SQL = with_std("""
, b AS (
  SELECT CASE WHEN p >= 0 AND p < 500 THEN '0-500' WHEN p >= 500 AND p < 1000 THEN '500-1000'
              WHEN p >= 1000 AND p < 2000 THEN '1000-2000' WHEN p >= 2000 THEN '2000+' END AS band, count(*) AS products
  FROM (SELECT coalesce(CAST(price AS DOUBLE), 0) AS p FROM std_products) GROUP BY 1
), full_ AS (
  SELECT bands.band_idx, bands.band, CAST(coalesce(products, 0) AS BIGINT) AS products
  FROM (VALUES (0, '0-500'), (1, '500-1000'), (2, '1000-2000'), (3, '2000+')) AS bands(band_idx, band) LEFT JOIN b USING (band)
)
SELECT *, (row_number() OVER (ORDER BY products DESC, band_idx) = 1 AND products > 0) AS is_main FROM full_
""", products=True)


@register("price_distribution", DIST_SQL)
def price_distribution(m):
    """Product count per price range over the product dimension."""
    return breakdowns.price_distribution(m.products)


CAT_SQL = with_std(PRODUCT_STATS_CTE + """
, g AS (SELECT coalesce(category, '未分类') AS category, sum(gmv) AS gmv_d FROM stats GROUP BY 1)
SELECT category, CAST(round(gmv_d, 2) AS DOUBLE) AS gmv,
       round(CAST(gmv_d * 100.0 AS DOUBLE) / nullif(CAST(sum(gmv_d) OVER () AS DOUBLE), 0), 1) AS pct
FROM g
""", products=True)


@register("category_share", CAT_SQL)
def category_share(m):
    """Gmv share per category."""
    return breakdowns.category_share(m.orders_in(W365), m.products, W365)


@register("category_list", with_std("SELECT DISTINCT category FROM std_products WHERE category IS NOT NULL", products=True))
def category_list(m):
    """Sorted distinct categories."""
    return breakdowns.category_list(m.products)


# ---------------------------------------------------------------- shops / geo / status / types / shipping
SHOPS_SQL = with_std("""
SELECT coalesce(shop_id, '') AS shop_id, coalesce(shop_id, '默认店铺') AS name,
       CAST(count(*) AS BIGINT) AS order_count, CAST(round(coalesce(sum(gmv), 0), 2) AS DOUBLE) AS gmv
FROM std_orders GROUP BY shop_id
UNION ALL
SELECT '', '默认店铺', 0, 0.0 WHERE NOT EXISTS (SELECT 1 FROM std_orders)
""")


@register("shop_list", SHOPS_SQL)
def shop_list(m):
    """Shops with order count and gmv (refunds included)."""
    return breakdowns.shop_list(m.orders)


GEO_SQL = with_std(f"""
SELECT province, CAST(count(*) AS BIGINT) AS orders,
       CAST(round(sum(CASE WHEN status <> 'refunded' THEN gmv ELSE 0 END), 2) AS DOUBLE) AS gmv
FROM std_orders WHERE {_in365()} AND province IS NOT NULL
GROUP BY province ORDER BY sum(CASE WHEN status <> 'refunded' THEN gmv ELSE 0 END) DESC, province LIMIT 20
""")


@register("geo_top", GEO_SQL)
def geo_top(m):
    """Top-20 provinces by gmv."""
    return breakdowns.geo_top(m.orders_in(W365), W365, 20)


STATUS_SQL = with_std(f"""
SELECT status,
       CASE status WHEN 'completed' THEN '已完成' WHEN 'shipped' THEN '已发货' WHEN 'paid' THEN '已付款'
                   WHEN 'refunded' THEN '已退款/取消' ELSE status END AS label,
       CAST(count(*) AS BIGINT) AS orders,
       CAST(round(sum(CASE WHEN status <> 'refunded' THEN gmv ELSE 0 END), 2) AS DOUBLE) AS gmv,
       round(CAST(count(*) * 100.0 AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE), 1) AS pct
FROM std_orders WHERE {_in365()} GROUP BY status
""")


@register("status_mix", STATUS_SQL)
def status_mix(m):
    """Status distribution with labels and % of orders."""
    return breakdowns.status_mix(m.orders_in(W365), W365)


TYPES_SQL = with_std(f"""
SELECT type, CASE type WHEN 'sample' THEN '样品单' WHEN 'cod' THEN '货到付款' ELSE '普通订单' END AS label,
       CAST(count(*) AS BIGINT) AS orders,
       CAST(round(sum(CASE WHEN status <> 'refunded' THEN gmv ELSE 0 END), 2) AS DOUBLE) AS gmv,
       round(CAST(count(*) * 100.0 AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE), 1) AS pct
FROM (SELECT *, CASE WHEN is_sample_order THEN 'sample' WHEN is_cod THEN 'cod' ELSE 'normal' END AS type
      FROM std_orders WHERE {_in365()}) GROUP BY type
""")


@register("order_type_mix", TYPES_SQL)
def order_type_mix(m):
    """A9 + T11: sample / cod / normal mix."""
    return breakdowns.order_type_mix(m.orders_in(W365), W365)


SHIP_SQL = with_std(f"""
, g AS (SELECT coalesce(shipping_provider, '未知') AS name, CAST(count(*) AS BIGINT) AS orders
        FROM std_orders WHERE {_in365()} GROUP BY shipping_provider)
SELECT name, orders, round(CAST(orders * 100.0 AS DOUBLE) / CAST(sum(orders) OVER () AS DOUBLE), 1) AS pct FROM g
""")


@register("shipping_providers", SHIP_SQL)
def shipping_providers(m):
    """A10 + T11: orders per shipping provider with share."""
    return breakdowns.shipping_providers(m.orders_in(W365), W365)


DELIV_SQL = with_std(f"""
SELECT coalesce(round(avg((epoch(delivery_time) - epoch(rts_time)) / 3600.0), 1), 0) AS avg_delivery_hours,
       count(*) AS orders_measured
FROM std_orders WHERE {_in365()} AND rts_time IS NOT NULL AND delivery_time IS NOT NULL
""")


@register("delivery_hours", DELIV_SQL)
def delivery_hours(m):
    """Mean delivery hours."""
    return breakdowns.delivery_hours(m.orders_in(W365), W365)


SITE_SQL = with_std(f"""
SELECT site_code, coalesce(currency, 'USD') AS currency,
       CAST(round(coalesce(sum(gmv), 0), 2) AS DOUBLE) AS total_gmv, CAST(count(*) AS BIGINT) AS total_orders,
       CAST(round(avg(gmv), 2) AS DOUBLE) AS avg_order_value
FROM std_orders WHERE {_in365()} GROUP BY site_code, currency
""")


@register("site_breakdown", SITE_SQL)
def site_breakdown(m):
    """A19 + T14: site x currency breakdown."""
    return breakdowns.site_breakdown(m.orders_in(W365), W365)


SCATTER_SQL = with_std("""
SELECT creator_id, name, category, engagement_rate, conversion_rate,
       CAST(round(gmv, 2) AS DOUBLE) AS gmv, round(roi, 2) AS roi, CAST(coalesce(followers, 0) AS BIGINT) AS followers,
       coalesce(is_suspicious, false) AS is_suspicious,
       count(*) FILTER (WHERE coalesce(is_suspicious, false)) OVER () AS suspicious_count
FROM std_influencers
""", influencers=True)


@register("influencer_scatter", SCATTER_SQL)
def influencer_scatter(m):
    """P10: influencer scatter points with suspicious total."""
    return breakdowns.influencer_scatter(m.influencers)


# ---------------------------------------------------------------- shop filter
SHOPS = ["", "SHOP_1", "SHOP_3"]
SHOP_SQL = "(shop_id IS NULL OR shop_id IN ('SHOP_1', 'SHOP_3'))"


@register("kpi_overview_shops", KPI_SQL.replace(
    f"FROM std_orders WHERE paid_at >= {P30} AND paid_at < {E30}",
    f"FROM std_orders WHERE paid_at >= {P30} AND paid_at < {E30} AND {SHOP_SQL}"))
def kpi_overview_shops(m):
    """A2 + F5: KPIs for the default shop (null id) and two named shops."""
    return kpi.kpi_overview(m.orders_in(W30, previous=True), W30, SHOPS)


@register("top_products_shops", TOP_SQL.replace(
    f"FROM std_orders WHERE {_in365()} GROUP BY 1, 2, 3",
    f"FROM std_orders WHERE {_in365()} AND {SHOP_SQL} GROUP BY 1, 2, 3"))
def top_products_shops(m):
    """A5 + F5: top products of the selected shops."""
    return breakdowns.top_products(m.orders_in(W365), m.products, W365, 10, SHOPS)
