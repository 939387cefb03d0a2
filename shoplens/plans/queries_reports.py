"""Registered influencer, report, tool and data-quality queries (phases 2-3)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from shoplens.functions import exprs as X
from shoplens.operators import influencers as inf
from shoplens.operators import kpi, quality, reports
from shoplens.plans.catalog import W30, W365, register, ts
from shoplens.plans.oracle import with_std

C365, E365 = ts(W365.start), ts(W365.end)
C30, E30 = ts(W30.start), ts(W30.end)
IN365 = f"paid_at >= {C365} AND paid_at < {E365}"
IN30 = f"paid_at >= {C30} AND paid_at < {E30}"
METRIC_SQL = """creator_id, name, category, CAST(round(gmv, 2) AS DOUBLE) AS gmv, CAST(orders AS BIGINT) AS orders,
       round(roi, 2) AS roi, CAST(coalesce(followers, 0) AS BIGINT) AS followers, engagement_rate, conversion_rate,
       coalesce(is_suspicious, false) AS is_suspicious"""


# ---------------------------------------------------------------- tools
@register("sales_totals", with_std(f"""
SELECT CAST(round(coalesce(sum(gmv), 0), 2) AS DOUBLE) AS gmv, CAST(count(*) AS BIGINT) AS orders,
       coalesce(round(CAST(sum(gmv) AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE), 0), 2), 0) AS avg_order_value
FROM std_orders WHERE {IN365}
"""))
def sales_totals(m):
    """Period totals, refunds included."""
    return reports.sales_totals(m.orders_in(W365), W365)


@register("sales_totals_tiktok", with_std(f"""
SELECT CAST(round(coalesce(sum(gmv), 0), 2) AS DOUBLE) AS gmv, CAST(count(*) AS BIGINT) AS orders,
       coalesce(round(CAST(sum(gmv) AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE), 0), 2), 0) AS avg_order_value
FROM std_orders WHERE {IN365} AND platform = 'tiktok'
"""))
def sales_totals_tiktok(m):
    """A12 + F6: period totals for one platform."""
    return reports.sales_totals(m.orders_in(W365), W365, platform="tiktok")


@register("tool_top_products", with_std(f"""
SELECT product_name AS product, CAST(round(sum(gmv), 2) AS DOUBLE) AS gmv, CAST(count(*) AS BIGINT) AS orders
FROM std_orders WHERE {IN365} GROUP BY product_name ORDER BY sum(gmv) DESC, product_name LIMIT 10
"""))
def tool_top_products(m):
    """Tool top-10 products with order counts."""
    return reports.tool_top_products(m.orders_in(W365), W365)


@register("influencer_metrics", with_std(f"""
, top AS (SELECT * FROM std_influencers ORDER BY gmv DESC, creator_id LIMIT 10),
u AS (
  SELECT *, 'top' AS source FROM top
  UNION ALL
  SELECT *, 'flagged' FROM std_influencers WHERE coalesce(is_suspicious, false) AND creator_id NOT IN (SELECT creator_id FROM top)
)
SELECT {METRIC_SQL}, source FROM u
""", influencers=True))
def influencer_metrics(m):
    """A14 + J6 + D2: top-10 influencers by gmv plus all flagged ones."""
    return inf.influencer_metrics(m.influencers, top_n=10)


@register("influencer_metrics_by_name", with_std(f"""
SELECT {METRIC_SQL}, 'name' AS source FROM std_influencers WHERE name = 'KOL00007'
""", influencers=True))
def influencer_metrics_by_name(m):
    """A14 + F12: exact creator-name lookup."""
    return inf.influencer_metrics(m.influencers, creator_name="KOL00007")


# ---------------------------------------------------------------- report tools
@register("influencer_product", with_std(f"""
, g AS (
  SELECT o.creator_id, i.name AS influencer_name, o.product_id, p.name AS product_name, i.conversion_rate, i.roi,
         sum(o.gmv) AS s, count(*) AS n, sum(o.quantity) AS u
  FROM std_orders o JOIN std_influencers i ON o.creator_id = i.creator_id
  JOIN std_products p ON o.product_id = p.product_id AND o.platform = p.platform
  WHERE o.{IN365.replace('paid_at', 'paid_at', 1)}
  GROUP BY o.creator_id, i.name, o.product_id, p.name, i.conversion_rate, i.roi
)
SELECT creator_id AS influencer_id, influencer_name, product_id, product_name,
       CAST(round(s, 2) AS DOUBLE) AS total_sales, CAST(n AS BIGINT) AS total_orders,
       round(CAST(s AS DOUBLE) / n, 2) AS avg_order_value, CAST(u AS BIGINT) AS total_units,
       round(coalesce(conversion_rate, 0), 4) AS conversion_rate, round(coalesce(roi, 0), 2) AS roi
FROM g ORDER BY s DESC, creator_id, product_id LIMIT 20
""", products=True, influencers=True))
def influencer_product(m):
    """A15 + J2: influencer x product top 20."""
    return inf.influencer_product(m.orders_in(W365), m.influencers, m.products, W365)


@register("daily_sales", with_std(f"""
SELECT strftime(CAST(paid_at AS DATE), '%Y-%m-%d') AS date, CAST(round(sum(gmv), 2) AS DOUBLE) AS daily_gmv,
       CAST(count(*) AS BIGINT) AS daily_orders, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS daily_units
FROM std_orders WHERE {IN30} GROUP BY CAST(paid_at AS DATE)
"""))
def daily_sales(m):
    """Undensified daily sales."""
    return reports.daily_sales(m.orders_in(W30), W30)


RANKING_CTE = f"""
, g AS (
  SELECT o.product_id, max(p.name) AS product_name, max(p.category) AS category, max(p.price) AS price,
         sum(o.gmv) AS s, count(*) AS n, sum(o.quantity) AS u
  FROM std_orders o JOIN std_products p ON o.product_id = p.product_id AND o.platform = p.platform
  WHERE o.{IN365} GROUP BY o.product_id
), rank_ AS (
  SELECT product_id, product_name, category, CAST(round(coalesce(price, 0), 2) AS DOUBLE) AS price,
         CAST(round(s, 2) AS DOUBLE) AS total_sales, CAST(n AS BIGINT) AS total_orders, CAST(u AS BIGINT) AS total_units,
         round(CAST(s AS DOUBLE) / greatest(n, 1), 2) AS avg_order_value, s AS s_
  FROM g ORDER BY s DESC, product_id LIMIT 10
)"""


@register("product_ranking", with_std(RANKING_CTE + """
SELECT * EXCLUDE (s_) FROM rank_
""", products=True))
def product_ranking(m):
    """A17 + J3: product sales ranking (top 10)."""
    return reports.product_ranking(m.orders_in(W365), m.products, W365, 10)


@register("red_black_products", with_std(RANKING_CTE + """
, r AS (SELECT * EXCLUDE (s_), row_number() OVER (ORDER BY total_sales DESC, product_id) AS pos,
               row_number() OVER (ORDER BY total_sales ASC, product_id DESC) AS rev FROM rank_)
SELECT *, 'red' AS list FROM r WHERE pos <= 5
UNION ALL SELECT *, 'black' AS list FROM r WHERE rev <= 3
""", products=True))
def red_black_products(m):
    """A23 + L8: product red list (first 5) and black list (last 3)."""
    return reports.red_black_products(reports.product_ranking(m.orders_in(W365), m.products, W365, 10))


PERF_CTE = f"""
, perf AS (
  SELECT i.creator_id AS influencer_id, i.name AS influencer_name,
         CAST(coalesce(i.followers, 0) AS BIGINT) AS follower_count,
         round(coalesce(i.engagement_rate, 0), 4) AS engagement_rate,
         round(coalesce(i.conversion_rate, 0), 4) AS conversion_rate,
         round(coalesce(i.roi, 0), 2) AS roi, coalesce(i.is_suspicious, false) AS is_suspicious,
         CAST(round(coalesce(sum(o.gmv), 0), 2) AS DOUBLE) AS total_sales,
         CAST(count(o.order_id) AS BIGINT) AS total_orders, sum(o.gmv) AS s_
  FROM std_influencers i LEFT JOIN std_orders o ON i.creator_id = o.creator_id
  WHERE (o.{IN365}) OR o.order_id IS NULL
  GROUP BY i.creator_id, i.name, i.followers, i.engagement_rate, i.conversion_rate, i.roi, i.is_suspicious
  ORDER BY s_ DESC NULLS LAST, i.creator_id LIMIT 10
)"""


@register("influencer_performance", with_std(PERF_CTE + """
SELECT * EXCLUDE (s_) FROM perf
""", influencers=True))
def influencer_performance(m):
    """A18 + J4: influencer ranking with left-join post-filter semantics."""
    return inf.influencer_performance(m.orders_in(W365), m.influencers, W365, 10, ever="orders")


@register("influencer_red_list", with_std(PERF_CTE + """
SELECT * EXCLUDE (s_) FROM perf WHERE NOT is_suspicious AND total_sales > 0
ORDER BY total_sales DESC, influencer_id LIMIT 5
""", influencers=True))
def influencer_red_list(m):
    """non-suspicious influencers with sales, first 5."""
    return inf.red_list(inf.influencer_performance(m.orders_in(W365), m.influencers, W365, 10, ever="orders"))


@register("suspicious_top", with_std("""
SELECT creator_id AS influencer_id, name AS influencer_name, CAST(coalesce(followers, 0) AS BIGINT) AS follower_count,
       coalesce(engagement_rate, 0) AS engagement_rate, coalesce(conversion_rate, 0) AS conversion_rate,
       '互动多而成交极少' AS risk_reason
FROM std_influencers
WHERE coalesce(is_suspicious, false)
   OR (coalesce(engagement_rate, 0) >= 20.0 AND conversion_rate IS NOT NULL AND conversion_rate < 0.5)
ORDER BY engagement_rate DESC NULLS LAST, creator_id LIMIT 5
""", influencers=True))
def suspicious_top(m):
    """A20 + F9: top-5 suspicious influencers."""
    return inf.suspicious_top(m.influencers, 5)


@register("trend_class", with_std(f"""
, d AS (SELECT CAST(round(sum(gmv), 2) AS DOUBLE) AS g FROM std_orders WHERE {IN30} GROUP BY CAST(paid_at AS DATE)),
s AS (SELECT count(*) AS days, avg(g) AS a, max(g) AS mx, min(g) AS mn FROM d)
SELECT days, round(coalesce(a, 0), 2) AS avg_gmv, coalesce(mx, 0) AS max_gmv, coalesce(mn, 0) AS min_gmv,
       CASE WHEN days < 3 THEN 'insufficient' WHEN mx > a * 1.2 THEN 'volatile'
            WHEN mn < a * 0.8 THEN 'dip' ELSE 'stable' END AS trend
FROM s
"""))
def trend_class(m):
    """Trend class of the daily gmv series."""
    return reports.trend_class(reports.daily_sales(m.orders_in(W30), W30))


def _site_lines() -> str:
    from shoplens.plans.queries_core import SITE_SQL
    return SITE_SQL


@register("fallback_report", with_std(RANKING_CTE + PERF_CTE + f"""
, tot AS (
  SELECT CAST(round(coalesce(sum(gmv), 0), 2) AS DOUBLE) AS gmv, CAST(count(*) AS BIGINT) AS orders,
         coalesce(round(CAST(sum(gmv) AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE), 0), 2), 0) AS aov
  FROM std_orders WHERE {IN365}
), d AS (SELECT CAST(round(sum(gmv), 2) AS DOUBLE) AS v FROM std_orders WHERE {IN365} GROUP BY CAST(paid_at AS DATE)),
s0 AS (SELECT count(*) AS days, avg(v) AS a, max(v) AS mx, min(v) AS mn FROM d),
tr AS (SELECT CASE WHEN days < 3 THEN 'insufficient' WHEN mx > a * 1.2 THEN 'volatile' WHEN mn < a * 0.8 THEN 'dip' ELSE 'stable' END AS trend,
              round(coalesce(a, 0), 2) AS a, coalesce(mx, 0) AS mx, coalesce(mn, 0) AS mn FROM s0),
pr AS (SELECT product_id, product_name, total_sales, row_number() OVER (ORDER BY total_sales DESC, product_id) AS pos,
              row_number() OVER (ORDER BY total_sales ASC, product_id DESC) AS rev FROM rank_),
ri AS (SELECT *, row_number() OVER (ORDER BY total_sales DESC, influencer_id) AS pos FROM perf WHERE NOT is_suspicious AND total_sales > 0),
bi AS (SELECT creator_id, row_number() OVER (ORDER BY engagement_rate DESC NULLS LAST, creator_id) AS pos FROM std_influencers
       WHERE coalesce(is_suspicious, false)
          OR (coalesce(engagement_rate, 0) >= 20.0 AND conversion_rate IS NOT NULL AND conversion_rate < 0.5)),
n AS (SELECT (SELECT count(*) FROM bi WHERE pos <= 5) AS black)
SELECT 'weekly' AS report_type, '{W365.label_start} ~ {W365.label_end}' AS period, gmv AS total_gmv, orders AS total_orders, aov AS avg_order_value,
       coalesce((SELECT string_agg(product_id, ',' ORDER BY pos) FROM pr WHERE pos <= 5), '') AS product_red_list,
       coalesce((SELECT string_agg(product_id, ',' ORDER BY pos) FROM pr WHERE rev <= 3), '') AS product_black_list,
       coalesce((SELECT string_agg(influencer_id, ',' ORDER BY pos) FROM ri WHERE pos <= 5), '') AS influencer_red_list,
       coalesce((SELECT string_agg(creator_id, ',' ORDER BY pos) FROM bi WHERE pos <= 5), '') AS influencer_black_list,
       coalesce((SELECT string_agg(site_code || '/' || currency, ',' ORDER BY total_gmv DESC, site_code, currency) FROM ({_site_lines()}) sites), '') AS site_breakdown,
       trend,
       CASE trend WHEN 'volatile' THEN printf('日销售额起伏较大：最高一天 %.2f，日均 %.2f。', mx, a)
                  WHEN 'dip' THEN printf('最低一天仅 %.2f，明显少于日均 %.2f。', mn, a)
                  WHEN 'stable' THEN printf('每日销售额基本持平，日均 %.2f。', a) ELSE '' END AS trend_analysis,
       CASE WHEN black > 0 THEN printf('有 %d 位达人互动多而成交极少，需要核查。', black) ELSE '' END AS anomaly_analysis,
       concat_ws(chr(10), (SELECT '优先投放销售榜首商品「' || product_name || '」。' FROM pr WHERE pos = 1),
                 (SELECT '与销售领先的达人「' || influencer_name || '」延长合作。' FROM ri WHERE pos = 1),
                 CASE WHEN black > 0 THEN '待核查的达人暂不签新单。' END, '按站点跟踪销售变化，据此调配预算。') AS action_suggestions
FROM tot, tr, n
""", products=True, influencers=True))
def fallback_report(m):
    """The structured report row, its lists as text in list order."""
    r = reports.fallback_report(m.orders_in(W365), m.products, m.influencers, W365, "weekly", ever="orders")
    names = lambda c, *f: F.array_join(F.transform(c, lambda x: F.concat_ws("/", *[x[k] for k in f])), ",").alias(c)
    return r.select(
        "report_type", "period", "core_summary.*", names("product_red_list", "product_id"), names("product_black_list", "product_id"),
        names("influencer_red_list", "influencer_id"), names("influencer_black_list", "influencer_id"),
        names("site_breakdown", "site_code", "currency"), "trend", "trend_analysis", "anomaly_analysis",
        F.array_join("action_suggestions", "\n").alias("action_suggestions"))


@register("daily_digest", with_std(f"""
, tot AS (
  SELECT CAST(round(coalesce(sum(gmv), 0), 2) AS DOUBLE) AS gmv, CAST(count(*) AS BIGINT) AS orders,
         coalesce(round(CAST(sum(gmv) AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE), 0), 2), 0) AS aov
  FROM std_orders WHERE {IN30}
), top3 AS (
  SELECT product_name AS product, CAST(round(sum(gmv), 2) AS DOUBLE) AS g
  FROM std_orders WHERE {IN30} GROUP BY product_name ORDER BY sum(gmv) DESC, product_name LIMIT 3
), tt AS (
  SELECT string_agg(product || ' ¥' || format('{{:,.2f}}', g), chr(10) ORDER BY g DESC, product) AS t FROM top3
), sus AS (
  SELECT * FROM std_influencers
  WHERE coalesce(is_suspicious, false)
     OR (coalesce(engagement_rate, 0) >= 20.0 AND conversion_rate IS NOT NULL AND conversion_rate < 0.5)
), warn AS (SELECT * FROM sus),
wt AS (
  SELECT string_agg('🚨 ' || name || ' 互动率 ' || format('{{:,.1f}}', engagement_rate) || '% 转化率 '
                    || format('{{:,.2f}}', conversion_rate) || '%', chr(10) ORDER BY engagement_rate DESC, creator_id) AS w
  FROM warn
)
SELECT '每日经营日报 {W30.label_end}' AS title,
       CASE WHEN (SELECT count(*) FROM sus) > 0 THEN 'red' ELSE 'blue' END AS header_template,
       concat_ws(chr(10), 'GMV: ¥' || format('{{:,.2f}}', gmv), printf('订单数: %d', orders),
                 '客单价: ¥' || format('{{:,.2f}}', aov)) AS kpi_text,
       coalesce((SELECT t FROM tt), '') AS top_products_text,
       CAST((SELECT count(*) FROM sus) AS BIGINT) AS suspicious_count,
       coalesce((SELECT w FROM wt), '') AS warnings_text,
       '' AS summary
FROM tot
""", influencers=True))
def daily_digest(m):
    """Daily digest card (totals, top 3, suspicious warnings) as card text."""
    return reports.daily_digest(m.orders_in(W30), m.influencers, W30, W30.label_end)


# ---------------------------------------------------------------- influencer cards
CARDS_CTE = """
, cards AS (
  SELECT coalesce(creator_id, name) AS influencer_id, name, platform, CAST(followers AS BIGINT) AS followers,
         nullif(engagement_rate, 0) AS engagement_rate, nullif(conversion_rate, 0) AS conversion_rate,
         nullif(roi, 0) AS roi, coalesce(is_suspicious, false) AS is_suspicious, category AS niche
  FROM std_influencers
)"""


@register("influencer_summary", with_std(CARDS_CTE + """
SELECT count(*) AS total, CAST(coalesce(sum(coalesce(followers, 0)), 0) AS BIGINT) AS total_followers,
       coalesce(round(avg(roi), 2), 0) AS avg_roi, count(*) FILTER (WHERE is_suspicious) AS suspicious
FROM cards
""", influencers=True))
def influencer_summary(m):
    """Card summary."""
    return inf.card_summary(inf.cards(m.influencers))


@register("platform_mix", with_std(CARDS_CTE + """
SELECT coalesce(platform, '未知') AS platform, count(*) AS count FROM cards GROUP BY 1
""", influencers=True))
def platform_mix(m):
    """Platform distribution."""
    return inf.platform_mix(inf.cards(m.influencers))


@register("roi_buckets", with_std(CARDS_CTE + """
, b AS (
  SELECT CASE WHEN roi < 1 THEN '0-1' WHEN roi >= 1 AND roi < 3 THEN '1-3' WHEN roi >= 3 AND roi < 5 THEN '3-5'
              WHEN roi >= 5 THEN '5+' END AS range, count(*) AS n
  FROM cards WHERE roi IS NOT NULL GROUP BY 1
)
SELECT names.idx, names.range, CAST(coalesce(n, 0) AS BIGINT) AS count
FROM (VALUES (0, '0-1'), (1, '1-3'), (2, '3-5'), (3, '5+')) AS names(idx, range) LEFT JOIN b USING (range)
""", influencers=True))
def roi_buckets(m):
    """Roi buckets, all four present."""
    return inf.roi_buckets(inf.cards(m.influencers))


@register("top_followers", with_std(CARDS_CTE + """
SELECT influencer_id, name, platform, CAST(coalesce(followers, 0) AS BIGINT) AS followers
FROM cards ORDER BY coalesce(followers, 0) DESC, influencer_id LIMIT 10
""", influencers=True))
def top_followers(m):
    """Top 10 by followers."""
    return inf.top_followers(inf.cards(m.influencers))


@register("period_report", with_std(CARDS_CTE + f"""
, summ AS (
  SELECT count(*) AS total, CAST(coalesce(sum(coalesce(followers, 0)), 0) AS BIGINT) AS total_followers,
         coalesce(round(avg(roi), 2), 0) AS avg_roi, count(*) FILTER (WHERE is_suspicious) AS suspicious
  FROM cards
), pl AS (
  SELECT string_agg(printf('- %s: %d', platform, cnt), chr(10) ORDER BY cnt DESC, platform) AS pl
  FROM (SELECT coalesce(platform, '未知') AS platform, count(*) AS cnt FROM cards GROUP BY 1)
), b AS (
  SELECT CASE WHEN roi < 1 THEN '0-1' WHEN roi >= 1 AND roi < 3 THEN '1-3' WHEN roi >= 3 AND roi < 5 THEN '3-5'
              WHEN roi >= 5 THEN '5+' END AS range, count(*) AS n
  FROM cards WHERE roi IS NOT NULL GROUP BY 1
), bk AS (
  SELECT string_agg(printf('- ROI %s: %d', names.range, coalesce(n, 0)), chr(10) ORDER BY names.idx) AS bk
  FROM (VALUES (0, '0-1'), (1, '1-3'), (2, '3-5'), (3, '5+')) AS names(idx, range) LEFT JOIN b USING (range)
)
SELECT '{W30.label_start} ~ {W30.label_end}' AS period,
       concat_ws(chr(10), '# 达人周期报告 {W30.label_start} ~ {W30.label_end}', printf('达人总数: %d', total),
                 '粉丝总量: ' || format('{{:,}}', total_followers), printf('平均ROI: %.2f', avg_roi),
                 printf('疑似水军: %d', suspicious), '## 平台分布', pl, '## ROI 分布', bk) AS markdown
FROM summ, pl, bk
""", influencers=True))
def period_report(m):
    """Markdown period report over the card aggregates."""
    c = inf.cards(m.influencers)
    return reports.period_report(inf.card_summary(c), inf.platform_mix(c), inf.roi_buckets(c),
                                 W30.label_start, W30.label_end)


@register("influencer_stats", with_std("""
SELECT count(*) AS total,
       coalesce(round(CAST(count(*) FILTER (WHERE coalesce(is_suspicious, false)) * 100.0 AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE), 0), 1), 0) AS suspicious_rate,
       round(avg(CASE WHEN engagement_rate > 0 THEN engagement_rate END), 1) AS avg_engagement,
       round(avg(CASE WHEN conversion_rate > 0 THEN conversion_rate END), 1) AS avg_conversion
FROM std_influencers
""", influencers=True))
def influencer_stats(m):
    """T10 + F21: suspicious rate and positive-only means."""
    return inf.influencer_stats(m.influencers)


@register("creator_rollup", with_std("""
, roll AS (SELECT creator_id, sum(CASE WHEN status <> 'refunded' THEN gmv ELSE 0 END) AS g, count(*) AS n
           FROM std_orders WHERE creator_id IS NOT NULL GROUP BY creator_id)
SELECT i.creator_id, i.name, CAST(round(coalesce(g, 0), 2) AS DOUBLE) AS gmv, CAST(coalesce(n, 0) AS BIGINT) AS orders,
       CAST(round(i.cost, 2) AS DOUBLE) AS cost,
       CASE WHEN i.cost > 0 THEN round(CAST(coalesce(g, 0) AS DOUBLE) / CAST(i.cost AS DOUBLE), 2) END AS roi
FROM std_influencers i LEFT JOIN roll USING (creator_id)
""", influencers=True))
def creator_rollup(m):
    """Influencer gmv / orders / roi roll-up from attributed orders."""
    return inf.creator_rollup(m.orders, m.influencers)


def _requests(m):
    c = m.raw("customer")
    return c.select(F.col("c_custkey").alias("record_id"),
                    F.concat(F.lit("KOL"), F.lpad((F.col("c_custkey") / 5).cast("bigint").cast("string"), 5, "0")).alias("influencer_name"),
                    F.floor(F.abs(F.col("c_acctbal")) * 100).alias("followers"))


@register("match_scores", with_std("""
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
)
SELECT *, CASE WHEN ai_match_score >= 80 THEN 'high' WHEN ai_match_score >= 60 THEN 'medium' ELSE 'low' END AS band FROM s
""", influencers=True))
def match_scores(m):
    """A34 + T16: rule-based match score per request."""
    return inf.match_scores(_requests(m), m.influencers)


# ---------------------------------------------------------------- data quality
@register("row_counts", with_std("""
SELECT 'orders' AS "table", CAST(count(*) AS BIGINT) AS rows FROM std_orders
UNION ALL SELECT 'products', count(*) FROM std_products
UNION ALL SELECT 'influencers', count(*) FROM std_influencers
UNION ALL SELECT 'suspicious_influencers', count(*) FILTER (WHERE coalesce(is_suspicious, false)) FROM std_influencers
""", products=True, influencers=True))
def row_counts(m):
    """Table row counts."""
    return quality.row_counts(m.orders, m.products, m.influencers)


def _tz_sql():
    import datetime as dt
    sh = dt.timedelta(hours=8)
    a0, a1, b0, b1 = W30.start, W30.end, W30.start - sh, W30.end - sh
    ina = f"paid_at >= {ts(a0)} AND paid_at < {ts(a1)}"
    inb = f"paid_at >= {ts(b0)} AND paid_at < {ts(b1)}"
    parts = []
    for k, exprs in (("orders", ("count(*) FILTER (WHERE {c})",)),
                     ("units", ("coalesce(sum(CASE WHEN {c} THEN quantity END), 0)",)),
                     ("gmv_valid", ("coalesce(sum(CASE WHEN {c} AND status <> 'refunded' THEN gmv END), 0)",)),
                     ("gmv_all", ("coalesce(sum(CASE WHEN {c} THEN gmv END), 0)",))):
        e = exprs[0]
        parts.append(f"SELECT '{k}' AS metric, CAST({e.format(c=ina)} AS DOUBLE) AS u, CAST({e.format(c=inb)} AS DOUBLE) AS l FROM std_orders")
    return with_std("\n, x AS (" + "\nUNION ALL ".join(parts) + """)
SELECT metric, round(u, 2) AS utc, round(l, 2) AS local, round(l - u, 2) AS diff,
       round((l - u) * 100 / nullif(u, 0), 2) AS diff_pct FROM x
""")


@register("window_timezone_diff", _tz_sql())
def window_timezone_diff(m):
    """A25 + J9: UTC vs UTC+8 window reconciliation in one pass."""
    return quality.window_timezone_diff(m.orders_between(W30.start - dt.timedelta(hours=8), W30.end), W30)


@register("id_compliance", with_std("""
SELECT 'order_id_format' AS "check", CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE regexp_matches(order_id, '^5[78].{16}$')) AS BIGINT) AS compliant,
       coalesce(round(CAST(count(*) FILTER (WHERE regexp_matches(order_id, '^5[78].{16}$')) * 100.0 AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE), 0), 2), 0) AS pct
FROM std_orders WHERE platform = 'tiktok'
UNION ALL
SELECT 'product_id_length' AS "check", CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE length(product_id) = 17) AS BIGINT) AS compliant,
       coalesce(round(CAST(count(*) FILTER (WHERE length(product_id) = 17) * 100.0 AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE), 0), 2), 0) AS pct
FROM std_products WHERE platform = 'tiktok'
UNION ALL
SELECT 'order_product_id_length' AS "check", CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE length(product_id) = 17) AS BIGINT) AS compliant,
       coalesce(round(CAST(count(*) FILTER (WHERE length(product_id) = 17) * 100.0 AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE), 0), 2), 0) AS pct
FROM std_orders WHERE platform = 'tiktok' AND product_id IS NOT NULL
""", products=True))
def id_compliance(m):
    """A26 + F18: id format compliance."""
    return quality.id_compliance(m.orders, m.products)


@register("update_month_hist", with_std("""
SELECT strftime(update_time, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS rows,
       strftime(max(max(update_time)) OVER (), '%Y-%m-%d %H:%M:%S') AS latest
FROM std_orders WHERE update_time IS NOT NULL GROUP BY 1
"""))
def update_month_hist(m):
    """Update-time month histogram and latest update."""
    return quality.update_month_hist(m.orders)


@register("head_concentration", with_std("""
, per AS (SELECT product_id, sum(CASE WHEN status <> 'refunded' THEN gmv ELSE 0 END) AS g FROM std_orders GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY g DESC, product_id) AS rk, count(*) OVER () AS n, sum(g) OVER () AS tot FROM per)
SELECT CAST(max(n) AS BIGINT) AS keys, CAST(count(*) AS BIGINT) AS head_keys, CAST(round(sum(g), 2) AS DOUBLE) AS head_gmv,
       CAST(round(max(tot), 2) AS DOUBLE) AS total_gmv,
       round(CAST(sum(g) * 100 AS DOUBLE) / CAST(max(tot) AS DOUBLE), 2) AS head_share_pct
FROM r WHERE rk <= greatest(1, floor(n * 0.2))
"""))
def head_concentration(m):
    """A28 + W6: gmv share of the top 20 % of products (distributed global rank)."""
    return quality.head_concentration(m.orders)


# ---------------------------------------------------------------- browser-side series
@register("iso_week_gmv", with_std(f"""
, cal AS (SELECT CAST(unnest(generate_series(DATE '{W365.start.date()}', DATE '{W365.end.date()}' - 1, INTERVAL 1 DAY)) AS DATE) AS day),
daily AS (SELECT CAST(paid_at AS DATE) AS day, sum(CASE WHEN status <> 'refunded' THEN gmv ELSE 0 END) AS gmv, count(*) AS n
          FROM std_orders WHERE {IN365} GROUP BY 1),
d AS (SELECT cal.day, coalesce(gmv, 0) AS gmv, coalesce(n, 0) AS n FROM cal LEFT JOIN daily USING (day))
SELECT printf('%04d-W%02d', isoyear(day), week(day)) AS week, CAST(round(sum(gmv), 2) AS DOUBLE) AS gmv,
       CAST(sum(n) AS BIGINT) AS orders, count(*) AS days
FROM d GROUP BY 1
"""))
def iso_week_gmv(m):
    """ISO-week roll-up of the densified daily series."""
    return kpi.iso_week_gmv(m.orders_in(W365), W365)


@register("hourly_events", """
, h AS (SELECT hour(ts) AS hour, sum(CAST(value AS DECIMAL(14,2))) AS v, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1),
f AS (SELECT hrs.hour, round(CAST(coalesce(v, 0) AS DOUBLE), 2) AS value, CAST(coalesce(n, 0) AS BIGINT) AS events
      FROM (SELECT CAST(range AS INTEGER) AS hour FROM range(24)) hrs LEFT JOIN h USING (hour))
SELECT *, row_number() OVER (ORDER BY value DESC, hour) = 1 AS is_peak FROM f
""".replace(", h AS", "WITH h AS", 1))
def hourly_events(m):
    """24-hour distribution of event value, zero-filled, with peak hour."""
    ev = m.raw("events").select("ts", F.col("value").cast("decimal(14,2)").alias("value"))
    return kpi.hourly_gmv(ev, "ts", "value")


@register("weekday_gmv", with_std(f"""
, cal AS (SELECT CAST(unnest(generate_series(DATE '{W365.start.date()}', DATE '{W365.end.date()}' - 1, INTERVAL 1 DAY)) AS DATE) AS day),
daily AS (SELECT CAST(paid_at AS DATE) AS day, sum(CASE WHEN status <> 'refunded' THEN gmv ELSE 0 END) AS gmv
          FROM std_orders WHERE {IN365} GROUP BY 1),
d AS (SELECT cal.day, coalesce(gmv, 0) AS gmv FROM cal LEFT JOIN daily USING (day)),
g AS (SELECT dayofweek(day) AS weekday, count(*) AS days, sum(gmv) AS s FROM d GROUP BY 1),
g2 AS (SELECT weekday, days, CAST(round(s, 2) AS DOUBLE) AS gmv, round(CAST(s AS DOUBLE) / days, 2) AS avg_gmv FROM g)
SELECT weekday, days, gmv, avg_gmv,
       row_number() OVER (ORDER BY avg_gmv DESC, weekday) = 1 AS is_best,
       (row_number() OVER (ORDER BY CASE WHEN avg_gmv > 0 THEN avg_gmv END ASC NULLS LAST, weekday) = 1 AND avg_gmv > 0) AS is_worst,
       round(avg(avg_gmv) OVER (), 2) AS mean_of_means
FROM g2
"""))
def weekday_gmv(m):
    """Weekday distribution over the densified series."""
    return kpi.weekday_gmv(m.orders_in(W365), W365)


@register("sparkline", with_std(f"""
, cal AS (SELECT CAST(unnest(generate_series(DATE '{W30.start.date()}', DATE '{W30.end.date()}' - 1, INTERVAL 1 DAY)) AS DATE) AS day),
daily AS (SELECT CAST(paid_at AS DATE) AS day, sum(CASE WHEN status <> 'refunded' THEN gmv ELSE 0 END) AS gmv
          FROM std_orders WHERE {IN30} GROUP BY 1)
SELECT strftime(cal.day, '%Y-%m-%d') AS date, CAST(round(coalesce(gmv, 0), 2) AS DOUBLE) AS gmv
FROM cal LEFT JOIN daily USING (day) ORDER BY cal.day DESC LIMIT 14
"""))
def sparkline(m):
    """T4: last 14 points of the daily series."""
    return kpi.sparkline(m.orders_in(W30), W30, 14)


# ---------------------------------------------------------------- multi-period series / roi top
@register("kpi_periods", with_std(f"""
, p AS (
  SELECT CAST(floor((epoch(TIMESTAMP '{W30.end.strftime('%Y-%m-%d %H:%M:%S')}') - epoch(paid_at)) / (30 * 86400)) AS INTEGER) AS period,
         sum(CASE WHEN status <> 'refunded' THEN gmv ELSE 0 END) AS g, count(*) AS n,
         count(*) FILTER (WHERE status = 'refunded') AS r
  FROM std_orders
  WHERE paid_at >= TIMESTAMP '{W30.end.strftime('%Y-%m-%d %H:%M:%S')}' - INTERVAL 180 DAY
    AND paid_at < TIMESTAMP '{W30.end.strftime('%Y-%m-%d %H:%M:%S')}'
  GROUP BY 1
), f AS (
  SELECT a.period, coalesce(p.g, 0) AS g, CAST(coalesce(p.n, 0) AS BIGINT) AS orders, CAST(coalesce(p.r, 0) AS BIGINT) AS refunds
  FROM (SELECT CAST(range AS INTEGER) AS period FROM range(6)) a LEFT JOIN p USING (period)
)
SELECT period, strftime(TIMESTAMP '{W30.end.strftime('%Y-%m-%d %H:%M:%S')}' - to_days(30 * (period + 1)), '%Y-%m-%d') AS period_start,
       CAST(round(g, 2) AS DOUBLE) AS gmv, orders, refunds,
       CASE WHEN lag(CAST(g AS DOUBLE)) OVER w <> 0
            THEN round((CAST(g AS DOUBLE) - lag(CAST(g AS DOUBLE)) OVER w) / lag(CAST(g AS DOUBLE)) OVER w * 100, 1) END AS gmv_delta_pct
FROM f WINDOW w AS (ORDER BY period DESC)
"""))
def kpi_periods(m):
    """W7 + J10: six consecutive 30-day periods with period-over-period change."""
    lo = W30.end - dt.timedelta(days=180)
    return kpi.period_series(m.orders_between(lo, W30.end), "1998-06-30", 30, 6)


@register("top_roi", with_std("""
SELECT creator_id, name, round(coalesce(roi, 0), 2) AS roi, CAST(round(gmv, 2) AS DOUBLE) AS gmv
FROM std_influencers ORDER BY coalesce(roi, 0) DESC, creator_id LIMIT 3
""", influencers=True))
def top_roi(m):
    """Top 3 influencers by roi (null as 0)."""
    return inf.top_by_roi(m.influencers, 3)


@register("product_filter", with_std(f"""
, pre AS (
  SELECT product_name, product_id, platform,
         sum(CASE WHEN status <> 'refunded' THEN gmv ELSE 0 END) AS gmv,
         sum(CASE WHEN status <> 'refunded' THEN quantity ELSE 0 END) AS units
  FROM std_orders WHERE {IN365} GROUP BY 1, 2, 3
), stats AS (
  SELECT product_name AS product, sum(gmv) AS gmv, CAST(sum(units) AS BIGINT) AS units, max(category) AS category, max(price) AS price
  FROM pre LEFT JOIN std_products USING (product_id, platform) GROUP BY product_name
)
SELECT product, CAST(round(gmv, 2) AS DOUBLE) AS gmv, units
FROM stats
WHERE coalesce(category, '未分类') = 'STANDARD'
  AND coalesce(CAST(price AS DOUBLE), CAST(gmv AS DOUBLE) / nullif(CAST(units AS DOUBLE), 0), 0) >= 990
  AND coalesce(CAST(price AS DOUBLE), CAST(gmv AS DOUBLE) / nullif(CAST(units AS DOUBLE), 0), 0) < 1000
""", products=True))
def product_filter(m):
    """F13 + P14: products of one category inside a [990, 1000) price band."""
    from shoplens.operators import breakdowns
    s = breakdowns.priced_products(breakdowns.product_stats(m.orders_in(W365), m.products, W365))
    f = breakdowns.filter_products(s, "STANDARD", 990, 1000)
    return f.select("product", X.money_out("gmv").alias("gmv"), "units")
