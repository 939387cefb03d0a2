"""Registered queries of creator cards, the period report and the digest card
in full (S10, P11, K12, K13, X20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens.operators import cards, mappers, reports
from shoplens.plans import tools
from shoplens.plans.catalog import W30, W365, register, ts
from shoplens.plans.oracle import with_std
from shoplens.plans.queries_feeds import mapped_feed
from shoplens.plans.queries_reports import IN30, IN365

PREVIOUS365 = f"paid_at >= {ts(W365.prev_start)} AND paid_at < {ts(W365.prev_end)}"
GENERATED_AT = "1998-07-01 06:00:00"
PERIOD_START = "2024-01-10T00:00:00Z"
SUMMARY = "  " + "日报。" * 2500 + "\n"

REMOTE_CARDS = """
, feed AS (SELECT *, CAST(creator_id AS INTEGER) AS uid FROM std_influencers),
remote AS (
  SELECT creator_id AS influencer_id, name, platform, CAST(followers AS BIGINT) AS followers,
         nullif(engagement_rate, 0) AS engagement_rate, nullif(conversion_rate, 0) AS conversion_rate, nullif(roi, 0) AS roi,
         is_suspicious, category AS niche, '' AS avatar_url, CAST(0 AS BIGINT) AS avg_likes, CAST(0 AS BIGINT) AS avg_comments,
         CAST(0 AS BIGINT) AS total_posts,
         CASE uid % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN printf('2024-01-%02d 08:00:00', uid % 28 + 1)
                      ELSE printf('2024-01-%02dT08:00:00Z', uid % 28 + 1) END AS created_at,
         CASE WHEN is_suspicious THEN 'rejected' ELSE 'active' END AS status, uid
  FROM feed
)"""
LOCAL_CARDS = """
SELECT creator_id AS influencer_id, name, platform, CAST(followers AS BIGINT) AS followers, engagement_rate, conversion_rate, roi,
       is_suspicious, category AS niche, CAST(NULL AS VARCHAR) AS avatar_url, CAST(NULL AS BIGINT) AS avg_likes,
       CAST(NULL AS BIGINT) AS avg_comments, CAST(NULL AS BIGINT) AS total_posts, CAST(NULL AS VARCHAR) AS created_at,
       CAST(NULL AS VARCHAR) AS status, 'local' AS source, true AS configured, {error} AS error
FROM std_influencers
"""


@register("card_fallback", with_std(REMOTE_CARDS + """
SELECT * EXCLUDE (uid), 'remote' AS source, true AS configured, CAST(NULL AS VARCHAR) AS error FROM remote
""", influencers=True))
def card_fallback(m):
    """S10 + P11: the 15 card columns of the feed, which has rows."""
    return cards.load_cards(cards.feed_cards(mapped_feed(m)), cards.local_cards(m.influencers))


@register("card_fallback_empty", with_std(LOCAL_CARDS.format(error=f"'{cards.EMPTY_REMOTE}'"), influencers=True))
def card_fallback_empty(m):
    """A configured source without rows in the period: local cards, and an error that says so."""
    feed = mappers.created_between(mapped_feed(m), "2030-01-01T00:00:00Z", None)
    return cards.load_cards(cards.feed_cards(feed), cards.local_cards(m.influencers))


@register("card_fallback_failed", with_std(LOCAL_CARDS.format(error="'HTTP 503'"), influencers=True))
def card_fallback_failed(m):
    """A failed fetch: local cards with the reason."""
    return cards.load_cards(None, cards.local_cards(m.influencers), failure="HTTP 503")


@register("period_labels", """
WITH b AS (SELECT c_custkey, CAST(min(CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END) AS VARCHAR) AS s,
                  CAST(max(CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderdate AS DATE) END) AS VARCHAR) AS e
           FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
SELECT c_custkey, CASE WHEN s IS NOT NULL AND e IS NOT NULL THEN s || ' 至 ' || e WHEN s IS NOT NULL THEN s || ' 至今'
                       WHEN e IS NOT NULL THEN '截至 ' || e ELSE '全部数据' END AS label
FROM b
""")
def period_labels(m):
    """The four labels, over the order history of every customer (first
    finished order to last open one; either may be missing)."""
    day = F.col("o_orderdate").cast("date")
    # one row per customer before the join
    bounds = m.raw("orders").groupBy("o_custkey").agg(F.min(F.when(F.col("o_orderstatus") == "F", day)).alias("s"),
                                                      F.max(F.when(F.col("o_orderstatus") == "O", day)).alias("e"))
    c = m.raw("customer").select("c_custkey")
    return c.join(bounds, c.c_custkey == bounds.o_custkey, "left").select(
        "c_custkey", cards.period_label(F.col("s").cast("string"), F.col("e").cast("string")).alias("label"))


@register("period_report_full", with_std(REMOTE_CARDS + f"""
, cards AS (SELECT * FROM remote WHERE uid % 5 <> 0 AND uid % 28 + 1 >= 10),
summ AS (
  SELECT count(*) AS total, CAST(coalesce(sum(followers), 0) AS BIGINT) AS fans, coalesce(round(avg(roi), 2), 0) AS ar,
         count(*) FILTER (WHERE is_suspicious) AS sus FROM cards
), pl AS (
  SELECT coalesce(string_agg(printf('- %s: %d 人', platform, n), chr(10) ORDER BY n DESC, platform), '- 无数据') AS t
  FROM (SELECT platform, count(*) AS n FROM cards GROUP BY 1)
), tp AS (
  SELECT coalesce(string_agg('- ' || name || ' (' || platform || '): ' || followers || ' 粉丝', chr(10) ORDER BY followers DESC, influencer_id), '- 无数据') AS t
  FROM (SELECT * FROM cards ORDER BY followers DESC, influencer_id LIMIT 10)
), b AS (
  SELECT CASE WHEN roi < 1 THEN '0-1' WHEN roi < 3 THEN '1-3' WHEN roi < 5 THEN '3-5' ELSE '5+' END AS range, count(*) AS n
  FROM cards WHERE roi IS NOT NULL GROUP BY 1
), bk AS (
  SELECT string_agg(printf('| %s | %d |', r.range, coalesce(n, 0)), chr(10) ORDER BY r.idx) AS t
  FROM (VALUES (0, '0-1'), (1, '1-3'), (2, '3-5'), (3, '5+')) AS r(idx, range) LEFT JOIN b USING (range)
), side AS (SELECT CASE WHEN total > 0 THEN 'remote' ELSE 'local' END AS s FROM summ)
SELECT '2024-01-10 至今' AS period, s AS source, CAST(NULL AS VARCHAR) AS error, CAST(total AS BIGINT) AS total,
       '{GENERATED_AT}' AS generated_at,
       concat_ws(chr(10), '# 达人数据汇总', '周期: 2024-01-10 至今', '来源: ' || s, '生成: {GENERATED_AT}', '## 指标',
                 printf('- 达人: %d', total), '- 粉丝: ' || format('{{:,}}', fans), printf('- 平均 ROI: %.2f', ar),
                 printf('- 可疑达人: %d 人', sus), '## 平台', pl.t, '## 粉丝前十', tp.t, '## ROI 分布', '| 区间 | 达人数 |', '|---|---|', bk.t) AS markdown
FROM summ, pl, tp, bk, side
""", influencers=True))
def period_report_full(m):
    """K13 + X20: the report of a period open at its end, over the feed's cards."""
    feed = mappers.created_between(mapped_feed(m), PERIOD_START, None)
    shown = cards.load_cards(cards.feed_cards(feed), cards.local_cards(m.influencers))
    return cards.period_report(shown, PERIOD_START, None, GENERATED_AT)


@register("digest_card", with_std(f"""
, tot AS (
  SELECT CAST(round(coalesce(sum(gmv), 0), 2) AS DOUBLE) AS gmv, CAST(count(*) AS BIGINT) AS orders,
         coalesce(round(CAST(sum(gmv) AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE), 0), 2), 0) AS aov
  FROM std_orders WHERE {IN30}
), top3 AS (
  SELECT product_name AS product, CAST(round(sum(gmv), 2) AS DOUBLE) AS g, count(*) AS n,
         row_number() OVER (ORDER BY sum(gmv) DESC, product_name) AS i
  FROM std_orders WHERE {IN30} GROUP BY product_name QUALIFY i <= 3
), sus AS (
  SELECT CAST(count(*) AS BIGINT) AS n FROM std_influencers
  WHERE coalesce(is_suspicious, false)
     OR (coalesce(engagement_rate, 0) >= 20.0 AND conversion_rate IS NOT NULL AND conversion_rate < 0.5)
)
SELECT '经营日报 {W30.label_end}' AS title, CASE WHEN sus.n > 0 THEN 'red' ELSE 'blue' END AS header_template,
       concat_ws(chr(10), 'GMV ¥' || format('{{:,.2f}}', gmv), '订单 ' || format('{{:,}}', orders), '客单价 ¥' || format('{{:,.2f}}', aov)) AS kpi_text,
       coalesce((SELECT string_agg(i || '. ' || product || ' ¥' || format('{{:,.2f}}', g) || '（' || format('{{:,}}', n) || ' 单）',
                                   chr(10) ORDER BY i) FROM top3), '') AS top_products_text,
       sus.n AS suspicious_count, repeat('日报。', 2000) || '{reports.SUMMARY_CUT}' AS summary, '数据区间 {W30.label_end}' AS note
FROM tot, sus
""", influencers=True))
def digest_card(m):
    """The digest card with order counts, separators, cut summary and note."""
    return cards.digest_card(m.orders_in(W30), m.influencers, W30, W30.label_end, SUMMARY)


@register("digest_warnings", with_std("""
, sus AS (
  SELECT *, row_number() OVER (ORDER BY engagement_rate DESC NULLS LAST, creator_id) AS rank_no FROM std_influencers
  WHERE coalesce(is_suspicious, false)
     OR (coalesce(engagement_rate, 0) >= 20.0 AND conversion_rate IS NOT NULL AND conversion_rate < 0.5)
)
SELECT rank_no, creator_id,
       '🚨 ' || name || ' 互动率 ' || coalesce(format('{:,.1f}', engagement_rate), 'N/A') || '% 转化率 '
       || coalesce(format('{:,.2f}', conversion_rate), 'N/A') || '% ROI ' || coalesce(format('{:,.2f}', roi), 'N/A') AS line
FROM sus
""", influencers=True))
def digest_warnings(m):
    """The digest's warnings as ranked rows, roi included."""
    return cards.digest_warnings(m.influencers)


@register("report_growth", with_std(f"""
, t AS (SELECT count(*) FILTER (WHERE {IN365}) AS n, CAST(round(coalesce(sum(gmv) FILTER (WHERE {IN365}), 0), 2) AS DOUBLE) AS g,
               count(*) FILTER (WHERE {PREVIOUS365}) AS pn, CAST(round(coalesce(sum(gmv) FILTER (WHERE {PREVIOUS365}), 0), 2) AS DOUBLE) AS pg
        FROM std_orders)
SELECT 'yearly' AS report_type, g AS total_gmv, CAST(n AS BIGINT) AS total_orders, round(g / nullif(CAST(n AS DOUBLE), 0), 2) AS avg_order_value,
       round((g - pg) * 100 / nullif(pg, 0), 2) AS gmv_growth, round((n - pn) * CAST(100 AS DOUBLE) / nullif(pn, 0), 2) AS order_growth,
       '{GENERATED_AT}' AS generated_at
FROM t
"""))
def report_growth(m):
    """The core summary of the report with its growth over the year before."""
    r = reports.report_with_growth(m.orders_in(W365, previous=True), m.products, m.influencers, W365, "yearly", GENERATED_AT, ever="orders")
    return r.select("report_type", "core_summary.*", "generated_at")


# what an assistant asks for: (call, registry, tool, JSON arguments); the last four are refused
CALLS = [
    ("sales", "ai", "query_sales_data", '{"start_date": "1997-07-01", "end_date": "1998-06-30", "platform": "tiktok"}'),
    ("days", "report", "get_daily_sales_trend", '{"date_range": {"start": "1998-06-01", "end": "1998-06-30"}}'),
    ("ranking", "report", "get_product_sales_ranking", '{"date_range": {"start": "1997-07-01", "end": "1998-06-30"}, "limit": "7"}'),
    ("creators", "report", "get_influencer_performance", '{"date_range": {"start": "1997-07-01", "end": "1998-06-30"}, "limit": 5}'),
    ("unknown", "ai", "drop_table", "{}"),
    ("missing", "ai", "query_sales_data", '{"start_date": "1997-07-01"}'),
    ("surplus", "ai", "get_influencer_metrics", '{"sql": "1"}'),
    ("type", "report", "get_top_suspicious_influencers", '{"limit": "many"}'),
]
RESULTS = {"sales": ("gmv", None), "days": ("date", "daily_gmv"), "ranking": ("product_id", "total_sales"), "creators": ("influencer_id", "total_sales")}


@register("tool_calls", with_std(f"""
, days AS (SELECT strftime(paid_at, '%Y-%m-%d') AS k, CAST(round(sum(gmv), 2) AS DOUBLE) AS v FROM std_orders WHERE {IN30} GROUP BY 1),
ranking AS (
  SELECT o.product_id AS k, sum(o.gmv) AS v FROM std_orders o JOIN std_products p ON o.product_id = p.product_id AND o.platform = p.platform
  WHERE o.{IN365} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7
), creators AS (
  SELECT i.creator_id AS k, sum(o.gmv) AS v FROM std_influencers i LEFT JOIN std_orders o ON o.creator_id = i.creator_id
  WHERE o.{IN365} OR o.order_id IS NULL GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 5
)
SELECT 'sales' AS call, CAST(CAST(round(sum(gmv), 2) AS DOUBLE) AS DOUBLE) AS value, NULL AS key, false AS refused
FROM std_orders WHERE {IN365} AND platform = 'tiktok'
UNION ALL SELECT 'days', v, k, false FROM days
UNION ALL SELECT 'ranking', CAST(round(v, 2) AS DOUBLE), k, false FROM ranking
UNION ALL SELECT 'creators', CAST(round(coalesce(v, 0), 2) AS DOUBLE), k, false FROM creators
UNION ALL SELECT c, NULL, NULL, true FROM (VALUES ('unknown'), ('missing'), ('surplus'), ('type')) AS e(c)
""", products=True, influencers=True))
def tool_calls(m):
    """V1 + V2: what named tools answer to JSON arguments, refused calls included."""
    out = None
    for call, registry, tool, arguments in CALLS:
        got = tools.execute(m.spark, m.sf_dir, tool, arguments, tools.REPORT_TOOLS if registry == "report" else None)
        none = F.lit(None)
        if "error" in got.columns:
            key, value = none, none
        else:
            key, value = (none if call == "sales" else F.col(RESULTS[call][0])), F.col(RESULTS[call][0 if call == "sales" else 1])
        rows = got.select(F.lit(call).alias("call"), value.cast("double").alias("value"), key.cast("string").alias("key"),
                          F.lit("error" in got.columns).alias("refused"))
        out = rows if out is None else out.unionByName(rows)
    return out
