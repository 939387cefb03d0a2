"""DuckDB SQL that states, independently of Spark, what each registered query
must return.  The binding CTEs repeat ``shoplens.sources.tables`` in SQL.

Conventions shared with the Spark side: money is summed as DECIMAL and handed
out as DOUBLE rounded to 2; days and times are handed out as text.
"""

from __future__ import annotations

AS_OF = "1998-06-30"

# Binding CTEs: std_orders / std_products / std_influencers.
STD_ORDERS = """
lines AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn_
    FROM lineitem) WHERE rn_ = 1
),
std_orders AS (
  SELECT
    CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS order_id,
    CASE WHEN l_suppkey % 10 <> 0 THEN 'SHOP_' || CAST(l_suppkey % 10 AS VARCHAR) END AS shop_id,
    CASE o_orderkey % 3 WHEN 0 THEN 'tiktok' WHEN 1 THEN 'douyin' ELSE 'manual' END AS platform,
    CAST(l_partkey AS VARCHAR) AS product_id,
    p_name AS product_name,
    CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(14,2)) AS gmv,
    CAST(l_quantity AS INTEGER) AS quantity,
    CAST(o_custkey AS VARCHAR) AS customer_id,
    CASE WHEN o_custkey % 10 < 7 THEN CAST(o_custkey // 10 AS VARCHAR) END AS creator_id,
    CASE WHEN l_returnflag = 'R' THEN 'refunded' WHEN l_linestatus = 'F' THEN 'completed'
         WHEN o_orderstatus = 'P' THEN 'paid' ELSE 'shipped' END AS status,
    o_orderdate AS paid_at,
    CASE WHEN n_nationkey % 7 <> 0 THEN n_name END AS province,
    'SKU' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS sku_id,
    CASE r_name WHEN 'AMERICA' THEN 'USD' WHEN 'EUROPE' THEN 'EUR' WHEN 'ASIA' THEN 'CNY'
                WHEN 'MIDDLE EAST' THEN 'AED' END AS currency,
    r_name AS site_code,
    CAST(l_extendedprice AS DECIMAL(14,2)) AS original_price,
    (o_orderpriority = '1-URGENT' AND l_linenumber = 1) AS is_sample_order,
    (o_orderpriority = '5-LOW') AS is_cod,
    CASE WHEN s_nationkey % 5 <> 0 THEN s_name END AS shipping_provider,
    o_orderdate AS rts_time,
    CASE WHEN l_linestatus <> 'O' THEN o_orderdate + to_days(l_linenumber) END AS delivery_time,
    l_shipdate AS update_time
  FROM lines
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
)"""

STD_PRODUCTS = """
std_products AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id, pl.platform, p_name AS name, p_type AS category,
         CAST(p_retailprice AS DECIMAL(12,2)) AS price, CAST(0 AS DECIMAL(38,2)) AS total_gmv, CAST(0 AS BIGINT) AS total_sold
  FROM part CROSS JOIN (VALUES ('tiktok'), ('douyin')) AS pl(platform)
)"""

STD_INFLUENCERS = """
ev_users AS (
  SELECT user_id, count(*) AS n,
         count(*) FILTER (WHERE event_type IN ('view', 'click')) AS n_eng,
         count(*) FILTER (WHERE event_type = 'purchase') AS n_buy,
         sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(14,2)) END) AS cost
  FROM events GROUP BY user_id
),
inf_roll AS (
  SELECT creator_id, sum(CASE WHEN status <> 'refunded' THEN gmv ELSE 0 END) AS gmv, count(*) AS orders
  FROM std_orders WHERE creator_id IS NOT NULL GROUP BY creator_id
),
inf_base AS (
  SELECT CAST(user_id AS VARCHAR) AS creator_id,
         CASE user_id % 3 WHEN 0 THEN 'tiktok' WHEN 1 THEN 'douyin' ELSE 'manual' END AS platform,
         'KOL' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS name,
         CASE user_id % 5 WHEN 0 THEN 'beauty' WHEN 1 THEN 'fashion' WHEN 2 THEN 'digital'
                          WHEN 3 THEN 'home' ELSE 'food' END AS category,
         CAST(n * 1000 AS BIGINT) AS followers,
         CAST(coalesce(cost, 0) AS DECIMAL(14,2)) AS cost,
         round(n_eng * 100.0 / n, 4) AS engagement_rate,
         round(n_buy * 100.0 / n, 4) AS conversion_rate
  FROM ev_users
),
std_influencers AS (
  SELECT b.creator_id, b.platform, b.name, b.category, b.followers,
         CAST(coalesce(r.gmv, 0) AS DECIMAL(14,2)) AS gmv,
         CAST(coalesce(r.orders, 0) AS BIGINT) AS orders,
         b.cost,
         CASE WHEN b.cost > 0 THEN round(CAST(coalesce(r.gmv, 0) AS DOUBLE) / CAST(b.cost AS DOUBLE), 2) END AS roi,
         b.engagement_rate, b.conversion_rate,
         CAST(b.followers // 50 AS BIGINT) AS avg_views,
         (b.engagement_rate >= 45.0 AND b.conversion_rate < 15.0) AS is_suspicious
  FROM inf_base b LEFT JOIN inf_roll r ON b.creator_id = r.creator_id
)"""


def with_std(body: str, products: bool = False, influencers: bool = False) -> str:
    """Prefix a query body with the binding CTEs it needs."""
    ctes = [STD_ORDERS]
    if products:
        ctes.append(STD_PRODUCTS)
    if influencers:
        ctes.append(STD_INFLUENCERS)
    return "WITH " + ",".join(ctes) + "\n" + body
