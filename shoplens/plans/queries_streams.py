"""Registered streaming queries (phase 6).

Each query runs its Structured Streaming job with ``availableNow`` over the
driver tables (or feed pages landed from them) and returns the sink, read
back as a batch DataFrame.  Window and session jobs return open windows too,
told apart by ``is_closed`` (window end <= max event time - delay).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens.operators import mappers
from shoplens.operators import upsert as U
from shoplens.plans.catalog import register
from shoplens.plans.oracle import with_std
from shoplens.sources import feeds
from shoplens.sources.keyed_table import KeyedTable
from shoplens.sources.tables import ORDER_SOURCES, land_pages
from shoplens.sources.tables import landed as land
from shoplens.streaming import jobs

TS = "%Y-%m-%d %H:%M:%S"
DAILY_CTE = """
WITH wm AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events),
d AS (
  SELECT date_trunc('day', ts) AS s, count(*) AS events,
         count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
         count(*) FILTER (WHERE event_type = 'error') AS errors,
         sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(14,2)) END) AS pv
  FROM events GROUP BY 1
),
closed AS (
  SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(s + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
         CAST(events AS BIGINT) AS events, CAST(purchases AS BIGINT) AS purchases, CAST(errors AS BIGINT) AS errors,
         CAST(round(coalesce(pv, 0), 2) AS DOUBLE) AS purchase_value, s + INTERVAL 1 DAY <= wm.wm AS is_closed
  FROM d, wm
)"""


@register("stream_daily_kpi", DAILY_CTE + "\nSELECT * FROM closed")
def stream_daily_kpi(m):
    """R2s: tumbling daily event KPIs, watermark 1 h, update mode (open windows marked)."""
    return jobs.window_states(m.spark, m.sf_dir, "1 day", None, "1 hour")


@register("stream_sliding_kpi", """
WITH wm AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events),
x AS (SELECT e.*, date_trunc('day', e.ts) - to_days(CAST(r.i AS INTEGER)) AS s FROM events e, range(7) r(i)),
d AS (
  SELECT s, count(*) AS events, count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
         count(*) FILTER (WHERE event_type = 'error') AS errors,
         sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(14,2)) END) AS pv
  FROM x GROUP BY s
)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(s + INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
       CAST(events AS BIGINT) AS events, CAST(purchases AS BIGINT) AS purchases, CAST(errors AS BIGINT) AS errors,
       CAST(round(coalesce(pv, 0), 2) AS DOUBLE) AS purchase_value, s + INTERVAL 7 DAY <= wm.wm AS is_closed
FROM d, wm
""")
def stream_sliding_kpi(m):
    """R2s: 7-day windows sliding by 1 day, open ones marked."""
    return jobs.window_states(m.spark, m.sf_dir, "7 days", "1 day", "1 hour")


@register("stream_alerts", DAILY_CTE + """
SELECT window_start, is_closed, purchase_value, errors,
       round((purchase_value - lag(purchase_value) OVER w) * 100.0 / nullif(lag(purchase_value) OVER w, 0), 2) AS value_change_pct,
       coalesce((purchase_value - lag(purchase_value) OVER w) * 100.0 / nullif(lag(purchase_value) OVER w, 0) < -30.0, false) AS gmv_drop,
       coalesce((errors - lag(errors) OVER w) * 100.0 / nullif(CAST(lag(errors) OVER w AS DOUBLE), 0) > 50.0, false) AS error_surge
FROM closed WINDOW w AS (ORDER BY window_start)
""")
def stream_alerts(m):
    """R6s: day-over-day purchase-value drop and error-surge flags on the daily windows."""
    return jobs.alerts(jobs.window_states(m.spark, m.sf_dir, "1 day", None, "1 hour"))


@register("stream_dedup", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def stream_dedup(m):
    """R5s: repeated order-line deliveries suppressed within the watermark."""
    return jobs.dedup_stream(m.spark, m.sf_dir, ["l_orderkey", "l_linenumber"], "l_shipdate", "3650 days")


@register("stream_sessions", """
WITH wm AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events),
o AS (SELECT user_id, ts, event_type, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
g AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
                  OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM o),
s AS (SELECT user_id, sid, min(ts) AS st, max(ts) + INTERVAL 30 MINUTE AS en, count(*) AS events,
             count(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM g GROUP BY user_id, sid)
SELECT user_id, strftime(st, '%Y-%m-%d %H:%M:%S.%f') AS session_start, strftime(en, '%Y-%m-%d %H:%M:%S.%f') AS session_end,
       CAST(events AS BIGINT) AS events, CAST(purchases AS BIGINT) AS purchases, en <= wm.wm AS is_closed
FROM s, wm
""")
def stream_sessions(m):
    """R7s: 30-minute-gap user sessions, open ones marked."""
    return jobs.sessions(m.spark, m.sf_dir, "30 minutes", "1 hour")


# ---------------------------------------------------------------- landed feed streams
MAPPED_A = """
, mapped_a AS (
  SELECT order_id, product_name,
         CAST(CASE WHEN (CASE WHEN is_sample_order THEN 'paid' ELSE status END) = 'refunded' THEN 0
                   WHEN quantity % 5 = 0 THEN round(gmv * quantity, 2) ELSE gmv END AS DECIMAL(14,2)) AS gmv,
         quantity, CASE WHEN is_sample_order THEN 'paid' ELSE status END AS status, paid_at, update_time
  FROM std_orders WHERE platform = 'tiktok'
)"""


def _land(pages, path: str) -> None:
    """One delivery, one page per line, in files of a size: a stream takes a
    number of files per micro-batch, and what a batch costs besides its rows
    would otherwise be paid for every small file of the orders table."""
    land_pages(pages.hint("rebalance"), path, "append")


def _land_deliveries(m, name: str) -> str:
    """Land the platform A pages as two deliveries (orders paid before 1998,
    then the rest) into one landing folder."""
    def write(path):
        for df in platform_a_pages_split(m):
            _land(df, path)
    return land(m.spark, m.sf_dir, "deliveries-a", write, ORDER_SOURCES + ["pages"])


def _land_redeliveries(m) -> str:
    """The two deliveries, and a third one: older states of a part of the orders
    (another quantity, a day before), repeats of others, and orders without id."""
    def write(path):
        from shoplens.plans import queries_feeds as QF
        some = F.pmod(F.xxhash64("order_id"), F.lit(10))
        older = (m.orders.where(some < 2).withColumn("quantity", F.col("quantity") + 1)
                 .withColumn("update_time", F.col("update_time") - F.expr("INTERVAL 1 DAY")))
        nameless = m.orders.where(some == 3).withColumn("order_id", F.lit(""))
        again = QF.platform_a_pages(m, older.unionByName(m.orders.where(some.between(1, 2))).unionByName(nameless))
        for df in [*platform_a_pages_split(m), again]:
            _land(df, path)
    return land(m.spark, m.sf_dir, "redeliveries-a", write, ORDER_SOURCES + ["pages"])


def platform_a_pages_split(m):
    """Two deliveries: orders paid before 1998, then the rest."""
    from shoplens.plans import queries_feeds as QF
    cut = F.lit("1998-01-01").cast("timestamp")
    return [QF.platform_a_pages(m, m.orders.where(F.col("paid_at") < cut)),
            QF.platform_a_pages(m, m.orders.where(F.col("paid_at") >= cut))]


def _parse_a(batch):
    return mappers.map_platform_a_order(feeds.parse_pages(batch, "platform_a_orders"), shop_id="SHOP_A")


@register("stream_orders_upsert", with_std(MAPPED_A + f"""
SELECT order_id, product_name, CAST(gmv AS DOUBLE) AS gmv, quantity, status, strftime(paid_at, '{TS}') AS paid_at
FROM mapped_a
"""))
def stream_orders_upsert(m):
    """R1s: landed page deliveries -> micro-batch mapping -> upsert of the touched
    key buckets; the deliveries hold repeated, late (older) and replayed
    records and records without an id."""
    landing = _land_redeliveries(m)
    table = U.staging_path(m.spark, "orders-table")
    keys, order = ["order_id", "platform"], [F.col("update_time")]
    jobs.ingest_feed(m.spark, landing, table, _parse_a, keys, order, max_files=16, buckets=16)
    t = KeyedTable(m.spark, table, keys, order, 16).read()
    return t.select("order_id", "product_name", F.col("gmv").cast("double").alias("gmv"), "quantity", "status",
                    F.date_format("paid_at", "yyyy-MM-dd HH:mm:ss").alias("paid_at"))


@register("stream_top_products", with_std(MAPPED_A + f"""
, w AS (
  SELECT to_timestamp(floor(epoch(paid_at) / 2592000) * 2592000) AS ws, product_name, sum(gmv) AS v
  FROM mapped_a GROUP BY 1, 2
), r AS (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY v DESC, product_name) AS rank_no FROM w)
SELECT strftime(ws AT TIME ZONE 'UTC', '{TS}') AS window_start, product_name, CAST(round(v, 2) AS DOUBLE) AS gmv, rank_no
FROM r WHERE rank_no <= 3
"""))
def stream_top_products(m):
    """R3s: top-3 products per 30-day window of the order stream (sums added batch by batch)."""
    landing = _land_deliveries(m, "topk")
    rows = _parse_a(jobs.page_stream(m.spark, landing, max_files=16))
    t = jobs.top_per_window(m.spark, rows, "paid_at", "product_name", "gmv", "30 days", 3)
    return t.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "product_name",
                    F.round("v", 2).cast("double").alias("gmv"), F.col("rank_no").cast("bigint").alias("rank_no"))


@register("stream_latest_orders", with_std(MAPPED_A + f"""
SELECT order_id, strftime(paid_at, '{TS}') AS paid_at, CAST(gmv AS DOUBLE) AS gmv
FROM mapped_a ORDER BY paid_at DESC, order_id DESC LIMIT 20
"""))
def stream_latest_orders(m):
    """R4s: the 20 newest orders of the stream (top-N carried between batches)."""
    landing = _land_deliveries(m, "latest")
    rows = _parse_a(jobs.page_stream(m.spark, landing, max_files=16)).select("order_id", "paid_at", "gmv")
    t = jobs.latest_n(m.spark, rows, ["paid_at", "order_id"], 20)
    return t.select("order_id", F.date_format("paid_at", "yyyy-MM-dd HH:mm:ss").alias("paid_at"),
                    F.col("gmv").cast("double").alias("gmv"))


@register("stream_order_alerts", with_std(MAPPED_A + """
, d AS (
  SELECT strftime(date_trunc('day', paid_at), '%Y-%m-%d') AS day,
         CAST(sum(CASE WHEN status <> 'refunded' THEN gmv ELSE 0 END) AS DOUBLE) AS gmv,
         CAST(count(*) AS BIGINT) AS orders, CAST(count(*) FILTER (WHERE status = 'refunded') AS BIGINT) AS refunds
  FROM mapped_a WHERE paid_at IS NOT NULL GROUP BY 1
), r AS (SELECT *, refunds * 100.0 / orders AS rr FROM d)
SELECT day, round(gmv, 2) AS gmv, orders, refunds, round(rr, 2) AS refund_rate,
       coalesce((gmv - lag(gmv) OVER w) * 100.0 / nullif(lag(gmv) OVER w, 0) < -30.0, false) AS gmv_drop,
       coalesce(rr - lag(rr) OVER w > 10.0, false) AS refund_surge
FROM r WINDOW w AS (ORDER BY day)
"""))
def stream_order_alerts(m):
    """R6s: day-over-day gmv-drop and refund-rate-surge flags, emitted by the
    micro-batch that moves a day; the last state of every day."""
    landing = _land_deliveries(m, "alerts")
    rows = _parse_a(jobs.page_stream(m.spark, landing, max_files=16))
    return jobs.order_alert_stream(m.spark, rows)


@register("stream_dedup_batched", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def stream_dedup_batched(m):
    """R5s (batch-wise): repeated deliveries dropped with a map-side combine per
    micro-batch and a published table of seen keys (exactly-once on replay)."""
    table = U.staging_path(m.spark, "dedup-batched")
    s = jobs.event_stream(m.spark, m.sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return jobs.dedup_batched(m.spark, s, ["l_orderkey", "l_linenumber"], "l_shipdate", table).select(
        "l_orderkey", "l_linenumber")
