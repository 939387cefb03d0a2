"""Period KPIs and time series.

All inputs are standard-order DataFrames; all outputs are small aggregated
frames.  Current and previous periods come out of one scan with conditional
aggregates (the source system issues one query per period).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoplens.functions import exprs as X
from shoplens.functions.periods import Window


def _scope(orders: DataFrame, window: Window | None, shop_ids=None, both: bool = False) -> DataFrame:
    conds = [X.shop_filter(shop_ids)]
    if window is not None:
        conds.append(window.contains_both("paid_at") if both else window.contains("paid_at"))
    c = X.all_of(conds)
    return orders if c is None else orders.where(c)


def period_metrics(orders: DataFrame, window: Window, shop_ids=None) -> DataFrame:
    """A1 for the current and the previous window in one pass.

    gmv excludes refunded orders; orders counts all; aov = gmv / non-refunded
    orders (0 when none); refund_rate = refunds / orders * 100 (0 when none).
    One row with ``cur_*`` and ``prev_*`` columns.
    """
    o = _scope(orders, window, shop_ids, both=True)
    cur, prev = window.contains("paid_at"), window.contains_prev("paid_at")
    refunded = F.col("status") == "refunded"
    aggs = []
    for p, cond in (("cur", cur), ("prev", prev)):
        aggs += [
            X.sum0(F.when(cond & ~refunded, F.col("gmv"))).alias(f"{p}_gmv"),
            F.count_if(cond).alias(f"{p}_orders"),
            F.count_if(cond & refunded).alias(f"{p}_refunds"),
        ]
    m = o.agg(*aggs)
    cols = []
    for p in ("cur", "prev"):
        g, n, r = F.col(f"{p}_gmv"), F.col(f"{p}_orders"), F.col(f"{p}_refunds")
        cols += [
            g.cast("double").alias(f"{p}_gmv"),
            n.cast("double").alias(f"{p}_orders"),
            F.coalesce(X.ratio(g, n - r), F.lit(0.0)).alias(f"{p}_aov"),
            F.coalesce(X.ratio(r * 100, n), F.lit(0.0)).alias(f"{p}_refund_rate"),
        ]
    return m.select(*cols)


KPIS = [  # key, label, higher_is_better, format
    ("gmv", "GMV", True, "currency"),
    ("orders", "订单数", True, "int"),
    ("aov", "客单价", True, "currency"),
    ("refund_rate", "退款率", False, "percent"),
]


def delta_pct(cur, prev):
    """(cur - prev) / prev * 100, rounded to 1; null when prev is 0."""
    return F.when(prev != 0, F.round((cur - prev) / prev * 100, 1))


def kpi_overview(orders: DataFrame, window: Window, shop_ids=None) -> DataFrame:
    """A2: one row per KPI with value (r2), previous value, delta_pct (r1),
    higher_is_better, display format, period labels and the T15 verdict."""
    m = period_metrics(orders, window, shop_ids)
    rows = F.explode(F.array(*[
        F.struct(F.lit(k).alias("key"), F.lit(lbl).alias("label"),
                 F.col(f"cur_{k}").alias("cur"), F.col(f"prev_{k}").alias("prev"),
                 F.lit(hib).alias("higher_is_better"), F.lit(fmt).alias("format"))
        for k, lbl, hib, fmt in KPIS
    ])).alias("k")
    out = m.select(rows).select(
        "k.key", "k.label",
        F.round("k.cur", 2).alias("value"),
        F.round("k.prev", 2).alias("prev_value"),
        delta_pct(F.col("k.cur"), F.col("k.prev")).alias("delta_pct"),
        "k.higher_is_better", "k.format",
        F.lit(window.label_start).alias("period_start"),
        F.lit(window.label_end).alias("period_end"),
        F.lit(window.prev_label_start).alias("prev_period_start"),
        F.lit(window.prev_label_end).alias("prev_period_end"),
    )
    return out.withColumn("good", X.verdict("delta_pct", "higher_is_better"))


def data_range(orders: DataFrame, shop_ids=None) -> DataFrame:
    """A3 + T12: earliest / latest paid day, and whether any order exists."""
    o = _scope(orders, None, shop_ids).where(F.col("paid_at").isNotNull())
    return o.agg(F.min("paid_at").alias("a"), F.max("paid_at").alias("b")).select(
        X.day_str("a").alias("earliest"), X.day_str("b").alias("latest"),
        F.col("a").isNotNull().alias("has_data"))


def calendar(spark: SparkSession, start: dt.date, end_inclusive: dt.date) -> DataFrame:
    """One row per day ``[start, end_inclusive]``; size is the window length."""
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(start), F.lit(end_inclusive), F.expr("INTERVAL 1 DAY"))).alias("day"))


def gmv_trend(orders: DataFrame, window: Window, shop_ids=None) -> DataFrame:
    """A4: daily non-refunded GMV over the window, every day present."""
    spark = orders.sparkSession
    o = _scope(orders, window, shop_ids)
    daily = o.groupBy(F.to_date("paid_at").alias("day")).agg(X.sum0(X.valid_gmv()).alias("gmv"))
    cal = calendar(spark, window.start.date(), (window.end - dt.timedelta(days=1)).date())
    # ``daily`` holds at most one row per window day (days <= 3660): bounded.
    return (cal.join(F.broadcast(daily), "day", "left")
               .select(X.day_str("day").alias("date"),
                       X.money_out(F.coalesce("gmv", F.lit(0).cast("decimal(14,2)"))).alias("gmv"))
               .orderBy("date"))


def daily_series(orders: DataFrame, window: Window, shop_ids=None, densify: bool = True) -> DataFrame:
    """Daily gmv / orders / units (optionally gap-filled) as a ``day`` DATE frame."""
    spark = orders.sparkSession
    o = _scope(orders, window, shop_ids)
    daily = o.groupBy(F.to_date("paid_at").alias("day")).agg(
        X.sum0(X.valid_gmv()).alias("gmv"), F.count(F.lit(1)).alias("orders"),
        F.coalesce(F.sum("quantity"), F.lit(0)).cast("bigint").alias("units"))
    if not densify:
        return daily
    cal = calendar(spark, window.start.date(), (window.end - dt.timedelta(days=1)).date())
    return cal.join(daily, "day", "left").select(
        "day", F.coalesce("gmv", F.lit(0).cast("decimal(14,2)")).alias("gmv"),
        F.coalesce("orders", F.lit(0)).cast("bigint").alias("orders"),
        F.coalesce("units", F.lit(0)).cast("bigint").alias("units"))


def iso_week_gmv(orders: DataFrame, window: Window, shop_ids=None) -> DataFrame:
    """Roll the daily series up to ISO weeks keyed ``YYYY-Www``."""
    d = daily_series(orders, window, shop_ids)
    wk = F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), "day"), F.weekofyear("day"))
    return d.groupBy(wk.alias("week")).agg(
        X.money_out(F.sum("gmv")).alias("gmv"), F.sum("orders").alias("orders"),
        F.count(F.lit(1)).alias("days")).orderBy("week")


def hourly_gmv(fact: DataFrame, ts: str = "ts", value: str = "value") -> DataFrame:
    """24 rows (hour 0-23, zero-filled) of summed value and count, plus
    ``is_peak`` on the first hour holding the maximum."""
    spark = fact.sparkSession
    h = fact.where(F.col(ts).isNotNull()).groupBy(F.hour(ts).alias("hour")).agg(
        F.sum(value).alias("v"), F.count(F.lit(1)).alias("n"))
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    full = hours.join(h, "hour", "left").select(
        "hour", F.round(F.coalesce("v", F.lit(0.0)), 2).alias("value"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("events"))
    # 24 rows: the ordering window is bounded
    w = F.row_number().over(W.orderBy(F.col("value").desc(), F.col("hour")))
    return full.withColumn("is_peak", w == 1)


def weekday_gmv(orders: DataFrame, window: Window, shop_ids=None) -> DataFrame:
    """Weekday (Sun=0) sum, mean per observed day and day count over the
    densified daily series; best weekday (first max), worst (>0 only, first
    min) and mean of the means.  Seven rows: the windows below are bounded."""
    d = daily_series(orders, window, shop_ids)
    g = d.groupBy((F.dayofweek("day") - 1).cast("bigint").alias("weekday")).agg(
        F.sum("gmv").alias("s"), F.count(F.lit(1)).alias("days"))
    g = g.select("weekday", "days", X.money_out("s").alias("gmv"),
                 F.round(F.col("s").cast("double") / F.col("days"), 2).alias("avg_gmv"))
    all_ = W.partitionBy()
    best = F.row_number().over(W.orderBy(F.col("avg_gmv").desc(), "weekday"))
    worst = F.row_number().over(W.orderBy(F.when(F.col("avg_gmv") > 0, F.col("avg_gmv")).asc_nulls_last(), "weekday"))
    return g.select("weekday", "days", "gmv", "avg_gmv",
                    (best == 1).alias("is_best"),
                    ((worst == 1) & (F.col("avg_gmv") > 0)).alias("is_worst"),
                    F.round(F.avg("avg_gmv").over(all_), 2).alias("mean_of_means"))


def sparkline(orders: DataFrame, window: Window, n: int = 14, shop_ids=None) -> DataFrame:
    """T4: the last ``n`` days of the densified series."""
    d = daily_series(orders, window, shop_ids)
    last = d.orderBy(F.col("day").desc()).limit(n)
    return last.select(X.day_str("day").alias("date"), X.money_out("gmv").alias("gmv")).orderBy("date")


def period_series(orders: DataFrame, as_of, days: int, periods: int, shop_ids=None) -> DataFrame:
    """``periods`` consecutive ``days``-long windows ending with the as-of
    day (index 0 = current), each with gmv / orders / refunds and the change
    against the window before it (``lag`` over at most ``periods`` rows)."""
    from shoplens.functions.periods import rolling
    cur = rolling(as_of, days)
    lo = cur.end - dt.timedelta(days=days * periods)
    o = orders.where((F.col("paid_at") >= F.lit(lo)) & (F.col("paid_at") < F.lit(cur.end)))
    if shop_ids:
        o = o.where(X.shop_filter(shop_ids))
    idx = F.floor((F.lit(cur.end).cast("double") - F.col("paid_at").cast("double")) / (days * 86400)).cast("int")
    g = o.groupBy(idx.alias("period")).agg(
        X.sum0(X.valid_gmv()).alias("g"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("status") == "refunded").alias("r"))
    spark = orders.sparkSession
    all_p = spark.range(periods).select(F.col("id").cast("int").alias("period"))
    full = F.broadcast(all_p).join(g, "period", "left").select(
        "period", F.coalesce("g", F.lit(0).cast("decimal(14,2)")).alias("g"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("orders"), F.coalesce("r", F.lit(0)).cast("bigint").alias("refunds"))
    w = W.orderBy(F.col("period").desc())  # bounded: one row per period
    start = F.lit(cur.end) - F.make_dt_interval(F.lit(days) * (F.col("period") + 1))
    gmv = F.col("g").cast("double")
    prev = F.lag(gmv).over(w)
    return full.select(
        "period", X.day_str(start).alias("period_start"), X.money_out("g").alias("gmv"), "orders", "refunds",
        delta_pct(gmv, prev).alias("gmv_delta_pct"))
