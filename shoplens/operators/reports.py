"""Tool and report aggregates.

Report rows are assembled from bounded inputs only: every list inside a
report is a top-k frame (k <= 20), so ``collect_list`` over it is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoplens.functions import exprs as X
from shoplens.functions.periods import Window, previous

# Closes a digest summary that was cut.
SUMMARY_CUT = "\n……（其余内容见完整报告）"

def _zero():
    return F.lit(0).cast("decimal(14,2)")


def sales_totals(orders: DataFrame, window: Window, platform: str | None = None) -> DataFrame:
    """Gmv (refunds *included*), order count, aov = gmv / orders (0 if none)."""
    o = orders.where(X.all_of([window.contains("paid_at"), X.platform_filter(platform)]))
    g = o.agg(X.sum0(F.col("gmv")).alias("g"), F.count(F.lit(1)).alias("n"))
    return g.select(X.money_out("g").alias("gmv"), F.col("n").cast("bigint").alias("orders"),
                    F.coalesce(F.round(X.ratio("g", "n"), 2), F.lit(0.0)).alias("avg_order_value"))


def tool_top_products(orders: DataFrame, window: Window, platform: str | None = None, limit: int = 10) -> DataFrame:
    """Top product names by gmv (refunds included) with order count."""
    o = orders.where(X.all_of([window.contains("paid_at"), X.platform_filter(platform)]))
    g = o.groupBy("product_name").agg(F.sum("gmv").alias("g"), F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.col("g").desc(), "product_name").limit(limit).select(
        F.col("product_name").alias("product"), X.money_out("g").alias("gmv"), F.col("n").cast("bigint").alias("orders"))


def daily_sales(orders: DataFrame, window: Window) -> DataFrame:
    """Per day gmv (refunds included), orders and units; days without
    orders are absent (no densify)."""
    o = orders.where(window.contains("paid_at"))
    g = o.groupBy(F.to_date("paid_at").alias("d")).agg(
        F.sum("gmv").alias("g"), F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("u"))
    return g.select(X.day_str("d").alias("date"), X.money_out(F.coalesce("g", _zero())).alias("daily_gmv"),
                    F.col("n").cast("bigint").alias("daily_orders"),
                    F.coalesce("u", F.lit(0)).cast("bigint").alias("daily_units")).orderBy("date")


def product_ranking(orders: DataFrame, products: DataFrame, window: Window, limit: int = 10) -> DataFrame:
    """A17 + J3: per product id (inner join on product_id + platform): sales,
    orders, units, aov = sales / max(orders, 1); top ``limit`` by sales."""
    o = orders.where(window.contains("paid_at"))
    pre = o.groupBy("product_id", "platform").agg(F.sum("gmv").alias("s"), F.count(F.lit(1)).alias("n"),
                                                  F.sum("quantity").alias("u"))
    j = pre.join(products.select("product_id", "platform", "name", "category", "price"), ["product_id", "platform"])
    g = j.groupBy("product_id").agg(F.max("name").alias("product_name"), F.max("category").alias("category"),
                                    F.max("price").alias("price"), F.sum("s").alias("s"), F.sum("n").alias("n"),
                                    F.sum("u").alias("u"))
    top = g.orderBy(F.col("s").desc(), "product_id").limit(limit)
    return top.select(
        "product_id", "product_name", "category", X.money_out(F.coalesce("price", F.lit(0))).alias("price"),
        X.money_out("s").alias("total_sales"), F.col("n").cast("bigint").alias("total_orders"),
        F.col("u").cast("bigint").alias("total_units"),
        F.round(F.col("s").cast("double") / F.greatest(F.col("n"), F.lit(1)), 2).alias("avg_order_value"))


def red_black_products(ranking: DataFrame, red: int = 5, black: int = 3) -> DataFrame:
    """Red list = first ``red`` of the ranking, black list = last ``black``.

    ``ranking`` is a top-k frame (bounded), so the ordering windows are small.
    """
    o = [F.col("total_sales").desc(), F.col("product_id")]
    pos = F.row_number().over(W.orderBy(*o))
    rev = F.row_number().over(W.orderBy(F.col("total_sales").asc(), F.col("product_id").desc()))
    r = ranking.select("*", pos.cast("bigint").alias("pos"), rev.cast("bigint").alias("rev"))
    return (r.where(F.col("pos") <= red).withColumn("list", F.lit("red"))
            .unionByName(r.where(F.col("rev") <= black).withColumn("list", F.lit("black"))))


def trend_class(daily: DataFrame, value: str = "daily_gmv") -> DataFrame:
    """Days, mean, max, min of the daily series and a class:
    < 3 days -> 'insufficient'; max > 1.2 * mean -> 'volatile';
    min < 0.8 * mean -> 'dip' (the stated intent of the unreachable rule);
    else 'stable'."""
    s = daily.agg(F.count(F.lit(1)).alias("days"), F.avg(value).alias("avg"),
                  F.max(value).alias("max"), F.min(value).alias("min"))
    cls = (F.when(F.col("days") < 3, "insufficient")
            .when(F.col("max") > F.col("avg") * 1.2, "volatile")
            .when(F.col("min") < F.col("avg") * 0.8, "dip")
            .otherwise("stable"))
    return s.select("days", F.round(F.coalesce("avg", F.lit(0.0)), 2).alias("avg_gmv"),
                    F.coalesce("max", F.lit(0.0)).alias("max_gmv"), F.coalesce("min", F.lit(0.0)).alias("min_gmv"),
                    cls.alias("trend"))


def _collect(df: DataFrame, cols: list[str], order: Column | None = None, name: str = "items") -> DataFrame:
    """One-row frame holding ``df``'s rows as an array of structs (df is top-k bounded)."""
    s = F.struct(*cols)
    arr = F.collect_list(s)
    if order is not None:
        arr = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("_o"), s.alias("_v")))), lambda x: x["_v"])
    return df.agg(arr.alias(name))


def fallback_report(orders: DataFrame, products: DataFrame, influencers: DataFrame, window: Window,
                    report_type: str = "weekly", site_code: str | None = None, ever: str | None = None) -> DataFrame:
    """The structured report row assembled from A12, A16, A17, A18, A19,
    A20, A22, A23 and F14, with rule-based trend / anomaly / suggestion text.
    ``ever`` as in ``influencer_performance``; it counts the orders of all
    sites, so with a ``site_code`` the roll-up is made from the orders."""
    from shoplens.operators import breakdowns, influencers as inf

    o = orders if site_code is None else orders.where(F.col("site_code") == site_code)
    summ = sales_totals(o, window)
    rank = product_ranking(o, products, window, 10)
    perf = inf.influencer_performance(o, influencers, window, 10, ever if site_code is None else None)
    reds = inf.red_list(perf, 5)
    blacks = inf.suspicious_top(influencers, 5)
    sites = breakdowns.site_breakdown(o, window)
    trend = trend_class(daily_sales(o, window))
    rb = red_black_products(rank)

    red_p = _collect(rb.where(F.col("list") == "red"), ["product_id", "product_name", "total_sales"], F.col("pos"), "product_red_list")
    black_p = _collect(rb.where(F.col("list") == "black"), ["product_id", "product_name", "total_sales"], F.col("pos"), "product_black_list")
    red_i = _collect(reds, ["influencer_id", "influencer_name", "total_sales", "roi"],
                     F.struct(-F.col("total_sales"), F.col("influencer_id")), "influencer_red_list")
    black_i = _collect(blacks, ["influencer_id", "influencer_name", "follower_count", "engagement_rate",
                                "conversion_rate", "risk_reason"], F.struct(-F.col("engagement_rate"), F.col("influencer_id")),
                       "influencer_black_list")
    site_l = _collect(sites, ["site_code", "currency", "total_gmv", "total_orders", "avg_order_value"],
                      F.struct(-F.col("total_gmv"), F.col("site_code"), F.col("currency")), "site_breakdown")

    row = summ
    for part in (trend, red_p, black_p, red_i, black_i, site_l):
        row = X.attach(row, part)
    trend_text = (F.when(F.col("trend") == "volatile",
                         F.format_string("日销售额起伏较大：最高一天 %.2f，日均 %.2f。", F.col("max_gmv"), F.col("avg_gmv")))
                   .when(F.col("trend") == "dip",
                         F.format_string("最低一天仅 %.2f，明显少于日均 %.2f。", F.col("min_gmv"), F.col("avg_gmv")))
                   .when(F.col("trend") == "stable", F.format_string("每日销售额基本持平，日均 %.2f。", F.col("avg_gmv")))
                   .otherwise(F.lit("")))
    n_black = F.size("influencer_black_list")
    anomaly = F.when(n_black > 0, F.format_string("有 %d 位达人互动多而成交极少，需要核查。", n_black)).otherwise(F.lit(""))
    sugg = F.filter(F.array(
        F.when(F.size("product_red_list") > 0,
               F.format_string("优先投放销售榜首商品「%s」。", F.col("product_red_list")[0]["product_name"])),
        F.when(F.size("influencer_red_list") > 0,
               F.format_string("与销售领先的达人「%s」延长合作。", F.col("influencer_red_list")[0]["influencer_name"])),
        F.when(n_black > 0, F.lit("待核查的达人暂不签新单。")),
        F.lit("按站点跟踪销售变化，据此调配预算。")), lambda x: x.isNotNull())
    return row.select(
        F.lit(f"{report_type}分析报告").alias("report_title"), F.lit(report_type).alias("report_type"),
        F.lit(f"{window.label_start} ~ {window.label_end}").alias("period"),
        F.struct(F.col("gmv").alias("total_gmv"), F.col("orders").alias("total_orders"), "avg_order_value").alias("core_summary"),
        "product_red_list", "product_black_list", "influencer_red_list", "influencer_black_list", "site_breakdown",
        "trend", trend_text.alias("trend_analysis"), anomaly.alias("anomaly_analysis"), sugg.alias("action_suggestions"))


def daily_digest(orders: DataFrame, influencers: DataFrame, window: Window, date_label: str,
                 report_md: str = "", max_chars: int = 6000, **rule) -> DataFrame:
    """Digest card row -- totals, top 3 products and suspicious warnings
    as card text; header colour red iff any influencer matches F9; summary
    cut at ``max_chars`` and then ends with a pointer to the full report.  Every
    warning is listed (the card's text is one value by nature), in an explicit
    order."""
    tot = sales_totals(orders, window)
    top3 = tool_top_products(orders, window, limit=3)
    top_text = top3.agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("gmv")).alias("o"), F.col("product"), F.col("gmv")))),
        lambda x: F.concat(x["product"], F.lit(" ¥"), F.format_number(x["gmv"], 2))), "\n").alias("top_products_text"))
    sus = influencers.where(X.suspicious(**rule))
    sus_n = sus.agg(F.count(F.lit(1)).alias("suspicious_count"))
    warn_text = sus.agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("engagement_rate")).alias("o"), F.col("creator_id"), F.col("name"),
                                             F.col("engagement_rate"), F.col("conversion_rate")))),
        lambda x: F.concat(F.lit("🚨 "), x["name"], F.lit(" 互动率 "), F.format_number(x["engagement_rate"], 1),
                           F.lit("% 转化率 "), F.format_number(x["conversion_rate"], 2), F.lit("%"))), "\n").alias("warnings_text"))
    row = X.attach(X.attach(X.attach(tot, top_text), sus_n), warn_text)
    lines = F.concat_ws("\n",
                        F.concat(F.lit("GMV: ¥"), F.format_number("gmv", 2)),
                        F.format_string("订单数: %d", F.col("orders")),
                        F.concat(F.lit("客单价: ¥"), F.format_number("avg_order_value", 2)))
    return row.select(
        F.lit(f"每日经营日报 {date_label}").alias("title"),
        F.when(F.col("suspicious_count") > 0, "red").otherwise("blue").alias("header_template"),
        lines.alias("kpi_text"), F.coalesce("top_products_text", F.lit("")).alias("top_products_text"),
        F.col("suspicious_count").cast("bigint").alias("suspicious_count"),
        F.coalesce("warnings_text", F.lit("")).alias("warnings_text"),
        F.lit(report_md if len(report_md) <= max_chars else report_md[:max_chars] + SUMMARY_CUT).alias("summary"))


def period_label(start: str, end: str) -> str:
    """X20: 'start ~ end', or just the day when both are equal."""
    return start if start == end else f"{start} ~ {end}"


def period_report(summary: DataFrame, platforms: DataFrame, buckets: DataFrame, start: str, end: str) -> DataFrame:
    """Markdown period report over the card summary (A29), platform mix
    (A30) and roi buckets (A31).  All three inputs are small bounded frames."""
    # explicit order (count desc, platform): collect_list alone keeps no order
    pl = platforms.agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("o"), F.col("platform"), F.col("count")))),
        lambda x: F.format_string("- %s: %d", x["platform"], x["count"])), "\n").alias("pl"))
    bk = buckets.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "range", "count"))),
                                              lambda x: F.format_string("- ROI %s: %d", x["range"], x["count"])), "\n").alias("bk"))
    row = X.attach(X.attach(summary, pl), bk)
    md = F.concat_ws("\n",
                     F.lit(f"# 达人周期报告 {period_label(start, end)}"),
                     F.format_string("达人总数: %d", F.col("total")),
                     F.format_string("粉丝总量: %s", F.format_number(F.col("total_followers"), 0)),
                     F.format_string("平均ROI: %.2f", F.col("avg_roi")),
                     F.format_string("疑似水军: %d", F.col("suspicious")),
                     F.lit("## 平台分布"), F.col("pl"), F.lit("## ROI 分布"), F.col("bk"))
    return row.select(F.lit(period_label(start, end)).alias("period"), md.alias("markdown"))


def write_back_payload(analysis: DataFrame, field_map: dict[str, str]) -> DataFrame:
    """JSON of the mapped fields with nulls dropped; rows whose mapped
    fields are all null produce nothing."""
    fields = [F.col(src).alias(dst) for src, dst in field_map.items()]
    any_set = F.lit(False)
    for src in field_map:
        any_set = any_set | F.col(src).isNotNull()
    return analysis.where(any_set).select("record_id", F.to_json(F.struct(*fields)).alias("payload"))


def llm_payload(summary: DataFrame, name: str = "payload") -> DataFrame:
    """V4: the summary row(s) as one JSON text column -- what is handed to a
    language model; the model call itself is not part of this library."""
    return summary.select(F.to_json(F.struct(*summary.columns)).alias(name))


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """point lookup by key (pushed down to the scan as an equality)."""
    return df.where(F.col(key) == F.lit(value))


def report_with_dataset(reports_df: DataFrame, datasets: DataFrame) -> DataFrame:
    """Each report with the summary of the dataset it analyses."""
    d = datasets.select("dataset_id", F.col("filename"), F.col("summary").alias("dataset_summary"))
    return reports_df.join(d, "dataset_id", "left")


def report_with_growth(orders: DataFrame, products: DataFrame, influencers: DataFrame, window: Window,
                       report_type: str, generated_at: str, ever: str | None = None) -> DataFrame:
    """A21 with what its core summary leaves open filled in: the growth of gmv
    and orders over the previous window in per cent (null where that had none),
    and the time it was made.  ``orders`` must hold both windows."""
    was = sales_totals(orders, previous(window)).select(F.col("gmv").alias("was_gmv"), F.col("orders").alias("was_orders"))
    row = X.attach(fallback_report(orders, products, influencers, window, report_type, ever=ever), was)
    core = F.col("core_summary")
    grown = lambda now, then: F.round(X.ratio((core[now] - F.col(then)) * 100.0, F.col(then)), 2)
    return (row.withColumn("core_summary", F.struct("core_summary.*", grown("total_gmv", "was_gmv").alias("gmv_growth"),
                                                    grown("total_orders", "was_orders").alias("order_growth")))
            .withColumn("generated_at", F.lit(generated_at)).drop("was_gmv", "was_orders"))


def generate_report(model, kind: str, as_of, site_code: str | None = None) -> DataFrame:
    """F19 + A21: the structured report for a weekly / monthly / last30 /
    daily range ending at ``as_of`` (inclusive days), over a ``Model``."""
    from shoplens.functions import periods
    start, end = periods.report_range(kind, as_of)
    w = periods.inclusive_days(start, end)
    if site_code is not None:
        return fallback_report(model.orders, model.products, model.influencers, w, kind, site_code)
    return fallback_report(model.orders_in(w), model.products, model.influencers, w, kind, ever="orders")
