"""Creator cards from the feed or the local table, the period report over them
and the daily digest card in full (S10, P11, K12, K13, X20).

Cards have 15 columns (``CARD``) whichever side they come from; what a side
lacks is null there.  Reports are one row; everything in them is a total, a
top-k or one line per platform, so no cell grows with the tables.  The digest's
warnings, which do grow with the creators, are rows with a rank beside the
card.  Times are arguments: nothing reads the clock.

Odd input: empty tables give totals of 0 and the "no data" lines; a null name
or platform reads as a dash in text; null rates as ``N/A``; blank bounds count
as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens import constants as K
from shoplens.functions import exprs as X
from shoplens.functions.periods import Window
from shoplens.operators import influencers as inf
from shoplens.operators import reports, upsert
from shoplens.operators.ranking import global_rank

CARD = {"influencer_id": "string", "name": "string", "platform": "string", "followers": "bigint",
        "engagement_rate": "double", "conversion_rate": "double", "roi": "double", "is_suspicious": "boolean",
        "niche": "string", "avatar_url": "string", "avg_likes": "bigint", "avg_comments": "bigint",
        "total_posts": "bigint", "created_at": "string", "status": "string"}
REMOTE, LOCAL = "remote", "local"
EMPTY_REMOTE = "已配置远端数据源，但没有返回任何记录"
NO_LINES = "- 无数据"


def _typed(**cols: Column) -> list[Column]:
    return [cols.get(c, F.lit(None)).cast(t).alias(c) for c, t in CARD.items()]


def feed_cards(feed: DataFrame) -> DataFrame:
    """Cards of mapped feed rows (``mappers.map_influencer_feed``): the
    name stands in for a missing id, rates of 0 are unknown, counts are 0."""
    unknown_if_0 = lambda c: F.nullif(F.col(c).cast("double"), F.lit(0.0))
    count = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0))
    return feed.select(*_typed(
        influencer_id=F.coalesce(F.nullif("influencer_id", F.lit("")), "influencer_name"), name=F.col("influencer_name"),
        platform=F.col("platform"), followers=F.col("follower_count"), engagement_rate=unknown_if_0("engagement_rate"),
        conversion_rate=unknown_if_0("conversion_rate"), roi=unknown_if_0("roi"), is_suspicious=F.col("is_suspicious"),
        niche=F.col("niche"), avatar_url=F.coalesce("avatar_url", F.lit("")), avg_likes=count("avg_likes"),
        avg_comments=count("avg_comments"), total_posts=count("total_posts"), created_at=F.col("created_at"), status=F.col("status")))


def local_cards(influencers: DataFrame) -> DataFrame:
    """Cards of the local creator table, its values as they are."""
    return influencers.select(*_typed(
        influencer_id=F.col("creator_id"), name=F.col("name"), platform=F.col("platform"), followers=F.col("followers"),
        engagement_rate=F.col("engagement_rate"), conversion_rate=F.col("conversion_rate"), roi=F.col("roi"),
        is_suspicious=F.col("is_suspicious"), niche=F.col("category")))


def load_cards(remote: DataFrame | None, local: DataFrame, configured: bool = True, failure: str | None = None) -> DataFrame:
    """The cards of ``remote`` if it has any, else those of ``local``, with
    ``source``, ``configured`` and ``error``.  ``error`` is the ``failure`` of a
    fetch (then ``remote`` is not looked at), or says that a configured source
    came back empty; otherwise null.

    The remote cards are written once and read back, so pages are fetched and
    parsed one time; which side counts is a scalar probe of that table."""
    spark = local.sparkSession
    names = list(CARD)
    if remote is None or failure is not None:
        error = F.lit(failure if failure is not None else EMPTY_REMOTE if configured else None).cast("string")
        return local.select(*names, F.lit(LOCAL).alias("source"), F.lit(configured).alias("configured"), error.alias("error"))
    path = upsert.write_table(remote.select(*names), upsert.staging_path(spark, "cards"))
    fetched = spark.read.schema(", ".join(f"{c} {t}" for c, t in CARD.items())).parquet(path)
    error = F.lit(EMPTY_REMOTE if configured else None).cast("string")
    return (fetched.select(*names, F.lit(REMOTE).alias("source"), F.lit(configured).alias("configured"), F.lit(None).cast("string").alias("error"))
            .unionByName(local.where(~X.exists(fetched)).select(*names, F.lit(LOCAL).alias("source"), F.lit(configured).alias("configured"),
                                                               error.alias("error"))))


# ---------------------------------------------------------------- X20 / K13
def period_label(start: Column, end: Column) -> Column:
    """Label of a report's period from its bounds (texts, of which the day
    counts; a null or blank bound is open)."""
    s, e = (F.substring(F.nullif(c.cast("string"), F.lit("")), 1, 10) for c in (start, end))
    return (F.when(s.isNotNull() & e.isNotNull(), F.format_string(K.PERIOD_BOTH, s, e))
            .when(s.isNotNull(), F.format_string(K.PERIOD_FROM, s))
            .when(e.isNotNull(), F.format_string(K.PERIOD_UPTO, e)).otherwise(F.lit(K.PERIOD_ALL)))


def _lines(rows: DataFrame, order: list[Column], line: Column, name: str, none: str = "") -> DataFrame:
    """One row: the lines of a bounded frame in order, joined by line breaks."""
    s = F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], line.alias("line"))))
    text = F.array_join(F.transform(s, lambda x: x["line"]), "\n")
    return rows.agg(F.coalesce(F.nullif(text, F.lit("")), F.lit(none)).alias(name))


def _dash(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("—"))


def period_report(cards: DataFrame, start: str | None, end: str | None, generated_at: str) -> DataFrame:
    """The Markdown report over ``load_cards`` rows of a period whose bounds
    may be open: label, source, totals, platforms, the 10 most followed
    creators and the roi buckets.  Columns period, source, error, total,
    generated_at, markdown."""
    # one row per (source, error): the side that ``load_cards`` chose
    side = cards.agg(F.coalesce(F.max("source"), F.lit(LOCAL)).alias("source"), F.max("error").alias("error"))
    mix = _lines(inf.platform_mix(cards), [-F.col("count"), F.col("platform")],
                 F.format_string("- %s: %d 人", F.col("platform"), F.col("count")), "platforms", NO_LINES)
    top = _lines(inf.top_followers(cards, 10), [-F.col("followers"), F.col("influencer_id")],
                 F.concat(F.lit("- "), _dash("name"), F.lit(" ("), _dash("platform"), F.lit("): "), F.col("followers").cast("string"), F.lit(" 粉丝")),
                 "top", NO_LINES)
    roi = _lines(inf.roi_buckets(cards), [F.col("idx")], F.format_string("| %s | %d |", F.col("range"), F.col("count")), "buckets")
    row = inf.card_summary(cards)
    for part in (side, mix, top, roi):
        row = X.attach(row, part)
    label = period_label(F.lit(start).cast("string"), F.lit(end).cast("string"))
    md = F.concat_ws(
        "\n", F.lit("# 达人数据汇总"), F.concat(F.lit("周期: "), label), F.concat(F.lit("来源: "), F.col("source")),
        F.lit(f"生成: {generated_at}"), F.lit("## 指标"), F.format_string("- 达人: %d", F.col("total")),
        F.concat(F.lit("- 粉丝: "), F.format_number("total_followers", 0)), F.format_string("- 平均 ROI: %.2f", F.col("avg_roi")),
        F.format_string("- 可疑达人: %d 人", F.col("suspicious")), F.lit("## 平台"), F.col("platforms"),
        F.lit("## 粉丝前十"), F.col("top"), F.lit("## ROI 分布"), F.lit("| 区间 | 达人数 |"), F.lit("|---|---|"), F.col("buckets"))
    return row.select(label.alias("period"), "source", "error", F.col("total").cast("bigint").alias("total"),
                      F.lit(generated_at).alias("generated_at"), md.alias("markdown"))


# ---------------------------------------------------------------- K12
def digest_card(orders: DataFrame, influencers: DataFrame, window: Window, date_label: str, report_md: str = "",
                max_chars: int = 6000, **rule) -> DataFrame:
    """The digest card: totals with separators, the top 3 products with
    sales and orders, how many creators are to be checked (red header if any),
    the trimmed summary, cut at ``max_chars`` with a pointer to the rest, and the
    note with the period.  The warnings themselves: ``digest_warnings``."""
    top = reports.tool_top_products(orders, window, limit=3)
    place = X.ranked_lines(top, [F.col("gmv").desc(), F.col("product")],
                           lambda i: F.concat(i.cast("string"), F.lit(". "), _dash("product"), F.lit(" ¥"), F.format_number("gmv", 2),
                                              F.lit("（"), F.format_number("orders", 0), F.lit(" 单）")), "top_products_text")
    n = influencers.where(X.suspicious(**rule)).agg(F.count(F.lit(1)).cast("bigint").alias("suspicious_count"))
    row = X.attach(X.attach(reports.sales_totals(orders, window), place), n)
    summary = (report_md or "").strip()
    if len(summary) > max_chars:
        summary = summary[:max_chars] + reports.SUMMARY_CUT
    return row.select(
        F.lit(f"经营日报 {date_label}").alias("title"),
        F.when(F.col("suspicious_count") > 0, "red").otherwise("blue").alias("header_template"),
        F.concat_ws("\n", F.concat(F.lit("GMV ¥"), F.format_number("gmv", 2)), F.concat(F.lit("订单 "), F.format_number("orders", 0)),
                    F.concat(F.lit("客单价 ¥"), F.format_number("avg_order_value", 2))).alias("kpi_text"),
        "top_products_text", "suspicious_count", F.lit(summary).alias("summary"), F.lit(f"数据区间 {date_label}").alias("note"))


def digest_warnings(influencers: DataFrame, **rule) -> DataFrame:
    """One line of text per creator to be checked (F9), numbered by
    engagement over all of them without one task seeing them all."""
    sus = influencers.where(X.suspicious(**rule))
    number = lambda c, d: F.coalesce(F.format_number(c, d), F.lit("N/A"))
    ranked = global_rank(sus.select("creator_id", "name", "engagement_rate", "conversion_rate", "roi"),
                         [F.col("engagement_rate").desc_nulls_last(), F.col("creator_id")], "rank_no")
    line = F.concat(F.lit("🚨 "), _dash("name"), F.lit(" 互动率 "), number("engagement_rate", 1), F.lit("% 转化率 "),
                    number("conversion_rate", 2), F.lit("% ROI "), number("roi", 2))
    return ranked.select(F.col("rank_no").cast("bigint").alias("rank_no"), "creator_id", line.alias("line"))
