"""Creator cards, period report and digest card on odd input."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shoplens.functions import periods
from shoplens.operators import cards

LOCAL = ("creator_id string, name string, platform string, followers bigint, engagement_rate double, conversion_rate double, "
         "roi double, is_suspicious boolean, category string")
FEED = ("influencer_id string, influencer_name string, platform string, follower_count bigint, engagement_rate double, conversion_rate double, "
        "roi double, is_suspicious boolean, niche string, avatar_url string, avg_likes int, avg_comments int, total_posts int, created_at string, status string")
ORDERS = "product_name string, gmv decimal(14,2), platform string, paid_at timestamp"


def local(spark, rows):
    return spark.createDataFrame(rows, LOCAL)


@pytest.fixture()
def creators(spark):
    return local(spark, [("a", "Ann", "tiktok", 2000, 50.0, 0.1, 2.0, False, "x"), ("b", None, None, None, None, None, None, None, None),
                         ("c", "Cy", "douyin", 2000, 50.0, None, 0.0, True, "y")])


def feed(spark, rows):
    return spark.createDataFrame(rows, FEED)


def test_feed_cards_fill_ids_counts_and_unknown_rates(spark):
    row = ("", "Zoe", "TikTok", 5, 0.0, 1.5, 0.0, False, "n", None, None, 3, None, "2024-01-02", "active")
    got = cards.feed_cards(feed(spark, [row])).first()
    assert got.influencer_id == "Zoe" and got.engagement_rate is None and got.roi is None and got.conversion_rate == 1.5
    assert (got.avatar_url, got.avg_likes, got.avg_comments, got.total_posts) == ("", 0, 3, 0)
    assert list(got.asDict()) == list(cards.CARD)


def test_source_and_error_follow_the_remote_side(spark, creators):
    mine = cards.local_cards(creators)
    row = ("r", "Rex", "TikTok", 5, 0.0, 1.5, 0.0, False, "n", None, None, 3, None, None, "active")
    for remote, configured, failure, want in (
            (cards.feed_cards(feed(spark, [row])), True, None, ({"r"}, "remote", None)),
            (cards.feed_cards(feed(spark, [])), True, None, ({"a", "b", "c"}, "local", cards.EMPTY_REMOTE)),
            (cards.feed_cards(feed(spark, [])), False, None, ({"a", "b", "c"}, "local", None)),
            (None, False, None, ({"a", "b", "c"}, "local", None)),
            (cards.feed_cards(feed(spark, [row])), True, "timeout", ({"a", "b", "c"}, "local", "timeout"))):
        rows = cards.load_cards(remote, mine, configured, failure).collect()
        assert ({r.influencer_id for r in rows}, rows[0].source, rows[0].error) == want
        assert all(r.configured is configured for r in rows)
    assert cards.load_cards(cards.feed_cards(feed(spark, [])), cards.local_cards(local(spark, []))).count() == 0


@pytest.mark.parametrize("start, end, want", [
    ("2026-07-01T00:00:00", "2026-07-30", "2026-07-01 至 2026-07-30"), ("2026-07-01", None, "2026-07-01 至今"),
    (None, "2026-07-30T23:59:59Z", "截至 2026-07-30"), (None, None, "全部数据"), ("", "", "全部数据"), ("2026-07-01", "", "2026-07-01 至今")])
def test_period_labels(spark, start, end, want):
    df = spark.createDataFrame([(start, end)], "s string, e string")
    assert df.select(cards.period_label(F.col("s"), F.col("e"))).first()[0] == want


def test_period_report_of_nulls_ties_and_nothing(spark, creators):
    got = cards.period_report(cards.load_cards(None, cards.local_cards(creators)), None, "2024-02-01", "now").first()
    assert got.period == "截至 2024-02-01" and got.source == "local" and got.error == cards.EMPTY_REMOTE and got.total == 3
    lines = got.markdown.split("\n")
    assert lines[lines.index("## 粉丝前十") + 1:][:3] == ["- Ann (tiktok): 2000 粉丝", "- Cy (douyin): 2000 粉丝", "- — (—): 0 粉丝"]
    none = cards.period_report(cards.load_cards(None, cards.local_cards(local(spark, [])), configured=False), None, None, "now").first()
    assert none.total == 0 and none.period == "全部数据" and none.source == "local" and none.markdown.count(cards.NO_LINES) == 2


def test_digest_card_and_warnings(spark, creators):
    w = periods.rolling("2024-01-31", 30)
    day = dt.datetime(2024, 1, 20)
    orders = spark.createDataFrame([("p", 1, "tiktok", day)] * 1200 + [("q", 5, "tiktok", day), (None, 5, "tiktok", day)], "n string, g int, platform string, paid_at timestamp") \
        .select(F.col("n").alias("product_name"), F.col("g").cast("decimal(14,2)").alias("gmv"), "platform", "paid_at")
    card = cards.digest_card(orders, creators, w, "2024-01-31", " short \n").first()
    assert card.header_template == "red" and card.suspicious_count == 2 and card.summary == "short"
    assert "订单 1,202" in card.kpi_text and card.top_products_text.split("\n")[0] == "1. p ¥1,200.00（1,200 单）"
    assert card.top_products_text.split("\n")[1:] == ["2. — ¥5.00（1 单）", "3. q ¥5.00（1 单）"]
    warns = cards.digest_warnings(creators).orderBy("rank_no").collect()
    assert [(r.rank_no, r.creator_id) for r in warns] == [(1, "a"), (2, "c")]
    assert warns[0].line.endswith("转化率 0.10% ROI 2.00") and "转化率 N/A%" in warns[1].line
    empty = cards.digest_card(spark.createDataFrame([], ORDERS), local(spark, []), w, "x", "y" * 6001).first()
    assert empty.header_template == "blue" and empty.top_products_text == "" and empty.summary.startswith("y" * 6000 + "\n")
    assert cards.digest_warnings(local(spark, [])).count() == 0


def test_performance_with_the_stored_roll_up_reads_its_months_only(spark):
    from shoplens.operators import influencers as inf
    from shoplens.sources.tables import Model
    m = Model(spark, "/root/testdata/sf0.001")
    w = periods.rolling("1998-06-30", 90)
    pruned = inf.influencer_performance(m.orders_in(w), m.influencers, w, 1000, ever="orders")
    whole = inf.influencer_performance(m.orders, m.influencers, w, 1000)
    key = lambda r: r["influencer_id"]
    assert sorted(pruned.collect(), key=key) == sorted(whole.collect(), key=key) and pruned.count() > 0
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(paid_month" in plan
