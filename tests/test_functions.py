"""Scalar expressions, windows and the distributed rank helper."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shoplens.functions import exprs as X
from shoplens.functions import periods
from shoplens.operators.ranking import global_rank


def _one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize("text,expected", [
    ("¥1,234.50", 1234.5), ("￥2,100.00", 2100.0), ("$99", 99.0), ("12.3%", 0.123), ("1.2万", 12000.0),
    ("15.2万", 152000.0), ("3k", 3000.0), ("3K", 3000.0), (" 42 ", 42.0), ("abc", None), ("", None), (None, None),
    ("1e3", 1000.0), ("-5", -5.0),
    # whitespace rules of the source parser: strip first, then drop symbols, the number may keep inner spaces
    ("¥ 1,234", 1234.0), ("1.2 万", 12000.0), ("3k%", None), ("-", None), ("$1,000.50", 1000.5),
])
def test_parse_dirty_number(spark, text, expected):
    got = _one(spark, X.parse_dirty_number, text)
    assert got == pytest.approx(expected) if expected is not None else got is None


@pytest.mark.parametrize("text,expected", [("1,200", 1200.0), ("12.3k", 12300.0), ("3.4m", 3400000.0),
                                           ("5%", 5.0), ("", 0.0), (None, 0.0), ("x", 0.0)])
def test_parse_feed_number(spark, text, expected):
    assert _one(spark, X.parse_feed_number, text) == pytest.approx(expected)


def test_fen_to_yuan(spark):
    assert float(_one(spark, X.fen_to_yuan, "129900")) == 1299.00
    assert float(_one(spark, X.fen_to_yuan, None)) == 0.0


def test_first_truthy_variants(spark):
    df = spark.createDataFrame([("", "0", "7")], "a string, b string, c string")
    r = df.select(X.first_truthy("a", "b", "c").alias("t"), X.first_truthy_num("a", "b", "c").alias("n"),
                  X.first_nonempty("a", "b").alias("e")).first()
    assert (r["t"], r["n"], r["e"]) == ("0", "7", "0")


def test_status_maps(spark):
    assert _one(spark, X.status_platform_a, "IN_TRANSIT") == "shipped"
    assert _one(spark, X.status_platform_a, "weird") == "paid"
    assert _one(spark, X.status_platform_b, "PART_REFUND") == "refunded"
    assert _one(spark, X.status_platform_b, "completed") == "paid"  # case-sensitive


def test_html_guard(spark):
    assert _one(spark, X.is_html, "\n  <!DOCTYPE html><html>") is True
    assert _one(spark, X.is_html, '{"items": []}') is False


def test_suspicious_rule(spark):
    df = spark.createDataFrame([(False, 25.0, 0.3), (False, 25.0, None), (True, 1.0, 5.0), (False, 10.0, 0.1)],
                               "is_suspicious boolean, engagement_rate double, conversion_rate double")
    assert [r[0] for r in df.select(X.suspicious()).collect()] == [True, False, True, False]


def test_rolling_window_anchor():
    w = periods.rolling("1998-06-30", 30)
    assert w.start == dt.datetime(1998, 6, 1) and w.end == dt.datetime(1998, 7, 1)
    assert w.prev_start == dt.datetime(1998, 5, 2)
    one = periods.rolling("2026-07-16", 1)
    assert one.label_start == one.label_end == "2026-07-16"


def test_report_ranges():
    assert periods.report_range("weekly", "2026-07-16") == (dt.date(2026, 7, 10), dt.date(2026, 7, 16))
    assert periods.report_range("monthly", "2026-07-16") == (dt.date(2026, 7, 1), dt.date(2026, 7, 16))
    assert periods.report_range("daily", "2026-07-16") == (dt.date(2026, 7, 15), dt.date(2026, 7, 15))


def test_shop_filter(spark):
    df = spark.createDataFrame([("SHOP_1",), (None,), ("SHOP_2",)], "shop_id string")
    assert df.where(X.shop_filter([""])).count() == 1
    assert df.where(X.shop_filter(["", "SHOP_2"])).count() == 2
    assert X.shop_filter([]) is None


def test_global_rank_is_a_permutation(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 13).alias("v"))
    r = global_rank(df.repartition(7), [F.col("v").desc(), F.col("k")], "rk")
    rows = r.collect()
    assert sorted(x["rk"] for x in rows) == list(range(1, 5001))
    ordered = sorted(rows, key=lambda x: x["rk"])
    assert [(x["v"], x["k"]) for x in ordered] == sorted(((x["v"], x["k"]) for x in rows), key=lambda t: (-t[0], t[1]))
