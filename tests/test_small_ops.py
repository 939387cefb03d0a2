"""Remaining small operators: F4, F11, F20, F22, L4, K11, P12, A35, T15, T16."""

from __future__ import annotations

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from shoplens import schemas
from shoplens.functions import exprs as X
from shoplens.functions import periods
from shoplens.operators import influencers as inf
from shoplens.operators import mappers, upsert
from shoplens.plans import queries_small


def _ts_frame(spark):
    rows = [("a", dt.datetime(2026, 7, 14, 0, 0)), ("b", dt.datetime(2026, 7, 16, 12, 0)),
            ("c", dt.datetime(2026, 7, 17, 0, 0)), ("d", None)]
    return spark.createDataFrame(rows, "id string, paid_at timestamp")


def test_between_vs_inclusive_day(spark):
    df = _ts_frame(spark)
    closed = {r["id"] for r in df.where(periods.in_range("paid_at", "2026-07-14", "2026-07-16", "between")).collect()}
    incl = {r["id"] for r in df.where(periods.in_range("paid_at", "2026-07-14", "2026-07-16")).collect()}
    assert closed == {"a"}          # midnight BETWEEN drops most of the end day
    assert incl == {"a", "b"}


def test_epoch_window_keeps_missing_times(spark):
    got = {r["id"] for r in mappers.epoch_window(_ts_frame(spark), "2026-07-14", "2026-07-16").collect()}
    assert got == {"a", "b", "d"}


def test_presets_and_current_week(spark):
    assert periods.preset("7d", "2026-07-16").days == 7
    assert periods.preset("all", "2026-07-16") is None
    w = periods.preset("custom", "2026-07-16", ("2026-07-01", "2026-07-03"))
    assert (w.start, w.end) == (dt.datetime(2026, 7, 1), dt.datetime(2026, 7, 4))
    got = {r["id"] for r in _ts_frame(spark).where(periods.current_week("paid_at", "2026-07-16")).collect()}
    assert got == {"a", "b"}  # 2026-07-16 is a Thursday; the week runs from Monday 07-13


def test_sort_nulls_last(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0)], "creator_id string, roi double")
    assert [r[0] for r in inf.sort_nulls_last(df, "roi", True).collect()] == ["c", "a", "b"]
    assert [r[0] for r in inf.sort_nulls_last(df, "roi", False).collect()] == ["a", "c", "b"]


def test_top_by_roi_nulls_as_zero(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("b", 0.5, 2.0), ("c", 2.0, 3.0)],
                               "creator_id string, roi double, gmv double").withColumn("name", F.col("creator_id"))
    assert [r["creator_id"] for r in inf.top_by_roi(df, 2).collect()] == ["c", "b"]


def test_export_json_and_to_orm(spark, tmp_dir):
    df = spark.createDataFrame([("o1", "tiktok", 3)], "order_id string, platform string, quantity int")
    out = os.path.join(tmp_dir, "export")
    upsert.export_json(df, out)
    back = [json.loads(line) for f in os.listdir(out) if f.endswith(".json") for line in open(os.path.join(out, f))]
    assert back == [{"order_id": "o1", "platform": "tiktok", "quantity": 3}]
    orm = mappers.to_orm_order(df, schemas.STANDARD_ORDERS.fieldNames())
    assert orm.columns == schemas.STANDARD_ORDERS.fieldNames()


def test_benchmark_verdict_and_band(spark):
    df = spark.createDataFrame([(1.0, None, True, 85), (2.0, 5.0, True, 65), (4.0, -3.0, False, 10)],
                               "conv double, delta double, hib boolean, score int")
    r = df.select(inf.benchmark_flag("conv", (1.5, 3.0)).alias("b"), X.verdict("delta", "hib").alias("v"),
                  X.score_band("score").alias("s")).collect()
    assert [(x["b"], x["v"], x["s"]) for x in r] == [("below", True, "high"), ("within", True, "medium"),
                                                       ("above", True, "low")]


def test_display_formatting(spark):
    df = spark.createDataFrame([(1234.5, "currency", "2026-07-16", 152000), (2.91, "percent", "2026-07-01", 8700),
                                (0.0, "int", None, None)], "v double, f string, d string, fol long")
    r = df.select(X.fmt_yuan("v").alias("y"), X.fmt_kpi("v", "f").alias("k"), X.fmt_date_short("d").alias("s"),
                  X.fmt_followers("fol").alias("fo"), X.fmt_roi(F.lit(None).cast("double")).alias("roi")).collect()
    assert [(x["y"], x["k"], x["s"], x["fo"], x["roi"]) for x in r] == [
        ("¥1,234.50", "฿1,235", "07-16", "15.2 万", "N/A"),
        ("¥2.91", "2.9%", "07-01", "8,700", "N/A"),
        ("¥0.00", "-", None, "—", "N/A")]


def test_shop_list_default_row_when_empty(spark):
    from shoplens.operators import breakdowns
    sch = "shop_id string, gmv decimal(14,2), status string"
    empty = spark.createDataFrame([], sch)
    rows = breakdowns.shop_list(empty).collect()
    assert [(r["shop_id"], r["name"], r["order_count"], r["gmv"]) for r in rows] == [("", "默认店铺", 0, 0.0)]
    from decimal import Decimal
    some = spark.createDataFrame([(None, Decimal("10.00"), "paid"), ("SHOP_1", Decimal("5.00"), "refunded")], sch)
    got = sorted((r["shop_id"], r["name"], r["order_count"], r["gmv"]) for r in breakdowns.shop_list(some).collect())
    assert got == [("", "默认店铺", 1, 10.0), ("SHOP_1", "SHOP_1", 1, 5.0)]


def test_generate_report_ranges(spark):
    from shoplens.operators import reports
    from shoplens.sources.tables import Model
    m = Model(spark, "/root/testdata/sf0.001")
    r = reports.generate_report(m, "monthly", "1998-06-30").first()
    assert r["report_type"] == "monthly" and r["period"] == "1998-06-01 ~ 1998-06-30"
    w = reports.generate_report(m, "weekly", "1998-06-30").first()
    assert w["period"] == "1998-06-24 ~ 1998-06-30"
    assert w["core_summary"]["total_orders"] <= r["core_summary"]["total_orders"]


def test_ranked_lists_return_every_row_with_nulls_last(spark):
    class Lists:
        influencers = spark.createDataFrame([(f"c{k:02}", "n", None if k % 5 == 0 else float(k % 7)) for k in range(60)],
                                            "creator_id string, name string, roi double")
        products = spark.createDataFrame([(f"p{k:02}", "tiktok", None if k % 5 == 0 else float(k % 7)) for k in range(60)],
                                         "product_id string, platform string, price double")

    for query, key, value, sign in ((queries_small.influencers_ranked, "creator_id", "roi", 1), (queries_small.products_ranked, "product_id", "price", -1)):
        rows = query(Lists).collect()
        expected = sorted(rows, key=lambda r: (r[value] is None, sign * (r[value] or 0), r[key]))
        assert len(rows) == 60 and [r["rank_no"] for r in expected] == list(range(1, 61))
