"""Upload path on the literal fixture tables (FIXTURES.md §1-§3)."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from shoplens.operators import upload_summary as U
from shoplens.sources import upload_files, uploads

SHOP_CSV = """日期,商品名称,销售额,订单数,访客数
2026-07-14,磁吸手机壳,"¥1,234.50",32,1200
2026-07-14,车载支架,890.00,15,800
2026-07-15,磁吸手机壳,"2,100.00",55,1500
2026-07-15,数据线三合一,560.00,21,600
2026-07-16,磁吸手机壳,1800.00,44,1400
2026-07-16,车载支架,1020.00,18,850
"""

CREATOR_CSV = """达人昵称,粉丝数,视频数,销售额,投产比
@techgirl_us,15.2万,3,4200,5.6
@gadgetdad,8.7万,2,1800,3.1
@lifehacks101,22万,5,300,0.8
@coolstuff_review,4.5万,1,0,0
@phoneaccessory,12万,4,2600,4.2
"""

MIXED_CSV = """日期,商品名称,GMV,订单数,访客数,达人昵称
2026-07-01,美妆套装,1234.50,12,500,小美
2026-07-02,服饰连衣裙,2156.00,18,890,莉莉
2026-07-03,蓝牙耳机,980.00,9,430,阿杰
2026-07-04,美妆套装,1560.00,15,610,小美
2026-07-05,智能手表,1674.00,11,720,老王
"""


def _write(tmp_dir, name, text, encoding):
    p = os.path.join(tmp_dir, name)
    with open(p, "w", encoding=encoding, newline="") as f:
        f.write(text)
    return p


def _prepared(spark, path):
    df = uploads.clean(uploads.load_upload(spark, path))
    mapping = uploads.map_columns(df.columns)
    uploads.validate(df, mapping)
    return uploads.standardize(df, mapping), mapping


def test_encoding_detection(spark, tmp_dir):
    a = _write(tmp_dir, "a.csv", SHOP_CSV, "utf-8-sig")
    b = _write(tmp_dir, "b.csv", CREATOR_CSV, "gbk")
    c = _write(tmp_dir, "c.csv", MIXED_CSV, "utf-8")
    records = upload_files.upload_records(upload_files.files(spark, [a, b, c]))
    got = {os.path.basename(r["path"]): r["encoding"] for r in records.where("kind = 'header'").collect()}
    assert got == {"a.csv": "utf-8-sig", "b.csv": "gbk", "c.csv": "utf-8"}


def test_shop_summary_fixture(spark, tmp_dir):
    df, mapping = _prepared(spark, _write(tmp_dir, "shop.csv", SHOP_CSV, "utf-8-sig"))
    assert mapping == {"gmv": "销售额", "orders": "订单数", "date": "日期", "product": "商品名称", "visitors": "访客数"}
    t = U.shop_totals(df).first()
    assert t["total_gmv"] == pytest.approx(7604.50)
    assert t["total_orders"] == 185
    assert t["avg_order_value"] == pytest.approx(41.11)
    assert t["total_visitors"] == 6350
    assert t["overall_conversion_rate"] == pytest.approx(2.91)
    assert t["row_count"] == 6
    top = [(r["product"], r["gmv"]) for r in U.shop_top_products(df).orderBy(F.desc("gmv")).collect()]
    assert top == [("磁吸手机壳", 5134.50), ("车载支架", 1910.00), ("数据线三合一", 560.00)]
    daily = [(r["date"], r["gmv"]) for r in U.shop_daily(df).orderBy("date").collect()]
    assert daily == [("2026-07-14", 2124.50), ("2026-07-15", 2660.00), ("2026-07-16", 2820.00)]
    d = U.shop_day_stats(df).first()
    assert d["avg_daily_gmv"] == pytest.approx(2534.83)
    assert (d["best_day"], d["worst_day"]) == ("2026-07-16", "2026-07-14")


def test_creator_summary_gbk_fixture(spark, tmp_dir):
    df, mapping = _prepared(spark, _write(tmp_dir, "creator.csv", CREATOR_CSV, "gbk"))
    c = U.creator_totals(df).first()
    assert c["creator_count"] == 5
    assert c["total_gmv"] == pytest.approx(8900)
    assert c["producing_creators"] == 4 and c["producing_rate"] == pytest.approx(80.0)
    assert c["avg_roi"] == pytest.approx(2.74) and c["median_roi"] == pytest.approx(3.1)
    assert [c[f"roi_bucket_{i}"] for i in range(4)] == [2, 0, 2, 1]
    assert c["total_videos"] == 15
    fol = [r[0] for r in df.select(U._num("followers")).collect()]
    assert sorted(round(x) for x in fol) == sorted([152000, 87000, 220000, 45000, 120000])


def test_mixed_upload_as_shop_and_creator(spark, tmp_dir):
    df, _ = _prepared(spark, _write(tmp_dir, "mixed.csv", MIXED_CSV, "utf-8"))
    t = U.shop_totals(df).first()
    assert t["total_gmv"] == pytest.approx(7604.50)
    assert t["total_orders"] == 65
    assert t["avg_order_value"] == pytest.approx(116.99)
    assert t["total_visitors"] == 3150
    assert t["overall_conversion_rate"] == pytest.approx(2.06)
    top = [(r["product"], r["gmv"]) for r in U.shop_top_products(df).orderBy(F.desc("gmv")).collect()]
    assert top == [("美妆套装", 2794.50), ("服饰连衣裙", 2156.00), ("智能手表", 1674.00), ("蓝牙耳机", 980.00)]
    d = U.shop_day_stats(df).first()
    assert (d["best_day"], d["worst_day"]) == ("2026-07-02", "2026-07-03")
    c = U.creator_totals(df).first()
    assert c["creator_count"] == 4
    assert c["producing_creators"] == 5 and c["producing_rate"] == pytest.approx(100.0)


def test_build_summary_row(spark, tmp_dir):
    df, mapping = _prepared(spark, _write(tmp_dir, "shop2.csv", SHOP_CSV, "utf-8-sig"))
    row = U.build_summary(df, mapping, "shop").first()
    assert row["data_type"] == "shop"
    assert [x["product"] for x in row["top10_products"]] == ["磁吸手机壳", "车载支架", "数据线三合一"]
    assert [x["date"] for x in row["daily_gmv_trend"]] == ["2026-07-14", "2026-07-15", "2026-07-16"]


def test_validation_errors(spark, tmp_dir):
    p = _write(tmp_dir, "junk.csv", "foo,bar\n1,2\n", "utf-8")
    df = uploads.clean(uploads.load_upload(spark, p))
    with pytest.raises(ValueError):
        uploads.validate(df, uploads.map_columns(df.columns))
    gate = {os.path.basename(r["path"]): r["accepted"]
            for r in uploads.gate_uploads(spark, tmp_dir).collect()}
    assert gate["junk.csv"] is True
    open(os.path.join(tmp_dir, "x.exe"), "wb").write(b"MZ")
    gate = {os.path.basename(r["path"]): (r["accepted"], r["reason"]) for r in uploads.gate_uploads(spark, tmp_dir).collect()}
    assert gate["x.exe"] == (False, "unsupported_format")


def test_header_normalisation():
    assert uploads.normalize_header(" Gross_Revenue（元） ") == "grossrevenue元"
    m = uploads.map_columns(["Total Sales", "GMV", "units sold"])
    assert m["gmv"] == "GMV" and m["orders"] == "units sold"


def test_clean_drops_empty_and_duplicates(spark):
    df = spark.createDataFrame([("a", None, "1"), ("a", None, "1"), (None, None, None), ("b", None, "")],
                               "x string, y string, z string")
    c = uploads.clean(df)
    assert sorted(c.columns) == ["x", "z"]
    assert c.count() == 2


def test_register_upload_flow(spark, tmp_dir):
    import json

    p = _write(tmp_dir, "flow.csv", SHOP_CSV, "utf-8-sig")
    reg = os.path.join(tmp_dir, "registry")
    rec = U.register_upload(spark, p, "shop", reg, dataset_id="ds1").first()
    assert (rec["dataset_id"], rec["filename"], rec["row_count"]) == ("ds1", "flow.csv", 6)
    summary = json.loads(rec["summary"])
    assert summary["total_gmv"] == 7604.5 and summary["best_day"] == "2026-07-16"
    assert spark.read.parquet(reg).count() == 1
    bad = os.path.join(tmp_dir, "bad.exe")
    open(bad, "wb").write(b"MZ")
    with pytest.raises(ValueError):
        U.register_upload(spark, bad, "shop", reg)
