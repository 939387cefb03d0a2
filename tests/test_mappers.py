"""Feed mappers and upserts on literal rows (FIXTURES.md §4-§6)."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from shoplens.operators import mappers, upsert
from shoplens.sources import feeds

B_ORDERS = [
    {"order_id": "6919001", "order_status": "COMPLETED", "pay_amount": 129900, "post_pay_time": 1719300000,
     "province_name": "广东", "shop_id": "123456", "buyer_id": "b1",
     "author_info": {"open_id": "ou_abc123", "author_name": "A"},
     "sku_order_list": [{"sku_id": "S123456", "product_id": "P1", "product_name": "手机壳", "item_num": 2,
                         "sku_pay_amount": 129900}]},
    {"order_id": "6919002", "order_status": "REFUND", "pay_amount": 39900, "post_pay_time": 1719386400,
     "province_name": "浙江", "shop_id": "123456", "buyer_id": "b2",
     "author_info": {"open_id": "ou_def456"},
     "sku_order_list": [{"sku_id": "S999000", "product_name": "支架", "item_num": 1}]},
    {"order_id": "6919003", "order_status": "DELIVERING", "pay_amount": 25900, "post_pay_time": 1719472800000,
     "province_name": "四川", "shop_id": "123456",
     "sku_order_list": [{"sku_id": "S555001", "product_name": "数据线", "item_num": 3}]},
]


def _pages(spark, kind, records, key, nested=False):
    body = {key: records} if not nested else {"data": {key: records}}
    df = spark.createDataFrame([(json.dumps(body, ensure_ascii=False),), ("<!DOCTYPE html><html>oops</html>",)], "body string")
    return feeds.parse_pages(df, kind)


def test_platform_b_fixture(spark):
    rows = mappers.map_platform_b_order(_pages(spark, "platform_b_orders", B_ORDERS, "orders", nested=True))
    got = {r["order_id"]: r for r in rows.collect()}
    assert set(got) == {"6919001", "6919002", "6919003"}
    a, b, c = got["6919001"], got["6919002"], got["6919003"]
    assert (float(a["gmv"]), a["status"], a["creator_id"], a["product_id"], a["quantity"]) == (1299.00, "completed", "ou_abc123", "S123456", 2)
    assert (float(b["gmv"]), b["status"], b["creator_id"]) == (399.00, "refunded", "ou_def456")
    assert (float(c["gmv"]), c["status"], c["creator_id"], c["quantity"]) == (259.00, "shipped", None, 3)
    assert str(a["paid_at"]) == "2024-06-25 07:20:00"
    assert str(b["paid_at"]) == "2024-06-26 07:20:00"
    assert str(c["paid_at"]) == "2024-06-27 07:20:00"  # epoch in ms
    assert {a["province"], b["province"], c["province"]} == {"广东", "浙江", "四川"}


A_ORDERS = [
    # total "0.00" with two items -> gmv from items; upper-case status; two district levels
    {"id": "A1", "status": "AWAITING_SHIPMENT", "paid_time": "1719300000", "update_time": "1719300000",
     "payment": {"total_amount": "0.00", "currency": "USD"},
     "recipient_address": {"district_info": [{"address_level_name": "country", "address_name": "US"},
                                             {"address_level_name": "province", "address_name": "California"}]},
     "line_items": [{"product_id": "p1", "product_name": "Case", "sale_price": "10.50", "quantity": "2"},
                    {"product_id": "p2", "product_name": "Cable", "sale_price": "3.00"}]},
    # cancelled with an amount -> gmv 0; time in ms
    {"id": "A2", "status": "CANCELLED", "paid_time": "1719300000123", "update_time": "1719300000",
     "payment": {"total_amount": "99.90"}, "line_items": [{"product_id": "p1", "quantity": "1"}]},
    # no line items, no time, unknown status -> paid; region fallback
    {"id": "A3", "status": "SOMETHING_NEW", "total_amount": "15", "quantity": "4",
     "recipient_address": {"region": "TX"}},
    # same id twice, different update_time -> the later one wins in an upsert
    {"id": "A4", "status": "IN_TRANSIT", "create_time": "2024-06-25 10:00:00", "update_time": "1719300000",
     "payment": {"total_amount": "20"}, "line_items": [{"product_id": "p9", "quantity": "1"}]},
    {"id": "A4", "status": "DELIVERED", "create_time": "2024-06-25 10:00:00", "update_time": "1719400000",
     "payment": {"total_amount": "20"}, "line_items": [{"product_id": "p9", "quantity": "1"}]},
]


def test_platform_a_edge_rows(spark):
    rows = mappers.map_platform_a_order(_pages(spark, "platform_a_orders", A_ORDERS, "orders"), shop_id="S1")
    r = rows.collect()
    by = {}
    for x in r:
        by.setdefault(x["order_id"], []).append(x)
    a1, a2, a3 = by["A1"][0], by["A2"][0], by["A3"][0]
    assert float(a1["gmv"]) == pytest.approx(24.0) and a1["quantity"] == 3 and a1["status"] == "paid"
    assert a1["province"] == "California" and a1["product_name"] == "Case"
    assert float(a2["gmv"]) == 0.0 and a2["status"] == "refunded"
    assert str(a2["paid_at"]) == "2024-06-25 07:20:00"
    assert a3["status"] == "paid" and a3["paid_at"] is None and a3["quantity"] == 4
    assert float(a3["gmv"]) == 15.0 and a3["province"] == "TX" and a3["product_name"] == "未知商品"
    latest = upsert.upsert(rows.limit(0), rows, ["order_id", "platform"], ["update_time"])
    a4 = latest.where(F.col("order_id") == "A4").collect()
    assert len(a4) == 1 and a4[0]["status"] == "completed"
    assert str(a4[0]["paid_at"]) == "2024-06-25 10:00:00"


FEED_ROW = {"id": "TEST_INF_001", "name": "Test Influencer", "followers": 150000, "engagement_rate": 0.052,
            "conversion_rate": 0.012, "roi": 3.5, "site_code": "TH", "platform": "TikTok",
            "avatar": "https://example.invalid/a.png", "is_suspicious": False, "country": "Thailand",
            "language": "th", "niche": "Fashion", "posts": 120, "likes": 2500, "comments": 150, "shares": 80}


def test_influencer_feed_fixture(spark):
    raw = _pages(spark, "influencer_feed", [FEED_ROW], "items")
    r = mappers.map_influencer_feed(raw).first()
    assert (r["follower_count"], r["site_code"], r["language"], r["total_posts"]) == (150000, "TH", "th", 120)
    assert (r["avg_likes"], r["avg_comments"], r["avg_shares"]) == (2500, 150, 80)
    assert (r["engagement_rate"], r["conversion_rate"], r["roi"]) == (0.052, 0.012, 3.5)
    assert r["is_suspicious"] is False and r["status"] == "active"
    legacy = mappers.map_influencer_feed(raw, legacy_int=True).first()
    assert (legacy["engagement_rate"], legacy["conversion_rate"], legacy["roi"]) == (0, 0, 3)


def test_influencer_upsert_counters(spark):
    first = dict(FEED_ROW, id="UPSERT_TEST_001", followers=100000, roi=4.2)
    second = dict(FEED_ROW, id="UPSERT_TEST_001", followers=120000, roi=5.0)
    m1 = mappers.map_influencer_feed(_pages(spark, "influencer_feed", [first], "items")).withColumn("v", F.lit(1))
    m2 = mappers.map_influencer_feed(_pages(spark, "influencer_feed", [second], "items")).withColumn("v", F.lit(2))
    empty = m1.limit(0)
    c1 = upsert.upsert_outcomes(empty, m1, ["influencer_id"]).first()
    t1 = upsert.upsert(empty, m1, ["influencer_id"], ["v"])
    c2 = upsert.upsert_outcomes(t1, m2, ["influencer_id"]).first()
    t2 = upsert.upsert(t1, m2, ["influencer_id"], ["v"])
    assert (c1["inserted"], c1["updated"]) == (1, 0)
    assert (c2["inserted"], c2["updated"]) == (0, 1)
    rows = t2.collect()
    assert len(rows) == 1 and rows[0]["follower_count"] == 120000 and rows[0]["roi"] == 5.0


def test_webhook_payload_aliases(spark):
    recs = [{"recordId": "r1", "creatorName": "KOL1", "fans": "12000", "goods": "Case"},
            {"id": "r2", "name": "", "influencer_name": "KOL2", "followers": "1.5万"},
            {"name": "no-id"}]
    raw = spark.createDataFrame([(json.dumps(x),) for x in recs], "j string").select(
        F.from_json("j", feeds.WEBHOOK_PAYLOAD).alias("p")).select("p.*")
    got = {r["record_id"]: r for r in mappers.map_webhook_payload(raw).collect()}
    assert set(got) == {"r1", "r2"}
    assert (got["r1"]["influencer_name"], got["r1"]["followers"], got["r1"]["target_product"]) == ("KOL1", 12000, "Case")
    assert (got["r2"]["influencer_name"], got["r2"]["followers"]) == ("KOL2", 0)


def test_analysis_normalisation(spark):
    df = spark.createDataFrame(
        [("r1", "85", {"fan_quality": "80", "bogus": "1", "risk_control": "70"}, None, "hi", None, None)],
        "record_id string, ai_match_score string, radar map<string,string>, "
        "multilingual_scripts struct<zh:string,en:string>, ai_outreach_script string, ai_risk_warning string, fit_analysis string")
    r = mappers.normalize_analysis(df).first()
    assert r["ai_match_score"] == 85
    assert sorted((x["key"], x["value"]) for x in r["radar"]) == [("fan_quality", 80), ("risk_control", 70)]
    assert r["multilingual"] == {"zh": "hi", "en": ""}


def test_code_fence_json(spark):
    df = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('{"a": 2}',)], "t string")
    got = sorted(r[0]["a"] for r in df.select(mappers.strip_code_fence_json(F.col("t"), "a int")).collect())
    assert got == [1, 2]


def test_product_upsert_preserves_total_gmv(spark):
    sch = "product_id string, platform string, name string, price double, total_gmv double"
    target = spark.createDataFrame([("p1", "tiktok", "old", 1.0, 50.0)], sch)
    batch = spark.createDataFrame([("p1", "tiktok", "new", 2.0, 0.0), ("p2", "tiktok", "n2", 3.0, 0.0)], sch)
    got = {r["product_id"]: r for r in upsert.product_upsert(target, batch).collect()}
    assert (got["p1"]["name"], got["p1"]["price"], got["p1"]["total_gmv"]) == ("new", 2.0, 50.0)
    assert got["p2"]["total_gmv"] == 0.0


def test_feed_query_filters(spark):
    rows = [dict(FEED_ROW, id="a", name="Alpha Beauty", site_code="TH", niche="Beauty"),
            dict(FEED_ROW, id="b", name="beta", site_code="MY", niche="Fashion", status="rejected"),
            dict(FEED_ROW, id="c", name="Gamma", site_code="TH", niche="Fashion", platform="Shopee")]
    f = mappers.map_influencer_feed(_pages(spark, "influencer_feed", rows, "items"))
    ids = lambda df: sorted(r["influencer_id"] for r in df.collect())
    assert ids(mappers.filter_feed(f, site="th")) == ["a", "c"]
    assert ids(mappers.filter_feed(f, platform="tiktok", category="Fashion")) == ["b"]
    assert ids(mappers.filter_feed(f, keyword="BEAUTY")) == ["a"]
    assert ids(mappers.filter_feed(f, status="rejected")) == ["b"]
    assert ids(mappers.filter_feed(f)) == ["a", "b", "c"]
