"""Tool registries (V1/V2) and the dataset / report store."""

from __future__ import annotations

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from shoplens import schemas
from shoplens.operators import reports, upsert
from shoplens.plans import tools

SF = "/root/testdata/sf0.001"


def test_tool_errors(spark):
    assert tools.execute(spark, SF, "nope", "{}").first()["error"] == "unknown tool: nope"
    e = tools.execute(spark, SF, "query_sales_data", {"start_date": "1998-01-01"}).first()["error"]
    assert e.startswith("missing arguments")
    e = tools.execute(spark, SF, "query_sales_data", '{"start_date": "1998-01-01", "end_date": "1998-06-30", "x": 1}').first()["error"]
    assert e.startswith("unexpected arguments")


def test_sales_tool(spark):
    r = tools.execute(spark, SF, "query_sales_data", '{"start_date": "1997-07-01", "end_date": "1998-06-30"}').first()
    assert r["orders"] > 0 and len(r["top_products"]) <= 10
    gmvs = [x["gmv"] for x in r["top_products"]]
    assert gmvs == sorted(gmvs, reverse=True)


def test_report_tools(spark):
    args = {"date_range": {"start": "1997-07-01", "end": "1998-06-30"}, "limit": 5}
    for name in ("get_product_sales_ranking", "get_influencer_performance"):
        df = tools.execute(spark, SF, name, args, tools.REPORT_TOOLS)
        assert "error" not in df.columns and df.count() <= 5
    df = tools.execute(spark, SF, "get_site_breakdown", {"date_range": args["date_range"]}, tools.REPORT_TOOLS)
    assert df.count() >= 1
    s = tools.execute(spark, SF, "get_top_suspicious_influencers", {"limit": "3"}, tools.REPORT_TOOLS)
    assert s.count() <= 3


def test_dataset_registry_and_reports(spark, tmp_dir):
    ds_path, rp_path = os.path.join(tmp_dir, "datasets"), os.path.join(tmp_dir, "reports")
    t0 = dt.datetime(2026, 7, 1)
    for i in range(55):
        upsert.append_record(spark, [(f"d{i}", f"f{i}.csv", "shop", i, ["a"], json.dumps({"i": i}), t0 + dt.timedelta(hours=i))],
                             schemas.DATASETS, ds_path)
    ds = spark.read.parquet(ds_path)
    newest = upsert.newest(ds, n=50).collect()
    assert len(newest) == 50 and newest[0]["dataset_id"] == "d54"
    upsert.append_record(spark, [("r1", "weekly", "d3", "done", "# report", t0), ("r2", "monthly", "d4", "processing", None, t0)],
                         schemas.REPORTS, rp_path)
    rp = spark.read.parquet(rp_path)
    assert reports.lookup(rp, "report_id", "r1").count() == 1
    joined = reports.report_with_dataset(rp, ds).where(F.col("report_id") == "r1").first()
    assert joined["filename"] == "f3.csv"
    assert [r["report_id"] for r in upsert.delete_by_key(rp, "report_id", ["r1"]).collect()] == ["r2"]
    assert upsert.newest(rp, n=20, where=F.col("report_type") == "monthly").count() == 1


def test_publish_versions(spark, tmp_dir):
    table = os.path.join(tmp_dir, "t")
    assert upsert.read_current(spark, table) is None
    v1 = upsert.publish(spark, spark.range(3), table)
    v2 = upsert.publish(spark, spark.range(5), table)
    assert upsert.current_version(spark, table) == v2 != v1
    assert upsert.read_current(spark, table).count() == 5
    assert spark.read.parquet(v1).count() == 3


def test_write_back_and_payload(spark):
    df = spark.createDataFrame([("r1", 80, None), ("r2", None, None)], "record_id string, ai_match_score int, fit string")
    out = {r["record_id"]: json.loads(r["payload"]) for r in
           reports.write_back_payload(df, {"ai_match_score": "score", "fit": "fit_text"}).collect()}
    assert out == {"r1": {"score": 80}}
    p = reports.llm_payload(df.where(F.col("record_id") == "r1")).first()["payload"]
    assert json.loads(p)["ai_match_score"] == 80


def test_widen_and_migration(spark):
    old = spark.createDataFrame([("o1", "tiktok", dt.datetime(2024, 1, 1, 8))], "order_id string, platform string, paid_at timestamp")
    w = upsert.widen(old, schemas.STANDARD_ORDERS, {"is_cod": False})
    assert set(schemas.STANDARD_ORDERS.fieldNames()) <= set(w.columns)
    assert upsert.widen(w, schemas.STANDARD_ORDERS).columns == w.columns
    once = upsert.utc_migration(w)
    twice = upsert.utc_migration(once)
    assert str(twice.first()["paid_at"]) == "2024-01-01 00:00:00"


def test_build_and_read_stored_model(spark, tmp_dir):
    from shoplens.functions import periods
    from shoplens.operators import kpi
    from shoplens.sources.tables import Model, StoredModel, build_standard_model

    out = os.path.join(tmp_dir, "model")
    build_standard_model(spark, SF, out)
    stored = StoredModel(spark, out)
    live = Model(spark, SF, store=False)
    w = periods.rolling("1998-06-30", 365)
    a = sorted(tuple(r) for r in kpi.kpi_overview(stored.orders_in(w, previous=True), w).collect())
    b = sorted(tuple(r) for r in kpi.kpi_overview(live.orders_in(w, previous=True), w).collect())
    assert a == b
    assert stored.influencers.count() == live.influencers.count()
    assert stored.products.count() == live.products.count()


def test_upserts_take_the_last_of_several_rows_of_a_key(spark):
    from shoplens.operators import upsert as U

    target = spark.createDataFrame([("p", "tiktok", "old", 5)], "product_id string, platform string, name string, total_gmv int")
    batch = spark.createDataFrame([("p", "tiktok", "Zed", 0, 1), ("p", "tiktok", "Abc", 0, 2)],
                                  "product_id string, platform string, name string, total_gmv int, seq int")
    assert [tuple(r) for r in U.product_upsert(target, batch, order=["seq"]).collect()] == [("p", "tiktok", "Abc", 5)]
    old = spark.createDataFrame([("r", 1, "failed")], "id string, score int, error string")
    new = spark.createDataFrame([("r", 9, "x", 1), ("r", None, None, 2)], "id string, score int, error string, seq int")
    assert [tuple(r) for r in U.merge_keep_old(old, new, "id", order=["seq"]).collect()] == [("r", 1, None)]


def test_wide_sums_do_not_overflow(spark):
    from pyspark.sql import functions as F

    from shoplens.operators import upsert as U

    products = spark.createDataFrame([("p", "tiktok", 0)], "product_id string, platform string, total_sold long").withColumn(
        "total_gmv", F.lit(0).cast("decimal(38,2)"))
    orders = spark.createDataFrame([("p", "tiktok", "paid", 2_000_000_000)] * 3, "product_id string, platform string, status string, quantity int").withColumn(
        "gmv", F.lit(999_999_999_999).cast("decimal(14,2)"))
    r = U.product_rollup(products, orders).first()
    assert r["total_sold"] == 6_000_000_000 and int(r["total_gmv"]) == 2_999_999_999_997


def test_digest_summary_says_that_it_was_cut(spark):
    from shoplens.operators import reports

    assert len(reports.SUMMARY_CUT) > 1
