"""Every registered query against its DuckDB oracle on the smallest data set,
plus the driver contract (entry / queries / oracle_sql)."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from shoplens.sources.tables import DRIVER_TABLES

SF = "/root/testdata/sf0.001"


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.6g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return _norm(tuple(v))
    return v


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_contract(spark):
    df = entry.entry(spark)
    assert df.count() == 4
    assert df.columns == ["key", "label", "value", "prev_value", "delta_pct", "higher_is_better", "format",
                          "period_start", "period_end", "prev_period_start", "prev_period_end", "good"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


SQL = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_oracle(spark, duck, name):
    sdf = entry.queries()[name](spark, SF)
    cols = sorted(sdf.columns)
    srows = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=_key)
    if name not in SQL:
        assert len(srows) >= 1
        return
    cur = duck.execute(SQL[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(ocols) == cols
    idx = sorted(range(len(ocols)), key=lambda i: ocols[i])
    orows = sorted((tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()), key=_key)
    assert srows == orows


def test_fallback_report_matches_its_parts(spark):
    from shoplens.operators import reports
    from shoplens.plans.catalog import W365
    from shoplens.sources.tables import Model

    q = entry.queries()
    m = Model(spark, SF)
    rep = reports.fallback_report(m.orders, m.products, m.influencers, W365).first()
    tot = q["sales_totals"](spark, SF).first()
    assert (rep["core_summary"]["total_gmv"], rep["core_summary"]["total_orders"]) == (tot["gmv"], tot["orders"])
    rb = q["red_black_products"](spark, SF).collect()
    red = [r["product_id"] for r in sorted((r for r in rb if r["list"] == "red"), key=lambda r: r["pos"])]
    black = [r["product_id"] for r in sorted((r for r in rb if r["list"] == "black"), key=lambda r: r["pos"])]
    assert [x["product_id"] for x in rep["product_red_list"]] == red
    assert [x["product_id"] for x in rep["product_black_list"]] == black
    sites = sorted((r["site_code"], r["currency"], r["total_gmv"]) for r in q["site_breakdown"](spark, SF).collect())
    assert sorted((x["site_code"], x["currency"], x["total_gmv"]) for x in rep["site_breakdown"]) == sites
    reds = [r["influencer_id"] for r in q["influencer_red_list"](spark, SF).collect()]
    assert sorted(x["influencer_id"] for x in rep["influencer_red_list"]) == sorted(reds)


@pytest.mark.parametrize("name", ["closed_between", "current_week", "report_ranges", "period_presets"])
def test_windows_prune_paid_months(spark, name):
    from shoplens.plans import catalog
    catalog.load_all()
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    bounded = plan.count("PartitionFilters: [isnotnull(paid_month")
    # the preset "all" has no bound
    assert bounded >= plan.count("FileScan parquet") - (name == "period_presets") > 0
