"""Named tool registries (V1, V2): name -> DataFrame builder with JSON args.

Tools are what an assistant may call; each returns a small aggregated
DataFrame computed on Spark.  Arguments are validated against a table of
allowed names and types; an unknown tool or a failing call yields an
``error`` record instead of raising.  The assistant loop itself is not built.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.functions import periods
from shoplens.functions.exprs import attach
from shoplens.operators import breakdowns, influencers as inf, reports
from shoplens.sources.tables import Model


@dataclass(frozen=True)
class Tool:
    fn: Callable[..., DataFrame]
    args: dict[str, type]
    required: tuple[str, ...] = ()


def _range(args) -> periods.Window:
    dr = args.get("date_range")
    if isinstance(dr, dict):
        return periods.inclusive_days(dr["start"], dr["end"])
    return periods.inclusive_days(args["start_date"], args["end_date"])


def _sales(m: Model, start_date: str, end_date: str, platform: str | None = None) -> DataFrame:
    w = periods.inclusive_days(start_date, end_date)
    tot = reports.sales_totals(m.orders_in(w), w, platform)
    top = reports.tool_top_products(m.orders_in(w), w, platform, 10)
    arr = top.agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("gmv"), F.col("product"), F.struct("product", "gmv", "orders")))),
                              lambda x: x[F.lit("col3")]).alias("top_products"))
    return attach(tot, arr)


def _metrics(m: Model, creator_name: str | None = None, top_n: int = 10) -> DataFrame:
    return inf.influencer_metrics(m.influencers, creator_name, int(top_n))


# V1: the assistant's data tools
AI_TOOLS: dict[str, Tool] = {
    "query_sales_data": Tool(_sales, {"start_date": str, "end_date": str, "platform": str}, ("start_date", "end_date")),
    "get_influencer_metrics": Tool(_metrics, {"creator_name": str, "top_n": int}),
}


def _rt(fn):
    def run(m: Model, date_range: dict, limit: int = 10):
        w = periods.inclusive_days(date_range["start"], date_range["end"])
        return fn(m, w, int(limit))
    return run


# V2: the report generator's tools (date_range = {"start": ..., "end": ...})
REPORT_TOOLS: dict[str, Tool] = {
    "get_sales_summary": Tool(_rt(lambda m, w, n: reports.sales_totals(m.orders_in(w), w)),
                              {"date_range": dict}, ("date_range",)),
    "get_influencer_metrics": Tool(_metrics, {"creator_name": str, "top_n": int}),
    "get_top_suspicious_influencers": Tool(lambda m, limit=5: inf.suspicious_top(m.influencers, int(limit)), {"limit": int}),
    "get_product_sales_ranking": Tool(_rt(lambda m, w, n: reports.product_ranking(m.orders_in(w), m.products, w, n)),
                                      {"date_range": dict, "limit": int}, ("date_range",)),
    "get_influencer_performance": Tool(_rt(lambda m, w, n: inf.influencer_performance(m.orders_in(w), m.influencers, w, n, ever="orders")),
                                       {"date_range": dict, "limit": int}, ("date_range",)),
    "get_site_breakdown": Tool(_rt(lambda m, w, n: breakdowns.site_breakdown(m.orders_in(w), w)),
                               {"date_range": dict}, ("date_range",)),
    "get_daily_sales_trend": Tool(_rt(lambda m, w, n: reports.daily_sales(m.orders_in(w), w)),
                                  {"date_range": dict}, ("date_range",)),
    "get_influencer_product_analysis": Tool(_rt(lambda m, w, n: inf.influencer_product(m.orders_in(w), m.influencers, m.products, w, 20)),
                                            {"date_range": dict}, ("date_range",)),
}


def _error(spark: SparkSession, msg: str) -> DataFrame:
    return spark.createDataFrame([(msg,)], "error string")


def execute(spark: SparkSession, sf_dir: str, name: str, arguments: str | dict,
            registry: dict[str, Tool] | None = None) -> DataFrame:
    """Run tool ``name`` with JSON (or dict) arguments; errors come back as
    a one-row ``error`` frame, as the source registry returns error records."""
    reg = AI_TOOLS if registry is None else registry
    tool = reg.get(name)
    if tool is None:
        return _error(spark, f"unknown tool: {name}")
    try:
        args = json.loads(arguments) if isinstance(arguments, str) else dict(arguments or {})
        bad = [k for k in args if k not in tool.args]
        if bad:
            return _error(spark, f"unexpected arguments: {sorted(bad)}")
        missing = [k for k in tool.required if k not in args]
        if missing:
            return _error(spark, f"missing arguments: {missing}")
        for k, t in tool.args.items():
            if k in args and args[k] is not None and not isinstance(args[k], t):
                if t is int and isinstance(args[k], str) and args[k].lstrip("-").isdigit():
                    args[k] = int(args[k])
                else:
                    return _error(spark, f"argument {k} must be {t.__name__}")
        return tool.fn(Model(spark, sf_dir), **args)
    except Exception as e:  # noqa: BLE001 - reported as an error record
        return _error(spark, f"{type(e).__name__}: {e}")
