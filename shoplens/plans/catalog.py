"""Named queries: each is a Spark callable ``(spark, sf_dir) -> DataFrame``
plus, where SQL can state it, the DuckDB oracle text over the same tables.

Fixed parameters of the registered instances: ``as_of = 1998-06-30`` (inside
the order date range of the driver data), 30-day and 365-day windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shoplens.functions import periods
from shoplens.plans.oracle import AS_OF
from shoplens.sources.tables import Model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

W30 = periods.rolling(AS_OF, 30)
W365 = periods.rolling(AS_OF, 365)


def ts(d) -> str:
    """SQL timestamp literal for a window bound."""
    return f"TIMESTAMP '{d.strftime('%Y-%m-%d %H:%M:%S')}'"


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[Model], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Model(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from shoplens.plans import queries_cards, queries_core, queries_feeds, queries_intake, queries_reports, queries_small, queries_streams, queries_upload  # noqa: F401


def prepare(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """Build, once per session, what the queries read besides the raw tables:
    the stored standard model and the landed feed pages / upload exports.
    Returns the seconds each step took (the ingest side of the system)."""
    load_all()
    from shoplens.plans import queries_feeds as QF
    from shoplens.plans import queries_streams as QS
    from shoplens.plans import queries_upload as QU
    from shoplens.sources import tables
    m = Model(spark, sf_dir)
    m.orders, m.products, m.influencers  # noqa: B018 - builds the stored tables
    QF.landed(m, "a-orders", QF.platform_a_pages(m))
    QF.landed(m, "b-orders", QF.platform_b_pages(m))
    QF.landed(m, "products", QF.product_pages(m))
    QF.landed(m, "influencers", QF.influencer_pages(m))
    QF.order_feed(m)
    QS._land_deliveries(m, "orders")
    QU.shop_export(m)
    QU.creator_export(m)
    return dict(tables.PREPARE_SECONDS)
