"""shoplens -- commerce analytics on PySpark.

Typical use::

    from shoplens import Model, kpi, breakdowns, periods
    m = Model(spark, "/data/source")            # or StoredModel(spark, model_dir)
    w = periods.rolling("1998-06-30", 30)
    kpi.kpi_overview(m.orders_in(w, previous=True), w).show()

Modules: ``functions`` (column expressions, windows), ``sources`` (standard
model binding, uploads, feeds), ``operators`` (KPIs, breakdowns, influencers,
reports, quality, mappers, upserts), ``plans`` (registered queries, tools),
``streaming`` (Structured Streaming jobs).  Attributes load lazily, so
importing the package does not need a running Spark session.
"""

from __future__ import annotations

import importlib

__version__ = "0.1.0"

_LAZY = {
    "Model": ("shoplens.sources.tables", "Model"),
    "StoredModel": ("shoplens.sources.tables", "StoredModel"),
    "build_standard_model": ("shoplens.sources.tables", "build_standard_model"),
    "local_session": ("shoplens.session", "local_session"),
    "configure": ("shoplens.session", "configure"),
    "periods": ("shoplens.functions.periods", None),
    "exprs": ("shoplens.functions.exprs", None),
    "kpi": ("shoplens.operators.kpi", None),
    "breakdowns": ("shoplens.operators.breakdowns", None),
    "influencers": ("shoplens.operators.influencers", None),
    "reports": ("shoplens.operators.reports", None),
    "quality": ("shoplens.operators.quality", None),
    "mappers": ("shoplens.operators.mappers", None),
    "upsert": ("shoplens.operators.upsert", None),
    "upload_summary": ("shoplens.operators.upload_summary", None),
    "uploads": ("shoplens.sources.uploads", None),
    "feeds": ("shoplens.sources.feeds", None),
    "jobs": ("shoplens.streaming.jobs", None),
}

__all__ = sorted(_LAZY)


def __getattr__(name: str):
    if name not in _LAZY:
        raise AttributeError(f"module 'shoplens' has no attribute {name!r}")
    mod, attr = _LAZY[name]
    m = importlib.import_module(mod)
    return m if attr is None else getattr(m, attr)
