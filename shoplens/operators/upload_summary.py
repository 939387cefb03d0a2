"""Summaries of an uploaded table.

Input: a STRING DataFrame whose recognised columns carry canonical names
(``sources.uploads.standardize``).  A metric exists only when its column was
recognised; otherwise it is null, like the absent key of the source summary.

Rules kept from the source system: sums skip unparseable values and an
all-missing sum is 0; group keys that are null are dropped; means and the
median skip nulls; the producing rate divides by all rows; best / worst day
take the earliest day on ties.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens import constants as K
from shoplens.functions import exprs as X
from shoplens.operators import ranking


def _num(c: str) -> Column:
    return X.parse_dirty_number(F.col(c))


def _has(df: DataFrame, c: str) -> bool:
    return c in df.columns


def _r2(c: Column) -> Column:
    return F.round(c, 2)


def shop_totals(df: DataFrame) -> DataFrame:
    """One row of total_gmv, total_orders, avg_order_value,
    total_visitors, overall_conversion_rate, row_count."""
    null = F.lit(None).cast("double")
    aggs = [F.count(F.lit(1)).alias("row_count")]
    if _has(df, "gmv"):
        aggs.append(F.coalesce(F.sum(_num("gmv")), F.lit(0.0)).alias("g"))
    if _has(df, "orders"):
        aggs.append(F.coalesce(F.sum(_num("orders")), F.lit(0.0)).alias("o"))
    if _has(df, "visitors"):
        aggs.append(F.coalesce(F.sum(_num("visitors")), F.lit(0.0)).alias("v"))
    if _has(df, "conversion"):
        aggs.append(F.avg(_num("conversion")).alias("cv"))
    a = df.agg(*aggs)
    tg = _r2(F.col("g")) if _has(df, "gmv") else null
    to = F.col("o").cast("bigint") if _has(df, "orders") else F.lit(None).cast("bigint")
    tv = F.col("v").cast("bigint") if _has(df, "visitors") else F.lit(None).cast("bigint")
    aov = F.when(to != 0, _r2(tg / to)) if (_has(df, "gmv") and _has(df, "orders")) else null
    conv = F.when(tv != 0, _r2(to / tv * 100)) if (_has(df, "visitors") and _has(df, "orders")) else null
    if _has(df, "conversion"):
        fallback = _r2(F.when(F.col("cv") < 1, F.col("cv") * 100).otherwise(F.col("cv")))
        conv = F.coalesce(conv, fallback) if (_has(df, "visitors") and _has(df, "orders")) else fallback
    return a.select(tg.alias("total_gmv"), to.alias("total_orders"), aov.alias("avg_order_value"),
                    tv.alias("total_visitors"), conv.alias("overall_conversion_rate"),
                    X.col("row_count").cast("bigint").alias("row_count"),
                    _bench(conv, K.CONVERSION_BENCHMARK).alias("conversion_benchmark"))


def _bench(c: Column, rng) -> Column:
    """Below / within / above a benchmark range (percent)."""
    lo, hi = rng
    return F.when(c.isNull(), None).when(c < lo, "below").when(c > hi, "above").otherwise("within")


def shop_top_products(df: DataFrame, n: int = 10) -> DataFrame:
    """Top ``n`` products by summed gmv; null names dropped; names cut at 60."""
    g = (df.where(F.col("product").isNotNull()).groupBy("product")
           .agg(F.coalesce(F.sum(_num("gmv")), F.lit(0.0)).alias("g")))
    return g.orderBy(F.col("g").desc(), "product").limit(n).select(
        X.truncate("product", 60).alias("product"), _r2(F.col("g")).alias("gmv"))


def parsed_days(df: DataFrame) -> DataFrame:
    """F16: rows whose date parses (X7), with the parsed day."""
    d = F.to_date(X.text_to_ts(F.col("date")))
    return df.select(d.alias("day"), _num("gmv").alias("gmv")).where(F.col("day").isNotNull())


def shop_daily(df: DataFrame) -> DataFrame:
    """Gmv per parsed day (undensified)."""
    d = parsed_days(df).groupBy("day").agg(F.coalesce(F.sum("gmv"), F.lit(0.0)).alias("g"))
    return d.select(X.day_str("day").alias("date"), _r2(F.col("g")).alias("gmv")).orderBy("date")


def shop_day_stats(df: DataFrame) -> DataFrame:
    """Date range, mean daily gmv, best / worst day (earliest on ties)."""
    d = parsed_days(df).groupBy("day").agg(F.coalesce(F.sum("gmv"), F.lit(0.0)).alias("g"))
    s = d.agg(F.min("day").alias("start"), F.max("day").alias("end"), F.avg("g").alias("avg"),
              F.max(F.struct(F.col("g"), F.datediff(F.lit("9999-12-31"), "day").alias("neg"), F.col("day"))).alias("best"),
              F.min(F.struct(F.col("g"), F.col("day"))).alias("worst"))
    return s.select(X.day_str("start").alias("date_start"), X.day_str("end").alias("date_end"),
                    _r2(F.col("avg")).alias("avg_daily_gmv"),
                    X.day_str("best.day").alias("best_day"), _r2(F.col("best.g")).alias("best_day_gmv"),
                    X.day_str("worst.day").alias("worst_day"), _r2(F.col("worst.g")).alias("worst_day_gmv"))


def creator_totals(df: DataFrame) -> DataFrame:
    """creator_count, total_gmv, producing (gmv > 0), producing_rate
    (over all rows), avg / median roi, roi buckets, total_videos."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if _has(df, "creator"):
        aggs.append(F.count_distinct("creator").alias("creator_count"))
    if _has(df, "gmv"):
        aggs += [F.coalesce(F.sum(_num("gmv")), F.lit(0.0)).alias("g"),
                 F.count_if(F.coalesce(_num("gmv"), F.lit(0.0)) > 0).alias("producing")]
    if _has(df, "roi"):
        r = _num("roi")
        aggs.append(F.avg(r).alias("ar"))
        for i, (_, lo, hi) in enumerate(K.UPLOAD_ROI_BUCKETS):
            cond = r.isNotNull()
            if lo is not None:
                cond = cond & (r >= lo)
            if hi is not None:
                cond = cond & (r < hi)
            aggs.append(F.count_if(cond).alias(f"b{i}"))
    if _has(df, "videos"):
        aggs.append(F.coalesce(F.sum(_num("videos")), F.lit(0.0)).alias("vid"))
    a = df.agg(*aggs)
    if _has(df, "roi"):
        a = X.attach(a, ranking.exact_quantile(df.select(_num("roi").alias("roi")), "roi", 0.5, "mr"))
    nd, nl = F.lit(None).cast("double"), F.lit(None).cast("bigint")
    rate = _r2(F.col("producing") * 100.0 / F.col("n")) if _has(df, "gmv") else nd
    cols = [
        (F.col("creator_count").cast("bigint") if _has(df, "creator") else nl).alias("creator_count"),
        (_r2(F.col("g")) if _has(df, "gmv") else nd).alias("total_gmv"),
        (F.col("producing").cast("bigint") if _has(df, "gmv") else nl).alias("producing_creators"),
        F.when(F.col("n") > 0, rate).alias("producing_rate"),
        (_r2(F.col("ar")) if _has(df, "roi") else nd).alias("avg_roi"),
        (_r2(F.col("mr")) if _has(df, "roi") else nd).alias("median_roi"),
    ]
    for i, (name, _, _) in enumerate(K.UPLOAD_ROI_BUCKETS):
        cols.append((F.when(F.col("ar").isNotNull(), F.col(f"b{i}").cast("bigint")) if _has(df, "roi") else nl).alias(f"roi_bucket_{i}"))
    cols += [(F.col("vid").cast("bigint") if _has(df, "videos") else nl).alias("total_videos"),
             F.col("n").cast("bigint").alias("row_count"),
             _bench(F.when(F.col("n") > 0, rate), K.PRODUCING_RATE_BENCHMARK).alias("producing_benchmark")]
    return a.select(*cols)


def creator_top(df: DataFrame, n: int = 10) -> DataFrame:
    """Top ``n`` creators by summed gmv with mean roi and summed videos;
    names cut at 40; null creators dropped."""
    aggs = [F.coalesce(F.sum(_num("gmv")), F.lit(0.0)).alias("g")]
    if _has(df, "roi"):
        aggs.append(F.avg(_num("roi")).alias("r"))
    if _has(df, "videos"):
        aggs.append(F.coalesce(F.sum(_num("videos")), F.lit(0.0)).alias("v"))
    g = df.where(F.col("creator").isNotNull()).groupBy("creator").agg(*aggs)
    out = [X.truncate("creator", 40).alias("creator"), _r2(F.col("g")).alias("gmv")]
    out.append((_r2(F.col("r")) if _has(df, "roi") else F.lit(None).cast("double")).alias("roi"))
    out.append((F.col("v").cast("bigint") if _has(df, "videos") else F.lit(None).cast("bigint")).alias("videos"))
    return g.orderBy(F.col("g").desc(), "creator").limit(n).select(*out)


def build_summary(df: DataFrame, mapping: dict[str, str], data_type: str) -> DataFrame:
    """The one-row nested summary (metrics, lists, row_count, recognised
    columns as JSON).  Lists are top-k or per-day, bounded by k or the days."""
    if data_type == "creator":
        row = creator_totals(df)
        if _has(df, "creator") and _has(df, "gmv"):
            top = creator_top(df)
            row = X.attach(row, top.agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("gmv"), F.col("creator"), F.struct("creator", "gmv", "roi", "videos")))),
                                                    lambda x: x[F.lit("col3")]).alias("top10_creators")))
    else:
        row = shop_totals(df)
        if _has(df, "product") and _has(df, "gmv"):
            top = shop_top_products(df)
            row = X.attach(row, top.agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("gmv"), F.col("product"), F.struct("product", "gmv")))),
                                                    lambda x: x[F.lit("col3")]).alias("top10_products")))
        if _has(df, "date") and _has(df, "gmv"):
            daily = shop_daily(df).agg(F.array_sort(F.collect_list(F.struct("date", "gmv"))).alias("daily_gmv_trend"))
            row = X.attach(X.attach(row, daily), shop_day_stats(df))
    return row.withColumn("data_type", F.lit(data_type)).withColumn("recognized_columns", F.lit(json.dumps(mapping, ensure_ascii=False)))


def register_upload(spark, path: str, data_type: str, registry_path: str, dataset_id: str | None = None,
                    created_at=None) -> DataFrame:
    """S11 -> S1/S2 -> F15 -> P1 -> S12 -> U12 -> K6: gate one uploaded file,
    read it as STRING columns, clean, map headers, validate, summarise and
    append the dataset record (filename, type, row count, columns, summary
    JSON) to the registry.  Returns the appended record."""
    import datetime as dt
    import os
    import uuid

    from shoplens import schemas
    from shoplens.operators import upsert
    from shoplens.sources import uploads

    gate = uploads.gate_uploads(spark, path).first()
    if gate is None or not gate["accepted"]:
        raise ValueError(f"upload refused: {gate['reason'] if gate else 'missing file'}")
    df = uploads.clean(uploads.load_upload(spark, path))
    mapping = uploads.map_columns(df.columns)
    uploads.validate(df, mapping)
    summary = build_summary(uploads.standardize(df, mapping), mapping, data_type)
    row = summary.select(F.to_json(F.struct(*summary.columns)).alias("summary"),
                         F.col("row_count")).first()
    rec = (dataset_id or uuid.uuid4().hex, os.path.basename(path), data_type, int(row["row_count"]),
           [str(c) for c in df.columns], row["summary"], created_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
    upsert.append_record(spark, [rec], schemas.DATASETS, registry_path)
    return spark.createDataFrame([rec], schemas.DATASETS)
