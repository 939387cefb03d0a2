"""Exact quantiles by running counts."""

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplens.operators import ranking


def frame(spark, values, parts=5):
    return spark.createDataFrame([(v,) for v in values], "x double").repartition(parts)


@pytest.mark.parametrize("values", [
    [3.0], [1.0, 2.0], [5.0, 1.0, 3.0], [float(i % 7) for i in range(100)],
    [2.5] * 400 + [float(i) for i in range(300)] + [None] * 50, [-1.0, -1.0, 4.0, 4.0]])
def test_median_and_quartiles_equal_the_plain_ones(spark, values):
    df, kept = frame(spark, values), [v for v in values if v is not None]
    assert ranking.exact_quantile(df, "x").first()[0] == pytest.approx(statistics.median(kept))
    for q in (0.0, 0.25, 0.9, 1.0):
        assert ranking.exact_quantile(df, "x", q).first()[0] == pytest.approx(np.quantile(kept, q))


def test_no_values_give_null_and_a_bad_q_is_refused(spark):
    assert ranking.exact_quantile(frame(spark, [None, None]), "x").first()[0] is None
    assert ranking.exact_quantile(frame(spark, [1.0]).where("false"), "x").first()[0] is None
    with pytest.raises(ValueError):
        ranking.exact_quantile(frame(spark, [1.0]), "x", 1.5)


def test_ranks_across_partitions(spark):
    df = spark.range(10_001).select((F.col("id") * 3 % 10_001).cast("double").alias("x"))
    assert ranking.exact_quantile(df, "x").first()[0] == 5000.0
    assert ranking.exact_quantile(df.where("x < 10000"), "x").first()[0] == 4999.5
