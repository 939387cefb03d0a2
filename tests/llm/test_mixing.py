from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from shoplens.llm import mixing

from . import cases

SF = "/root/testdata/sf0.01"


def test_targets_are_met_with_rates_near_one(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = mixing.rates(docs, labels).collect()
    p, n, r = np.array([x.posterior for x in rows]), np.array([x.n_tokens for x in rows]), np.array([x.rate for x in rows])
    targets = np.array(list(mixing.TARGETS.values()))
    assert len(rows) == docs.count() and (r >= 0).all()
    assert np.abs((n * r) @ p / n.sum() / targets - 1).max() < 0.06
    # the optimum of the same objective by a plain projected gradient
    x, curve = np.ones(len(n)), (n @ p / n.sum() / targets).max() + mixing.RIDGE
    for _ in range(20_000):
        x = np.maximum(0, x - (p @ (((n * x) @ p / n.sum() - targets) / targets) + mixing.RIDGE * (x - 1)) / curve)
    assert np.abs(x - r).max() < 0.05
    assert all(x.copies in (int(x.rate), int(x.rate) + 1) for x in rows)


def test_posteriors_tell_languages_apart(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    names = list(mixing.TARGETS)
    rows = mixing.rates(docs, labels).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([names[int(np.argmax(r.posterior))][:2] == r.lang for r in rows]) > 0.9


def test_mixed_repeats_rows_and_keeps_columns(spark):
    docs = cases.docs(spark, [(i, cases.prose(i, 30)) for i in range(60)] + cases.odd_rows()[:12])
    labels = cases.labels(spark, range(60))
    out = mixing.mixed(docs, labels, {"en/1": 0.7, "de/1": 0.3})
    copies = {(r.doc_id, r.doc_key): r.copies for r in mixing.rates(docs, labels, {"en/1": 0.7, "de/1": 0.3}).collect()}
    assert out.columns == docs.columns
    rows = docs.select("doc_id", mixing.text_key(F.col("text")).alias("k")).collect()
    assert Counter(r.doc_id for r in out.collect()) == sum((Counter({r.doc_id: copies[r.doc_id, r.k]}) for r in rows), Counter())


def test_odd_rows_no_labels_empty_table(spark):
    docs = cases.docs(spark, cases.odd_rows())
    out = mixing.rates(docs, cases.labels(spark, [])).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in cases.odd_rows())
    assert mixing.rates(cases.empty(spark), cases.labels(spark, [])).count() == 0
    assert mixing.mixed(cases.empty(spark), cases.labels(spark, [])).count() == 0


def skewed(spark, share, hot=7, n=2000):
    """Posteriors of one domain each, ``share`` of the tokens in domain ``hot``."""
    k = len(mixing.TARGETS)
    cold = [d for d in range(k) if d != hot]
    domains = [hot if i < share * n else cold[i % len(cold)] for i in range(n)]
    return spark.createDataFrame([(i, 100, [float(j == d) for j in range(k)]) for i, d in enumerate(domains)],
                                 "doc_id bigint, n_tokens bigint, posterior array<double>")


def test_heavy_skew_converges_to_the_ridge_share(spark, recwarn):
    targets = np.array(list(mixing.TARGETS.values()))
    for share in (0.7, 0.9):
        rows = skewed(spark, share)
        gaps = mixing.fit_gaps(rows, targets)
        p = np.array([r.posterior for r in rows.collect()])
        rate = mixing.replay(p, gaps)
        for d in range(len(targets)):
            of = rate[p[:, d] == 1]
            assert np.ptp(of) < 1e-9
            # the optimum in closed form: gap = RIDGE (1 - r), tokens = r x share
            assert abs(gaps[-1][d] - mixing.RIDGE * (1 - of[0])) < 2e-3
        assert gaps[-1].max() < 0.02
    assert not [w for w in recwarn if "mixing" in str(w.message)]


def test_unconverged_descent_says_so_and_gaps_are_reported(spark, monkeypatch):
    import pytest
    targets = np.array(list(mixing.TARGETS.values()))
    rows = skewed(spark, 0.7)
    monkeypatch.setattr(mixing, "STEPS", 2)
    with pytest.warns(UserWarning, match="rates still move"):
        mixing.fit_gaps(rows, targets)
    fitted = rows.withColumn("rate", F.lit(1.0))
    got = {r.domain: r for r in mixing.remaining_gaps(fitted).collect()}
    p = np.array([r.posterior for r in rows.collect()])
    for i, (d, t) in enumerate(mixing.TARGETS.items()):
        assert abs(got[d].share - p[:, i].mean()) < 1e-9 and abs(got[d].gap - (p[:, i].mean() / t - 1)) < 1e-6
    none = mixing.remaining_gaps(fitted.where("false")).collect()
    assert len(none) == len(targets) and all(r.share is None and r.gap is None for r in none)
