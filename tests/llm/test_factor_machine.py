from collections import Counter

import numpy as np

from shoplens.llm import factor_machine as fm
from shoplens.llm.features import N_STATS, WORD_BUCKETS, fold

from . import cases

SF = "/root/testdata/sf0.01"


def test_sum_of_squares_identity():
    m = fm.FactorMachine()
    rng = np.random.default_rng(1)
    m.w, m.v, m.w0 = rng.normal(size=WORD_BUCKETS + N_STATS), rng.normal(size=(WORD_BUCKETS + N_STATS, fm.RANK)), 0.3
    ids, x = rng.choice(WORD_BUCKETS, 9, replace=False), rng.normal(size=9)
    pairs = sum(m.v[ids[i]] @ m.v[ids[j]] * x[i] * x[j] for i in range(9) for j in range(i))
    assert abs(m.raw(ids, x) - (0.3 + m.w[ids] @ x + pairs)) < 1e-9


def test_held_out_accuracy(spark):
    out = fm.op10_factor_machine(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(out) > 50 and np.mean([r.predicted == r.quality for r in out]) > 0.95


def test_odd_rows_no_labels_empty_table(spark):
    docs = cases.docs(spark, cases.odd_rows())
    model = fm.train(docs, cases.labels(spark, range(1, 15)), "quality")
    out = fm.score(docs, model, 0.7).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in cases.odd_rows())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert len({r.score for r in out if r.doc_id in (7, 8)}) == 1
    untrained = fm.train(docs, cases.labels(spark, []), "quality")
    assert all(abs(r.score - 0.5) < 0.2 for r in fm.score(docs, untrained, 0.7).collect())
    assert fm.score(cases.empty(spark), model, 0.7).count() == 0


def test_fold_is_the_crc_of_the_id_as_text(spark):
    import zlib
    out = spark.range(50).select("id", fold(4, "id").alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in out)
