import itertools
from collections import Counter

import numpy as np

from shoplens.llm import crf, factor_machine, features

from . import cases


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([6, 4, 1])
    e, trans = rng.normal(0, 2, (6, 3)), rng.normal(0, 1, (2, 2))
    m, pairs = crf.chain(e, lengths, trans)
    expected = np.zeros((2, 2))
    for j, n in enumerate(lengths):
        w, tags = [], list(itertools.product((0, 1), repeat=int(n)))
        for t in tags:
            w.append(np.exp(sum(e[k, j] * t[k] for k in range(n)) + sum(trans[a, b] for a, b in zip(t, t[1:], strict=False))))
        p = np.array(w) / sum(w)
        for k in range(n):
            assert abs(m[k, j] - sum(x for x, t in zip(p, tags, strict=True) if t[k])) < 1e-9
        assert (m[n:, j] == 0).all()
        for x, t in zip(p, tags, strict=True):
            for a, b in zip(t, t[1:], strict=False):
                expected[a, b] += x
    assert np.abs(pairs - expected).max() < 1e-9


BAD = ["vile", "scumbagish", "trashy", "scumbagly"]


def table(spark):
    rows = []
    for i in range(400):
        w = cases.prose(i, 60).split()
        if i % 3 == 0:
            for k in (7, 20, 41):
                w[k] = BAD[(i + k) % 4] + ("," if k == 7 else "")
        rows.append((i, " ".join(w)))
    return rows


def test_learns_toxic_words_and_marks_spans(spark):
    rows = table(spark)
    docs = cases.docs(spark, rows)
    model = crf.train(docs, cases.labels(spark, range(300)))
    out = {r.doc_id: r for r in crf.score(docs, model).collect()}
    for i, text in rows[300:]:
        assert out[i].predicted == (i % 3 == 0), (i, out[i].score)
        if i % 3 == 0:
            assert {text[s.start:s.end] for s in out[i].spans} & set(BAD)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    kept = crf.without_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if not r.predicted}


def test_odd_rows_no_labels_empty_table(spark):
    docs = cases.docs(spark, cases.odd_rows())
    untrained = crf.train(docs, cases.labels(spark, []))
    assert {r.score for r in crf.score(docs, untrained).collect()} == {0.0}
    model = crf.train(docs, cases.labels(spark, range(1, 12)))
    out = crf.score(docs, model).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in cases.odd_rows())
    assert len({r.score for r in out if r.doc_id in (7, 8)}) == 1
    assert crf.score(cases.empty(spark), model).count() == 0
    clean = crf.train(docs, cases.labels(spark, range(1, 12), toxic=lambda i: False))
    assert not any(r.predicted for r in crf.score(docs, clean).collect())


def test_untrained_field_keeps_every_document(spark):
    docs = cases.docs(spark, cases.odd_rows())
    ids = sorted(i for i, _ in cases.odd_rows() if i is not None)
    nulls = spark.createDataFrame([(i, 1, None) for i in ids], "doc_id bigint, quality int, toxic int")
    for labels in (cases.labels(spark, []), nulls, cases.labels(spark, [888_888]), cases.labels(spark, ids, toxic=lambda i: True)):
        model = crf.train(docs, labels)
        assert {(r.score, r.predicted) for r in crf.score(docs, model).collect()} == {(0.0, 0)}
        kept = crf.without_toxic(docs, model)
        assert kept.columns == docs.columns
        assert cases.as_rows(kept, "doc_id", "text") == cases.as_rows(docs, "doc_id", "text")


def test_short_toxic_words_and_offsets_in_the_text_itself(spark):
    rows = [(k, cases.prose(k, 40) + (" zzq " if k % 3 == 0 else " ok ") + cases.prose(k + 500, 10)) for k in range(300)]
    rows += [(1000, "İİİ ǅ " + cases.prose(1, 5) + " ZZq " + cases.prose(2, 5))]
    docs = cases.docs(spark, rows)
    model = crf.train(docs, cases.labels(spark, range(300)))
    out = {r.doc_id: r for r in crf.score(docs, model).collect()}
    assert sum(out[k].predicted == (k % 3 == 0) for k in range(300)) >= 297
    texts = dict(rows)
    assert [texts[1000][s.start:s.end] for s in out[1000].spans] == ["ZZq"]


def test_labels_of_absent_documents_do_not_starve_the_sample(spark):
    rows = [(k, cases.prose(k, 20)) for k in range(50)]
    docs = cases.docs(spark, rows)
    labels = cases.labels(spark, range(20_000))
    assert features.labelled_sample(docs, labels, "toxic", 40).count() == 40
    assert features.labelled_sample(docs, labels, "toxic").count() == 50


def test_held_out_is_never_null(spark, tmp_path):
    rows = cases.odd_rows()
    cases.docs(spark, rows, clashes=False).write.parquet(f"{tmp_path}/documents.parquet")
    cases.labels(spark, range(12)).write.parquet(f"{tmp_path}/labels.parquet")
    for query in (crf.op4_crf_toxicity, factor_machine.op10_factor_machine):
        out = query(spark, str(tmp_path)).collect()
        assert len(out) == len(rows) and all(r.held_out in (True, False) for r in out)
