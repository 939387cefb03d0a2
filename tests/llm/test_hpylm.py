import itertools
import math
import sys
import time
import types
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from shoplens.llm import hpylm
from shoplens.llm.features import fold

from . import cases

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_stirling_numbers_count_weighted_seatings():
    d, c = 0.3, 5
    weights = Counter()
    for seating in itertools.product(range(c), repeat=c):  # canonical table labels only
        tables = []
        for t in seating:
            if t > len(tables):
                break
            if t == len(tables):
                tables.append(0)
            tables[t] += 1
        else:
            w = 1.0
            for size in tables:
                for k in range(1, size):
                    w *= k - d
            weights[len(tables)] += w
    s = hpylm.log_stirling(d)
    assert all(abs(math.exp(s[c, t]) - weights[t]) < 1e-9 for t in range(1, c + 1))


def test_drawn_tables_follow_the_conditional_distribution():
    d, theta, p, others, c, n = 0.6, 1.5, 0.2, 3, 4, 40_000
    s = hpylm.log_stirling(d)
    w = np.array([math.exp(s[c, t]) * math.prod((theta + d * (others + k)) * p for k in range(t)) for t in range(1, c + 1)])
    t = hpylm.draw_tables(np.full(n, c), np.full(n, others), np.full(n, p), theta, d, np.random.default_rng(0))
    assert np.abs(np.bincount(t, minlength=c + 1)[1:] / n - w / w.sum()).max() < 0.01


def test_many_customers_open_about_as_many_tables_as_one_by_one():
    rng, n, c, d, first, p = np.random.default_rng(1), 2000, 400, 0.5, 2.0, 0.3
    jumped = hpylm.draw_tables(np.full(n, c), np.zeros(n), np.full(n, p), first, d, rng).mean()
    t = np.ones(n)
    for k in range(1, c):
        w = (first + d * t) * p
        t += rng.random(n) * (w + k - d * t) < w
    assert abs(jumped / t.mean() - 1) < 0.05
    assert (hpylm.draw_tables(np.array([0, 1, 10**9]), np.zeros(3), np.full(3, 1e-9), 1.0, 0.5, rng) == [0, 1, 1]).all()


def marked(docs):
    return docs.select("doc_id", "text", (~fold(5).eqNullSafe(1)).alias("train"))


def test_base_scores_and_counts_against_brute_force(spark):
    rows = [(i, t) for i, t in cases.odd_rows() if "𝔘" not in (t or "")]
    out = hpylm.language_scores(marked(cases.docs(spark, rows))).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    texts = [(i, hpylm.WORDS.findall((t or "").translate(hpylm.ASCII_LOWER)) + [None]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in texts if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    wanted = sorted((repr(i), not held(i), len(t), sum(c[w] > 0 for w in t), n,
                     round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for i, t in texts)
    assert sorted((repr(r.doc_id), r.train, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == wanted
    assert all(r.score < 0 for r in out)


def test_probabilities_of_a_context_sum_to_one(spark):
    rows = [(k, cases.prose(k % 7, 30, 12)) for k in range(40)]
    words = sorted({w for _, t in rows for w in t.split()})
    probe = [(1000 + k, f"{words[0]} {w}") for k, w in enumerate([*words, "never-seen"])] + [(2000, words[0])]
    docs = cases.docs(spark, rows + probe).select("doc_id", "text", (F.col("doc_id") < 1000).alias("train"))
    model = hpylm.Model(docs)

    def sums(b, answers, stats):
        sent = {}
        for batch, (_, p, _) in b.answered(answers, stats, 1):
            sent.setdefault(batch, []).extend(np.frombuffer(p, np.float32))
        order = np.concatenate([b.cell_of])
        p = dict(zip(order.tolist(), np.concatenate(list(sent.values())).tolist(), strict=True))
        for cell, x in p.items():
            yield int(b.contexts[b.context_of[cell]]), x

    total = model._buckets(sums).filter(lambda r: r[0] == hpylm.word_hash(words[0])).map(lambda r: r[1]).sum()
    assert abs(total - 1) < 1e-4


def test_held_out_text_is_likelier_than_by_the_base(spark):
    source = cases.prose(3, 300, 50).split()
    rows = [(k, " ".join(source[(k * 7) % 200:(k * 7) % 200 + 60])) for k in range(150)]
    out = hpylm.language_scores(marked(cases.docs(spark, rows))).where("NOT train").collect()
    assert out and sum(r.score for r in out) > 0.6 * sum(r.base_score for r in out)


def test_empty_table_and_no_training(spark):
    assert hpylm.language_scores(marked(cases.empty(spark))).count() == 0
    docs = cases.docs(spark, [(1, "a b"), (2, None)]).select("doc_id", "text", F.lit(False).alias("train"))
    out = {r.doc_id: r for r in hpylm.language_scores(docs).collect()}
    assert out[1].n_tokens == 3 and out[1].n_known == 0 and out[1].train_tokens == 0 and out[1].score == 0.0


def batched(monkeypatch, texts, tokens=10**9):
    """Rows that ``batches_of`` makes of the texts, in two slices of one array."""
    monkeypatch.setattr(hpylm, "BATCH_TOKENS", tokens)
    monkeypatch.setattr(hpylm, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    n = len(texts)
    whole = pa.record_batch({"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts, pa.string()), "train": pa.array([True] * n)})
    return [tuple(c[0].as_py() for c in r.columns) for r in hpylm.batches_of(iter([whole.slice(0, n // 2), whole.slice(n // 2)]))]


def test_batches_hold_the_words_of_each_text(monkeypatch):
    texts = [t for _, t in cases.odd_rows()] + [" A b\u00c4 \t\x0bA ", "", None, "x\u00a0y"]
    wanted = [hpylm.WORDS.findall((t or "").translate(hpylm.ASCII_LOWER)) for t in texts]
    for tokens in (1, 7, 10**9):
        rows = batched(monkeypatch, texts, tokens)
        assert [i for r in rows for i in r[1]] == list(range(len(texts)))
        got = []
        for r in rows:
            b = hpylm.Batch(r)
            assert len(b.tokens) < tokens + b.lengths[-1]
            got += [b.hashes[b.tokens[a:a + k]].tolist() for a, k in zip(b.starts, b.lengths, strict=True)]
        assert got == [[*map(hpylm.word_hash, words), hpylm.END] for words in wanted]


def test_batching_takes_less_time_than_a_lookup_for_every_word(monkeypatch):
    texts = [cases.prose(k % 50, 2000, 5000) for k in range(300)]
    t = time.process_time()
    known = {}
    for x in texts:
        np.fromiter((known.setdefault(w, len(known)) for w in hpylm.WORDS.findall(x.translate(hpylm.ASCII_LOWER))), np.int64)
    by_word = time.process_time() - t
    t = time.process_time()
    assert batched(monkeypatch, texts)
    assert time.process_time() - t < 0.8 * by_word


def test_bucket_adds_up_the_cells_of_all_batches():
    rng = np.random.default_rng(5)
    wanted, records = Counter(), []
    for batch in range(4):
        heads = np.sort(rng.choice(20, 8, False)).astype(np.uint64) * np.uint64(10**15)
        sizes, words = rng.integers(1, 6, 8).astype(np.int32), []
        for u, k in zip(heads, sizes, strict=True):
            words += (rng.choice(15, k, False).astype(np.uint64) * np.uint64(3 * 10**15)).tolist()
        counts = rng.integers(0, 4, len(words)).astype(np.int32)
        for u, w, c in zip(np.repeat(heads, sizes).tolist(), words, counts.tolist(), strict=True):
            wanted[u, w] += c
        records.append(("cells", batch, hpylm.narrow(heads), hpylm.pressed(sizes), hpylm.narrow(np.array(words, np.uint64)), hpylm.pressed(counts)))
    b = hpylm.Bucket(0, records, 3, np.zeros(0, np.uint64))
    cells = list(zip(b.contexts[b.context_of].tolist(), b.words[b.word_of].tolist(), strict=True))
    assert cells == sorted(wanted) and b.c.tolist() == [wanted[x] for x in cells]
    sent = [(u, w) for r in b.sent for u, w in zip(np.repeat(hpylm.wide(r[2]), hpylm.loosed(r[3], np.int32)).tolist(), hpylm.wide(r[4]).tolist(), strict=True)]
    assert [cells[k] for k in b.cell_of] == sent
