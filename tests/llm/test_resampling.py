import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from shoplens.llm import resampling

from . import cases

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, max_n=2):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i:i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, k=10_000, min_words=20):
    bucket = lambda g: zlib.crc32(g.encode()) % k
    s = Counter(bucket(g) for _, t in rows for g in grams(t)[1])
    b = Counter(bucket(g) for t in target for g in grams(t)[1])
    s_all, b_all = sum(s.values()), sum(b.values())
    gain = lambda x: math.floor(1000 * math.log((b[x] + 1) * (s_all + k) / ((s[x] + 1) * (b_all + k))))
    out, open_ = [], []
    for doc_id, text in rows:
        n, g = grams(text)
        weight = sum(gain(bucket(x)) for x in g) // len(g) if g else 0
        h = int(sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32)))
        out.append((doc_id, len(g), weight, score))
        if n >= min_words:
            open_.append((-score, doc_id is not None, doc_id or 0, len(g)))
    ranks = {}
    for rank, (s_, has, i, n) in enumerate(sorted(open_)[:25 * len(open_) // 100], 1):
        ranks.setdefault((i if has else None, n, -s_), []).append(rank)
    return Counter((i, n, w, s_, ranks[(i, n, s_)].pop(0) if ranks.get((i, n, s_)) else None) for i, n, w, s_ in out)


def target(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id bigint, text string").withColumn("weight", F.lit("x"))


ODD = ["", " ", "...", "a", "a b", " a  b ", "A-b_C", "é É ß", "x\x00y\x7fz", "12 3a a3", "漢字 b", "a\n\tb\r\nc", "\x80\x85\xa0 q"]


@pytest.mark.parametrize("max_n", [1, 2, 3])
def test_spans(max_n):
    for text in [*ODD, " ".join(ODD), cases.prose(1, 500)]:
        got = resampling.spans(text.encode(), resampling.scanners(max_n))
        assert len(got[0]) == grams(text)[0] and [g.decode() for n in got for g in n] == grams(text, max_n)[1], text


def test_odd_rows_against_brute_force(spark):
    rows = cases.odd_rows() + [(50 + k, t) for k, t in enumerate(ODD)] + [(200 + k, cases.prose(k, 15 + k)) for k in range(40)]
    wanted = [cases.prose(3, 200), None, "", cases.prose(8, 50)]
    out = resampling.resample(cases.docs(spark, rows).repartition(5), target(spark, wanted))
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in out.collect()) == brute(rows, wanted)


def test_repeated_rows_and_ties_take_adjacent_ranks(spark):
    text = cases.prose(2, 30)
    rows = [(5, text)] * 8 + [(6, text)] * 4
    out = resampling.resample(cases.docs(spark, rows), target(spark, [text])).collect()
    assert sorted(r.rank for r in out if r.rank) == [1, 2, 3]
    best = max(r.score for r in out)
    assert all(r.score == best for r in out if r.rank)


@pytest.mark.parametrize("wanted", [[], [None, ""]])
def test_empty_tables(spark, wanted):
    rows = cases.odd_rows()
    out = resampling.resample(cases.docs(spark, rows), target(spark, wanted)).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in out) == brute(rows, wanted)
    none = resampling.resample(cases.empty(spark), target(spark, wanted))
    assert none.count() == 0 and none.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]


def test_texts_like_the_target_weigh_more(spark):
    near, far = [cases.prose(k, 60, 30) for k in range(60)], [cases.prose(k, 60).replace("w", "q") for k in range(60)]
    out = resampling.resample(cases.docs(spark, list(enumerate(near + far))), target(spark, [cases.prose(99, 2000, 30)])).collect()
    assert sum(r.rank is not None for r in out) == 30
    assert min(r.weight for r in out if r.doc_id < 60) > max(r.weight for r in out if r.doc_id >= 60)
