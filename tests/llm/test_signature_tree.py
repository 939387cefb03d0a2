import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from shoplens.llm import signature_tree as st

from . import cases


def shingles(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(s), least.get(find(k))) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def copies(seed, groups, size, words, edits):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        text = cases.prose(seed * 100 + g, words).split()
        for _ in range(size):
            t = list(text)
            for _ in range(rng.randrange(edits + 1)):
                t[rng.randrange(len(t))] = f"e{rng.random()}"
            rows.append((len(rows) + 50, " ".join(t)))
    return rows


def result(out):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in out.collect())


def test_odd_rows_against_brute_force(spark):
    rows = cases.odd_rows()
    assert result(st.jaccard_components(cases.docs(spark, rows))) == brute(rows)


def test_near_copies_against_brute_force(spark):
    rows = copies(1, 6, 25, 90, 4) + [(i + 5000, t) for i, t in copies(2, 5, 8, 12, 2)]
    assert result(st.jaccard_components(cases.docs(spark, rows))) == brute(rows)


def test_small_blocks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(st, "BLOCK", 7)
    rows = copies(3, 3, 40, 90, 5)
    assert result(st.jaccard_components(cases.docs(spark, rows))) == brute(rows)


@pytest.mark.parametrize("seed", range(4))
def test_trees_find_all_pairs(seed):
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = []
    for _ in range(60):
        base = np.unique(rng.choice(pool, rng.integers(3, 60)))
        sets.append(base)
        sets.append(np.unique(np.concatenate([base[rng.random(len(base)) < 0.95], rng.integers(0, 2**63, 2).astype(np.uint64)])))
    truth = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if st.linked(sets[i], sets[j])}
    exact = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
             if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert truth == exact and truth
    block = pd.DataFrame({"gid": range(len(sets)), "grams": [s.tobytes() for s in sets]})

    def groups(pairs):
        up = list(range(len(sets)))

        def find(i):
            while up[i] != i:
                i = up[i]
            return i

        for i, j in pairs:
            up[find(i)] = find(j)
        return {frozenset(i for i in range(len(sets)) if find(i) == find(k)) for k in range(len(sets))}

    links = {tuple(sorted(p)) for p in st.tree_links(block).to_numpy().tolist()}
    assert links <= truth and groups(links) == groups(truth)
    # two sides: links across are found, labels count as links
    side = np.arange(len(sets)) % 2
    links = {tuple(sorted(p)) for p in st.tree_links(block.assign(side=side)).to_numpy().tolist()}
    assert links <= truth and groups(links) == groups({(i, j) for i, j in truth if side[i] != side[j]})
    label = np.array([min(min(g) for g in groups(truth) if i in g) for i in range(len(sets))])
    assert st.tree_links(block.assign(label=label)).empty


def test_components_of_a_long_path(spark):
    edges = spark.range(200).selectExpr("id + 1 AS a", "id AS b").union(spark.createDataFrame([(1000, 1001)], "a bigint, b bigint"))
    out = {r.gid: r.label for r in st.components(edges).collect()}
    assert out == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}


def test_one_of_each(spark):
    rows = cases.odd_rows() + copies(4, 3, 10, 60, 2)
    docs = cases.docs(spark, rows)
    kept = st.one_of_each(docs)
    assert kept.columns == docs.columns
    groups = brute(rows)
    ids = Counter(r.doc_id for r in kept.collect())
    wanted = Counter({i: 1 for i, n, c in groups if n and i == c}) + Counter(i for i, t in rows if not shingles(t))
    assert {i: k for i, k in ids.items() if i is not None} == {i: k for i, k in wanted.items() if i is not None}


def test_empty_table(spark):
    assert st.jaccard_components(cases.empty(spark)).count() == 0
    assert st.one_of_each(cases.empty(spark)).count() == 0
