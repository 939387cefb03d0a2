import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from shoplens.llm import vector_fit, word_ids

from . import cases

PATH = word_ids.public_tokenizer()


def spread(runs):
    """Every piece of a plan: (length, bin, offset)."""
    for length, low, high, first, per_bin, offset in runs:
        for n in range(high - low):
            yield length, first + n // per_bin, offset + n % per_bin * length


def check_plan(runs, bins, counts, max_tokens, max_docs=None, max_cost=None):
    held = defaultdict(list)
    for length, b, offset in spread(runs):
        held[b].append((offset, length))
    assert Counter(l for parts in held.values() for _, l in parts) == Counter(counts)
    assert sorted(held) == list(range(bins))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= max_tokens and len(parts) <= (max_docs or max_tokens) and sum(l * l for _, l in parts) <= (max_cost or max_tokens ** 2)


def one_by_one(counts, max_tokens):
    """Number of bins of best fit, longest piece first, one piece at a time."""
    left = []
    for length in sorted(Counter(counts).elements(), reverse=True):
        open_ = [(r, k) for k, r in enumerate(left) if r >= length]
        if open_:
            left[min(open_)[1]] -= length
        else:
            left.append(max_tokens - length)
    return len(left)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_by_tokens(seed):
    rng = random.Random(seed)
    top = rng.choice([10, 50, 300])
    counts = {l: rng.randrange(1, 30) for l in rng.sample(range(1, top + 1), rng.randrange(1, min(top, 40)))}
    runs, bins = vector_fit.plan(counts, top)
    check_plan(runs, bins, counts, top)
    assert bins == one_by_one(counts, top)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize(("max_docs", "max_cost"), [(3, None), (None, 2500), (4, 3000), (1, None)])
def test_every_constraint_holds(rule, max_docs, max_cost):
    rng = random.Random(7)
    counts = {l: rng.randrange(1, 40) for l in range(1, 48)}
    runs, bins = vector_fit.plan(counts, 100, max_docs, max_cost, rule, (1.0, 0.5, 0.5))
    check_plan(runs, bins, counts, 100, max_docs, max_cost)
    n = sum(counts.values())
    need = max(-(-sum(l * c for l, c in counts.items()) // 100), -(-n // (max_docs or 100)), -(-sum(l * l * c for l, c in counts.items()) // (max_cost or 10_000)))
    assert need <= bins <= 1.4 * need + 2


def test_plan_does_not_grow_with_the_corpus():
    rng = random.Random(1)
    counts = {l: rng.randrange(1, 50) for l in range(1, 2049)}
    runs, _ = vector_fit.plan(counts)
    many, bins = vector_fit.plan({l: c * 1_000_003 for l, c in counts.items()})
    assert len(many) < 3 * len(runs)
    assert bins <= 1.02 * sum(l * c * 1_000_003 for l, c in counts.items()) / 2048 + 1


def test_a_third_of_all_pieces_of_one_length():
    counts = {1: 10 ** 9, 2047: 10, 700: 10 ** 6}
    runs, bins = vector_fit.plan(counts)
    assert bins == -(-sum(l * c for l, c in counts.items()) // 2048) and len(runs) < 20


def test_impossible_piece_is_an_error():
    with pytest.raises(ValueError, match="does not fit"):
        vector_fit.plan({11: 1}, 10)
    assert vector_fit.plan({}) == ([], 0)


def brute(rows, max_tokens):
    tokenizer = Tokenizer.from_file(PATH)
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, vector_fit.END_ID]
        for piece, start in enumerate(range(0, len(ids), max_tokens)):
            part = ids[start:start + max_tokens]
            yield doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())


@pytest.mark.parametrize(("max_tokens", "max_docs", "max_cost", "rule"), [(2048, None, None, "norm"), (64, 3, 1000, "norm"), (64, 3, None, "dot")])
def test_odd_rows_against_brute_force(spark, max_tokens, max_docs, max_cost, rule):
    rows = cases.odd_rows() + [(100 + k, cases.prose(k, 5 + k)) for k in range(40)]
    longest = min(max_tokens, int((max_cost or max_tokens ** 2) ** 0.5))
    packed = vector_fit.pack(cases.docs(spark, rows).repartition(5), PATH, max_tokens, max_docs, max_cost, rule)
    out = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in out) == Counter(brute(rows, longest))
    held = defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
    for parts in held.values():
        parts.sort()
        assert [o for o, _, _ in parts] == np.cumsum([0, *[l for _, l, _ in parts]])[:-1].tolist()
        assert sum(l for _, l, _ in parts) <= max_tokens and len(parts) <= (max_docs or max_tokens)
        assert sum(l * l for _, l, _ in parts) <= (max_cost or max_tokens ** 2)
    made = {r.sequence_id: r for r in vector_fit.sequences(packed).collect()}
    assert {k: b"".join(i for _, _, i in p) for k, p in held.items()} == {k: bytes(r.ids) for k, r in made.items()}
    assert all(r.n_tokens == len(r.ids) // 4 == sum(p.length for p in r.parts) for r in made.values())


def test_shuffled_starts_give_the_same_kind_of_places(spark, monkeypatch):
    monkeypatch.setattr(vector_fit, "MAX_BROADCAST_ROWS", 0)
    rows = [(k, cases.prose(k % 5, 10)) for k in range(60)]
    out = vector_fit.pack(cases.docs(spark, rows).repartition(7), PATH, 50).collect()
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out) == sum(1 for _ in brute(rows, 50))


def test_empty_table(spark):
    out = vector_fit.pack(cases.empty(spark), PATH)
    assert out.count() == 0 and out.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]


def test_query_on_a_whole_table(spark):
    out = vector_fit.op12_vector_fit(spark, "/root/testdata/sf0.001").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(out[columns].itertuples(index=False, name=None)) == Counter(brute(docs, 2048))
    assert out.groupby("sequence_id").length.sum().max() <= 2048
    assert out.sequence_id.nunique() <= 1.02 * out.length.sum() / 2048 + 1
