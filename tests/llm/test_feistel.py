import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shoplens.llm import feistel

from . import cases


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 12, 97, 1000])
def test_permutation_and_cycle_walk(spark, n):
    got = [r[0] for r in spark.range(n).select(feistel.position(F.col("id"), n, 99).alias("p")).collect()]
    assert sorted(got) == list(range(n))
    assert got == [feistel.position_of(i, n, 99) for i in range(n)]


def test_odd_rows_against_brute_force(spark):
    rows = cases.odd_rows()
    out = feistel.feistel_shards(cases.docs(spark, rows), n_shards=4, seed=5).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter(
        (i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted(r.row_number for r in out) == list(range(len(rows)))
    in_order = [r.doc_id for r in sorted(out, key=lambda r: r.row_number)]
    assert in_order == sorted(in_order, key=lambda i: (i is not None, i))
    for r in out:
        assert feistel.position_of(r.row_number, len(rows), 5) == r.slot * 4 + r.shard and r.law == "rows" and r.grown_shard is None
    per_shard = Counter(r.shard for r in out)
    assert max(per_shard.values()) - min(per_shard.values()) <= 1


def test_empty_table(spark):
    out = feistel.feistel_shards(cases.empty(spark))
    assert out.count() == 0 and out.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
