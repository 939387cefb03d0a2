"""Tables kept by key: only touched buckets move (K1, J5, R1s)."""

from __future__ import annotations

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from shoplens.operators import upsert as U
from shoplens.sources.keyed_table import KeyedTable

SCHEMA = "id string, part string, at long, v string"
KEYS, ORDER = ["id", "part"], ["at", "v"]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def brute(stored, batch, keep_newer=True):
    held = {(r[0], r[1]): r for r in stored}
    last = {}
    for r in batch:
        if r[0] and r[1] and (r[2:] >= last.get((r[0], r[1]), r)[2:]):
            last[(r[0], r[1])] = r
    for k, r in last.items():
        if not (keep_newer and k in held and held[k][2:] > r[2:]):
            held[k] = r
    return sorted(held.values())


def some_rows(seed, n, ids=40):
    rng = random.Random(seed)
    return [(rng.choice(["", None]) if rng.random() < 0.1 else f"k{rng.randrange(ids)}", rng.choice("ab"), rng.randrange(50), f"v{rng.randrange(1000)}") for _ in range(n)]


def files(table):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(os.path.join(table.data, "kb=*", "*.parquet"))}


@pytest.mark.parametrize("limit", [U.MAX_BROADCAST_KEYS, 0])
@pytest.mark.parametrize("keep_newer", [True, False])
def test_upsert_against_brute_force(spark, monkeypatch, limit, keep_newer):
    monkeypatch.setattr(U, "MAX_BROADCAST_KEYS", limit)
    stored = brute([], some_rows(1, 60))
    for seed in (2, 3):
        batch = some_rows(seed, 80)
        t = spark.createDataFrame(stored, SCHEMA)
        out = U.upsert(t, spark.createDataFrame(batch, SCHEMA), KEYS, ORDER, keep_newer)
        assert rows_of(out) == brute(stored, batch, keep_newer)
    assert rows_of(U.upsert(t, t.limit(0), KEYS, ORDER)) == stored
    assert rows_of(U.upsert(t.limit(0), t, KEYS, ORDER)) == stored


def test_target_rows_are_not_shuffled(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t")
    spark.range(5000).select(F.col("id").cast("string"), F.lit("a").alias("part"), F.col("id").alias("at"), F.lit("x").alias("v")).write.parquet(path)
    out = U.upsert(spark.read.parquet(path), spark.createDataFrame([("7", "a", 9999, "new")], SCHEMA), KEYS, ORDER)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortAggregate" not in plan and "BroadcastHashJoin" in plan
    assert out.count() == 5000 and out.where("v = 'new'").count() == 1


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_dir):
    table = KeyedTable(spark, os.path.join(tmp_dir, "t"), KEYS, ORDER, buckets=32)
    assert table.read() is None
    first = [(f"k{i}", "a", 1, "x") for i in range(2000)]
    assert table.upsert(spark.createDataFrame(first, SCHEMA)) == list(range(32))
    before = files(table)
    batch = [(f"k{i}", "a", 2, "y") for i in range(4)] + [("new", "a", 1, "z"), ("k9", "a", 0, "late"), (None, "a", 5, "no key")]
    touched = table.upsert(spark.createDataFrame(batch, SCHEMA))
    after = files(table)
    changed = {f.split("kb=")[1].split("/")[0] for f in before.keys() ^ after.keys()}
    assert len(touched) <= 6 and changed <= {str(b) for b in touched}
    assert all(after[f] == t for f, t in before.items() if f in after)
    assert rows_of(table.read()) == brute(first, batch)
    assert rows_of(table.lookup(id="k2", part="a")) == [("k2", "a", 2, "y")] and rows_of(table.lookup(id="k9", part="a")) == [("k9", "a", 1, "x")]
    assert table.lookup(id="none", part="a").count() == 0


def test_replayed_and_torn_batches(spark, tmp_dir):
    table = KeyedTable(spark, os.path.join(tmp_dir, "t"), KEYS, ORDER, buckets=8)
    one, two = some_rows(5, 100), some_rows(6, 100)
    table.upsert(spark.createDataFrame(one, SCHEMA), 0)
    table.upsert(spark.createDataFrame(two, SCHEMA), 1)
    whole = brute(brute([], one), two)
    assert rows_of(table.read()) == whole
    # the writer was lost while buckets were put in place: some are missing
    gone = sorted(files(table))[:3]
    for f in gone:
        os.remove(f)
        crc = os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")
        if os.path.exists(crc):
            os.remove(crc)
    table.upsert(spark.createDataFrame(two, SCHEMA), 1)
    assert rows_of(table.read()) == whole


def test_batches_without_rows(spark, tmp_dir):
    table = KeyedTable(spark, os.path.join(tmp_dir, "t"), KEYS, ORDER)
    none = spark.createDataFrame([], SCHEMA)
    assert table.upsert(none, 0) == [] and table.read() is None
    table.upsert(spark.createDataFrame([("a", "a", 1, "x")], SCHEMA), 1)
    assert table.upsert(spark.createDataFrame([("", "a", 1, "x")], SCHEMA), 2) == []
    assert rows_of(table.read()) == [("a", "a", 1, "x")]
