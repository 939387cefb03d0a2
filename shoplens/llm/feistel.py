"""Sharding by a Feistel permutation of the global row numbers.

Rows are numbered 0 .. n-1 in ascending ``doc_id``; a keyed Feistel network
over ``Z_a x Z_b`` (``a * b`` is the least such product that holds n) maps a
row number to a position, walking the cycle until it lies below n.  Position
``p`` is shard ``p % n_shards``, slot ``p // n_shards``: a reproducible
shuffle whose shard and slot follow from the row number, the row count and the
seed alone, and whose shards differ by one row at most.  Only narrow rows are
sorted; the texts never move.

Defined results: null or empty text has size 1; null ids come first; rows with
equal ids are ordered by their text hash, rows equal in both take adjacent
numbers; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
from math import isqrt

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import row_numbers

ROUNDS = 6
# Walks beyond this many steps stop the job (never seen: each step of a walk
# stays outside with a chance of at most n**-0.5; small tables have no more
# points outside than this).
MAX_WALK = 64


def sides(n: int) -> tuple[int, int]:
    a = max(1, isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _network(x: Column, a: int, b: int, seed: int) -> Column:
    left, right = F.lit(a).cast("bigint"), F.lit(b).cast("bigint")

    def turn(s: Column, k: Column) -> Column:
        mix = lambda v: F.xxhash64(v, k.cast("bigint"), F.lit(seed).cast("bigint"))
        even = F.struct(F.pmod(s["l"] + F.pmod(mix(s["r"]), left), left).alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(mix(s["l"]), right), right).alias("r"))
        return F.when(k % 2 == 0, even).otherwise(odd)

    start = F.struct(F.pmod(x, left).alias("l"), F.floor(x / left).cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["r"] * left + s["l"])


def position(row: Column, n: int, seed: int) -> Column:
    """Position of a row number under the permutation of ``0 .. n-1``."""
    a, b = sides(n)
    first = _network(row, a, b, seed)
    if a * b == n:
        return first
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(min(MAX_WALK, a * b - n))), first,
                         lambda p, _: F.when(p >= n, _network(p, a, b, seed)).otherwise(p))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("Feistel cycle walk did not end")).cast("bigint"))


def position_of(row: int, n: int, seed: int) -> int:
    """The same for one row number, without Spark."""
    a, b = sides(n)

    def mix(v: int, k: int) -> int:
        h = 42
        for part in (v, k, seed):
            h = xxhash.xxh64_intdigest(struct.pack("<q", part), seed=h)
        return h - 2**64 if h >= 2**63 else h

    p = row
    while True:
        l, r = p % a, p // a
        for k in range(ROUNDS):
            if k % 2 == 0:
                l = (l + mix(r, k) % a) % a
            else:
                r = (r + mix(l, k) % b) % b
        p = r * a + l
        if p < n:
            return p


def feistel_shards(docs: DataFrame, n_shards: int = 8, seed: int = 20240601,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its shard and slot (columns below)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("tie"))
    rows, n = row_numbers(narrow, ["doc_id", "tie", "size", "text_crc32"], "rows")
    placed = rows.withColumn("position", position(F.col("row"), max(n, 1), seed))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.pmod("position", F.lit(n_shards).cast("bigint")).cast("int").alias("shard"),
        F.floor(F.col("position") / n_shards).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("row").alias("row_number"))


def op8_feistel_shards(spark, sf_dir):
    from shoplens.llm.common import table
    return feistel_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
