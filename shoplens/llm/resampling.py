"""Importance resampling of documents towards a target's n-grams.

A text is lower-cased (A-Z), its separators are collapsed to single spaces, and
a regular expression for each n, scanned with overlapping matches and bounded by
look-arounds, emits the spans of all runs of n consecutive words; the unsigned
CRC-32 of a span's UTF-8 bytes, modulo the number of buckets, is its feature.
Separators are ASCII, so the scan works on the UTF-8 bytes themselves.

Bucket counts of documents and target are pre-aggregated in each task, so a
frequent bucket costs one row a task; only the counts by bucket (a fixed number)
reach the driver, where each bucket gets its gain.  A document's weight is the
floored mean gain of its features; with Gumbel noise that its id fixes, the
documents of the highest scores are a sample without replacement in proportion
to importance.  Ranks come from row numbers over range partitions.

Defined results: null or empty texts, and texts without words, have no features
and weight 0; a null id draws its noise as the text ``7:``; rows of equal id
have equal noise, and of equal score too they take adjacent ranks; an empty
target leaves gains to the smoothing; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from operator import methodcaller

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import row_numbers, stored, table

BUCKETS = 10_000
MAX_N = 2
MIN_WORDS = 20
SHARE = (25, 100)
SEED = 7

# ASCII bytes that are no word characters (0-9, A-Z and a-z are,
# as is every byte of a letter beyond ASCII).
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
_FOLD = bytes.maketrans(SEPARATORS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(SEPARATORS) + b"abcdefghijklmnopqrstuvwxyz")

FEATURES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.binary())])


def scanners(max_n: int) -> list[regex.Pattern]:
    """One pattern for each n: n words between single spaces, both ends bounded."""
    return [regex.compile(rb"(?<![^ ])[^ ]++" + rb" [^ ]++" * (n - 1) + rb"(?![^ ])") for n in range(1, max_n + 1)]


def spans(text: bytes, patterns: list[regex.Pattern]) -> list[list[bytes]]:
    """The n-grams of a text (UTF-8), in order, by n."""
    folded = regex.sub(rb"  +", b" ", text.translate(_FOLD)).strip(b" ")
    gram = methodcaller("group")
    return [[*map(gram, p.finditer(folded, overlapped=True))] for p in patterns]


def bucket_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_n: int = MAX_N,
                    buckets: int = BUCKETS) -> DataFrame:
    """Stored ``doc_id, n_words, n_features, buckets`` of every row (buckets: one
    little-endian unsigned 32-bit number for each feature)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = scanners(max_n)
        for b in batches:
            n_words, n_features, found = [], [], []
            for text in b.column("text"):
                grams = spans(text.as_buffer().to_pybytes() if text.is_valid else b"", patterns)
                hashes = [np.fromiter(map(zlib.crc32, g), np.uint32, len(g)) for g in grams]
                n_words.append(len(grams[0]))
                n_features.append(sum(map(len, grams)))
                found.append((np.concatenate(hashes) % buckets).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()),
                                              pa.array(found, pa.binary())], schema=FEATURES)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(scan, "doc_id bigint, n_words bigint, n_features bigint, buckets binary"), "features")


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features lie in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for found in b.column("buckets"):
                total += np.bincount(np.frombuffer(found.as_buffer(), "<u4"), minlength=buckets)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(total[has])], ["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    for r in features.select("buckets").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of smoothed target and source shares, floored."""
    k, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(t + 1) * float(s_all + k)) / (float(s + 1) * float(t_all + k))))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel number that the id fixes, floored."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, min_words: int = MIN_WORDS, max_n: int = MAX_N,
             buckets: int = BUCKETS, seed: int = SEED, target_id: str = "item_id") -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with ``n_words, n_features, weight,
    score`` and its ``rank`` in the draw (null: not drawn).

    Of the rows with at least ``min_words`` words, ``share[0] / share[1]`` of
    their number (floored) are drawn.
    """
    spark = docs.sparkSession
    features = bucket_features(docs, max_n=max_n, buckets=buckets)
    wanted = bucket_features(target, id_col=target_id, max_n=max_n, buckets=buckets)
    gain = spark.sparkContext.broadcast(gains(bucket_counts(features, buckets), bucket_counts(wanted, buckets)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weight = []
            for found in b.column("buckets"):
                g = gain.value[np.frombuffer(found.as_buffer(), "<u4")]
                weight.append(int(g.sum()) // len(g) if len(g) else 0)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    weighed = (features.mapInArrow(weigh, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
               .withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    scored = stored(weighed, "scores")
    open_ = scored.where(F.col("n_words") >= min_words).withColumn("falling", -F.col("score"))
    ranked, n = row_numbers(open_, ["falling", "doc_id", "n_features", "weight", "n_words"], "ranks")
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    return (ranked.select(*columns, F.when(F.col("row") < share[0] * n // share[1], F.col("row") + 1).cast("bigint").alias("rank"))
            .unionByName(scored.where(F.col("n_words") < min_words).select(*columns, F.lit(None).cast("bigint").alias("rank"))))


def op13_resampling(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")).drop("n_words")


# CRC-32 by its table of 256 remainders (each by the rule: eight shifts, XOR with
# the reversed polynomial where a one falls out), over the distinct features.
ORACLE = r"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
texts AS (
  SELECT 'd' AS kind, row_number() OVER () AS n, doc_id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), item_id, text FROM benchmark),
worded AS (
  SELECT kind, n, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
grams AS (
  SELECT kind, n, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram FROM worded),
counted AS (SELECT kind, n, gram, count(*) AS c FROM grams GROUP BY ALL),
features AS (SELECT DISTINCT gram FROM counted),
bytes AS (
  SELECT gram, list_transform(range(len(hex(encode(gram))) // 2), lambda i: ('0x' || substring(hex(encode(gram)), 2 * i + 1, 2))::BIGINT) AS b FROM features),
hashed AS (
  SELECT gram, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda x, y: xor(x >> 8, t[xor(x % 256, y) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM bytes, crc_table),
placed AS (SELECT kind, n, bucket, c FROM counted JOIN hashed USING (gram)),
per_bucket AS (
  SELECT k.bucket, coalesce(sum(c) FILTER (kind = 'd'), 0)::BIGINT AS s, coalesce(sum(c) FILTER (kind = 'b'), 0)::BIGINT AS t
  FROM range(10000) k(bucket) LEFT JOIN placed USING (bucket) GROUP BY k.bucket),
gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g
  FROM per_bucket),
summed AS (
  SELECT n, sum(c * g)::BIGINT AS total, sum(c)::BIGINT AS k FROM placed JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY n),
weighed AS (
  SELECT n, doc_id, len(w) AS n_words, coalesce(k, 0)::BIGINT AS n_features,
    coalesce(CASE WHEN total >= 0 THEN total // k ELSE -((-total + k - 1) // k) END, 0)::BIGINT AS weight
  FROM worded LEFT JOIN summed USING (n) WHERE kind = 'd'),
scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substring(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM weighed),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_words >= 20) AS of_all
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 25 * of_all // 100 THEN r END::BIGINT AS rank FROM ranked
"""
