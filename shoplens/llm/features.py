"""Text features the classifiers share, and the bounded labelled sample they
are trained on.

A text becomes hashed words (log counts, scaled to length one) and structure
statistics.  Neither the label table nor ``lang``, ``source`` or ``doc_id`` is
an input.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BUCKETS = 1 << 15
# Rows of a classifier's training sample, and the longest text in it.
MAX_SAMPLE = 6000
MAX_SAMPLE_CHARS = 200_000
# Words a Python worker remembers the bucket of.
MAX_CACHE = 500_000

# byte classes: upper, lower, digit, space, line feed, sentence mark, symbol, beyond ASCII
_CLASS = np.full(256, 7, np.uint8)
for _chars, _k in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0), ("abcdefghijklmnopqrstuvwxyz", 1), ("0123456789", 2), (" \t\r\x0b\x0c", 3),
                   ("\n", 4), (".,;:'\"?()-", 5)):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[[b for b in range(128) if _CLASS[b] == 7]] = 6
N_STATS = 15


class Buckets(dict):
    """word -> hash bucket, remembering a bounded number of words."""

    def __init__(self, n: int = WORD_BUCKETS):
        super().__init__()
        self.n = n

    def __missing__(self, word: str) -> int:
        k = xxhash.xxh64_intdigest(word) % self.n
        if len(self) < MAX_CACHE:
            self[word] = k
        return k


def statistics(text: str, ids: np.ndarray, n_distinct: int) -> np.ndarray:
    """Structure of a text: sizes, shares of character classes, repetition.
    ``ids`` are the words' buckets in order."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kinds = _CLASS[data]
    n, m = max(1, len(data)), max(1, len(ids))
    share = np.bincount(kinds, minlength=8) / n
    gap = np.concatenate([[True], (kinds == 3) | (kinds == 4), [True]])
    alone = (gap[:-2] & ~gap[1:-1] & gap[2:]).sum()
    lines = [x for x in text.split("\n") if x.strip()]
    letters = max(1e-9, share[0] + share[1] + share[7])
    return np.array([
        np.log1p(len(text)), np.log1p(len(ids)), np.log1p(len(lines)), n / m / 10,
        share[0] / letters, share[2], share[4] * 50, share[5], share[6],
        n_distinct / m, len(set(lines)) / max(1, len(lines)), (ids[1:] == ids[:-1]).sum() / m,
        text.count("|") / m, text.count("!") / m, alone / m,
    ])


def featurize(text: str | None, buckets: Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word buckets, their weights, statistics) of a whole text."""
    text = text or ""
    low = text.lower().split()
    every = np.fromiter(map(buckets.__getitem__, low), np.int32, len(low))
    if not low:
        return every, np.zeros(0), statistics(text, every, 0)
    ids, counts = np.unique(every, return_counts=True)
    weights = np.log1p(counts)
    return ids, weights / np.sqrt((weights * weights).sum()), statistics(text, every, len(ids))


def fold(modulus: int, id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_SAMPLE) -> DataFrame:
    """(doc_id, text, label) of at most ``max_rows`` labelled documents, those
    whose id has the least hash; rows without id or label, labels of absent
    documents, and (as the sample is held in one place) documents of more than
    ``MAX_SAMPLE_CHARS`` characters are passed over before the choice."""
    usable = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= MAX_SAMPLE_CHARS)
    chosen = (labels.select("doc_id", F.col(label).alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
              .join(usable.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    # a repeated id counts once, with its least text
    return (usable.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")))
