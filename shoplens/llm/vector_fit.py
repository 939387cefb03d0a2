"""Packing documents into sequences by vector best-fit.

A sequence (bin) has three capacities: tokens, documents, and attention cost
(the sum of squared lengths).  A document is tokenized where it lies; one that
is longer than a sequence is cut into whole sequences and a last piece.  A
piece of ``l`` tokens demands the vector ``(l, 1, l * l)``, so all that packing
needs to know of a corpus is how many pieces have each length: one row for each
possible length, whatever the number of documents.

Pieces are placed longest first.  Among the open bins that every constraint
lets take the piece, the one is chosen whose residual vector (each residual as
a share of its capacity) has the least weighted norm afterwards (``norm``), or
the greatest weighted dot product with the piece's demand (``dot``); a new bin
is opened when there is none.  Bins of equal contents are held as one class
(a run of bin numbers), so pieces of equal length are placed many at a time and
the whole corpus is packed as one, not task by task.  The plan is a small table
of runs: pieces ``low .. high - 1`` of a length go to bins from ``bin`` on, at
``offset``.

Every stored partition numbers its own pieces of each length; the counts by
partition and length give the number of a piece among all of its length,
without a sort.  A length that a third of all pieces have is spread like any
other.

Defined results: null counts as empty, and an empty text has the end id only;
null ids are kept; rows of equal id are packed each by itself (with equal
doc_id and piece); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.common import broadcast_if, kept, lean, stored, table
from shoplens.llm.word_ids import WordEncoder, chunks, public_tokenizer

END_ID = 0
MAX_TOKENS = 2048
# Weights of the residual tokens, documents and attention cost in a choice; by
# default the tokens decide and the others break ties.
WEIGHTS = (1.0, 1e-8, 1e-8)
# Counts by partition and length beyond this many rows are joined by a shuffle.
MAX_BROADCAST_ROWS = 500_000

PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                   ("task", pa.int32()), ("nth", pa.int64()), ("ids", pa.binary())])


def plan(counts: dict[int, int], max_tokens: int = MAX_TOKENS, max_docs: int | None = None, max_cost: int | None = None,
         rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> tuple[list[tuple[int, ...]], int]:
    """Runs ``(length, low, high, bin, per_bin, offset)`` and the number of bins:
    piece ``n`` of a length, ``low <= n < high``, goes to bin ``bin + (n - low)
    // per_bin`` at ``offset + (n - low) % per_bin * length``.

    ``counts`` has the number of pieces by length.
    """
    full = np.array([max_tokens, max_docs or max_tokens, max_cost or max_tokens ** 2], np.int64)
    share = np.array(weights) / full ** 2 if rule == "norm" else np.array(weights) / full
    left, first, n = np.empty((0, 3), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    runs, bins = [], 0
    for length in sorted(counts, reverse=True):
        want = np.array([length, 1, length * length], np.int64)
        if (want > full).any() or length < 1:
            raise ValueError(f"a piece of {length} tokens does not fit an empty sequence")
        placed, end = 0, counts[length]
        while placed < end:
            fits = np.flatnonzero((left >= want).all(axis=1))
            if len(fits):
                free = left[fits]
                score = ((free - want) ** 2 @ share) if rule == "norm" else -(free * (want / full) @ share)
                at = fits[np.argmin(score)]
            else:  # a class of empty bins, as many as it takes
                at, most = len(left), int((full // want).min())
                new = -(-(end - placed) // most)
                left, first, n = np.vstack([left, full]), np.append(first, bins), np.append(n, new)
                bins += new
            # by the norm a bin that has just taken a piece is the best for the next
            per_bin = int((left[at] // want).min()) if rule == "norm" or not len(fits) else 1
            per_bin = min(per_bin, end - placed)
            k = min(int(n[at]), (end - placed) // per_bin)
            runs.append((length, placed, placed + k * per_bin, int(first[at]), per_bin, int(full[0] - left[at, 0])))
            placed += k * per_bin
            if k < n[at]:  # the class is split
                left, first, n = np.vstack([left, left[at] - want * per_bin]), np.append(first, first[at]), np.append(n, k)
                first[at], n[at] = first[at] + k, n[at] - k
            else:
                left[at] -= want * per_bin
        keep = (left >= 1).all(axis=1)
        left, first, n = left[keep], first[keep], n[keep]
    return runs, bins


def token_pieces(docs: DataFrame, tokenizer: str, max_piece: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Stored pieces of every document: ``doc_id, piece, start, length, ids``
    (little-endian unsigned 32-bit), the ``task`` that wrote it and its number
    ``nth`` among the task's pieces of its length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(f"ids of {tokenizer}", lambda: WordEncoder(tokenizer, end_id))
        task, seen = TaskContext.get().partitionId(), np.zeros(max_piece + 1, np.int64)
        for b in chunks(batches):
            made, sizes = encoder.encode_all(b.column("text"), end_id)
            pieces = -(-sizes // max_piece)
            doc = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * max_piece
            length = np.minimum(sizes[doc] - start, max_piece)
            order = np.argsort(length, kind="stable")
            have = np.bincount(length, minlength=max_piece + 1)
            nth = np.empty(len(doc), np.int64)
            nth[order] = np.arange(len(doc)) - np.repeat(np.cumsum(have) - have, have) + np.repeat(seen, have)
            seen += have
            offsets = np.concatenate([[0], np.cumsum(length) * 4]).astype(np.int32 if len(made) < 1 << 29 else np.int64)
            kind = pa.binary() if offsets.dtype == np.int32 else pa.large_binary()
            ids = pa.Array.from_buffers(kind, len(doc), [None, pa.py_buffer(offsets), pa.py_buffer(made.astype("<u4"))])
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                pa.array(np.full(len(doc), task, np.int32)), pa.array(nth), ids.cast(pa.binary())], schema=PIECE)

    made = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        lean(cut), "doc_id bigint, piece int, start bigint, length bigint, task int, nth bigint, ids binary")
    return stored(made, "pieces")


def pack(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, max_docs: int | None = None, max_cost: int | None = None,
         rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS, end_id: int = END_ID) -> DataFrame:
    """Every piece of ``docs`` (doc_id, text) with its token ids and its place:
    ``doc_id, piece, start, length, ids, sequence_id, offset``.

    No sequence holds more than ``max_tokens`` tokens, ``max_docs`` pieces or
    ``max_cost`` of attention (both unbounded by default: tokens bound them).
    Pieces are as long as the tokens and the attention cost let them be.
    """
    spark = docs.sparkSession
    longest = min(max_tokens, math.isqrt(max_cost) if max_cost else max_tokens)
    if longest < 1:
        raise ValueError("a sequence must have room for a token")
    pieces = token_pieces(docs, tokenizer, longest, end_id)
    by_task = stored(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    # one row for each possible length
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan(counts, max_tokens, max_docs, max_cost, rule, weights)
    column = [np.array(c, np.int64) for c in zip(*runs, strict=True)] or [np.empty(0, np.int64)] * 6
    # runs in order of length and number
    order = np.lexsort((column[1], column[0]))
    lengths, lows, _, bins, per_bin, offsets = (c[order] for c in column)
    sent = spark.sparkContext.broadcast((lengths, lows, bins, per_bin, offsets))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        lengths, lows, bins, per_bin, offsets = sent.value
        # runs of a length are found first, then the run that holds the number
        base = np.searchsorted(lengths, np.arange(longest + 2))
        at, n = np.empty(len(length), np.int64), number.to_numpy()
        by_length = length.to_numpy()
        for one in np.unique(by_length):
            mine = by_length == one
            at[mine] = base[one] + np.searchsorted(lows[base[one]:base[one + 1]], n[mine], "right") - 1
        past = n - lows[at]
        return pd.DataFrame({"sequence_id": bins[at] + past // per_bin[at], "offset": offsets[at] + past % per_bin[at] * by_length})

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "starts")
    placed = pieces.join(broadcast_if(starts, MAX_BROADCAST_ROWS), ["task", "length"])
    return (placed.withColumn("place", place("length", F.col("before") + F.col("nth")))
            .select("doc_id", "piece", "start", "length", "ids", "place.sequence_id", "place.offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: ``sequence_id, n_tokens, ids`` (little-endian
    unsigned 32-bit, in order of offset) and ``parts`` (doc_id, piece, offset,
    length), one row each; a group is no longer than a sequence."""
    part = F.struct("offset", "doc_id", "piece", "length", "ids")
    return (packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
            .select("sequence_id", F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, p: n + p["length"]).alias("n_tokens"),
                    F.aggregate("parts", F.lit(b""), lambda made, p: F.concat(made, p["ids"])).alias("ids"),
                    F.transform("parts", lambda p: F.struct(p["doc_id"], p["piece"], p["offset"], p["length"])).alias("parts")))


def op12_vector_fit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, public_tokenizer()).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
