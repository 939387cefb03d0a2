"""Hierarchical Pitman-Yor language model, sampled and scored at corpus scale.

Each context (the word before) is a restaurant whose customers are the tokens
that follow it; all restaurants share one parent, the restaurant of single
words, whose customers are the tables of its children and whose own base is
uniform over the ``V`` known words and one unknown.  A state of the sampler is
the number of tables ``t`` per context and word, and ``s`` per word in the
parent.  Each Gibbs sweep draws every ``t`` from its conditional distribution
given the parent's predictive probabilities and the other tables of its
restaurant (weights: generalised Stirling numbers; above ``STIRLING`` customers
they are reseated one by one), then every ``s``; the sweep is synchronous.
A token's probability is averaged over the states after the first
(``BURN_IN`` states are left out), and a text's score sums their log10.

How it runs: documents are cut into batches of about ``BATCH_TOKENS`` tokens
(kept in one shuffle, read twice).  A batch sends its distinct (context, word)
cells with their training counts to the context's bucket; buckets hold whole
restaurants, but a context with more than ``1 / (4 buckets)`` of all tokens is
spread over all buckets by word.  Per sweep, buckets send table counts per word
to the word's part, which seats the parent and answers with its predictive
weights (and with the totals of spread contexts).  At the end every bucket
answers each batch cell by cell, and the batch adds up its documents.  Random
numbers are seeded per bucket and sweep, so a lost task gives the same state
again.  Only sums come to the driver, and at most ``4 x buckets`` contexts.

Defined results: null or blank text is one end token; rows with equal ids are
scored each; without training documents every probability is that of the
unknown word; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import islice, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import ASCII_LOWER, WORDS, lean, n_partitions, table  # noqa: F401
from shoplens.llm.features import fold
from shoplens.llm.word_ids import chunks

BATCH_TOKENS = 2_000_000
BUCKET_CHARS = 64_000_000
SWEEPS = 2
BURN_IN = 1
THETA, THETA_ROOT = 1.0, 10.0
STIRLING = 32
# hashes of the end token and of the context before the first token
END, START = 1, 2
# A batch is numbered by its partition and, in so many bits, within it.
SEQ_BITS = 20
# Words are known by 56 bits of their hash: a thousand million words have
# about seven pairs that share one.
HASH_BYTES = 7


def word_hash(word: str | bytes) -> int:
    return xxhash.xxh64_intdigest(word) & (1 << 8 * HASH_BYTES) - 1


def narrow(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // HASH_BYTES, 8), np.uint8)
    out[:, :HASH_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, HASH_BYTES)
    return out.view("<u8").ravel().astype(np.uint64)


def same(key: int) -> int:
    """Partition of a record keyed by its partition."""
    return key


def pressed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def loosed(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


# -- batches ----------------------------------------------------------------
def batches_of(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as rows of ids, lengths, training marks, distinct word hashes
    and local token ids (the end token's is the number of distinct words).
    Arrow cuts the texts into words; Python sees those that differ."""
    part, seq = TaskContext.get().partitionId(), 0
    ids: list[pa.Array] = []
    train: list[pa.Array] = []
    lengths: list[np.ndarray] = []
    tokens: list[pa.Array] = []
    size = 0

    def row() -> pa.RecordBatch:
        each = np.concatenate(lengths).astype(np.int32)
        found = pa.concat_arrays(tokens).dictionary_encode()
        flat = np.full(each.sum(), len(found.dictionary), np.int32)
        inner = np.ones(len(flat), bool)
        inner[np.cumsum(each) - 1] = False
        flat[inner] = found.indices.to_numpy()
        known = found.dictionary.cast(pa.large_binary())
        _, offsets, data = known.buffers()
        cuts, data = np.frombuffer(offsets, np.int64, len(known) + 1).tolist(), data.to_pybytes() if data else b""
        hashes = np.fromiter((word_hash(data[a:z]) for a, z in pairwise(cuts)), np.uint64, len(known))
        listed = lambda arrays, kind: pa.array([pa.concat_arrays(arrays).to_pylist()], pa.list_(kind))
        return pa.RecordBatch.from_arrays(
            [pa.array([(part << SEQ_BITS) + seq], pa.int64()), listed(ids, pa.int64()), listed(train, train[0].type),
             *[pa.array([x], pa.binary()) for x in (each.tobytes(), narrow(hashes), pressed(flat))]],
            ["batch", "ids", "train", "lengths", "vocabulary", "tokens"])

    for piece in (c for r in records for c in chunks([r])):
        counts, words = words_of(piece.column("text"))
        ends = np.cumsum(counts)
        a = 0
        while a < len(counts):
            # up to the document that fills the batch
            filled = size + np.cumsum(counts[a:] + 1)
            z = min(a + int(np.searchsorted(filled, BATCH_TOKENS)) + 1, len(counts))
            at = int(ends[a - 1]) if a else 0
            tokens.append(words.slice(at, int(ends[z - 1]) - at))
            lengths.append(counts[a:z] + 1)
            ids.append(piece.column("doc_id").slice(a, z - a).cast(pa.int64()))
            train.append(piece.column("train").slice(a, z - a))
            size = int(filled[z - a - 1])
            if size >= BATCH_TOKENS:
                yield row()
                seq, size = seq + 1, 0
                ids.clear(), train.clear(), lengths.clear(), tokens.clear()
            a = z
    if lengths:
        yield row()


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of words of each text (null: none), and all words, their
    ASCII letters in lower case."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    # words, not texts, are lowered: of a slice of texts Arrow lowers others
    words, offsets = pc.ascii_lower(split.flatten()), split.offsets.to_numpy()
    real = pc.greater(pc.binary_length(words), 0)  # white space at the ends of a text leaves empty words
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(real.to_numpy(zero_copy_only=False))])
    return np.diff(before[offsets - offsets[0]]), words.filter(real)


class Batch:
    """The cells of a batch, in the order in which they are sent and answered."""

    def __init__(self, row: tuple, cells: bool = True):
        self.key, self.ids, self.train, lengths, vocabulary, tokens = row
        self.lengths = np.frombuffer(lengths, np.int32)
        words = wide(vocabulary)
        v = len(words)
        self.hashes = np.concatenate([words, np.array([END, START], np.uint64)])
        self.tokens = loosed(tokens, np.int32).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.before = np.roll(self.tokens, 1)
        self.before[self.starts] = v + 1
        if not cells:
            return
        codes, self.cell_of = np.unique(self.before * (v + 2) + self.tokens, return_inverse=True)
        self.context, self.word = codes // (v + 2), codes % (v + 2)
        self.in_training = np.repeat(np.array(self.train, bool), self.lengths)
        self.counts = np.bincount(self.cell_of[self.in_training], minlength=len(codes))

    def routed(self, n: int, spread: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, cells), contexts together."""
        hu, hw = self.hashes[self.context], self.hashes[self.word]
        to = np.where(np.isin(hu, spread), mixed(hu ^ mixed(hw)), mixed(hu)) % np.uint64(n)
        to = to.astype(np.uint16 if n <= 1 << 16 else np.int64)  # 16 bits are sorted by counting
        order = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.diff(to[order])) + 1
        for cells in np.split(order, cuts):
            if len(cells):
                yield int(to[cells[0]]), cells

    def heavy(self, share: float) -> Iterator[tuple[int, int]]:
        per = np.bincount(self.before, minlength=len(self.hashes))
        for i in np.flatnonzero(per >= share * len(self.tokens)):
            yield int(self.hashes[i]), int(per[i])


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit hashes anew (bits of the words' own hashes pick parts)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def runs(a: np.ndarray) -> np.ndarray:
    """Where a new value starts."""
    return np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)


def send_cells(rows: Iterable, n: int, spread: np.ndarray) -> Iterator[tuple]:
    for row in rows:
        b = Batch(row[1])
        for to, cells in b.routed(n, spread):
            u = b.context[cells]
            at = runs(u)
            sizes = np.diff(np.append(at, len(u)))
            yield to, ("cells", b.key, narrow(b.hashes[u[at]]), pressed(sizes.astype(np.int32)),
                       narrow(b.hashes[b.word[cells]]), pressed(b.counts[cells].astype(np.int32)))


def place(batch: int, n: int) -> int:
    """Partition of a batch."""
    return int((batch >> SEQ_BITS) * 7 + batch % (1 << SEQ_BITS)) % n


# -- seating ----------------------------------------------------------------
def log_stirling(d: float) -> np.ndarray:
    """log generalised Stirling numbers S(c, t) for c, t up to STIRLING."""
    s = np.full((STIRLING + 1, STIRLING + 1), -np.inf)
    s[1, 1] = 0.0
    for c in range(1, STIRLING):
        t = np.arange(1, c + 2)
        stay = np.where(t <= c, np.log(np.maximum(c - d * t, 1e-300)) + s[c, t], -np.inf)
        s[c + 1, 1:c + 2] = np.logaddexp(s[c, 0:c + 1], stay)
    return s


def draw_tables(c: np.ndarray, others: np.ndarray, p: np.ndarray, theta: float, d: float, rng) -> np.ndarray:
    """Tables of ``c`` customers per dish, given the other tables of its
    restaurant and the parent's probability of the dish."""
    t = (c > 0).astype(np.int64)
    first = theta + d * others
    stirling = log_stirling(d)
    for n in range(2, STIRLING + 1):
        i = np.flatnonzero(c == n)
        if len(i):
            open_ = np.cumsum(np.log(first[i, None] + d * np.arange(n)), axis=1)
            w = stirling[n, 1:n + 1] + np.arange(1, n + 1) * np.log(p[i, None]) + open_
            w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
            t[i] = 1 + (rng.random(len(i))[:, None] * w[:, -1:] > w).sum(axis=1)
    i = np.flatnonzero(c > STIRLING)
    if len(i):
        t[i] = reseat(c[i], first[i], p[i], d, rng)
    return t


def reseat(c, first, p, d, rng) -> np.ndarray:
    """Customers seated one after the other by the Chinese restaurant rule; past
    STIRLING customers straight to the next new table, whose place has the
    distribution function 1 - ((n - dt) / (m - dt)) ** weight."""
    t = np.ones(len(c), np.int64)
    for n in range(1, STIRLING):
        weight = (first + d * t) * p
        t += rng.random(len(c)) * (weight + n - d * t) < weight
    n, live = np.full(len(c), float(STIRLING)), np.arange(len(c))
    while len(live):
        tl = t[live]
        weight = (first[live] + d * tl) * p[live]
        with np.errstate(over="ignore", divide="ignore"):
            m = np.ceil(d * tl + (n[live] - d * tl) * rng.random(len(live)) ** (-1 / weight))
        opened = m < c[live]
        live = live[opened]
        n[live] = m[opened] + 1
        t[live] += 1
    return t


class Bucket:
    """Restaurants (or the share of a spread one) of all batches' cells."""

    def __init__(self, number: int, records: list[tuple], parts: int, spread: np.ndarray):
        self.number, self.parts = number, parts
        self.sent = sorted(records, key=lambda r: r[1])
        heads = [wide(r[2]) for r in self.sent]
        sizes = [loosed(r[3], np.int32) for r in self.sent]
        self.heads, self.n_cells = heads, [int(s.sum()) for s in sizes]
        # Ranks of contexts and words, so that a cell is one number: numbers of
        # a kind are sorted several times as fast as pairs of hashes.
        self.contexts, rank = np.unique(np.concatenate(heads), return_inverse=True)
        found, words = pd.factorize(np.concatenate([wide(r[4]) for r in self.sent]))
        by = np.argsort(words)
        self.words, place_of = words[by], np.empty(len(words), np.int64)
        place_of[by] = np.arange(len(words))
        cell = (np.repeat(rank, np.concatenate(sizes)) << 32) + place_of[found]
        self.sorted = np.argsort(cell)
        cell = cell[self.sorted]
        self.cells_at = runs(cell)
        counts = np.concatenate([loosed(r[5], np.int32) for r in self.sent]).astype(np.int64)
        self.c = np.add.reduceat(counts[self.sorted], self.cells_at)
        cell = cell[self.cells_at]
        self.context_of, self.word_of = cell >> 32, cell & (1 << 32) - 1
        first = self.first = runs(self.context_of)
        to = (mixed(self.words) % np.uint64(parts)).astype(np.int64)
        self.order = np.argsort(to, kind="stable")
        self.cuts = np.searchsorted(to[self.order], np.arange(parts + 1))
        self.customers = np.add.reduceat(self.c, first)
        self.spread = np.flatnonzero(np.isin(self.contexts, spread))

    @cached_property
    def cell_of(self) -> np.ndarray:
        """Of every cell that was sent, its number here."""
        out = np.empty(len(self.sorted), np.int64)
        out[self.sorted] = np.repeat(np.arange(len(self.c)), np.diff(np.append(self.cells_at, len(out))))
        return out

    def tables(self, t: np.ndarray) -> np.ndarray:
        return np.add.reduceat(t, self.first)

    def states(self, answers: dict[int, dict], stats: list[dict]) -> Iterator[tuple]:
        """(tables per cell, per context, parent probability per word, customers
        per context) of state 0, 1, ...; the parent's probability is None for a
        state that has no answer yet."""
        t = (self.c > 0).astype(np.int64)
        for k in range(len(stats) + 1):
            per_context, customers, p = self.tables(t), self.customers, None
            if k < len(stats):
                weight, totals = self._answer(answers[k])
                s = stats[k]
                p = (weight + (THETA_ROOT + s["d_root"] * s["s"]) / (s["v"] + 1)) / (THETA_ROOT + s["t"])
                if len(self.spread):
                    customers, per_context = customers.copy(), per_context.copy()
                    customers[self.spread], per_context[self.spread] = totals
            yield t, per_context, p, customers
            if p is not None:
                rng = np.random.default_rng([self.number, k])
                t = draw_tables(self.c, per_context[self.context_of] - t, p[self.word_of], THETA, stats[0]["d"], rng)

    def _answer(self, answer: dict) -> tuple[np.ndarray, tuple]:
        weight = np.empty(len(self.words))
        totals = {}
        for part, (raw, heavy) in answer.items():
            weight[self.order[self.cuts[part]:self.cuts[part + 1]]] = loosed(raw, np.float32)
            totals |= heavy
        pairs = [totals[int(u)] for u in self.contexts[self.spread]]
        return weight, (np.array([x[0] for x in pairs], np.int64), np.array([x[1] for x in pairs], np.int64))

    def answered(self, answers: dict[int, dict], stats: list[dict], burn_in: int) -> Iterator[tuple]:
        """To every batch the averaged probability of each of its cells, and the
        customers of its contexts."""
        total, d, n = np.zeros(len(self.c)), stats[0]["d"], 0
        for k, (t, per_context, p, customers) in enumerate(islice(self.states(answers, stats), len(stats))):
            if k >= burn_in:
                back = (THETA + d * per_context)[self.context_of] * p[self.word_of]
                total += (np.maximum(self.c - d * t, 0) + back) / (THETA + customers[self.context_of])
                n += 1
        at = 0
        for r, head, size in zip(self.sent, self.heads, self.n_cells, strict=True):
            cells = self.cell_of[at:at + size]
            at += size
            yield r[1], (self.number, (total[cells] / n).astype(np.float32).tobytes(),
                         pressed(customers[np.searchsorted(self.contexts, head)].astype(np.int64)))

    def ask(self, t: np.ndarray, state: int) -> Iterator[tuple]:
        """Tables per word to the words' parts; of spread contexts the customers
        and tables here."""
        per_word = np.bincount(self.word_of, t, len(self.words)).astype(np.int64)
        per_context = self.tables(t)
        heavy: dict[int, dict] = {}
        for i in self.spread:
            u = int(self.contexts[i])
            heavy.setdefault(u % self.parts, {})[u] = (int(self.customers[i]), int(per_context[i]))
        seen = np.bincount(np.minimum(self.c, 3), minlength=4)
        for part in range(self.parts):
            mine = self.order[self.cuts[part]:self.cuts[part + 1]]
            own = part == self.number % self.parts
            if len(mine) or part in heavy or own:
                yield part, ("tables", self.number, b"" if state else narrow(self.words[mine]),
                             pressed(per_word[mine].astype(np.int32)), heavy.get(part, {}),
                             (int(self.c.sum()), int(seen[1]), int(seen[2])) if own else (0, 0, 0), state)


class Part:
    """The parent's customers for one part of the words."""

    def __init__(self, number: int, records: list[tuple], state: int):
        self.number = number
        names = sorted((r for r in records if r[6] == 0), key=lambda r: r[1])
        by_bucket = {r[1]: r for r in records if r[6] == state}
        self.asked = [by_bucket[r[1]] for r in names]
        words = [wide(r[2]) for r in names]
        self.sizes = [len(w) for w in words]
        self.words, self.at = np.unique(np.concatenate(words), return_inverse=True)
        self.t = np.bincount(self.at, np.concatenate([loosed(r[3], np.int32) for r in self.asked]), len(self.words)).astype(np.int64)

    def seated(self, d: float, v: int, s_before: int, state: int) -> np.ndarray:
        rng = np.random.default_rng([self.number, state, 77])
        others = np.full(len(self.t), max(0.0, s_before - 1.0))
        return draw_tables(self.t, others, np.full(len(self.t), 1 / (v + 1)), THETA_ROOT, d, rng)

    def answers(self, s: np.ndarray, d: float) -> Iterator[tuple]:
        weight = np.maximum(self.t - d * s, 0).astype(np.float32)[self.at]
        totals: dict[int, tuple[int, int]] = {}
        for r in self.asked:
            for u, (c, t) in r[4].items():
                totals[u] = (totals.get(u, (0, 0))[0] + c, totals.get(u, (0, 0))[1] + t)
        ends = np.cumsum(self.sizes)
        for r, a, z in zip(self.asked, ends - self.sizes, ends, strict=True):
            yield r[1], (self.number, pressed(weight[a:z]), {u: totals[u] for u in r[4]})


def last(items: Iterable):
    for x in items:
        pass
    return x


def grouped(records: Iterable) -> dict[int, list]:
    out: dict[int, list] = {}
    for key, value in records:
        out.setdefault(key, []).append(value)
    return out


def discount(n1: int, n2: int) -> float:
    return float(np.clip(n1 / (n1 + 2 * n2), 0.1, 0.95)) if n1 else 0.5


def buckets_for(docs: DataFrame) -> int:
    """Buckets for the size of the texts: the session's shuffle partitions, or
    more where a bucket would hold the cells of over ``BUCKET_CHARS``."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(n_partitions(docs.sparkSession), -(-chars // BUCKET_CHARS))


class Model:
    """Seating by rounds between buckets and parts, and the scores."""

    def __init__(self, docs: DataFrame, sweeps: int = SWEEPS, burn_in: int = BURN_IN):
        """``docs``: doc_id, text, train (boolean)."""
        self.burn_in = burn_in
        n = self.n = buckets_for(docs)
        rows = docs.select("doc_id", "text", "train").mapInArrow(
            lean(batches_of), "batch bigint, ids array<bigint>, train array<boolean>, lengths binary, vocabulary binary, tokens binary").rdd
        # one shuffle keeps the batches for both uses
        self.batches = rows.map(lambda r: (place(r[0], n), (
            "batch", (r[0], list(r[1]), list(r[2]), bytes(r[3]), bytes(r[4]), bytes(r[5]))))).partitionBy(n, same)
        share = 1 / (4 * n)
        heavy = (self.batches.flatMap(lambda r: [*(b := Batch(r[1][1], cells=False)).heavy(share / 2), (-1, len(b.tokens))])
                 .reduceByKey(lambda a, b: a + b, n))
        total = dict(heavy.filter(lambda r: r[0] == -1).collect()).get(-1, 0)
        spread = np.array(sorted(u for u, _ in heavy.filter(lambda r: r[0] != -1 and r[1] >= share * total).collect()), np.uint64)
        self.spread = spread
        self.cells = self.batches.mapPartitions(lambda rows: send_cells(((k, v[1]) for k, v in rows), n, spread)).partitionBy(n, same)
        self.answers, self.stats, names = [], [], None
        for state in range(sweeps + 1):
            asked = self._buckets(lambda b, answers, stats, state=state: b.ask(last(b.states(answers, stats))[0], state)).partitionBy(n, same)
            names = names or asked
            self._root(asked if state == 0 else names.union(asked), state)

    def _buckets(self, act):
        n, spread, stats = self.n, self.spread, list(self.stats)
        rdd = self.cells
        for a in self.answers:
            rdd = rdd.union(a)

        def run(records: Iterable) -> Iterator[tuple]:
            for number, own in sorted(grouped(records).items()):
                cells = [r for r in own if r[0] == "cells"]
                if cells:
                    answers: dict[int, dict] = {}
                    for r in own:
                        if r[0] == "answer":
                            answers.setdefault(r[1], {})[r[2]] = r[3:]
                    yield from act(Bucket(number, cells, n, spread), answers, stats)

        return rdd.mapPartitions(run)

    def _root(self, asked, state: int) -> None:
        """Seats the parent for a state and has its weights sent to the buckets."""
        n = self.n

        def parts(records: Iterable) -> Iterator[Part]:
            for number, own in sorted(grouped(records).items()):
                yield Part(number, own, state)

        if state == 0:
            def sums(records: Iterable) -> Iterator[tuple]:
                for p in parts(records):
                    tokens = np.array([r[5] for r in p.asked]).reshape(-1, 3).sum(axis=0)
                    yield (*map(int, tokens), int((p.t > 0).sum()), int((p.t == 1).sum()), int((p.t == 2).sum()))

            tokens, c1, c2, v, t1, t2 = np.array(asked.mapPartitions(sums).collect(), np.int64).reshape(-1, 6).sum(axis=0)
            first = {"tokens": int(tokens), "v": int(v), "d": discount(int(c1), int(c2)), "d_root": discount(int(t1), int(t2))}
        else:
            first = self.stats[0]
        d, v, before = first["d_root"], first["v"], self.stats[-1]["s"] if self.stats else first["v"]

        def seats(records: Iterable) -> Iterator[tuple]:
            for p in parts(records):
                yield int(p.t.sum()), int(p.seated(d, v, before, state).sum())

        t, s = np.array(asked.mapPartitions(seats).collect(), np.int64).reshape(-1, 2).sum(axis=0)
        self.stats.append(first | {"t": int(t), "s": int(s)})

        def answers(records: Iterable) -> Iterator[tuple]:
            for p in parts(records):
                for bucket, (number, raw, totals) in p.answers(p.seated(d, v, before, state), d):
                    yield bucket, ("answer", state, number, raw, totals)

        self.answers.append(asked.mapPartitions(answers).partitionBy(n, same))

    def scores(self):
        """RDD of (doc_id, train, n_tokens, n_known, train_tokens, base_score, score)."""
        n, burn_in, spread, first = self.n, self.burn_in, self.spread, self.stats[0]

        def reply(b: Bucket, answers: dict, stats: list) -> Iterator[tuple]:
            for batch, (bucket, p, customers) in b.answered(answers, stats, burn_in):
                yield place(batch, n), ("scores", batch, bucket, p, customers)

        replies = self._buckets(reply).partitionBy(n, same)

        def run(records: Iterable) -> Iterator[tuple]:
            scores: dict[int, dict] = {}
            rows = []
            for _, r in records:
                if r[0] == "scores":
                    scores.setdefault(r[1], {})[r[2]] = r[3:]
                else:
                    rows.append(r[1])
            for row in rows:
                b = Batch(row)
                p, customers = np.zeros(len(b.context)), np.zeros(len(b.hashes), np.int64)
                for bucket, cells in b.routed(n, spread):
                    probability, counts = scores[b.key][bucket]
                    p[cells] = np.frombuffer(probability, np.float32)
                    u = b.context[cells]
                    customers[u[runs(u)]] = loosed(counts, np.int64)
                customers[-2] = customers[-1]  # as many ends as starts
                c = customers[b.tokens]
                base = np.log10((c + 0.5) / (first["tokens"] + 0.5 * (first["v"] + 1)))
                total = lambda x: np.add.reduceat(x, b.starts)  # noqa: E731, B023
                for out in zip(b.ids, b.train, b.lengths.tolist(), total((c > 0).astype(np.int64)).tolist(),
                               total(base).tolist(), total(np.log10(p)[b.cell_of]).tolist(), strict=True):
                    yield (*out[:4], first["tokens"], *out[4:])

        return self.batches.union(replies).mapPartitions(run)


def language_scores(docs: DataFrame) -> DataFrame:
    """Scores of ``docs`` (doc_id, text, train) by a model of its train rows."""
    return docs.sparkSession.createDataFrame(
        Model(docs).scores(), "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                              "base_score double, score double", verifySchema=False)


def op1_pitman_yor(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", fold(5).eqNullSafe(1).alias("held"))
    out = language_scores(docs.select("doc_id", "text", (~docs["held"]).alias("train")))
    return out.selectExpr("doc_id", "NOT train AS held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
