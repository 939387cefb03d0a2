"""Prefix tries of conversations, packed as double arrays per prefix shard.

A conversation is a sequence of turns, each known by a 128-bit hash of its role
and text; texts stay where they are read.  Equal sequences are collapsed with
their number, their least id and the hash of their ids before any trie is
built, so copies of a conversation, however many, are one sequence.  A prefix
that holds more than ``shard_sequences`` distinct sequences and more than
``shard_turns`` turns in them is *upper*; every sequence goes to the shard of its first prefix that is not, so a hot
first turn is split by the turns after it, and all below such a prefix is in
one shard.

A shard gives its turns dense ids and packs BASE and CHECK: the child of state
``s`` by turn id ``c`` is ``BASE[s] + c``, valid where CHECK there is ``s``.
Walking its sequences through these arrays, level by level, gives the counts of
each node.  Upper nodes are met in many shards: their partial aggregates are
merged by prefix hash over the whole table, together with what upper nodes hold
of each other.

A sum over a subtree of (n_convs - 1) times words is a sum over members (each
counts the words it has from here on) less a sum over distinct nodes, and both
add up over shards.  The hash of a node's ending ids streams over them in order
in bounded chunks; an SHA-256 cannot be split further.  A conversation's hashes
and word counts (24 bytes a turn) are held by one task, its texts never.

Defined results: rows with a null id belong to no conversation and are left
out; turns are ordered by number (null first), then role, then the hash of the
text, and equal rows are turns of their own; null role or text counts as empty;
remainders of negative ids have the sign of the id (as in SQL); a conversation
without turns after rebuilding is a member of the root and ends there; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import broadcast_if, n_partitions, stored, table

# A prefix with more distinct sequences than this, and with more turns in them,
# is split further.
SHARD_SEQUENCES, SHARD_TURNS = 64, 4096
# Turns a task holds, about: the number of shards follows the data.
TASK_TURNS = 1 << 19
# Ids hashed as one chunk.
CHUNK_IDS = 4096
# Upper nodes beyond this number are joined by a shuffle.
MAX_BROADCAST_ROWS = 200_000
DONORS, HEAD = 20, 4
ROOT = b"\0" * 16
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def step(key: bytes, turn: bytes) -> bytes:
    """The key of a prefix with one turn more."""
    return hashlib.blake2b(key + turn, digest_size=16).digest()


def turn_hash(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """One row for each conversation: ``conv_id``, ``turns`` (structs of ``turn``
    hash and ``words``) in order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    narrow = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(F.col("turn").cast("bigint").alias("at"), role.alias("role"), F.md5(text).alias("tie"), turn_hash(role, text).alias("turn"), words.alias("words")).alias("t"))
    return (narrow.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
            .select("conv_id", F.transform("t", lambda t: F.struct(t["turn"].alias("turn"), t["words"].alias("words"))).alias("turns")))


def rebuilt(conversations: DataFrame, donors: int = DONORS, head: int = HEAD) -> DataFrame:
    """Each conversation with its first ``h`` turns taken from its donor: ``h`` is
    the CRC-32 of its decimal id modulo ``head``, the donor the id rounded down
    to a multiple of ``donors``."""
    own = stored(turn_arrays(conversations), "turns")
    heads = own.where(F.col("conv_id") % donors == 0).select(
        F.col("conv_id").alias("donor"), F.slice("turns", 1, max(head - 1, 1)).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % head).cast("int")
    none = F.array().cast(own.schema["turns"].dataType)
    return (own.withColumn("donor", F.col("conv_id") - F.col("conv_id") % donors).join(heads, "donor", "left")
            .select("conv_id", F.concat(F.slice(F.coalesce("first", none), F.lit(1), h),
                                        F.when(F.size("turns") > h, F.slice("turns", h + 1, F.size("turns"))).otherwise(none)).alias("turns")))


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """``convs`` (conv_id, turns) collapsed to distinct sequences, stored: ``seq``
    (key of the whole sequence), ``turns`` (16 bytes each), ``words``,
    ``n_convs``, ``first_id`` and ``ends`` (hash of its ids in order)."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs = []
            for turns in b.column("turns").to_pylist():
                key = ROOT
                for t in turns:
                    key = step(key, t)
                seqs.append(key)
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(seqs, pa.binary()), b.column("turns"), b.column("words")],
                                             ["conv_id", "seq", "turns", "words"])

    flat = convs.select("conv_id", F.col("turns.turn").alias("turns"), F.col("turns.words").alias("words"))
    keys = stored(flat.mapInArrow(keyed, "conv_id bigint, seq binary, turns array<binary>, words array<bigint>"), "keyed")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted ids of each sequence, ``CHUNK_IDS`` to a row with its turns."""
        seq, ids, content, rows = None, [], None, []

        def closed() -> list[tuple]:
            return [(seq, ids[0], len(ids), ",".join(map(str, ids)), *content)] if ids else []

        for b in batches:
            for conv, s, turns, words in zip(*(b.column(c).to_pylist() for c in ("conv_id", "seq", "turns", "words")), strict=True):
                if s != seq or len(ids) >= CHUNK_IDS:
                    rows += closed()
                    seq, ids, content = s, [], (turns, words)
                ids.append(conv)
            yield CHUNKS(rows)
            rows = []
        yield CHUNKS(closed())

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each sequence from its chunks, in order of their ids."""
        held, rows = None, []

        def closed() -> list[tuple]:
            return [(*held[:5], held[5].hexdigest())] if held else []

        for b in batches:
            for s, first, n, text, turns, words in zip(*(b.column(c).to_pylist() for c in ("seq", "first_id", "n", "ids", "turns", "words")), strict=True):
                if held is None or s != held[0]:
                    rows += closed()
                    held = [s, turns, words, 0, first, hashlib.sha256(text.encode())]
                else:
                    held[5].update(b"," + text.encode())
                held[3] += n
            yield SEQUENCES(rows)
            rows = []
        yield SEQUENCES(closed())

    n = n_partitions(convs.sparkSession)
    parts = (keys.repartitionByRange(n, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
             .mapInArrow(chunks, "seq binary, first_id bigint, n bigint, ids string, turns array<binary>, words array<bigint>"))
    whole = (parts.repartition(n, "seq").sortWithinPartitions("seq", "first_id")
             .mapInArrow(joined, "seq binary, turns array<binary>, words array<bigint>, n_convs bigint, first_id bigint, ends string"))
    return stored(whole, "sequences")


def _batch(fields: list[tuple[str, pa.DataType]]):
    schema = pa.schema(fields)

    def make(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return make


_TURNS = [("turns", pa.list_(pa.binary())), ("words", pa.list_(pa.int64()))]
CHUNKS = _batch([("seq", pa.binary()), ("first_id", pa.int64()), ("n", pa.int64()), ("ids", pa.string()), *_TURNS])
SEQUENCES = _batch([("seq", pa.binary()), *_TURNS, ("n_convs", pa.int64()), ("first_id", pa.int64()), ("ends", pa.string())])


def cut_sequences(sequences: DataFrame, shard_turns: int = SHARD_TURNS, shard_sequences: int = SHARD_SEQUENCES) -> DataFrame:
    """``sequences`` with ``cut`` -- the depth from which its nodes lie in one
    shard -- and the key of the prefix that names the shard (of the whole
    sequence where all its prefixes are upper)."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs, depths, keys, sizes = [], [], [], []
            for s, turns in zip(b.column("seq").to_pylist(), b.column("turns").to_pylist(), strict=True):
                key = ROOT
                for depth, t in enumerate(turns, 1):
                    key = step(key, t)
                    keys.append(key)
                    depths.append(depth)
                seqs += [s] * len(turns)
                sizes += [len(turns)] * len(turns)
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.binary()), pa.array(depths, pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64())],
                                             ["seq", "depth", "key", "size"])

    of_each = sequences.select("seq", "turns").mapInArrow(prefixes, "seq binary, depth bigint, key binary, size bigint")
    upper = stored(of_each.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
                   .where((F.col("size") > shard_turns) & (F.col("n") > shard_sequences)).select("key"), "upper")
    deepest = stored(of_each.join(broadcast_if(upper, MAX_BROADCAST_ROWS), "key", "left_semi").groupBy("seq").agg(F.max("depth").alias("deepest")), "deepest")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shards = []
            for turns, cut in zip(b.column("turns").to_pylist(), b.column("cut").to_pylist(), strict=True):
                key = ROOT
                for t in turns[:cut]:
                    key = step(key, t)
                shards.append(key)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shards, pa.binary())], [*b.schema.names, "shard"])

    cut = sequences.join(broadcast_if(deepest, MAX_BROADCAST_ROWS), "seq", "left").withColumn("cut", F.coalesce("deepest", F.lit(0)) + 1).drop("deepest")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return cut.mapInArrow(named, f"{kinds}, shard binary")


class DoubleArray:
    """A double-array trie over sequences of dense turn ids (1, 2, ...).

    State 0 is the root.  ``base`` and ``check`` are packed level by level:
    children go to the first free run of slots that takes them all, or to the
    end of the arrays after some tries.
    """

    TRIES = 16

    def __init__(self, turns: np.ndarray, lengths: np.ndarray):
        """``turns``: ids of all sequences one after the other."""
        self.turns, self.lengths = turns, lengths
        self.starts = np.cumsum(lengths) - lengths
        self.base = np.zeros(1, np.int64)
        self.check = np.full(1, -1, np.int64)
        self.check[0] = 0
        self.lowest = 1
        state, level = np.zeros(len(lengths), np.int64), 0
        while True:
            on = np.flatnonzero(lengths > level)
            if not len(on):
                break
            by = turns[self.starts[on] + level]
            pairs = np.unique(np.stack([state[on], by], axis=1), axis=0)
            parents, first = np.unique(pairs[:, 0], return_index=True)
            for s, a, b in zip(parents.tolist(), first.tolist(), [*first[1:].tolist(), len(pairs)], strict=True):
                self._place(s, pairs[a:b, 1])
            state[on] = self.child(state[on], by)
            level += 1

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _place(self, state: int, ids: np.ndarray) -> None:
        span = int(ids[-1] - ids[0])
        while self.lowest < len(self.check) and self.check[self.lowest] >= 0:
            self.lowest += 1
        slot = self.lowest
        for _ in range(self.TRIES):
            self._grow(slot + span + 1)
            if (self.check[slot + ids - ids[0]] < 0).all():
                break
            slot += 1
        else:
            slot = len(self.check)
            self._grow(slot + span + 1)
        self.base[state] = slot - ids[0]
        self.check[slot + ids - ids[0]] = state

    def child(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The states after one turn more; -1 where there is none."""
        at = self.base[states] + ids
        inside = (at > 0) & (at < len(self.check)) & (states >= 0)
        at = np.where(inside, at, 0)
        return np.where(inside & (self.check[at] == states), at, -1)

    def levels(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each depth from 0: the sequences that reach it and their states."""
        state, level = np.zeros(len(self.lengths), np.int64), 0
        on = np.arange(len(self.lengths))
        while len(on):
            yield level, on, state[on]
            on = on[self.lengths[on] > level]
            state[on] = self.child(state[on], self.turns[self.starts[on] + level])
            level += 1


NODE = ("key binary, parent binary, depth bigint, words bigint, upper boolean, path array<binary>, n_convs bigint, first_id bigint, parent_id bigint, "
        "n_children bigint, n_leaves bigint, member_words bigint, node_words bigint, ends string")
NODES = _batch([("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("words", pa.int64()), ("upper", pa.bool_()),
                ("path", pa.list_(pa.binary())), *[(c, pa.int64()) for c in ("n_convs", "first_id", "parent_id", "n_children", "n_leaves", "member_words", "node_words")],
                ("ends", pa.string())])


def shard_nodes(turns: list[list[bytes]], words: list[list[int]], n_convs: list[int], first_id: list[int], ends: list[str],
                cut: list[int]) -> Iterator[tuple]:
    """Rows of ``NODE`` for the trie of distinct sequences.  Children, leaves and
    words count what lies in this shard; upper nodes count no upper ones."""
    lengths = np.array([len(t) for t in turns], np.int64)
    flat = np.frombuffer(b"".join(b"".join(t) for t in turns), "S16") if lengths.sum() else np.empty(0, "S16")
    ids = np.unique(flat.view("V16") if len(flat) else flat, return_inverse=True)[1].astype(np.int64) + 1
    trie = DoubleArray(ids, lengths)
    n, least, cuts = np.array(n_convs, np.int64), np.array(first_id, np.int64), np.array(cut, np.int64)
    flat_words = np.array([w for ws in words for w in ws], np.int64)
    size = len(trie.check)
    count, first = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
    depth_of, parent, own = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.zeros(size, np.int64)
    upper, members, sample = np.zeros(size, bool), np.zeros(size, np.int64), np.zeros(size, np.int64)
    end_of: dict[int, int] = {}
    before, order = None, []
    for depth, on, at in trie.levels():
        states = np.unique(at)
        order.append(states)
        np.add.at(count, at, n[on])
        np.minimum.at(first, at, least[on])
        depth_of[at], sample[at], upper[at] = depth, on, depth < cuts[on]
        if depth:
            parent[at] = before[on]
            own[at] = flat_words[trie.starts[on] + depth - 1]
        before = np.full(len(lengths), -1, np.int64)
        before[on] = at
        done = lengths[on] == depth
        end_of.update(zip(at[done].tolist(), on[done].tolist(), strict=True))
    # bottom up: children, leaves, words of members and of distinct lower nodes
    children, leaves, nodes = (np.zeros(size, np.int64) for _ in range(3))
    for states in reversed(order):
        lower = states[~upper[states]]
        leaves[lower] += children[lower] == 0
        nodes[lower] += own[lower]
        members[states] += own[states] * count[states]
        if (parent[states] >= 0).all():
            np.add.at(children, parent[lower], 1)
            for sums in (leaves, nodes, members):
                np.add.at(sums, parent[states], sums[states])
    keys: dict[int, bytes] = {0: ROOT}
    paths: dict[int, list[bytes]] = {0: []}
    for states in order:
        for s in states.tolist():
            if s:
                p = int(parent[s])
                keys[s] = step(keys[p], turns[sample[s]][depth_of[s] - 1])
                if upper[s]:
                    paths[s] = [*paths[p], keys[p]]
            p = int(parent[s])
            end = end_of.get(s)
            yield (keys[s], keys.get(p), int(depth_of[s]), int(own[s]), bool(upper[s]), paths.get(s), int(count[s]), int(first[s]),
                   int(first[p]) if p >= 0 and not upper[p] else None, int(children[s]), int(leaves[s]), int(members[s]), int(nodes[s]),
                   None if end is None else ends[end])


def trie_nodes(convs: DataFrame, shard_turns: int = SHARD_TURNS, shard_sequences: int = SHARD_SEQUENCES, task_turns: int = TASK_TURNS) -> DataFrame:
    """Every node of the trie of ``convs`` (conv_id, turns): ``key`` and ``parent``
    (prefix hashes), ``conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``."""
    spark = convs.sparkSession
    sequences = distinct_sequences(convs)
    turns = sequences.agg(F.sum(F.size("turns"))).first()[0] or 0
    shards = max(n_partitions(spark), -(-turns // task_turns))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches).to_pydict()
        if not held["turns"]:
            return
        rows = []
        for row in shard_nodes(*(held[c] for c in ("turns", "words", "n_convs", "first_id", "ends", "cut"))):
            rows.append(row)
            if len(rows) == 10_000:
                yield NODES(rows)
                rows = []
        yield NODES(rows)

    made = (cut_sequences(sequences, shard_turns, shard_sequences).select("shard", "turns", "words", "n_convs", "first_id", "ends", "cut")
            .repartition(shards, "shard").mapInArrow(_some(build), NODE))
    nodes = stored(made, "nodes")

    # upper nodes: partial aggregates of all shards, then what they hold of each other
    sums = ("n_convs", "n_children", "n_leaves", "member_words", "node_words")
    merged = stored(nodes.where("upper").groupBy("key").agg(
        *[F.sum(c).alias(c) for c in sums], F.min("first_id").alias("first_id"), F.max("ends").alias("ends"),
        *[F.max(c).alias(c) for c in ("parent", "depth", "words", "path")]), "upper-nodes")
    children = merged.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("upper_children"))
    merged = stored(merged.join(children, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("upper_children", F.lit(0))), "upper-children")
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    below = (merged.select(F.explode(F.concat("path", F.array("key"))).alias("key"), F.col("words").alias("upper_words"), leaf.alias("upper_leaves"))
             .groupBy("key").agg(F.sum("upper_words").alias("upper_words"), F.sum("upper_leaves").alias("upper_leaves")))
    firsts = broadcast_if(merged, MAX_BROADCAST_ROWS).select(F.col("key").alias("parent"), F.col("first_id").alias("upper_id"))
    above = (merged.join(below, "key")
             .select("key", "parent", "depth", "n_convs", "first_id", F.lit(None).cast("bigint").alias("parent_id"), "n_children",
                     (F.col("n_leaves") + F.col("upper_leaves")).alias("n_leaves"),
                     "member_words", (F.col("node_words") + F.col("upper_words")).alias("node_words"), "ends"))
    lower = nodes.where("NOT upper").select(above.columns)
    # only nodes right below an upper one lack their parent's least id
    edge = lower.where("parent_id IS NULL").unionByName(above).join(firsts, "parent", "left")
    rest = lower.where("parent_id IS NOT NULL").withColumn("upper_id", F.lit(None).cast("bigint"))
    return (edge.unionByName(rest)
            .select("key", "parent", F.col("first_id").alias("conv_id"), "depth", F.coalesce("parent_id", "upper_id").alias("parent_conv_id"),
                    "n_convs", "n_children", "n_leaves", (F.col("member_words") - F.col("node_words")).alias("saved_tokens"),
                    F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256")))


def _some(build):
    """``build`` for partitions that may have no batch at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if batches:
            yield from build(batches)

    return run


def op11_prefix_trie(spark, sf_dir):
    convs = rebuilt(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return trie_nodes(convs).drop("key", "parent")


# A node is the string of its turns' hashes.  CRC-32 of an id's digits, bit by bit.
ORACLE = r"""
WITH own AS (
  SELECT conv_id, list({'t': md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')),
      'w': len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))}
    ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
headed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda x, y: list_reduce(list_prepend(xor(x, y), range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295::BIGINT) % 4 AS h
  FROM own),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(list_slice(d.turns, 1, a.h), []), list_slice(a.turns, a.h + 1, len(a.turns))) AS turns
  FROM headed a LEFT JOIN own d ON d.conv_id = a.conv_id - a.conv_id % 20),
paths AS (
  SELECT conv_id, len(turns) AS size, depth, array_to_string(list_transform(list_slice(turns, 1, depth), lambda t: t.t), '') AS key,
    array_to_string(list_transform(list_slice(turns, 1, depth - 1), lambda t: t.t), '') AS parent, CASE WHEN depth > 0 THEN turns[depth].w ELSE 0 END AS w
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM rebuilt)),
nodes AS (
  SELECT key, depth, any_value(parent) AS parent, any_value(w) AS w, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
  FROM paths GROUP BY key, depth),
families AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.parent = n.key AND c.depth = n.depth + 1) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.key = n.parent AND p.depth = n.depth - 1),
inside AS (
  SELECT DISTINCT a.key, a.depth, b.key AS below, b.depth AS below_depth
  FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
subtrees AS (
  SELECT i.key, i.depth, sum((f.n_convs - 1) * f.w)::BIGINT AS saved_tokens, count(*) FILTER (f.n_children = 0) AS n_leaves
  FROM inside i JOIN families f ON f.key = i.below AND f.depth = i.below_depth GROUP BY i.key, i.depth)
SELECT f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM families f JOIN subtrees s USING (key, depth)
"""
