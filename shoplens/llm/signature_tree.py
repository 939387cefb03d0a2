"""N-gram Jaccard join by signature trees.

Documents are sets of five-word shingles (lower-cased A-Z); two are linked when
``100 * common >= 80 * union``.  The result is exact: connected components of
the links, with one row per document.

A signature tree holds sets at its leaves; each node has the OR of its sets'
bitmaps (a shingle sets one bit), their size range and the largest number of
shingles a set has beyond its bits.  Of two nodes no pair can have more common
shingles than bits common to both bitmaps plus that slack; the dual traversal
of a tree with itself leaves a pair of nodes when this is too few for their
size ranges, when the ranges do not fit, or when all below is one component.

At scale the trees work on groups that are sure to hold every linked pair:

1. equal sets collapse to one representative (by 128-bit hash);
2. shingles are counted over all representatives; ordered from rare to common,
   the first ``n - ceil(0.8 n) + 1`` of a set must hold one that is shared with
   each set it is linked to.  Only sets with a shared shingle there go on;
3. they are grouped by their first, then second shared shingle, and each group
   (in blocks of ``BLOCK``) is joined by a tree on the sets themselves.  This
   finds most links and turns large groups of near copies into components;
4. sets with a shared shingle in their rare parts that is not all in one
   component yet meet once more (under that shingle's least component; more
   than ``BLOCK`` as pairs of blocks), and trees that start from the components
   find the links that are left.

Defined results: null or blank text has no shingles and its own component;
fewer than five words are one shingle; rows with equal id and text are one node
each and share a component; null ids come last in ``component_id`` (null only
if no member has an id); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import SHINGLE_WORDS, lean, n_partitions, stored, table
from shoplens.llm.hpylm import batches_of, buckets_for, grouped, loosed, mixed, place, pressed, same, wide

PERCENT = 80
BLOCK = 1000
LEAF, FANOUT = 8, 8
ROUNDS = 2
MAX_BITS = 1 << 17
# a row's number is its batch's and, in so many bits, its place in the batch
DOC_BITS = 22
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def needed(a, b):
    """Common shingles that sets of these sizes must have to be linked."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


# -- the tree ---------------------------------------------------------------
class Node:
    __slots__ = ("members", "children", "bits", "least", "most", "slack", "root")

    def __init__(self, members, children, bits, sizes, slack):
        self.members, self.children, self.bits = members, children, bits
        self.least, self.most, self.slack = int(sizes.min()), int(sizes.max()), int(slack.max())
        self.root = -1  # a member, once all members are one component


class Forest:
    """Components of the members of a block."""

    def __init__(self, labels: np.ndarray):
        _, self.parent = np.unique(labels, return_inverse=True)
        self.labels = labels
        first = {}
        self.up = [first.setdefault(int(c), i) for i, c in enumerate(self.parent)]

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.find(j)] = self.find(i)


def popcount(a: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a).sum(axis=-1, dtype=np.int64)


def bitmaps(sets: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(sets), width // 8), np.uint8)
    for i, s in enumerate(sets):
        bit = (s >> np.uint64(20)).astype(np.int64) % width
        np.bitwise_or.at(out[i], bit >> 3, (1 << (bit & 7)).astype(np.uint8))
    return out.view(np.uint64)


def tree(bits: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> Node:
    """A packed tree over the sets in ``order`` (like sets side by side)."""
    slack = sizes - popcount(bits)
    level = []
    for at in range(0, len(order), LEAF):
        m = order[at:at + LEAF]
        level.append(Node(m, [], np.bitwise_or.reduce(bits[m], axis=0), sizes[m], slack[m]))
    while len(level) > 1:
        level = [Node(np.concatenate([c.members for c in g]), g, np.bitwise_or.reduce(np.stack([c.bits for c in g]), axis=0),
                      np.concatenate([sizes[c.members] for c in g]), np.array([c.slack for c in g]))
                 for g in (level[at:at + FANOUT] for at in range(0, len(level), FANOUT))]
    return level[0]


def one_component(node: Node, forest: Forest) -> int:
    """The component's root if all below ``node`` is one component, else -1."""
    if node.root < 0:
        roots = {one_component(c, forest) for c in node.children} if node.children else {forest.find(int(i)) for i in node.members}
        if len(roots) > 1 or -1 in roots:
            return -1
        node.root = roots.pop()
    return forest.find(node.root)


def dual_join(root: Node, forest: Forest, leaves) -> None:
    """Traverses ``root`` against itself; ``leaves(a, b)`` gets the leaf pairs
    that may hold a linked pair."""
    stack = [(root, root)]
    while stack:
        a, b = stack.pop()
        one = one_component(a, forest)
        if one >= 0 and (a is b or one == one_component(b, forest)):
            continue
        if a is b:
            if not a.children:
                leaves(a, a)
                continue
            kids = a.children
            stack += [(x, y) for i, x in enumerate(kids) for y in kids[i + 1:]]
            stack += [(x, x) for x in kids]  # popped first
            continue
        if 100 * b.most < PERCENT * a.least or 100 * a.most < PERCENT * b.least:
            continue
        common = int(np.bitwise_count(a.bits & b.bits).sum())
        if min(common + min(a.slack, b.slack), a.most, b.most) < needed(a.least, b.least):
            continue
        if not a.children and not b.children:
            leaves(a, b)
        elif a.children and (not b.children or len(a.members) >= len(b.members)):
            stack += [(x, b) for x in a.children]
        else:
            stack += [(a, y) for y in b.children]


def pairs_within(a: Node, b: Node, bits, sizes, forest: Forest) -> Iterator[tuple[int, int]]:
    """Pairs of two leaves in different components that their own bitmaps allow."""
    slack = sizes - popcount(bits)
    for k, i in enumerate(a.members):
        others = a.members[k + 1:] if a is b else b.members
        if not len(others):
            continue
        common = popcount(bits[others] & bits[i]) + np.minimum(slack[others], slack[i])
        possible = np.minimum(common, np.minimum(sizes[others], sizes[i])) >= needed(sizes[others], sizes[i])
        for j in others[possible]:
            if forest.find(int(i)) != forest.find(int(j)):
                yield int(i), int(j)


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    return int((y[at] == x).sum()) >= needed(len(x), len(y))


def likeness_order(sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Sets that share their least shingles stand side by side."""
    least = np.array([s[0] for s in sets], np.uint64)
    second = np.array([s[min(1, len(s) - 1)] for s in sets], np.uint64)
    return np.lexsort((sizes, second, least))


def tree_links(block: pd.DataFrame) -> pd.DataFrame:
    """Links that connect the sets of a block as all its links would.  Sets of
    one ``label`` are connected already; of two ``side``s only pairs across."""
    sets = [np.frombuffer(g, np.uint64) for g in block["grams"]]
    sizes = np.array([len(s) for s in sets], np.int64)
    width = min(MAX_BITS, 64 << int(np.ceil(np.log2(max(1, sizes.max() / 16)))))
    bits = bitmaps(sets, width)
    ids = block["gid"].to_numpy()
    forest, found = Forest(block["label"].to_numpy() if "label" in block else ids), []
    side = block["side"].to_numpy() if "side" in block else np.zeros(len(ids))
    across = side.min() != side.max()

    def leaves(a: Node, b: Node) -> None:
        for i, j in pairs_within(a, b, bits, sizes, forest):
            if across and side[i] == side[j]:
                continue
            if forest.find(i) != forest.find(j) and linked(sets[i], sets[j]):
                forest.join(i, j)
                found.append((ids[i], ids[j]))

    dual_join(tree(bits, sizes, likeness_order(sets, sizes)), forest, leaves)
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


# -- sets -------------------------------------------------------------------
class Texts:
    """The shingle sets of a batch."""

    def __init__(self, row: tuple):
        self.key, self.ids, self.tags, lengths, vocabulary, tokens = row
        lengths = np.frombuffer(lengths, np.int32)
        words = np.append(wide(vocabulary), np.uint64(0))
        flat = words[loosed(tokens, np.int32)]
        m = max(0, len(flat) - SHINGLE_WORDS + 1)
        gram = np.zeros(m, np.uint64)
        for k in range(SHINGLE_WORDS):
            gram += mixed(flat[k:m + k] ^ _MIX[k]) * _MIX[k]
        gram = mixed(gram)
        self.sets, at = [], 0
        for n in lengths.tolist():
            own = n - 1  # without the end token
            if own >= SHINGLE_WORDS:
                self.sets.append(np.unique(gram[at:at + own - SHINGLE_WORDS + 1]))
            elif own:
                self.sets.append(np.array([xxhash.xxh64_intdigest(flat[at:at + own].tobytes(), seed=own)], np.uint64))
            else:
                self.sets.append(np.zeros(0, np.uint64))
            at += n

    def rows(self) -> Iterator[tuple]:
        for i, (doc_id, tag, s) in enumerate(zip(self.ids, self.tags, self.sets, strict=True)):
            h = xxhash.xxh3_128_intdigest(s.tobytes())
            yield (self.key << DOC_BITS) + i, doc_id, tag, len(s), signed(h >> 64), signed(h & (1 << 64) - 1)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def counted(sets: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, Iterator]:
    """Distinct shingles of a batch in bucket order, how many sets have each,
    and (bucket, first, end) of the buckets."""
    grams, counts = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
    to = (mixed(grams ^ _MIX[0]) % np.uint64(n)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(n + 1))
    return grams[order], counts[order], ((b, cuts[b], cuts[b + 1]) for b in range(n) if cuts[b + 1] > cuts[b])


def rarity(df: np.ndarray) -> np.ndarray:
    """Document counts in one byte, in order: exact up to 15."""
    return np.minimum(np.where(df < 16, df, 16 + 4 * np.log2(np.maximum(df, 1) / 16)), 255).astype(np.uint8)


def count_part(records: Iterable) -> Iterator[tuple]:
    """Adds up the counts of a bucket and answers every batch."""
    for bucket, asked in grouped(records).items():
        asked.sort(key=lambda r: r[0])
        grams = [loosed(r[1], np.uint32) for r in asked]
        _, at = np.unique(np.concatenate(grams), return_inverse=True)
        df = rarity(np.bincount(at, np.concatenate([loosed(r[2], np.uint16) for r in asked])))[at]
        ends = np.cumsum([len(g) for g in grams])
        for r, g, end in zip(asked, grams, ends, strict=True):
            yield r[0], ("rarity", r[0], bucket, pressed(df[end - len(g):end]))


def rare_part(s: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shared shingles among the rarest ones of a set, rarest first."""
    order = np.lexsort((s, rank))[:len(s) - -(-PERCENT * len(s) // 100) + 1]
    return s[order[rank[order] > 1]]


def candidate_sets(docs: DataFrame):
    """(sets, candidates): every document's (gid, doc_id, tag, n, ka, kb), and
    (gid, n, grams, keys) of the representatives that may have links."""
    spark, n = docs.sparkSession, buckets_for(docs)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("train")).mapInArrow(
        lean(batches_of), "batch bigint, ids array<bigint>, train array<bigint>, lengths binary, vocabulary binary, tokens binary").rdd
    batches = rows.map(lambda r: (place(r[0], n), (
        "batch", (r[0], list(r[1]), list(r[2]), bytes(r[3]), bytes(r[4]), bytes(r[5]))))).partitionBy(n, same)
    sets = stored(spark.createDataFrame(batches.flatMap(lambda r: Texts(r[1][1]).rows()),
                                        "gid bigint, doc_id bigint, tag bigint, n int, ka bigint, kb bigint", verifySchema=False), "sets")
    chosen = sets.where("n > 0").groupBy("ka", "kb").agg(F.min("gid").alias("gid")).select("gid").rdd.map(
        lambda r: (place(r[0] >> DOC_BITS, n), ("chosen", r[0] >> DOC_BITS, r[0] % (1 << DOC_BITS)))).partitionBy(n, same)

    def texts(records: Iterable) -> Iterator[tuple]:
        found = list(records)
        mine, said = {}, {}
        for _, r in found:
            if r[0] == "chosen":
                mine.setdefault(r[1], []).append(r[2])
            elif r[0] == "rarity":
                said.setdefault(r[1], {})[r[2]] = r[3]
        for _, r in found:
            if r[0] == "batch":
                t = Texts(r[1])
                own = sorted(mine.get(t.key, []))
                yield t.key, own, [t.sets[i] for i in own], said.get(t.key, {})

    def ask(records: Iterable) -> Iterator[tuple]:
        for key, _, own, _ in texts(records):
            grams, counts, cuts = counted(own, n)
            for bucket, a, z in cuts:
                yield bucket, (key, pressed((grams[a:z] >> np.uint64(32)).astype(np.uint32)),
                               pressed(np.minimum(counts[a:z], 65535).astype(np.uint16)))

    marked = batches.union(chosen)
    told = marked.mapPartitions(lean(ask)).partitionBy(n, same).mapPartitions(lean(count_part)).map(
        lambda r: (place(r[0], n), r[1])).partitionBy(n, same)

    def candidates(records: Iterable) -> Iterator[tuple]:
        for key, ids, own, said in texts(records):
            grams, _, cuts = counted(own, n)
            rank = np.zeros(len(grams), np.uint8)
            for bucket, a, z in cuts:
                rank[a:z] = loosed(said[bucket], np.uint8)
            order = np.argsort(grams)
            ordered, rank = grams[order], rank[order]
            for i, s in zip(ids, own, strict=True):
                keys = rare_part(s, rank[np.searchsorted(ordered, s)])
                if len(keys):
                    yield (key << DOC_BITS) + i, len(s), bytearray(s.tobytes()), keys.view(np.int64).tolist()

    found = spark.createDataFrame(marked.union(told).mapPartitions(lean(candidates)),
                                  "gid bigint, n int, grams binary, keys array<bigint>", verifySchema=False)
    return sets, stored(found, "candidates")


# -- components -------------------------------------------------------------
def components(edges: DataFrame) -> DataFrame:
    """(gid, label): the least member of each component of ``edges`` (a, b), by
    large-star and small-star steps until nothing moves."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    pairs = stored(pairs, "pairs")
    while True:
        both = pairs.select("hi", "lo").union(pairs.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("node"), F.least("m", "hi").alias("m"))
        # every larger neighbour is linked to the least one
        large = (both.join(least, both["hi"] == least["node"]).where("lo > node").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .where("hi <> lo").distinct())
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(low, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
                 .select("e.*").where("hi <> lo").distinct())
        new = stored(small, "pairs")
        same_rows = new.count() == pairs.count() and new.join(pairs, ["hi", "lo"], "left_anti").isEmpty()
        pairs = new
        if same_rows:
            break
    return stored(pairs.select(F.col("hi").alias("gid"), F.col("lo").alias("label"))
                  .union(pairs.select(F.col("lo").alias("gid"), F.col("lo").alias("label")).distinct()), "labels")


def per_group(rows: DataFrame, keys: list[str], act) -> DataFrame:
    """``act(group)`` for each group of ``keys``, as (a, b) rows.  Groups pass by
    in sorted order, many to a task: one at a time is held in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, found = None, []
        for b in batches:
            if rest is not None:
                b = pd.concat([rest, b], ignore_index=True)
            if not len(b):
                continue
            key = b[keys].to_numpy()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if j - i > 1:
                    found.append(act(b.iloc[i:j]))
            rest = b.iloc[cuts[-1]:]  # may go on in the next batch
            if found:
                yield pd.concat(found)
                found = []
        if rest is not None and len(rest) > 1:
            yield act(rest)

    n = n_partitions(rows.sparkSession)
    return rows.repartition(n, *keys).sortWithinPartitions(*keys).mapInPandas(lean(run), "a bigint, b bigint")


def block_links(candidates: DataFrame, at: int) -> DataFrame:
    """Links within the groups of the ``at``-th shared shingle."""
    keyed = candidates.where(F.size("keys") > at).select("gid", "grams", F.col("keys")[at].alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    blocks = keyed.join(counts, "key").withColumn(
        "block", F.pmod(F.xxhash64("gid"), F.ceil(F.col("members") / BLOCK)).cast("int"))
    return per_group(blocks.select("key", "block", "gid", "grams"), ["key", "block"], tree_links)


def open_links(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between components that the rounds left apart: all sets that have
    a shingle of more than one component in their rare parts meet, in blocks,
    under the least label of that shingle."""
    known = candidates.join(labels, "gid", "left").withColumn("label", F.coalesce("label", "gid"))
    rows = known.select("gid", "label", F.explode("keys").alias("key"))
    apart = (rows.groupBy("key").agg(F.min("label").alias("meet"), F.max("label").alias("most"))
             .where("meet <> most").select("key", "meet"))
    members = stored(rows.join(apart, "key").select("meet", "gid").distinct(), "meetings")
    sizes = members.groupBy("meet").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    met = (members.join(sizes, "meet").withColumn("side", F.pmod(F.xxhash64("gid"), "blocks").cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .select("meet", F.least("side", "other").alias("one"), F.greatest("side", "other").alias("two"), "side", "gid"))
    return per_group(met.join(known.select("gid", "label", "grams"), "gid"), ["meet", "one", "two"], tree_links)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(gid, doc_id, tag, n_shingles, component, component_id) of every row of
    ``docs`` (doc_id, text): ``gid`` numbers the rows, ``tag`` is the hash of
    the text, ``component`` the least gid of the component."""
    sets, candidates = candidate_sets(docs.select("doc_id", "text"))
    edges = stored(block_links(candidates, 0).union(block_links(candidates, 1)), "links")
    more = stored(open_links(candidates, components(edges)), "more-links")
    labels = components(edges.union(more))
    groups = (sets.where("n > 0").groupBy("ka", "kb").agg(F.min("gid").alias("gid"), F.min("doc_id").alias("least_id"))
              .join(labels, "gid", "left").withColumn("component", F.coalesce("label", "gid")))
    # AQE splits the large partition that a component of very many sets makes
    least = groups.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_set = groups.join(least, "component").select("ka", "kb", "component", "component_id")
    return (sets.where("n > 0").join(of_set, ["ka", "kb"])
            .select("gid", "doc_id", "tag", F.col("n").cast("bigint").alias("n_shingles"), "component", "component_id")
            .union(sets.where("n = 0").select("gid", "doc_id", "tag", F.lit(0).cast("bigint"), F.col("gid"), F.col("doc_id"))))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: that of the least id."""
    found = stored(jaccard_components(docs), "components")
    kept = (found.groupBy("component").agg(F.min_by(F.struct("doc_id", "tag"), F.struct(F.col("doc_id").isNull(), "doc_id", "tag")).alias("k"))
            .select("k.*").distinct())
    whole = docs.select(F.struct("*").alias("doc"))  # no name can clash
    text = F.xxhash64("doc.text")
    out = whole.join(kept, text.eqNullSafe(F.col("tag")) & F.col("doc.doc_id").eqNullSafe(F.col("doc_id")), "left_semi")
    if not found.groupBy("doc_id", "tag").count().where("count > 1").isEmpty():
        # rows equal in id and text: one stays
        out = (out.select("doc", F.col("doc.doc_id").alias("doc_id"), text.alias("tag"))
               .dropDuplicates(["doc_id", "tag"]).select("doc"))
    return out.select("doc.*")


def op3_signature_tree(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE
    list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY 1
"""
