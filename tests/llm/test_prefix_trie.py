import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplens.llm import prefix_trie

WORD = re.compile("[^\x20\x09-\x0d]+")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(spark, rows):
    """rows: (conv_id, turn, role, text), with columns whose names clash."""
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for c in ("turns", "seq", "key", "donor", "words", "cut", "shard", "upper", "n_convs"):
        df = df.withColumn(c, F.lit("x"))
    return df


def md5(t):
    return hashlib.md5(t.encode()).hexdigest()


def rebuild(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", md5(text or ""), text or ""))
    turns = {c: [(r, t) for _, _, r, _, t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in turns.items():
        h, donor = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = [*turns.get(donor, [])[:h], *ts[h:]]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = Counter(n[:-1] for n in members if n)
    saved, leaves = Counter(), Counter()
    for n, cs in members.items():
        own = (len(cs) - 1) * len(WORD.findall(n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            saved[n[:d]] += own
            leaves[n[:d]] += not children[n]
    out = []
    for n, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(convs[c]) == len(n)))
        out.append((min(cs), len(n), min(members[n[:-1]]) if n else None, len(cs), children[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def nodes(df, **how):
    how = {"shard_sequences": 1} | how
    return Counter(tuple(r) for r in prefix_trie.trie_nodes(prefix_trie.rebuilt(df), **how).select(*COLUMNS).collect())


def forest(seed, n=150, few=3):
    """Conversations that share prefixes of any depth."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, ["user", "assistant"][t % 2], f"say {rng.randrange(few)} " * rng.randrange(1, 3)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "few", "shard_turns"), [(1, 3, 4096), (1, 3, 10), (2, 1, 5), (3, 40, 30), (4, 2, 0), (5, 3, 0)])
def test_forests_against_brute_force(spark, seed, few, shard_turns, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 3)
    rows = forest(seed, few=few)
    assert nodes(table(spark, rows), shard_turns=shard_turns, shard_sequences=seed % 3, task_turns=40) == brute(rebuild(rows))


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "MAX_BROADCAST_ROWS", 0)
    rows = forest(6, 60)
    assert nodes(table(spark, rows), shard_turns=8) == brute(rebuild(rows))


def test_odd_rows(spark):
    long = "w " * 20_000
    rows = [(0, 0, "user", "a b"), (0, 1, None, None), (0, None, "user", "first"), (1, 0, "user", ""), (2, 5, "", " \n"), (2, 5, "user", "tie"),
            (2, 5, "user", "tie"), (2, 5, "user", "other"), (3, 0, "user", "a b"), (None, 0, "user", "lost"), (None, None, None, None),
            (-4, 0, "user", "minus"), (-41, 2, "user", "minus"), (45, 0, "user", long), (40, 0, "user", long), (40, 1, "a", "ab"), (41, 0, "aa", "b"),
            (100_000_000_000, 1, "x", "é\x00\x1c"), (63, 0, "only", "one"), (64, 0, "only", "one")]
    rows += [(60 + k, t, "user", f"same {t}") for k in range(5, 19) for t in range(4)]
    made = rebuild(rows)
    assert any(not ts for ts in made.values())
    for shard_turns in (4096, 2):
        assert nodes(table(spark, rows), shard_turns=shard_turns) == brute(made)


def test_many_copies_and_long_conversations(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(400) for t in range(5)] + [(1001, t, "user", f"turn {t % 7}") for t in range(600)]
    assert nodes(table(spark, rows), shard_turns=50) == brute(rebuild(rows))


def test_turnless_only_and_empty(spark):
    gone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    rows = [(gone, 0, "user", "x")]
    assert nodes(table(spark, rows)) == brute(rebuild(rows)) and len(brute(rebuild(rows))) == 1
    out = prefix_trie.trie_nodes(prefix_trie.rebuilt(table(spark, [])))
    assert out.count() == 0 and out.columns == ["key", "parent", *COLUMNS]


@pytest.mark.parametrize("seed", range(6))
def test_double_array(seed):
    rng = random.Random(seed)
    seqs = [[rng.randrange(1, rng.choice([3, 50]) + 1) for _ in range(rng.randrange(8))] for _ in range(200)]
    trie = prefix_trie.DoubleArray(np.array([i for s in seqs for i in s], np.int64), np.array([len(s) for s in seqs], np.int64))
    prefixes, state_of = {tuple(s[:d]) for s in seqs for d in range(len(s) + 1)}, {(): 0}
    for p in sorted(prefixes, key=len):
        for c in range(1, 55):
            to = int(trie.child(np.array([state_of[p]]), np.array([c]))[0])
            assert (to >= 0) == ((*p, c) in prefixes)
            if to >= 0:
                state_of[(*p, c)] = to
    assert len(set(state_of.values())) == len(prefixes) == (trie.check >= 0).sum()
    for depth, on, at in trie.levels():
        assert at.tolist() == [state_of[tuple(seqs[k][:depth])] for k in on]
