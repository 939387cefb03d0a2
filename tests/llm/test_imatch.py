import hashlib
import re
import struct
from collections import Counter

import xxhash

from shoplens.llm import imatch

from . import cases

SPACE = " \t\n\x0b\x0c\r"


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def terms(text):
    words = [w for w in re.split("[ \t-\r]+", (text or "").lower().strip(SPACE)) if w]
    return {signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in words}


def chain(values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=h)
    return h


def brute(texts, low, high):
    df = Counter(t for x in texts for t in terms(x))
    lexicon = {t for t, k in df.items() if low * len(texts) <= k <= high * len(texts)}

    def fingerprint(text):
        every = sorted(terms(text))
        kept = [t for t in every if t in lexicon]
        parts = [f"{chain(kept):X}" if kept else f"{chain(every):X}" if every else ""]
        for n, bits, skip in imatch.LEVELS:
            for j in range(n):
                a = [t for t in kept if ((t % 2**64) >> skip) % 2**bits == j]
                parts.append(f"{chain(a) % 2**32:X}" if a else "")
        return "-".join(parts)

    return fingerprint


def likeness(a, b):
    pairs = [(x, y) for x, y in zip(a.split("-"), b.split("-"), strict=True) if x or y]
    return 1.0 if a == b else sum(x == y for x, y in pairs) / len(pairs)


def test_against_brute_force(spark):
    rows = [(i, t) for i, t in cases.odd_rows() if i is not None and "\x1c" not in (t or "")]
    rows = [(k * 3, t) for k, (_, t) in enumerate(rows)]
    out = {r.doc_id: r for r in imatch.imatch_fingerprints(cases.docs(spark, rows), 0.1, 0.5).collect()}
    fingerprint = brute([t for _, t in rows], 0.1, 0.5)
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        r = out[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fingerprint(t) and r.edited_fingerprint == fingerprint(edited)
        assert abs(r.near_edited - likeness(r.fingerprint, r.edited_fingerprint)) < 1e-12
        assert abs(r.near_next - likeness(r.fingerprint, fingerprint(after))) < 1e-12


def test_odd_rows_and_empty_table(spark):
    rows = cases.odd_rows()
    out = imatch.imatch_fingerprints(cases.docs(spark, rows)).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    same = {r.fingerprint for r in out if r.doc_id in (7, 8)}
    assert len(same) == 1
    assert imatch.imatch_fingerprints(cases.empty(spark)).count() == 0
    one = imatch.imatch_fingerprints(cases.docs(spark, [(1, "a b c d")])).first()
    assert one.near_next == 1.0


def test_rows_find_their_range_by_halving(spark, monkeypatch):
    from pyspark.sql import functions as F

    made, aggregate = [], F.aggregate
    monkeypatch.setattr(F, "aggregate", lambda steps, *a: (made.append(steps), aggregate(steps, *a))[1])
    docs = cases.docs(spark, [(k, f"t{k}") for k in range(7 * 21)] + [(None, "t")]).select("doc_id", "text").withColumn("tie", F.xxhash64("text"))
    monkeypatch.setattr(imatch, "ranged", lambda df, *a: df.withColumn("pid", F.coalesce(F.floor(F.col("doc_id") / 7), F.lit(0)).cast("int")))
    rows, _ = imatch.with_next(docs, [])
    parts = {(r.doc_id, r.extra): r.part for r in rows.collect()}
    # a row in no part but its own, and the first row of a part at the end of the one before
    assert all(parts[k, 0] == k // 7 for k in range(7 * 21)) and parts[None, 0] == 0
    assert all(parts[7 * k, 1] == k - 1 for k in range(1, 21)) and parts[None, 1] == 20
    assert len(spark.range(1).select(made[0].alias("s")).first().s) == 5  # of 21 bounds


def test_terms_of_both_texts_are_grouped_once(spark):
    rows = [(k, f"a{k % 3} b{k % 4} c{k} d{k % 5} e{k % 2}") for k in range(30)]
    plan = imatch.imatch_fingerprints(cases.docs(spark, rows), 0.05, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 2 and plan.count("Generate explode") == 1
