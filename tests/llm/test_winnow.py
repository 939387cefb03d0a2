import random
import re
from collections import Counter

from shoplens.llm import winnow

from . import cases


def brute(rows, min_words):
    """Every window of whole lines with enough words that occurred before goes."""
    docs = sorted({(i is not None, i or 0, t, i) for i, t in rows if t is not None}, key=lambda d: d[:2])
    first, gone = {}, {}
    for d in docs:
        lines = d[2].split("\n")
        size = [max(1, len([w for w in re.split("[ \t-\r]+", x) if w])) for x in lines]
        cut = set()
        for a in range(len(lines)):
            z = next((z for z in range(a, len(lines)) if sum(size[a:z + 1]) >= min_words), None)
            if z is not None and first.setdefault(tuple(lines[a:z + 1]), (d, a)) != (d, a):
                cut |= set(range(a, z + 1))
        gone[d[3], d[2]] = "\n".join(x for k, x in enumerate(lines) if k not in cut), len(cut)
    return gone


def test_against_brute_force(spark):
    rng = random.Random(2)
    pool = [cases.prose(k, rng.randrange(1, 9)) for k in range(25)] + ["", "  "]
    passage = [cases.prose(900 + k, 6) for k in range(4)]
    rows = []
    for i in range(60):
        lines = [rng.choice(pool) for _ in range(rng.randrange(1, 15))]
        if i % 3 == 0:
            lines[2:2] = passage
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (None, rows[0][1]), (5, rows[5][1])]
    docs = cases.docs(spark, rows)
    out = winnow.deduped(docs, 12)
    assert set(docs.columns) <= set(out.columns)
    expected = brute(rows, 12)
    got = out.collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    wanted = Counter((i, *((expected[i, t]) if t is not None else (None, 0))) for i, t in rows)
    assert Counter((r.doc_id, r.text, r.n_removed) for r in got) == wanted
    assert sum(r.n_removed for r in got) > 50


def test_odd_rows_and_empty_table(spark):
    rows = cases.odd_rows()
    out = winnow.deduped(cases.docs(spark, rows)).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    assert winnow.deduped(cases.empty(spark)).count() == 0


def brute_words(rows, min_words):
    """Every word in a run of ``min_words`` words that occurred before goes."""
    docs = sorted({(i is not None, i or 0, t, i) for i, t in rows if t is not None}, key=lambda d: d[:2])
    first, out = {}, {}
    for d in docs:
        pieces = re.findall("[^ \t-\r]+[ \t-\r]*", d[2])
        w, cut = [p.rstrip(" \t\n\v\f\r") for p in pieces], set()
        for a in range(len(w) - min_words + 1):
            if first.setdefault(tuple(w[a:a + min_words]), (d, a)) != (d, a):
                cut |= set(range(a, a + min_words))
        lead = re.match("[ \t-\r]*", d[2])[0]
        out[d[3], d[2]] = lead + "".join(p for k, p in enumerate(pieces) if k not in cut), len(w), len(cut)
    return out


def test_passages_inside_lines_against_brute_force(spark):
    rng = random.Random(4)
    passage = [cases.prose(700 + k, 20).split() for k in range(4)]
    rows = []
    for i in range(50):
        w = cases.prose(i, rng.randrange(5, 60)).split()
        if i % 2:  # starts and ends anywhere, its lines broken elsewhere
            at = rng.randrange(len(w))
            w[at:at] = passage[i % 4][rng.randrange(6):]
        rows.append((i, rng.choice(["", "  "]) + "".join(x + rng.choice([" ", " ", "  ", "\n", "\t"]) for x in w)))
    again = " ".join(passage[0])
    rows += [(100, None), (101, ""), (None, rows[1][1]), (5, rows[5][1]), (103, again + " " + again), (104, "a " * 90)]
    docs = cases.docs(spark, rows)
    out = winnow.without_passages(docs, 12)
    assert set(docs.columns) <= set(out.columns)
    expected = brute_words(rows, 12)
    wanted = Counter((i, *(expected[i, t] if t is not None else (None, 0, 0))) for i, t in rows)
    got = out.collect()
    assert Counter((r.doc_id, r.text, r.n_words, r.n_removed) for r in got) == wanted
    assert sum(r.n_removed for r in got) > 200
    assert winnow.without_passages(cases.empty(spark)).count() == 0
    odd = winnow.without_passages(cases.docs(spark, cases.odd_rows())).collect()
    assert Counter(r.doc_id for r in odd) == Counter(i for i, _ in cases.odd_rows())
