import re

from shoplens.llm import containment

from . import cases

SPACE = " \t\n\x0b\x0c\r"


def shingles(text):
    w = [x for x in re.split("[ \t-\r]+", (text or "").lower().strip(SPACE)) if x]
    return {" ".join(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def table():
    rows = [r for r in cases.odd_rows() if "\x1c" not in (r[1] or "")]
    item = cases.prose(100, 40)
    w = item.split()
    edited = " ".join(w[:37] + ["other"] + w[38:])
    half = " ".join(w[:20])
    rows += [(20, cases.prose(21, 500) + " " + item.upper() + "\n" + cases.prose(22, 3000)), (21, edited), (22, half + cases.prose(23, 50)),
             (23, item), (23, item), (24, "Exactly Three Words")]
    return rows, [(1, item), (2, "exactly three words"), (3, None), (4, ""), (None, item), (1, cases.prose(101, 15)), (5, item)]


def brute(rows, bench):
    out = set()
    for i, t in rows:
        for k, x in bench:
            q, d = shingles(x), shingles(t)
            if q and 100 * len(q & d) >= 80 * len(q):
                out.add((i, k, len(q), len(q & d)))
    return out


def test_against_brute_force(spark):
    rows, bench = table()
    out = containment.contaminated_pairs(cases.docs(spark, rows), items(spark, bench)).collect()
    assert {(r.doc_id, r.item_id, r.item_shingles, r.common_shingles) for r in out} == brute(rows, bench)
    assert any(r.doc_id == 20 for r in out) and not any(r.doc_id == 22 for r in out)


def test_decontaminate_keeps_columns_and_clean_rows(spark):
    rows, bench = table()
    docs = cases.docs(spark, rows)
    out = containment.decontaminate(docs, items(spark, bench))
    bad = {i for i, *_ in brute(rows, bench)}
    assert out.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in out.collect()) == sorted(repr(i) for i, _ in rows if i not in bad)


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    rows, bench = table()
    monkeypatch.setattr(containment, "MAX_BROADCAST", 0)
    out = containment.contaminated_pairs(cases.docs(spark, rows), items(spark, bench)).collect()
    assert {(r.doc_id, r.item_id, r.item_shingles, r.common_shingles) for r in out} == brute(rows, bench)


def test_empty_tables(spark):
    rows, bench = table()
    assert containment.contaminated_pairs(cases.empty(spark), items(spark, bench)).count() == 0
    assert containment.contaminated_pairs(cases.docs(spark, rows), items(spark, [])).count() == 0
    assert containment.decontaminate(cases.docs(spark, rows), items(spark, [])).count() == len(rows)
