"""Small tables with everything that may be odd."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# columns that an operator may use inside
CLASHES = ["row", "size", "pid", "part", "label", "n", "gid", "key", "tie", "doc_key", "score", "count", "position", "gram",
           "term", "extra", "pos", "removed", "_id", "_key", "copies", "rate", "train", "item_id", "salt", "_tag", "in_band"]


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{int(rng.paretovariate(0.8)) % vocabulary}x{rng.randrange(40)}" for _ in range(n))


def docs(spark, rows, clashes: bool = True):
    """rows: (doc_id, text); the other columns are made up, clashing names added."""
    full = [(i, t, ["en", "de", "fr", "es", None][k % 5], "src0" if k % 3 else None, len(t) if t else None) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(full, SCHEMA)
    for c in CLASHES if clashes else []:
        df = df.withColumn(c, F.lit(None).cast("string") if c < "m" else F.lit("x"))
    return df


def odd_rows():
    long = prose(5, 20_000)
    same = prose(9, 40)
    return [(1, prose(1, 60)), (2, None), (3, ""), (4, " \n\t "), (5, "one"), (6, "one two three four"), (7, same), (8, same), (9, same),
            (9, same), (9, prose(11, 30)), (None, prose(12, 30)), (None, None), (None, same), (10, long), (11, "Ünïcode — ẞtraße 𝔘 \x1c\x85\xa0 İΣ " * 9),
            (12, "line\n" * 50), (13, same + " end"), (-4, prose(13, 25)), (14, "\x00null byte"), (15, "a " * 3000)]


def empty(spark):
    return docs(spark, [])


def labels(spark, ids, quality=lambda i: i % 4 > 0, toxic=lambda i: i % 3 == 0):
    rows = [(i, int(quality(i)), int(toxic(i))) for i in ids if i is not None]
    return spark.createDataFrame([*rows, (None, 1, 1), (777_777, None, None)], "doc_id bigint, quality int, toxic int")


def as_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
