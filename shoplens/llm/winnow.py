"""Line dedup by winnowing.

A document is the sequence of its lines (split at line feeds).  From each line
starts a window: it and the following lines until ``min_words`` words are
reached (a line counts as one word at least).  Of each window the least line
hash is selected, so two documents that share a run of lines with
``min_words`` words or more have selected the same line inside it: a guaranteed
fingerprint.  Windows whose fingerprint was selected at one position only in
the whole corpus drop out; the others are joined by the hash of the window's
lines to its first position in corpus order (id, text hash, line).  Every later
window is a repeat; overlapping windows extend a match line by line both ways
to the whole repeated run, and the lines of all repeats are deleted.

Hot lines stay cheap: positions are counted with partial aggregation, and each
window is linked to the first position only, never to all others.

Defined results: null text stays null with 0 lines; runs of fewer words stay;
the first occurrence stays (of a run that overlaps its own repeat, the lines
before the repeat); rows equal in id and text are one document and get the
same result; null ids come first; an empty table gives no rows; other columns
are kept in ``deduped`` and ignored in the query.

Passages that start or end inside a line are left by the line rule.
``without_passages`` finds them too: its windows are ``min_words`` words in a
row, selected by the least hash of the word runs of half that length inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.common import let, stored, table, text_key, words

MIN_WORDS = 50
SPACE_CLASS = "\\x20\\x09-\\x0D"


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, doc_key, removed): the line numbers to delete, of the documents
    of ``docs`` (doc_id, doc_key, text) that have any."""
    doc = ["doc_id", "doc_key"]
    per_line = F.transform(F.split("text", "\n"), lambda x: F.struct(
        F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(31), x).alias("b")).alias("line"),
        F.greatest(F.lit(1), F.size(words(x))).alias("n_words")))
    lines = (docs.where(F.col("text").isNotNull())
             .select(*doc, F.posexplode(per_line).alias("pos", "l"))
             .groupBy(*doc, "pos").agg(F.max("l").alias("l")).select(*doc, "pos", "l.*"))
    before = F.sum("n_words").over(Window.partitionBy(*doc).orderBy("pos")) - F.col("n_words")
    reach = Window.partitionBy(*doc).orderBy("words_before").rangeBetween(0, min_words - 1)
    run = F.collect_list("line").over(reach)
    windows = stored(
        lines.withColumn("words_before", before)
        .withColumn("run", run).withColumn("in_run", F.sum("n_words").over(reach))
        .where(F.col("in_run") >= min_words)
        .select(*doc, "pos", F.size("run").alias("n_lines"), F.array_min("run").alias("mark"),
                (F.col("pos") + F.array_position("run", F.array_min("run")) - 1).alias("mark_pos"),
                F.struct(F.xxhash64("run").alias("a"), F.xxhash64(F.lit(37), "run").alias("b")).alias("run_key")),
        "windows")
    shared = (windows.select(*doc, "mark", "mark_pos").distinct().groupBy("mark").agg(F.count("*").alias("n"))
              .where("n > 1").select("mark"))
    matched = windows.join(shared, "mark", "left_semi")
    place = F.struct("doc_id", "doc_key", "pos")
    first = (matched.groupBy("run_key").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return (matched.join(first, "run_key").where(~place.eqNullSafe(F.col("first")))
            .select(*doc, F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n_lines") - 1)).alias("pos"))
            .groupBy(*doc).agg(F.collect_set("pos").alias("removed")))


def deduped(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` replaced by its kept lines, and ``n_lines`` and
    ``n_removed``."""
    whole = docs.select(F.struct("*").alias("doc"), text_key(F.col("text")).alias("key"))  # no name can clash
    gone = repeated_lines(docs.select("doc_id", text_key(F.col("text")).alias("doc_key"), "text"), min_words).alias("gone")
    text = F.col("doc.text")
    lines = F.split(text, "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("gone.removed"), i)), "\n")
    joined = whole.join(gone, (F.col("key") == F.col("doc_key")) & F.col("doc.doc_id").eqNullSafe(F.col("doc_id")), "left")
    return joined.select(
        *[F.col(f"doc.`{c}`") for c in docs.columns if c not in ("text", "n_lines", "n_removed")],
        F.when(F.col("gone.removed").isNull(), text).otherwise(kept).alias("text"),
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone.removed"), F.lit(0)).cast("bigint").alias("n_removed"))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, doc_key, spans): the runs of words [first, last] (from 1) to
    delete, in order, of the documents of ``docs`` (doc_id, doc_key, text) that
    have any."""
    doc = ["doc_id", "doc_key"]
    in_gram = (min_words + 1) // 2
    in_window = min_words - in_gram + 1  # grams
    n = F.size("h")

    def key(h: Column) -> Column:
        return F.struct(F.xxhash64(h).alias("a"), F.xxhash64(F.lit(37), h).alias("b"))

    hashed = (docs.where(F.col("text").isNotNull()).groupBy(*doc).agg(F.max("text").alias("text"))
              .select(*doc, F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("h"))
              .where(n >= min_words))
    grams = F.transform(F.sequence(F.lit(1), n - in_gram + 1), lambda i: F.struct(
        F.xxhash64(F.slice("h", i, in_gram)).alias("gram"), i.alias("at")))
    least = F.transform(F.sequence(F.lit(1), n - min_words + 1), lambda i: F.array_min(F.slice("g", i, in_window)))
    marks = stored(hashed.withColumn("g", grams).select(*doc, F.explode(F.array_distinct(least)).alias("m"))
                   .select(*doc, "m.*"), "marks")
    shared = marks.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    near = (marks.join(shared, "gram", "left_semi").groupBy(*doc).agg(F.collect_set("at").alias("at"))
            .withColumnsRenamed({"doc_id": "id", "doc_key": "key"}))
    starts = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(
        F.greatest(F.lit(1), p - in_window + 1), F.least(p, n - min_words + 1)))))
    windows = stored(hashed.join(near, (F.col("doc_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")))
                     .select(*doc, "h", F.explode(starts).alias("pos"))
                     .select(*doc, "pos", key(F.slice("h", F.col("pos"), min_words)).alias("run_key")), "passages")
    place = F.struct("doc_id", "doc_key", "pos")
    first = windows.groupBy("run_key").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    by_place = Window.partitionBy(*doc).orderBy("pos")
    return (windows.join(first, "run_key").where(~place.eqNullSafe(F.col("first"))).select(*doc, "pos")
            .withColumn("new", F.coalesce(F.col("pos") - F.lag("pos").over(by_place) > min_words, F.lit(True)))
            .withColumn("run", F.sum(F.col("new").cast("int")).over(by_place))
            .groupBy(*doc, "run").agg(F.min("pos").alias("first"), (F.max("pos") + min_words - 1).alias("last"))
            .groupBy(*doc).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans")))


def without_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` replaced by its kept words, each with the white
    space that follows it, and ``n_words`` and ``n_removed``.

    A word goes if it lies in ``min_words`` words in a row, wherever lines end,
    that occurred before in corpus order.
    """
    whole = docs.select(F.struct("*").alias("doc"), text_key(F.col("text")).alias("key"))
    gone = repeated_passages(docs.select("doc_id", text_key(F.col("text")).alias("doc_key"), "text"), min_words).alias("gone")
    text, spans = F.col("doc.text"), F.col("gone.spans")
    joined = whole.join(gone, (F.col("key") == F.col("doc_key")) & F.col("doc.doc_id").eqNullSafe(F.col("doc_id")), "left")
    pieces = F.regexp_extract_all(text, F.lit(f"([^{SPACE_CLASS}]+[{SPACE_CLASS}]*)"))

    def between(p: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["last"]))
        firsts = F.concat(F.transform(spans, lambda s: s["first"]), F.array(F.size(p) + 1))
        return F.flatten(F.zip_with(ends, firsts, lambda a, b: F.slice(p, a + 1, b - a - 1)))

    kept = F.concat(F.regexp_extract(text, f"^[{SPACE_CLASS}]*", 0), F.array_join(let(pieces, between), ""))
    removed = F.aggregate(spans, F.lit(0), lambda n, s: n + s["last"] - s["first"] + 1)
    return joined.select(
        *[F.col(f"doc.`{c}`") for c in docs.columns if c not in ("text", "n_words", "n_removed")],
        F.when(spans.isNull(), text).otherwise(kept).alias("text"),
        F.size(words(text)).cast("bigint").alias("n_words"),
        F.coalesce(removed, F.lit(0)).cast("bigint").alias("n_removed"))


def op7_winnow_passages(spark, sf_dir):
    return without_passages(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", "text")


def op7_winnow_lines(spark, sf_dir):
    return deduped(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed", "text")


ORACLE = f"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                    generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
l AS (SELECT *, greatest(1, len(list_filter(string_split_regex(line, '[ \\t-\\r]+'), lambda x: x <> ''))) AS n FROM raw),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) - n AS before FROM l),
w AS (SELECT a.doc_id, a.pos, max(b.pos) AS last, string_agg(b.line, chr(10) ORDER BY b.pos) AS run
      FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.before BETWEEN a.before AND a.before + {MIN_WORDS - 1}
      GROUP BY 1, 2 HAVING sum(b.n) >= {MIN_WORDS}),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS nth FROM w),
gone AS (SELECT DISTINCT c.doc_id, c.pos FROM r JOIN c ON r.doc_id = c.doc_id AND c.pos BETWEEN r.pos AND r.last WHERE nth > 1),
kept AS (SELECT c.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
                coalesce(string_agg(c.line, chr(10) ORDER BY c.pos) FILTER (WHERE g.pos IS NULL), '') AS text
         FROM c LEFT JOIN gone g ON c.doc_id = g.doc_id AND c.pos = g.pos GROUP BY 1)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, k.text
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

PASSAGES = f"""
WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[^ \\t-\\r]+[ \\t-\\r]*') AS p,
                  list_filter(string_split_regex(text, '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - {MIN_WORDS - 1})) AS pos FROM t WHERE len(w) >= {MIN_WORDS}),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY array_to_string(w[pos:pos + {MIN_WORDS - 1}], ' ')
                                             ORDER BY doc_id, pos) AS nth FROM c),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(pos, pos + {MIN_WORDS - 1})) AS pos FROM r WHERE nth > 1),
e AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS pos FROM t),
k AS (SELECT e.doc_id, count(g.pos) AS n_removed,
             string_agg(e.piece, '' ORDER BY e.pos) FILTER (WHERE g.pos IS NULL) AS kept
      FROM e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY 1)
SELECT t.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       CASE WHEN n_removed > 0 THEN regexp_extract(text, '^[ \\t-\\r]*') || coalesce(kept, '') ELSE text END AS text
FROM t LEFT JOIN k USING (doc_id)
"""
