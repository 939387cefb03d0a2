"""I-Match fingerprints.

A document's terms are its distinct lower-cased words.  Terms whose share of
documents lies in ``[low, high]`` -- an inverse-document-frequency band -- form
the lexicon.  A fingerprint hashes the sorted in-band terms as a whole and
within 64 randomised subsets of the lexicon, from a quarter of it down to a
4096th (``LEVELS``), so that documents of any length have subsets with few
terms, which an edit can leave alone.  Two fingerprints are as
alike as the share of equal hashes among the subsets in which either has terms.

Document frequencies cover all rows.  At most ``mean distinct terms / low``
terms can lie in the band, whatever the corpus size, so the lexicon may go to
every executor; above MAX_BROADCAST_TERMS terms the join is left to a shuffle.

Defined results: null text counts as empty; a text without in-band terms is
has the hash of all its terms instead; a text without words has hashes of nothing
(empty strings), which are equal to each other; rows with equal ids are ordered
by text hash; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.common import SPACE_REGEX, broadcast_if, let, ranged, stored, table

LOW, HIGH = 0.001, 0.1
# a larger lexicon is joined by a shuffle instead
MAX_BROADCAST_TERMS = 4_000_000
# (subsets, each of 1 / 2**bits of the lexicon; bits of the term hash skipped)
LEVELS = ((4, 2, 0), (4, 4, 2), (8, 6, 6), (16, 8, 12), (16, 10, 20), (16, 12, 30))


def terms(text: Column) -> Column:
    """Hashes of the distinct words; white space at the ends leaves an empty
    word, which is dropped by its hash (trimming goes through a text by the
    character, twice)."""
    hashed = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE_REGEX), lambda w: F.xxhash64(w))
    return F.array_remove(F.array_distinct(hashed), F.xxhash64(F.lit("")))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """The in-band term hashes, stored."""
    n = docs.count()
    counts = docs.select(F.explode(terms(F.col(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return stored(counts.where((F.col("df") >= low * n) & (F.col("df") <= high * n)).select("term"), "lexicon")


def fingerprint(in_band: Column, all_terms: Column) -> Column:
    """65 hashes joined by ``-``: of the sorted in-band terms (or the hash of
    all terms where none is in band), then of the 64 subsets."""
    digest = lambda a: F.when(F.size(a) > 0, F.hex(F.pmod(F.xxhash64(a), F.lit(2**32)))).otherwise("")

    def subsets(ordered: Column, n: int, bits: int, skip: int) -> Column:
        # n is a power of two: the bits above it tell the level's terms, those below the subset
        of_level = F.filter(ordered, lambda h: h.bitwiseAND((2**bits - n) << skip) == 0) if n < 2**bits else ordered
        return let(of_level, lambda a: F.array_join(F.transform(
            F.array(*[F.lit(j << skip).cast("bigint") for j in range(n)]),
            lambda j: let(F.filter(a, lambda h: h.bitwiseAND((n - 1) << skip) == j), digest)), "-"))

    whole = F.when(F.size(in_band) > 0, F.hex(F.xxhash64(in_band))).otherwise(F.coalesce(F.hex(all_terms), F.lit("")))
    return F.concat_ws("-", whole, *[subsets(in_band, *level) for level in LEVELS])


def likeness(one: Column, other: Column) -> Column:
    pairs = F.zip_with(F.split(one, "-"), F.split(other, "-"), lambda x, y: F.when((x != "") | (y != ""), x == y))
    shown = F.size(F.filter(pairs, lambda p: p.isNotNull()))
    return F.when(one == other, F.lit(1.0)).otherwise(F.size(F.filter(pairs, lambda p: p)) / shown)


def with_next(docs: DataFrame, columns: list[str]):
    """``docs`` (columns ``doc_id``, ``tie``, ...) dealt into range partitions
    with the first row of the next partition added to each (``extra`` 1; the
    first of all after the last), and the window that orders a partition."""
    firsts = sorted((r["pid"], r["first"]["doc_id"], r["first"]["tie"]) for r in
                    ranged(docs.select("doc_id", "tie"), ["doc_id", "tie"], "bounds")
                    .groupBy("pid").agg(F.min(F.struct("doc_id", "tie")).alias("first")).collect())
    id_type = docs.schema["doc_id"].dataType
    bounds = [F.struct(F.lit(d).cast(id_type).alias("doc_id"), F.lit(t).cast("bigint").alias("tie")) for _, d, t in firsts]
    key = F.struct("doc_id", "tie")
    part = F.lit(0)
    if len(bounds) > 1:
        # the last bound that is not above the row, by halving: as many bounds as
        # partitions met every row before, so the work grew with the square
        steps = [2**k for k in reversed(range((len(bounds) - 1).bit_length()))]
        part = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(
            F.when(at + step < len(bounds), F.get(F.array(*bounds), at + step) <= key).otherwise(False), at + step).otherwise(at))
    dealt = docs.withColumn("part", part).withColumn("extra", F.lit(0))
    lead = dealt.limit(0)
    if bounds:
        is_first = key.eqNullSafe(F.element_at(F.array(*bounds), F.col("part") + 1))
        lead = (dealt.where(is_first).dropDuplicates(["part"]).withColumn("extra", F.lit(1))
                .withColumn("part", F.pmod(F.col("part") - 1, F.lit(len(bounds)))))
    order = Window.partitionBy("part").orderBy("extra", F.col("doc_id").asc_nulls_first(), "tie")
    return dealt.unionByName(lead).select("part", "extra", "doc_id", "tie", *columns), order


def imatch_fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH,
                        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text (second half replaced by
    the start of the next document) and their likeness."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    lex = broadcast_if(lexicon(docs, "text", low, high), MAX_BROADCAST_TERMS).withColumn("in_band", F.lit(True))
    rows, order = with_next(docs, ["text"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("after"), F.lit(1), half))
    paired = (rows.withColumn("after", F.coalesce(F.lead("text").over(order), F.lit("")))
              .withColumn("row", F.row_number().over(order))
              .select("part", "row", "extra", "doc_id", n.cast("bigint").alias("n_chars"), "text", edited.alias("edited"))
              .withColumn("text_terms", terms(F.col("text"))).withColumn("edited_terms", terms(F.col("edited"))))

    def marks(of: Column, which: int) -> Column:
        """One entry for each term: ``which`` 1 in the text, 2 in the edited text, 3 in both."""
        return F.transform(of, lambda h: F.struct(F.col("row").alias("row"), h.alias("term"), F.lit(which).alias("which"), F.lit(None).cast(
            "struct<extra:int,doc_id:bigint,n_chars:bigint,sha:string,all_terms:bigint,all_edited:bigint>").alias("info")))

    hashed = lambda of: F.when(F.size(of) > 0, F.xxhash64(F.sort_array(of)))
    # one entry with what the result needs
    info = F.struct("extra", "doc_id", "n_chars", F.sha2("edited", 256).alias("sha"),
                    hashed("text_terms").alias("all_terms"), hashed("edited_terms").alias("all_edited"))
    entries = F.concat(
        F.array(F.struct(F.col("row"), F.lit(None).cast("bigint").alias("term"), F.lit(0).alias("which"), info.alias("info"))),
        marks(F.array_intersect("text_terms", "edited_terms"), 3), marks(F.array_except("text_terms", "edited_terms"), 1),
        marks(F.array_except("edited_terms", "text_terms"), 2))
    in_band = lambda which: F.sort_array(F.collect_list(F.when(F.col("which").bitwiseAND(which) > 0, F.col("term"))))
    # Grouping keeps the partitioning by part: no shuffle from here on.
    both = (paired.select("part", F.explode(entries).alias("t"))
            .select("part", "t.*").join(lex, "term", "left").where("term IS NULL OR in_band")
            .groupBy("row", "part").agg(in_band(1).alias("of_text"), in_band(2).alias("of_edited"),
                                        F.first("info", ignorenulls=True).alias("info"))
            .select("part", "row", "info.extra", "info.doc_id", "info.n_chars", "info.sha",
                    fingerprint(F.col("of_text"), F.col("info.all_terms")).alias("fingerprint"),
                    fingerprint(F.col("of_edited"), F.col("info.all_edited")).alias("edited_fingerprint")))
    following = Window.partitionBy("part").orderBy("row")
    return (both.withColumn("next_fingerprint", F.lead("fingerprint").over(following)).where("extra = 0")
            .select("doc_id", "n_chars", F.col("sha").alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                    likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                    likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next")))


def op5_imatch(spark, sf_dir):
    return imatch_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
