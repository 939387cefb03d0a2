"""Benchmark decontamination: short test items found inside long documents.

Size-partitioned MinHash containment search.  Each item's set of five-word
shingles gets a MinHash signature: per slot (permutation) the shingle with the
least hash.  That shingle occurs in a document with a chance equal to the
item's containment in it, so one of ``slots`` minima of an item with 0.8 or
more inside is missed with a chance of at most 0.2**16.  A 20,000-word
document's own minima almost never fall into a 30-shingle item, so documents
are not reduced to theirs: the minima of the items are looked up among all
shingles of a document.  Items and documents are partitioned by size (powers of
two): a document is only searched for items that fit its partition's upper
bound.  Candidates are then verified by exact shingle containment.

The signatures are broadcast only while they have ``MAX_BROADCAST`` rows at
most; a larger benchmark is joined by a shuffle.

Defined results: words are compared in lower case; null or blank texts and
items have no shingles and never match; an item of fewer than five words is one
shingle and matches only a document of exactly these words; rows equal in id
and text are one document (or item); empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import broadcast_if, shingle_hashes, stored, table, text_key

THRESHOLD_PERCENT = 80
SLOTS = 16
MAX_BROADCAST = 2_000_000


def _size_class(n):
    return F.floor(F.log2(n)).cast("int")


def contaminated_pairs(docs: DataFrame, items: DataFrame, percent: int = THRESHOLD_PERCENT, slots: int = SLOTS,
                       id_col: str = "doc_id", text_col: str = "text",
                       item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, item_shingles, common_shingles, containment) of every
    item of which a document holds ``percent`` of the distinct shingles or more;
    with ``doc_key``, the hash pair that tells documents of equal id apart."""
    docs = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("doc_key"), F.col(text_col).alias("text"))
    grams = stored(
        items.select(F.col(item_id_col).alias("item_id"), text_key(F.col(item_text_col)).alias("item_key"),
                     F.array_distinct(shingle_hashes(F.col(item_text_col))).alias("grams")).distinct()
        .select(F.xxhash64("item_id", "item_key").alias("item"), "item_id", F.size("grams").alias("item_shingles"),
                F.explode("grams").alias("gram")), "item-shingles")
    signatures = stored(
        grams.select("item", "item_shingles", "gram", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
        .groupBy("item", "item_shingles", "slot").agg(F.min_by("gram", F.xxhash64("gram", "slot")).alias("gram"))
        .select("item", "gram", _size_class(F.ceil(F.col("item_shingles") * percent / 100)).alias("least_class"))
        .distinct(), "signatures")
    found = (docs.select("doc_id", "doc_key", shingle_hashes(F.col("text")).alias("grams"))
             .select("doc_id", "doc_key", _size_class(F.size("grams")).alias("size_class"), F.explode("grams").alias("gram"))
             .join(broadcast_if(signatures, MAX_BROADCAST), "gram")
             .where(F.col("size_class") >= F.col("least_class")))
    candidates = stored(found.select("doc_id", "doc_key").distinct(), "candidates")
    same = (docs["doc_key"] == F.col("c.doc_key")) & docs["doc_id"].eqNullSafe(F.col("c.doc_id"))
    common = (docs.join(broadcast_if(candidates, MAX_BROADCAST).alias("c"), same, "left_semi")
              .select("doc_id", "doc_key", F.explode(F.array_distinct(shingle_hashes(F.col("text")))).alias("gram")).distinct()
              .join(broadcast_if(grams, MAX_BROADCAST), "gram")
              .groupBy("doc_id", "doc_key", "item", "item_id", "item_shingles").agg(F.count("*").alias("common_shingles")))
    return (common.where(F.col("common_shingles") * 100 >= F.col("item_shingles") * percent)
            .select("doc_id", "item_id", F.col("item_shingles").cast("bigint").alias("item_shingles"), "common_shingles",
                    (F.col("common_shingles") / F.col("item_shingles")).alias("containment"), "doc_key"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    pairs = contaminated_pairs(docs, items)
    bad = stored(pairs.select("doc_id", "doc_key").distinct(), "contaminated")
    whole = docs.select(F.struct("*").alias("doc"))  # no name can clash
    same = text_key(F.col("doc.text")).eqNullSafe(F.col("doc_key")) & F.col("doc.doc_id").eqNullSafe(F.col("doc_id"))
    return whole.join(broadcast_if(bad, MAX_BROADCAST), same, "left_anti").select("doc.*")


def op6_containment(spark, sf_dir):
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("doc_key")


_SHINGLES = """
{t}_w AS (SELECT {id}, string_split_regex(trim(lower(text), E' \\t\\n\\x0b\\x0c\\r'), '[ \\t-\\r]+') AS w FROM {t}
          WHERE length(trim(coalesce(text, ''), E' \\t\\n\\x0b\\x0c\\r')) > 0),
{t}_s AS (SELECT DISTINCT {id}, g FROM (
            SELECT {id}, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE
              list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM {t}_w))"""

ORACLE = f"""
WITH {_SHINGLES.format(t="documents", id="doc_id")},{_SHINGLES.format(t="benchmark", id="item_id")},
sizes AS (SELECT item_id, count(*) AS item_shingles FROM benchmark_s GROUP BY 1),
common AS (SELECT doc_id, item_id, count(*) AS common_shingles FROM documents_s JOIN benchmark_s USING (g) GROUP BY 1, 2)
SELECT doc_id, item_id, item_shingles, common_shingles, common_shingles / item_shingles AS containment
FROM common JOIN sizes USING (item_id) WHERE common_shingles * 100 >= item_shingles * 80
"""
