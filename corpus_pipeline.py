"""From raw documents to token-id files, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``.

1. toxicity: documents that the conditional random field scores 0.5 or more go;
2. near duplicates: of each component of the n-gram Jaccard join the document
   of the least id stays;
3. decontamination: documents that hold a benchmark item go;
4. mixing: documents are repeated or dropped by rates that bring the expected
   domain token totals to the targets;
5. output: token-id files with a shared zstandard dictionary, read back as
   (doc_id, start, n_tokens, ids_crc32).

All stages but the last return the columns of ``documents``.  Empty tables,
null texts and ids, repeated rows and extra columns pass as the operators'
docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoplens.llm import containment, crf, mixing, signature_tree, zstd_ids
from shoplens.llm.common import scratch_path, table
from shoplens.llm.features import fold


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return crf.without_toxic(docs, crf.train(docs, table(spark, sf_dir, "labels").where(fold(5) != 0)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return signature_tree.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return containment.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ids")
    zstd_ids.write_ids(docs, path, zstd_ids.public_tokenizer())
    return zstd_ids.checked(zstd_ids.read_ids(spark, path))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
    ("token_files", token_files),
]

# classifiers, components and tokenizers are beyond SQL; see tests/llm
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
