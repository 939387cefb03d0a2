"""Token-id files: one zstandard frame per document with a shared dictionary.

Documents are sorted by id over range partitions, encoded with a public
tokenizer, and packed into blocks.  A block is one row of a Parquet file: the
frames of its documents one after the other, each compressed by itself with
the dictionary, the frames' offsets, the documents' ids and token counts, the
tokens before the block within its partition, and the dictionary's SHA-256.  A
short document is read by its block's id range and its offset, without
decompressing others.  The dictionary is trained on the serialized ids of a
bounded sample of documents and stored beside the blocks.  Spark's own writer
and reader move the files, so any store that Spark reaches will do.

Batches of texts are encoded at once (``word_ids``); a tokenizer that does not
split at white space encodes whole texts.  The number of range partitions
follows the bytes of text (``PART_BYTES``).

Defined results: null counts as empty, and an empty text has the end id only;
null ids come first; rows of equal id are ordered by text hash, equal rows take
adjacent places; an empty table gives no rows (and a dictionary of no bytes);
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import kept, lean, n_partitions, scratch_path, table
from shoplens.llm.word_ids import WordEncoder, chunks, public_tokenizer

END_ID = 2
# The dictionary: bytes, and the documents (count, characters each) it is trained on.
DICTIONARY_BYTES = 65536
SAMPLE_DOCS, SAMPLE_CHARS = 2000, 20_000
LEVEL = 2
BLOCK_DOCS, BLOCK_IDS = 512, 1 << 20
PART_BYTES = 64 << 20

BLOCK = pa.schema([("part", pa.int32()), ("ids_before", pa.int64()), ("sha256", pa.string()), ("id_bytes", pa.int32()),
                   ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())),
                   ("frames", pa.binary())])


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """A zstandard dictionary from the documents whose id has the least hash;
    no bytes if there are too few to train on."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(f"ids of {tokenizer}", lambda: WordEncoder(tokenizer, END_ID))
        for b in chunks(batches):
            made, counts = encoder.encode_all(b.column("text"), END_ID)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in np.split(made, np.cumsum(counts)[:-1])][:len(counts)], pa.binary())], ["ids"])

    sample = (docs.where(F.length("text").between(1, SAMPLE_CHARS)).select("doc_id", "text")
              .orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(SAMPLE_DOCS).select("text"))
    samples = sorted(bytes(r["ids"]) for r in sample.mapInArrow(lean(ids), "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples
        return b""


def write_ids(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Write the id files of ``docs`` (doc_id, text) under ``path``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dictionary = train_dictionary(docs, tokenizer)
    sha = hashlib.sha256(dictionary).hexdigest()
    spark.range(1).select(F.lit(sha).alias("sha256"), F.lit(dictionary).alias("dictionary")).write.parquet(f"{path}/dictionary")
    sent = spark.sparkContext.broadcast(dictionary)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(f"ids of {tokenizer}", lambda: WordEncoder(tokenizer, END_ID))
        shared = zstandard.ZstdCompressionDict(sent.value) if sent.value else None
        if shared:
            shared.precompute_compress(level=LEVEL)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True)
        part, before, held, ids, counts, frames = TaskContext.get().partitionId(), 0, 0, [], [], []

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{
                "part": part, "ids_before": before, "sha256": sha, "id_bytes": encoder.dtype.itemsize,
                "doc_ids": ids, "n_tokens": counts, "offsets": np.cumsum([0, *map(len, frames)]), "frames": b"".join(frames)}], schema=BLOCK)

        for b in chunks(batches):
            made, sizes = encoder.encode_all(b.column("text"), END_ID)
            data, at = memoryview(made).cast("B"), 0
            for doc_id, size in zip(b.column("doc_id").to_pylist(), sizes.tolist(), strict=True):
                end = at + size * encoder.dtype.itemsize
                ids.append(doc_id)
                counts.append(size)
                frames.append(compressor.compress(data[at:end]))
                at, held = end, held + size
                if len(ids) >= BLOCK_DOCS or held >= BLOCK_IDS:
                    yield block()
                    before, held, ids, counts, frames = before + held, 0, [], [], []
        if ids:
            yield block()

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    (docs.repartitionByRange(max(n_partitions(spark), -(-size // PART_BYTES)), *order).sortWithinPartitions(*order)
     .mapInArrow(lean(pack), "part int, ids_before bigint, sha256 string, id_bytes int, doc_ids array<bigint>, "
                       "n_tokens array<bigint>, offsets array<bigint>, frames binary")
     .withColumn("first_id", F.array_min("doc_ids")).withColumn("last_id", F.array_max("doc_ids"))
     .write.option("compression", "uncompressed").parquet(f"{path}/blocks"))


def read_dictionary(spark, path: str) -> bytes:
    r = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(r["dictionary"])
    if hashlib.sha256(data).hexdigest() != r["sha256"]:
        raise ValueError("the dictionary does not have the hash it was stored with")
    return data


def read_ids(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, ``ids`` as bytes of
    little-endian unsigned 32-bit integers."""
    dictionary = read_dictionary(spark, path)
    sha = hashlib.sha256(dictionary).hexdigest()
    blocks = spark.read.parquet(f"{path}/blocks")
    starts, total = {}, 0
    # one number per partition written
    for r in (blocks.select("part", F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
              .groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()):
        starts[r["part"]] = total
        total += r["n"]

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        decompressor = zstandard.ZstdDecompressor(dict_data=shared)
        for b in batches:
            for r in b.itertuples():
                if r.sha256 != sha:
                    raise ValueError("a block was written with another dictionary")
                counts = np.asarray(r.n_tokens)
                ids = []
                for a, z in zip(r.offsets[:-1], r.offsets[1:], strict=True):
                    data = decompressor.decompress(r.frames[a:z])
                    ids.append(np.frombuffer(data, f"<u{r.id_bytes}").astype("<u4").tobytes())
                yield pd.DataFrame({"doc_id": pd.array(list(r.doc_ids), "Int64"),
                                    "start": starts[r.part] + r.ids_before + np.cumsum(counts) - counts,
                                    "n_tokens": counts, "ids": ids})

    return blocks.mapInPandas(lean(unpack), "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def read_document(spark, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents of one id: only its block and frame are read."""
    decompressor = zstandard.ZstdDecompressor(
        dict_data=zstandard.ZstdCompressionDict(d) if (d := read_dictionary(spark, path)) else None)
    found = spark.read.parquet(f"{path}/blocks").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    hits = (found.select("part", "ids_before", "id_bytes", "frames", F.posexplode("doc_ids").alias("k", "id"), "offsets").where(F.col("id") == doc_id)
            .select("part", "ids_before", "k", "id_bytes", F.expr("substring(frames, int(offsets[k]) + 1, int(offsets[k + 1] - offsets[k]))").alias("frame")))
    return [np.frombuffer(decompressor.decompress(bytes(r["frame"])), f"<u{r['id_bytes']}").tolist()
            for r in hits.orderBy("part", "ids_before", "k").collect()]


def checked(ids: DataFrame) -> DataFrame:
    """The digest of what ``read_ids`` returns."""
    return ids.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_zstd_ids(spark, sf_dir):
    path = scratch_path(spark, "ids")
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizer())
    return checked(read_ids(spark, path))
