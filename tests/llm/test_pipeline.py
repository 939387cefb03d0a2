from collections import Counter

import numpy as np
import zlib

import corpus_pipeline
from shoplens.llm import containment, crf, mixing, zstd_ids
from shoplens.llm.common import scratch_path
from shoplens.llm.features import fold

from . import cases
from .test_containment import brute as leaks
from .test_signature_tree import brute as groups
from .test_signature_tree import shingles

SF = "/root/testdata/sf0.01"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        seen.append(name)
        rows = [(r.doc_id, r.text) for r in before.collect()]
        got = Counter(r.doc_id for r in docs.collect())
        if name != "token_files":
            assert docs.columns == columns
        if name == "toxicity":
            scores = crf.score(before, crf.train(before, labels.where(fold(5) != 0))).collect()
            assert got == Counter(r.doc_id for r in scores if r.score < 0.5) and len(got) < len(rows)
        elif name == "near_duplicates":
            assert got == Counter(i for i, n, c in groups(rows) if i == c or not n) and len(got) < len(rows)
        elif name == "decontamination":
            bad = {i for i, *_ in leaks(rows, [(r.item_id, r.text) for r in bench.collect()])}
            assert got == Counter(i for i, _ in rows if i not in bad)
        elif name == "mixing":
            assert got == +Counter({r.doc_id: r.copies for r in mixing.rates(before, labels).collect()})
        else:
            from tokenizers import Tokenizer
            t = Tokenizer.from_file(zstd_ids.public_tokenizer())
            crc = lambda x: zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
            assert Counter((r.doc_id, r.ids_crc32) for r in docs.collect()) == Counter((i, crc(x)) for i, x in rows)
    assert seen == [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None


def test_odd_and_empty_tables_pass(spark, tmp_path):
    for rows in (cases.odd_rows(), []):
        d = str(tmp_path / str(len(rows)))
        docs = cases.docs(spark, rows)
        docs.write.parquet(f"{d}/documents.parquet")
        cases.labels(spark, [i for i, _ in rows]).write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, cases.prose(100, 30))] if rows else [], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
        out = corpus_pipeline.run(spark, d)
        assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and (rows or out.count() == 0)


def test_toxicity_stage_without_usable_labels_keeps_the_corpus(spark, tmp_path):
    docs = cases.docs(spark, cases.odd_rows())
    held_out = [i for i, in spark.range(1, 400).where(fold(5, "id") == 0).collect()]
    for k, ids in enumerate(([], held_out)):
        d = str(tmp_path / str(k))
        cases.labels(spark, ids).write.parquet(f"{d}/labels.parquet")
        out = corpus_pipeline.toxicity(spark, docs, d)
        assert out.columns == docs.columns
        assert Counter(r.doc_id for r in out.collect()) == Counter(i for i, _ in cases.odd_rows())
