import itertools
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from shoplens.llm import word_ids, zstd_ids
from shoplens.llm.common import scratch_path

from . import cases

PATH = word_ids.public_tokenizer()


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def ids(plain, text):
    return [*plain.encode(text or "", add_special_tokens=False).ids, zstd_ids.END_ID]


ODD = ["", " ", "a", "Don't we'll 'tis it's", "x<|endoftext|>y <|startoftext|>", "İstanbul ΣΊΣΥΦΟΣ ß ŉ ǅ Ǆ K Å", "é ́a á.",
       "1234 5,6 a1b2", "YES!!", "a$$$ b&&& c.,!! d<| e<|endoftext|>!", "it's' x'", "rock'n'roll ''s", "Hello,World! foo.bar... baz?! end.", "\x1c a\x85b\xa0c d　e", "漢字 한글 하", "mail@x.org http://a/b?c=d", "\x00 � 🙂🙂"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("cache", [word_ids.MAX_CACHE, 5])
def test_batches_give_the_tokenizers_ids(name, cache, monkeypatch):
    monkeypatch.setattr(word_ids, "MAX_CACHE", cache)
    path = word_ids.public_tokenizer(name)
    tokenizer = Tokenizer.from_file(path)
    texts = [*ODD, " ".join(ODD), *[t for _, t in cases.odd_rows()], *ODD]
    encoder = word_ids.WordEncoder(path)
    monkeypatch.setattr(word_ids, "CHUNK_BYTES", 100)
    parts = [*word_ids.chunks([pa.record_batch([pa.array(texts)], ["text"]), pa.record_batch([pa.array([], pa.string())], ["text"])])]
    assert len(parts) > 5 and [t for p in parts for t in p.column("text").to_pylist()] == texts
    for part in parts:
        made, counts = encoder.encode_all(part.column("text"), 2)
        for text, got in zip(part.column("text").to_pylist(), np.split(made, np.cumsum(counts)[:-1]), strict=True):
            assert got.tolist() == ids(tokenizer, text), text
    assert [len(x) for x in encoder.encode_all(pa.array([], pa.string()), 2)] == [0, 0]


def test_random_texts_give_the_tokenizers_ids(plain):
    rng = random.Random(3)
    letters = "aZéÉßøĦ'’.,!?-$<|>\x1c\x85\xa0\u0301\u0307İſK漢9 \t\n" * 3 + "abcdefghst"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    made, counts = word_ids.WordEncoder(PATH).encode_all(pa.array(texts), 2)
    for text, got in zip(texts, np.split(made, np.cumsum(counts)[:-1]), strict=True):
        assert got.tolist() == ids(plain, text), text


def test_parts_of_pieces_are_remembered_once(plain):
    """Case and marks give no new entries, and a batch of new pieces takes
    arrays, no Python objects for each of them."""
    heads = ["".join(x) for x in itertools.product("abcdefgh", repeat=4)]
    pieces = [f(h) + m for h, f, m in itertools.product(heads, (str.lower, str.title, str.upper), ("", ".", "!!", "$$$", ",-&"))]
    encoder = word_ids.WordEncoder(PATH)
    texts = pa.array([" ".join(pieces[a::20]) for a in range(20)])
    encoder.encode_all(pa.array(["a"]), 2)
    tracemalloc.start()
    try:
        made, counts = encoder.encode_all(texts, 2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    for text, got in zip(texts.to_pylist(), np.split(made, np.cumsum(counts)[:-1]), strict=True):
        assert got.tolist() == ids(plain, text)
    assert len(encoder.words) <= len(heads) + 10
    assert peak < 200 * len(pieces)


def test_round_trip(spark, plain, monkeypatch):
    monkeypatch.setattr(zstd_ids, "BLOCK_DOCS", 4)
    rows = cases.odd_rows() + [(100 + k, t) for k, t in enumerate(ODD)] + [(200 + k, cases.prose(k, 80)) for k in range(60)]
    path = scratch_path(spark, "ids")
    zstd_ids.write_ids(cases.docs(spark, rows), path, PATH)
    out = sorted(zstd_ids.read_ids(spark, path).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in out) == Counter((i, tuple(ids(plain, t))) for i, t in rows)
    at = 0
    for r in out:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    order = [r.doc_id for r in out]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    digest = {r.start: r.ids_crc32 for r in zstd_ids.checked(zstd_ids.read_ids(spark, path)).collect()}
    assert all(digest[r.start] == zlib.crc32(r.ids) for r in out)
    assert zstd_ids.read_document(spark, path, 205) == [ids(plain, cases.prose(5, 80))]
    assert sorted(zstd_ids.read_document(spark, path, 9)) == sorted(ids(plain, t) for i, t in rows if i == 9)


def test_dictionary_hash_is_checked(spark):
    path, other = scratch_path(spark, "ids"), scratch_path(spark, "ids")
    zstd_ids.write_ids(cases.docs(spark, [(k, cases.prose(k, 200)) for k in range(300)]), path, PATH)
    zstd_ids.write_ids(cases.docs(spark, [(k, cases.prose(k + 999, 150)) for k in range(300)]), other, PATH)
    assert zstd_ids.read_dictionary(spark, path) and zstd_ids.read_dictionary(spark, path) != zstd_ids.read_dictionary(spark, other)
    spark.read.parquet(f"{other}/dictionary").write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(Exception, match="another dictionary"):
        zstd_ids.read_ids(spark, path).collect()


def test_empty_table(spark):
    path = scratch_path(spark, "ids")
    zstd_ids.write_ids(cases.empty(spark), path, PATH)
    assert zstd_ids.read_ids(spark, path).count() == 0
