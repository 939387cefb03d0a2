"""Token ids of whole batches of texts by a public tokenizer.

A tokenizer that splits at white space gives a text the ids of its white-space
pieces in order.  So a batch is cut into pieces by Arrow, its distinct pieces
into a run of letters and the marks after it; these parts are looked up among
those remembered (or encoded, some thousands at once), and the ids of all texts
are gathered from them at once.  All of it stays in arrays: as Python objects
the new pieces of a batch took several times the room.  Tokenizers of another
make encode whole texts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Parts of pieces a Python worker remembers the ids of, before it begins anew.
MAX_CACHE = 400_000
# Bytes of text that are worked on at once, and new parts that are encoded at once.
CHUNK_BYTES = 4 << 20
LEARNT_AT_ONCE = 5000

# Letters that neither compose nor change length in lower case: a run of them
# is one piece to the tokenizer, and so is a run of marks after it (but for
# apostrophes and what may begin a special token).
PLAIN = r"^(?P<head>[A-Za-zÀ-ÖØ-öø-įı-ɏ]+)(?P<marks>[!-&(-/:;=-@\[-`{-~]*)\z"


def splits_at_space(path: str) -> bool:
    """Whether the tokenizer drops white space, joins nothing across it and
    marks the last id of a word."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    normal = (made.get("normalizer") or {}).get("normalizers") or []
    cuts = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    pattern = (cuts[0].get("pattern") or {}).get("Regex", "")
    return (made["model"].get("end_of_word_suffix") == "</w>"
            and [n["type"] for n in normal] == ["NFC", "Replace", "Lowercase"] and normal[1]["pattern"] == {"Regex": r"\s+"}
            and cuts[0].get("type") == "Split" and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") is True
            and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"))


def runs(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``pool`` one after the other, and where each begins and the
    last ends."""
    to = np.zeros(len(sizes) + 1, np.int32 if int(sizes.sum(dtype=np.int64)) < 1 << 31 else np.int64)
    np.cumsum(sizes, out=to[1:])
    at = np.arange(to[-1], dtype=to.dtype)
    at += np.repeat(starts - to[:-1], sizes)
    return pool[at], to


class WordEncoder:
    """Ids of texts as arrays of ``dtype`` (16 bits if all fit)."""

    def __init__(self, path: str, *others: int):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        top = max(vocabulary.values())
        self.dtype = np.dtype("<u2") if max(top, *others, 0) < 65536 else np.dtype("<u4")
        self.by_word = splits_at_space(path)
        self.ends = np.zeros(top + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        """Known parts, and where the ids of each begin in ``pool``."""
        self.words, self.pool, self.starts = pa.array([""], pa.large_string()), np.empty(0, self.dtype), np.zeros(2, np.int32)

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts one after the other, and how many each has."""
        made = [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        return np.concatenate([*made, np.empty(0, self.dtype)]), np.array([len(m) for m in made], np.int64)

    def _encode_heads(self, heads: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for runs of letters, encoded as one text."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(heads)], add_special_tokens=False)[0].ids, self.dtype)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(cuts, prepend=0)) if len(cuts) == len(heads) else self._encode(heads)

    def _learn(self, heads: pa.Array, others: pa.Array) -> None:
        """Add distinct parts that are not known: runs of letters, and others."""
        pool, counts = [self.pool], [np.diff(self.starts)]
        for encode, parts in ((self._encode_heads, heads), (self._encode, others)):
            for a in range(0, len(parts), LEARNT_AT_ONCE):
                ids, sizes = encode(parts.slice(a, LEARNT_AT_ONCE).to_pylist())
                pool.append(ids)
                counts.append(sizes)
        self.words = pa.concat_arrays([self.words, heads, others])
        self.pool = np.concatenate(pool)
        self.starts = np.concatenate([np.zeros(1, np.int32), np.cumsum(np.concatenate(counts), dtype=np.int32)])

    def _find(self, parts: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(parts, value_set=self.words), -1).to_numpy()

    def _known(self, first: pa.Array, plain: np.ndarray, second: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of parts among the known, learning the others; a ``first``
        part is a run of letters where ``plain``."""
        at = self._find(pa.concat_arrays([first, second]))
        if len(self.words) > MAX_CACHE and (at < 0).any():
            self._forget()
            at = self._find(pa.concat_arrays([first, second]))
        if (at < 0).any():
            new, beside = at[:len(first)] < 0, at[len(first):] < 0
            heads, others = first.filter(pa.array(new & plain)), pa.concat_arrays([first.filter(pa.array(new & ~plain)), second.filter(pa.array(beside))])
            self._learn(heads.unique(), others.unique())
            at = at.copy()
            at[at < 0] = self._find(pa.concat_arrays([first.filter(pa.array(new)), second.filter(pa.array(beside))]))
        return at[:len(first)], at[len(first):]

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces one after the other, and where each begins."""
        cut = pc.extract_regex(pieces, PLAIN)
        first = pc.coalesce(pc.utf8_lower(pc.struct_field(cut, "head")), pieces)
        second = pc.fill_null(pc.struct_field(cut, "marks"), "")
        both = np.stack(self._known(first, cut.is_valid().to_numpy(zero_copy_only=False), second), axis=1).ravel()
        starts = self.starts[both]
        sizes = self.starts[both + 1] - starts
        ids, to = runs(self.pool, starts, sizes)
        return ids, to[::2]

    def _chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_word:
            return self._encode(texts.to_pylist())
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        pool, at = self._pieces(words.dictionary)
        which = words.indices.to_numpy()
        ids, to = runs(pool, at[which], np.diff(at)[which])
        return ids, np.diff(to[split.offsets.to_numpy() - split.offsets[0].as_py()])

    def encode_all(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty) one after the other, ``end_id``
        after each, and the number of ids of each."""
        if not len(texts):
            return np.empty(0, self.dtype), np.empty(0, np.int64)
        ids, counts = self._chunk(pc.fill_null(texts.cast(pa.large_string()), ""))
        out = np.empty(len(ids) + len(counts), self.dtype)
        ended = np.zeros(len(out), bool)
        ended[np.cumsum(counts + 1) - 1] = True
        out[ended] = end_id
        out[~ended] = ids
        return out, counts + 1


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut where their texts exceed ``CHUNK_BYTES``."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy()
        group = np.cumsum(sizes, dtype=np.int64) // CHUNK_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if z > a:
                yield b.slice(a, z - a)


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
