"""Toxic spans: a linear-chain conditional random field with two tags.

Tokens are words with their ends' punctuation cut off, lower-cased.  ``labels``
marks whole documents, so tokens are labelled first: a token of a toxic
training document is toxic if its word (of any length), or its first four or
five letters, is in many toxic training documents (``MIN_SHARE``) and far fewer clean ones
(``MIN_ODDS``); all others, and all tokens of clean documents, are clean.  The field has hashed weights for
the word, its first 3, 4 and 5 and last 3 letters, and the words before and
after, and a transition matrix; it is trained by stochastic gradient on the
log likelihood of the tag sequences (forward-backward), from a bounded sample
of labelled documents.

Scoring runs forward-backward over every whole text.  The marginals give the
offending spans (character offsets of runs of tokens with a marginal of 0.5 or
more) and, as largest and summed marginal, the document's score through a
logistic fitted on the sample.

Defined results: null counts as empty; a text without words has the marginals
of no tokens (score low, no spans); equal texts score equal; without toxic
labelled rows no token is toxic; without labelled rows, or with toxic ones
only, nothing tells toxic from clean: the field is untrained, every score is
0, no row is predicted toxic and ``without_toxic`` keeps every document; a null
id is never held out and never learned from; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import lean, table
from shoplens.llm.features import fold, labelled_sample

MAX_SAMPLE = 4000
BUCKETS = 1 << 18
MIN_ODDS = 20.0
MIN_DOCS = 3
MIN_SHARE = 0.02
EPOCHS = 4
RATE = 0.05
L2 = 1e-6
# tokens padded together, documents trained together, words remembered
PADDED = 400_000
GROUP = 64
MAX_CACHE = 300_000

TOKEN = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")


def kinds(word: str) -> tuple[str, ...]:
    """The features of a token by itself."""
    return "w" + word, "3" + word[:3], "4" + word[:4], "5" + word[:5], "e" + word[-3:]


def folded(text: str) -> str:
    """Lower case, letter by letter where the whole would change in length, so
    that offsets hold in the text itself."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c, x in zip(text, map(str.lower, text), strict=True))


def bucket(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature) % BUCKETS


def padded_groups(lengths: np.ndarray, most_rows: int) -> Iterator[np.ndarray]:
    """Indices of sequences of like length, ``PADDED`` cells a group at most
    (or one sequence)."""
    order = np.argsort(lengths, kind="stable")[::-1]
    at = 0
    while at < len(order):
        n = max(1, min(most_rows, PADDED // max(1, int(lengths[order[at]]))))
        yield order[at:at + n]
        at += n


def chain(emission: np.ndarray, lengths: np.ndarray, trans: np.ndarray):
    """Forward-backward for padded sequences (longest first).

    ``emission`` holds the log odds of the toxic tag per token, ``trans`` the
    log weights; row ``i`` is one time step.  Returns the marginals of the
    toxic tag, and the expected counts of the four tag pairs.
    """
    steps, n = emission.shape
    e = np.exp(np.clip(emission, -30, 30))
    (a, b), (c, d) = np.exp(trans)
    live = lengths[None, :] > np.arange(steps)[:, None]
    alive = live.sum(axis=1)
    fwd, bwd = np.ones((steps, n)), np.ones((steps, n))
    r = np.ones(n)
    for t in range(steps):
        k = alive[t]
        r = e[t, :k] if t == 0 else e[t, :k] * (b + d * r[:k]) / (a + c * r[:k])
        fwd[t, :k] = r
    q = np.ones(n)  # toxic to clean, of what follows
    for t in range(steps - 2, -1, -1):
        k = alive[t + 1]
        x = e[t + 1, :k] * q[:k]
        q[:k] = (c + d * x) / (a + b * x)
        bwd[t, :k] = q[:k]
    odds = fwd * bwd
    marginal = np.where(live, odds / (1 + odds), 0.0)
    if steps < 2:
        return marginal, np.zeros((2, 2))
    x = e[1:] * bwd[1:]
    w = np.stack([np.full_like(x, a), b * x, c * fwd[:-1], d * fwd[:-1] * x])
    w = np.where(live[1:], w / w.sum(axis=0), 0.0)
    return marginal, w.sum(axis=(1, 2)).reshape(2, 2)


def padded(values: list[np.ndarray], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(values[i]) for i in group])
    out = np.zeros((max(1, int(lengths.max(initial=0))), len(group)))
    for j, i in enumerate(group):
        out[:lengths[j], j] = values[i]
    return out, lengths


def summary(marginals: np.ndarray) -> list[float]:
    """What a document's score depends on."""
    total = float(marginals.sum())
    return [float(marginals.max(initial=0.0)), np.log1p(total), min(total, 3.0)]


class ToxicChain:
    def __init__(self):
        self.weights = np.zeros(BUCKETS)  # toxic against clean, of the token's own features
        self.before, self.after = np.zeros(BUCKETS), np.zeros(BUCKETS)
        self.bias, self.trans = 0.0, np.zeros((2, 2))
        self.document = np.zeros(4)
        self.trained = False
        self.memory: tuple[dict[str, int], list[tuple[float, float, float]]] = ({}, [])

    def sent(self) -> dict:
        """What a worker needs to score."""
        small = {k: getattr(self, k).astype(np.float32) for k in ("weights", "before", "after")}
        return self.__dict__ | small | {"memory": ({}, [])}

    # -- training ---------------------------------------------------------
    def fit(self, texts: list[str], y: np.ndarray) -> ToxicChain:
        if not (y <= 0).any():
            return self
        self.trained = True
        docs = [TOKEN.findall(folded(t)) for t in texts]
        toxic = self._toxic_features(docs, y)
        vocabulary: dict[str, int] = {}
        tokens = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in d), np.int64, len(d)) for d in docs]
        own = np.array([[bucket(f) for f in kinds(w)] for w in vocabulary], np.int64).reshape(-1, 5)
        near = own[:, 0]
        marked = np.array([any(f in toxic for f in kinds(w)) for w in vocabulary], bool)
        tags = [marked[t] & (label > 0) for t, label in zip(tokens, y, strict=True)]
        share = np.clip(sum(t.sum() for t in tags) / max(1, sum(map(len, tags))), 1e-5, 0.5)
        self.bias = float(np.log(share / (1 - share)))
        step, moments = 0, [np.zeros(3 * BUCKETS + 5) for _ in range(2)]
        theta = np.concatenate([self.weights, self.before, self.after, [self.bias], self.trans.ravel()])
        groups = list(padded_groups(np.array([len(t) for t in tokens]), GROUP))
        rng = np.random.default_rng(3)
        for epoch in range(EPOCHS):
            for g in rng.permutation(len(groups)):
                group = groups[g]
                ids, lengths = padded(tokens, group)
                if lengths.max(initial=0) == 0:
                    continue
                ids = ids.astype(np.int64)
                live = lengths[None, :] > np.arange(len(ids))[:, None]
                w, p, q = np.split(theta[:-5], 3)
                per_word = w[own].sum(axis=1)
                prev = np.where(np.arange(len(ids))[:, None] > 0, p[near[np.roll(ids, 1, axis=0)]], 0.0)
                following = np.roll(live, -1, axis=0) & (np.arange(len(ids))[:, None] < len(ids) - 1)
                nxt = np.where(following, q[near[np.roll(ids, -1, axis=0)]], 0.0)
                marginal, pairs = chain(per_word[ids] + prev + nxt + theta[-5], lengths, theta[-4:].reshape(2, 2))
                gold, _ = padded([t.astype(float) for t in tags], group)
                diff = np.where(live, marginal - gold, 0.0)
                n_live = live.sum()
                seen = np.bincount(ids[live], diff[live], len(near))
                grad = L2 * theta
                for k in range(5):
                    grad[:BUCKETS] += np.bincount(own[:, k], seen, BUCKETS) / n_live * 100
                inner = live.copy()
                inner[0] = False
                grad[BUCKETS:2 * BUCKETS] += np.bincount(near[np.roll(ids, 1, axis=0)[inner]], diff[inner], BUCKETS) / n_live * 100
                grad[2 * BUCKETS:-5] += np.bincount(near[np.roll(ids, -1, axis=0)[following]], diff[following], BUCKETS) / n_live * 100
                grad[-5] += diff.sum() / n_live * 100
                x, z = gold[:-1].astype(int), gold[1:].astype(int)
                real = np.bincount((2 * x + z)[live[1:]], minlength=4) if len(gold) > 1 else np.zeros(4)
                grad[-4:] += (pairs.ravel() - real) / n_live * 100
                step += 1
                moments[0] = 0.9 * moments[0] + 0.1 * grad
                moments[1] = 0.99 * moments[1] + 0.01 * grad * grad
                theta -= RATE * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        self.weights, self.before, self.after = np.split(theta[:-5], 3)
        self.bias, self.trans, self.memory = float(theta[-5]), theta[-4:].reshape(2, 2).copy(), ({}, [])
        self._fit_document(texts, y)
        return self

    @staticmethod
    def _toxic_features(docs: list[list[str]], y: np.ndarray) -> set[str]:
        """Words and word beginnings that tell toxic from clean documents."""
        seen = {True: Counter(), False: Counter()}
        for d, label in zip(docs, y, strict=True):
            seen[label > 0].update({f for w in set(d) for f in kinds(w) if f[0] == "w" or f[0] in "45" and len(f) > 4})
        n_toxic, n_clean = int((y > 0).sum()), int((y <= 0).sum())
        return {f for f, k in seen[True].items() if k >= max(MIN_DOCS, MIN_SHARE * n_toxic)
                and (k + 0.5) / (n_toxic + 1) >= MIN_ODDS * (seen[False][f] + 0.5) / (n_clean + 1)}

    def _fit_document(self, texts: list[str], y: np.ndarray) -> None:
        x = np.array([[1.0, *summary(m)] for _, m in self.marginals(texts)])
        beta = np.zeros(4)
        for _ in range(50):  # Newton steps of a ridge logistic
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            h = x.T @ (x * (p * (1 - p))[:, None]) + 0.05 * np.eye(4)
            beta -= np.linalg.solve(h, x.T @ (p - y) + 0.05 * beta)
        self.document = beta

    # -- scoring ----------------------------------------------------------
    def marginals(self, texts: list[str]) -> list[tuple[list[tuple[int, int]], np.ndarray]]:
        """Per text: the tokens' character offsets and marginals."""
        # word -> place in the list of its effects on itself, the next and the last token
        known, effect = self.memory
        if len(known) > MAX_CACHE:
            known.clear(), effect.clear()

        def look(word: str) -> int:
            k = known.get(word)
            if k is None:
                ids = [bucket(f) for f in kinds(word)]
                effect.append((float(self.weights[ids].sum()), float(self.before[ids[0]]), float(self.after[ids[0]])))
                k = known[word] = len(effect) - 1
            return k

        tokens = []
        for t in texts:
            low = TOKEN.findall(folded(t))
            tokens.append(np.fromiter(map(look, low), np.int64, len(low)))
        effects = np.array(effect).reshape(-1, 3)
        emission = []
        for t in tokens:
            e = effects[t]
            x = e[:, 0] + self.bias
            x[1:] += e[:-1, 1]
            x[:-1] += e[1:, 2]
            emission.append(x)
        out = [np.zeros(0)] * len(texts)
        for group in padded_groups(np.array([len(t) for t in tokens]), 512):
            block, lengths = padded(emission, group)
            m, _ = chain(block, lengths, self.trans)
            for j, i in enumerate(group):
                out[i] = m[:lengths[j], j]
        return list(zip(texts, out, strict=True))

    def results(self, texts: list[str]) -> list[tuple[float, list[tuple[int, int]]]]:
        """Per text: the score and the offending spans."""
        found = []
        for text, m in self.marginals(texts):
            z = float(self.document @ [1.0, *summary(m)])
            spans: list[list[int]] = []
            if (m >= 0.5).any():
                last = -2
                for k, match in enumerate(TOKEN.finditer(folded(text))):
                    if m[k] >= 0.5:
                        if last == k - 1:
                            spans[-1][1] = match.end()
                        else:
                            spans.append([match.start(), match.end()])
                        last = k
            found.append((float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), [tuple(s) for s in spans]))
        return found


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_SAMPLE) -> ToxicChain:
    """A field from ``labels`` as given (held-out rows must have been taken out)."""
    rows = sorted(labelled_sample(docs, labels, "toxic", max_rows).collect(), key=lambda r: r["doc_id"])
    return ToxicChain().fit([r["text"] or "" for r in rows], np.array([float(r["label"] > 0) for r in rows]))


def score(docs: DataFrame, model: ToxicChain) -> DataFrame:
    """(doc_id, score, predicted, spans) of every whole text; spans are
    character offsets [start, end) into the text."""
    sent = docs.sparkSession.sparkContext.broadcast(model.sent())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = ToxicChain.__new__(ToxicChain)
        m.__dict__.update(sent.value | {"memory": ({}, [])})
        for b in batches:
            texts = [t or "" for t in b["text"]]
            for at in range(0, len(texts), 1000):
                found = m.results(texts[at:at + 1000])
                p = np.array([f[0] if m.trained else 0.0 for f in found])
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[at:at + 1000].astype("Int64").array, "score": p,
                                    "predicted": (p >= 0.5).astype("int32"),
                                    "spans": [[{"start": x, "end": y} for x, y in f[1]] for f in found]})

    return docs.select("doc_id", "text").mapInPandas(
        lean(run), "doc_id bigint, score double, predicted int, spans array<struct<start:int,end:int>>")


def without_toxic(docs: DataFrame, model: ToxicChain, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more; all of
    ``docs``, with a warning, if the field is untrained."""
    if not model.trained:
        warnings.warn("toxicity: no usable labelled rows, every document is kept", stacklevel=2)
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model.sent())

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = ToxicChain.__new__(ToxicChain)
        m.__dict__.update(sent.value | {"memory": ({}, [])})
        for b in batches:
            texts = [t or "" for t in b]
            yield pd.Series([s for at in range(0, len(texts), 1000) for s, _ in m.results(texts[at:at + 1000])], dtype="float64")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from lean(scores)(batches)

    return docs.where(F.pandas_udf(run, "double")(F.col("text")) < threshold)


def op4_crf_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(fold(5) != 0))
    return score(docs, model).select("doc_id", fold(5).eqNullSafe(F.lit(0)).alias("held_out"), "score", "predicted", "spans")
