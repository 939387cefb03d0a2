"""Quality classifier: a factorisation machine.

``score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)`` over
hashed words, structure statistics and the length of the text; the pairwise
part is ``1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``, linear in the
features present.  Trained by Adam on a bounded sample of labelled rows
(``MAX_SAMPLE``), then every whole text is scored where it lies; only the model
(a fixed ``WORD_BUCKETS x (RANK + 1)`` table) travels.

Defined results: null counts as empty; an empty text is scored from its
statistics; equal texts score equal; without labelled rows every score is 0.5;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import table
from shoplens.llm.features import MAX_SAMPLE, N_STATS, WORD_BUCKETS, Buckets, featurize, fold, labelled_sample

RANK = 8
EPOCHS = 12
BATCH = 128
RATE = 0.02
L2 = 1e-5


class FactorMachine:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = WORD_BUCKETS + N_STATS
        self.w0, self.w, self.v = 0.0, np.zeros(n), rng.normal(0, 0.01, (n, RANK))
        self.mean, self.std = np.zeros(N_STATS), np.ones(N_STATS)

    def inputs(self, ids, weights, stats) -> tuple[np.ndarray, np.ndarray]:
        scaled = np.clip((stats - self.mean) / self.std, -4, 4) / 2
        return np.concatenate([ids, WORD_BUCKETS + np.arange(N_STATS)]), np.concatenate([weights, scaled])

    def raw(self, ids, x) -> float:
        v = self.v[ids]
        s = x @ v
        return float(self.w0 + x @ self.w[ids] + 0.5 * (s @ s - (x * x) @ (v * v).sum(axis=1)))

    def probability(self, ids, weights, stats) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(*self.inputs(ids, weights, stats)), -30, 30))))

    def fit(self, rows: list[tuple], y: np.ndarray, seed: int = 11) -> FactorMachine:
        if not rows:
            return self
        stats = np.stack([r[2] for r in rows])
        self.mean, self.std = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3)
        inputs = [self.inputs(*r) for r in rows]
        rng = np.random.default_rng(seed)
        table_ = np.concatenate([self.w[:, None], self.v], axis=1)
        m, s, step = np.zeros_like(table_), np.zeros_like(table_), 0
        share = np.clip(y.mean(), 0.01, 0.99)
        self.w0 = float(np.log(share / (1 - share)))
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), BATCH):
                chosen = order[at:at + BATCH]
                ids = np.concatenate([inputs[i][0] for i in chosen])
                x = np.concatenate([inputs[i][1] for i in chosen])
                sizes = np.array([len(inputs[i][0]) for i in chosen])
                starts, row = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(chosen)), sizes)
                vx = table_[ids, 1:] * x[:, None]
                sums = np.add.reduceat(vx, starts)
                z = self.w0 + np.add.reduceat(table_[ids, 0] * x, starts) + 0.5 * (
                    (sums * sums).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), starts))
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[chosen]) / len(chosen)
                gx = g[row] * x
                grad = L2 * table_
                grad[:, 0] += np.bincount(ids, gx, len(table_))
                each = gx[:, None] * (sums[row] - vx)
                for f in range(RANK):
                    grad[:, 1 + f] += np.bincount(ids, each[:, f], len(table_))
                step += 1
                m = 0.9 * m + 0.1 * grad
                s = 0.999 * s + 0.001 * grad * grad
                table_ -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
                self.w0 -= RATE * g.sum()
        self.w, self.v = table_[:, 0].copy(), table_[:, 1:].copy()
        return self


def train(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_SAMPLE) -> FactorMachine:
    """A machine for ``labels.<label>`` from ``labels`` as given (held-out rows
    must have been taken out)."""

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = Buckets()
        for b in batches:
            f = [featurize(t, buckets) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"].astype("float64"),
                                "ids": [x[0].astype(np.int32).tobytes() for x in f],
                                "weights": [x[1].astype(np.float32).tobytes() for x in f],
                                "stats": [x[2].tobytes() for x in f]})

    rows = sorted(labelled_sample(docs, labels, label, max_rows)
                  .mapInPandas(features, "doc_id bigint, label double, ids binary, weights binary, stats binary").collect(),
                  key=lambda r: r["doc_id"])
    data = [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["weights"], np.float32).astype(float),
             np.frombuffer(r["stats"])) for r in rows]
    return FactorMachine().fit(data, np.array([r["label"] for r in rows]))


def score(docs: DataFrame, model: FactorMachine, threshold: float) -> DataFrame:
    """(doc_id, score, predicted) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model.__dict__)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, buckets = FactorMachine.__new__(FactorMachine), Buckets()
        m.__dict__.update(sent.value)
        for b in batches:
            p = np.array([m.probability(*featurize(t, buckets)) for t in b["text"]])
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": p, "predicted": (p >= threshold).astype("int32")})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, score double, predicted int")


def op10_factor_machine(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(fold(4) != 2), "quality")
    return score(docs, model, 0.7).select("doc_id", fold(4).eqNullSafe(F.lit(2)).alias("held_out"), "score", "predicted")
