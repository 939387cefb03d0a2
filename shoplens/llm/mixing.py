"""Mixing sources to target weights by soft domain membership.

A softmax classifier over text features, trained on a bounded sample of the
label table's rows, gives every document a posterior ``p`` over domains.  Each
document gets a rate ``r >= 0``, its expected number of copies, that minimises

    1/2 sum_k (sum_i n_i r_i p_ik - T_k)^2 / (T T_k) + RIDGE / 2 sum_i n_i / T (r_i - 1)^2

(``n`` tokens, ``T`` all tokens, ``T_k`` = target weight x T): expected domain
token totals meet the targets with rates as near to one as that allows.
Projected gradient steps run over the documents where they lie; per step only
the K domain totals come to the driver.  A document's step is scaled by the
curvature of its own domains, so a domain far above its target slows no other.
A document's rates of earlier steps follow from the totals so far, so no step
rewrites the table and a lost executor only repeats its part.  Descent ends
when gaps and rates stand still; if ``STEPS`` do not suffice it says so in a
warning, and ``remaining_gaps`` gives what is left per domain.  The ridge's
share of it: a domain whose rates went to ``r`` misses its target by about
``RIDGE (1 - r)`` of it (0.01 at most above, at r = 20 0.19 below).

Defined results: null and blank texts have 0 tokens and take part with their
statistics' posterior; domains without documents leave their target unmet;
targets are scaled to sum to one; without labelled rows posteriors are uniform;
rows with equal id and text share rate and copies; rows without id are rated
like others; the sample leaves out texts of over ``features.MAX_SAMPLE_CHARS``; an empty table gives no
rows; other columns are kept in ``mixed`` and ignored in the query.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import lean, stored, table, text_key
from shoplens.llm.features import MAX_SAMPLE, N_STATS, WORD_BUCKETS, Buckets, featurize, labelled_sample

# language / quality label, and the share of tokens it is to have
TARGETS = {"en/1": 0.48, "en/0": 0.06, "de/1": 0.14, "de/0": 0.02, "fr/1": 0.14, "fr/0": 0.02, "es/1": 0.12, "es/0": 0.02}
RIDGE = 0.01
STEPS = 600
TOLERANCE = 2e-4  # of a domain's gap, in one step
STILL = 5e-3  # of a document's rate, in one step
LEAST_TARGET = 1e-3
SEED = 31


class DomainModel:
    """Softmax regression over hashed words and statistics."""

    def __init__(self, n_domains: int):
        self.w = np.zeros((WORD_BUCKETS + N_STATS, n_domains))
        self.b = np.zeros(n_domains)
        self.mean, self.std = np.zeros(N_STATS), np.ones(N_STATS)

    def inputs(self, ids, weights, stats):
        scaled = np.clip((stats - self.mean) / self.std, -4, 4) / 2
        return np.concatenate([ids, WORD_BUCKETS + np.arange(N_STATS)]), np.concatenate([weights, scaled])

    def posterior(self, ids, weights, stats) -> np.ndarray:
        i, x = self.inputs(ids, weights, stats)
        z = self.b + x @ self.w[i]
        e = np.exp(z - z.max())
        return e / e.sum()

    def fit(self, rows: list[tuple], y: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.05) -> DomainModel:
        if not rows:
            return self
        stats = np.stack([r[2] for r in rows])
        self.mean, self.std = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3)
        inputs = [self.inputs(*r) for r in rows]
        k = len(self.b)
        self.b = np.log((np.bincount(y, minlength=k) + 0.1) / (len(y) + 0.1 * k))
        rng, m, s, step = np.random.default_rng(5), np.zeros_like(self.w), np.zeros_like(self.w), 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), batch):
                chosen = order[at:at + batch]
                ids = np.concatenate([inputs[i][0] for i in chosen])
                x = np.concatenate([inputs[i][1] for i in chosen])
                sizes = np.array([len(inputs[i][0]) for i in chosen])
                starts, row = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(chosen)), sizes)
                z = self.b + np.add.reduceat(self.w[ids] * x[:, None], starts)
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(chosen)), y[chosen]] -= 1
                p /= len(chosen)
                grad = 1e-5 * self.w + np.stack([np.bincount(ids, p[row, d] * x, len(self.w)) for d in range(k)], axis=1)
                step += 1
                m = 0.9 * m + 0.1 * grad
                s = 0.999 * s + 0.001 * grad * grad
                self.w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
                self.b -= rate * p.sum(axis=0)
        return self


def train(docs: DataFrame, labels: DataFrame, domains: list[str]) -> DomainModel:
    """Domains are ``lang/quality`` of the rows of the label table."""
    named = (labels.select("doc_id", "quality").dropna().join(docs.select("doc_id", "lang").dropna(), "doc_id")
             .withColumn("domain", F.concat_ws("/", "lang", F.col("quality").cast("string"))))
    index = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain")) - 1
    sample = labelled_sample(docs, named.select("doc_id", index.alias("domain")).where("domain >= 0"), "domain", MAX_SAMPLE)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = Buckets()
        for b in batches:
            f = [featurize(t, buckets) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"].astype("int64"),
                                "ids": [x[0].astype(np.int32).tobytes() for x in f],
                                "weights": [x[1].astype(np.float32).tobytes() for x in f],
                                "stats": [x[2].tobytes() for x in f]})

    rows = sorted(sample.mapInPandas(lean(features), "doc_id bigint, label bigint, ids binary, weights binary, stats binary").collect(),
                  key=lambda r: r["doc_id"])
    data = [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["weights"], np.float32).astype(float),
             np.frombuffer(r["stats"])) for r in rows]
    return DomainModel(len(domains)).fit(data, np.array([r["label"] for r in rows], int))


def posteriors(docs: DataFrame, model: DomainModel) -> DataFrame:
    """(doc_id, doc_key, n_tokens, posterior) of every whole text, stored."""
    sent = docs.sparkSession.sparkContext.broadcast(
        model.__dict__ | {"w": model.w.astype(np.float32)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, buckets = DomainModel.__new__(DomainModel), Buckets()
        m.__dict__.update(sent.value)
        for b in batches:
            f = [featurize(t, buckets) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "a": b["a"], "b": b["b"],
                                "n_tokens": [round(float(np.expm1(x[2][1]))) for x in f],
                                "posterior": [m.posterior(*x) for x in f]})

    keyed = docs.select("doc_id", "text", text_key(F.col("text")).alias("k")).select("doc_id", "text", "k.a", "k.b")
    out = keyed.mapInPandas(lean(run), "doc_id bigint, a bigint, b bigint, n_tokens bigint, posterior array<double>")
    return stored(out.select("doc_id", F.struct("a", "b").alias("doc_key"), "n_tokens", "posterior"), "posteriors")


def descend(p: np.ndarray, gaps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The point at which the next gradient is taken, after steps with the
    domain ``gaps`` (relative to their targets) met so far, and how far the
    last step moved it: projected gradient with momentum, scaled by each
    document's tokens and curvature.  All entries of the Hessian are positive,
    so its row sums -- per token, the relative totals of a document's domains
    at rates of one -- bound it."""
    at = rate = np.ones(len(p))
    change = np.zeros(len(p))
    if not gaps:
        return at, change
    curvature = p @ (gaps[0] + 1) + RIDGE
    for k, gap in enumerate(gaps):
        moved = np.maximum(0.0, at - (p @ gap + RIDGE * (at - 1)) / curvature)
        ahead = np.maximum(0.0, moved + k / (k + 3) * (moved - rate))
        at, rate, change = ahead, moved, np.abs(ahead - at)
    return at, change


def replay(p: np.ndarray, gaps: list[np.ndarray]) -> np.ndarray:
    return descend(p, gaps)[0]


def fit_gaps(table_: DataFrame, targets: np.ndarray) -> list[np.ndarray]:
    """The domain gaps of all steps until gaps and rates stand still."""
    total = table_.agg(F.sum("n_tokens")).first()[0] or 0
    gaps: list[np.ndarray] = []
    if not total:
        return gaps
    k = len(targets)

    for step in range(STEPS):
        def sums(batches: Iterator[pd.DataFrame], gaps=gaps) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    p, n = np.stack(b["posterior"]), b["n_tokens"].to_numpy(float)
                    at, change = descend(p, gaps)
                    yield pd.DataFrame({"domain": np.arange(k), "tokens": (n * at) @ p, "change": change.max()})

        met, change = np.zeros(k), 0.0
        for r in (table_.select("n_tokens", "posterior").mapInPandas(sums, "domain int, tokens double, change double")
                  .groupBy("domain").agg(F.sum("tokens").alias("tokens"), F.max("change").alias("change")).collect()):
            met[r["domain"]], change = r["tokens"], max(change, r["change"])
        gaps = [*gaps, (met / total - targets) / np.maximum(targets, LEAST_TARGET)]
        if step >= 3 and change < STILL and np.abs(gaps[-1] - gaps[-2]).max() < TOLERANCE:
            return gaps
    warnings.warn(f"mixing: rates still move by {change:.3g} after {STEPS} steps; gaps {np.round(gaps[-1], 4).tolist()}", stacklevel=2)
    return gaps


def remaining_gaps(fitted: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """(domain, target, share, gap) of ``rates``' result: the expected share of
    tokens each domain gets, and its distance from the target relative to it.
    Domains whose target is 0 have no gap (null); without tokens shares are null."""
    weight = sum(targets.values())
    rows = fitted.select(F.posexplode("posterior").alias("at", "p"), "n_tokens", "rate")
    got = rows.groupBy("at").agg(F.sum(F.col("n_tokens") * F.col("rate") * F.col("p")).alias("tokens"))
    total = fitted.agg(F.sum("n_tokens").alias("n")).select(F.nullif("n", F.lit(0)))
    named = fitted.sparkSession.createDataFrame([(i, d, w / weight) for i, (d, w) in enumerate(targets.items())],
                                                "at int, domain string, target double")
    share = F.coalesce("tokens", F.lit(0.0)) / total.scalar()
    return (named.join(got, "at", "left").select("domain", "target", share.alias("share"))
            .withColumn("gap", (F.col("share") - F.col("target")) / F.nullif("target", F.lit(0.0))))


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """(doc_id, doc_key, n_tokens, posterior, rate, copies) of every document;
    ``copies`` rounds the rate up or down by a hash of the id, so its expected
    value is the rate."""
    domains = list(targets)
    weights = np.array([targets[d] for d in domains], float)
    rows = posteriors(docs, train(docs, labels, domains))
    gaps = fit_gaps(rows, weights / weights.sum())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            r = replay(np.stack(b["posterior"]), gaps) if len(b) else np.zeros(0)
            out = b.assign(rate=r)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    flat = rows.select("doc_id", "doc_key.a", "doc_key.b", "n_tokens", "posterior")
    out = flat.mapInPandas(run, "doc_id bigint, a bigint, b bigint, n_tokens bigint, posterior array<double>, rate double")
    chance = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "a"), F.lit(1 << 30)) / float(1 << 30)
    return out.select("doc_id", F.struct("a", "b").alias("doc_key"), "n_tokens", "posterior", "rate",
                      F.floor(F.col("rate") + chance).cast("int").alias("copies"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """``docs`` with each row repeated ``copies`` times (0: dropped)."""
    fitted = rates(docs, labels, targets).where("copies > 0").select("doc_id", "doc_key", "copies").dropDuplicates(["doc_id", "doc_key"])
    whole = docs.select(F.struct("*").alias("doc"))  # no name can clash
    same = (text_key(F.col("doc.text")) == F.col("doc_key")) & F.col("doc.doc_id").eqNullSafe(F.col("doc_id"))
    return (whole.join(fitted, same).select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
            .select("doc.*"))


def op2_soft_mixing(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return rates(docs, labels).drop("doc_key")
