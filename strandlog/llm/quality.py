"""Quality by positive-unlabelled learning.

Trusted positives are training rows labelled 1; the unlabelled set is a hash
sample of all documents outside the hold-out, whatever their labels say. A first
network tells positives from unlabelled; the least ratio of the shares above a score,
of positives and of all documents outside the hold-out, with a margin for chance,
estimates the class prior. A second network minimises the non-negative unbiased risk at that prior:
prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)]).

Each sample to fit on has at most ``SAMPLE`` rows (only their features reach the
driver); every document is scored from its whole text. Null and empty texts have all-zero
features; repeated rows are scored alike; rows without an id are scored but not
learnt from. Without positives, or without other documents, the score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_crc, label_sample, small_batches, smallest_hashes, table, text_of

SAMPLE, CUT, SEED = 20_000, 0.3, 7
HIDDEN, ROUNDS, RATE, DECAY = 16, 400, 0.02, 1e-4

_kind = np.full(256, 5, np.uint8)  # other ASCII
_kind[97:123], _kind[65:91], _kind[48:58], _kind[[32]], _kind[[10, 13]], _kind[128:192], _kind[192:256] = 0, 1, 2, 3, 4, 6, 7
_kind[[44, 46, 59, 58, 63, 39, 34, 40, 41, 45]] = 8
N_KINDS = 9


def features(text: str) -> list[float]:
    """Shares of kinds of characters, and figures on words, sentences, lines and repetition."""
    raw = text.encode("utf-8", "replace")
    words = text.split()
    if not words:
        return [0.0] * N_FEATURES
    shares = (np.bincount(_kind[np.frombuffer(raw, np.uint8)], minlength=N_KINDS) / len(raw)).tolist()
    lines = text.split("\n")
    n, distinct = len(words), set(words)
    steps = set(zip(words, words[1:], strict=False))
    ends = text.count(". ") + text.count(".\n") + text.endswith(".")
    return [
        *shares, np.log1p(n) / 10, len(distinct) / n, len(distinct) / n**0.8, len(steps) / n, sum(map(len, distinct)) / len(distinct) / 10, len(text) / n / 10,
        len(set(lines)) / len(lines), len(lines) / n, ends / n, text.count("!") / n, text.count("|") / n, sum(map(text.count, "#$%&*")) / n, sum(1 for w in distinct if w.isupper()) / len(distinct), sum(1 for a, b in steps if a == b) / n, text.count(",") / n,
        len(text) / max(1, len(lines)) / 1000, text.count("\n\n") / n, text.count("http") / n, text.count("{") / n, text.count("<") / n,
    ]


N_FEATURES = len(features("a b"))


def features_of(docs: DataFrame, ids: set[int]) -> dict[int, list[float]]:
    """Features of the documents with these ids (bounded by the caller)."""
    sent = docs.sparkSession.sparkContext.broadcast(ids)

    def run(batches):
        for b in batches:
            at = [i for i, d in enumerate(b.column(0).to_pylist()) if d in sent.value]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([features(b.column(1)[i].as_py()) for i in at], pa.list_(pa.float64()))], ["doc_id", "x"])

    rows = docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id long, x array<double>").collect()
    sent.unpersist()
    return {r.doc_id: r.x for r in rows}


class Network:
    """One hidden layer on standardised features."""

    def __init__(self, x: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        self.w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(z @ self.w[0] + self.w[1])
        return h, h @ self.w[2] + self.w[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.forward(self.scaled(x))[1]))

    def step(self, z: np.ndarray, h: np.ndarray, slope: np.ndarray) -> None:
        """One step of Adam for the slope of the risk by each output."""
        back = np.outer(slope, self.w[2]) * (1 - h * h)
        self.t += 1
        for i, g in enumerate([z.T @ back, back.sum(0), h.T @ slope, slope.sum(keepdims=True)]):
            g = g + DECAY * self.w[i]
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            self.w[i] = self.w[i] - RATE * (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8)


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> Network:
    """By the non-negative risk at this prior; None: positives against unlabelled."""
    x = np.concatenate([positive, unlabelled])
    net, n, m = Network(unlabelled), len(positive), len(unlabelled)
    z = net.scaled(x)
    for _ in range(ROUNDS):
        h, out = net.forward(z)
        p = 1 / (1 + np.exp(-out))
        slope = np.empty(n + m)
        if prior is None:
            slope[:n], slope[n:] = (p[:n] - 1) / n / 2, p[n:] / m / 2
        else:
            minus = np.logaddexp(0, out)
            negative = minus[n:].mean() - prior * minus[:n].mean()
            if negative >= 0:
                slope[:n], slope[n:] = prior * (p[:n] - 1) / n - prior * p[:n] / n, p[n:] / m
            else:  # the estimate overfits: the step undoes that
                slope[:n], slope[n:] = prior * p[:n] / n, -p[n:] / m
        net.step(z, h, slope)
    return net


def cuts(positive: np.ndarray) -> np.ndarray:
    """Scores at which the positives and the unlabelled are compared."""
    return np.quantile(positive, np.linspace(0.02, 0.9, 89))


def reached(docs: DataFrame, net: Network, at: np.ndarray) -> tuple[np.ndarray, int]:
    """Of all these documents, how many have each score of ``at`` or more, and how many there are."""

    def run(batches):
        total = np.zeros(len(at) + 1, np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            if texts:
                score = np.sort(net.score(np.array([features(t) for t in texts]).reshape(len(texts), N_FEATURES)))
                total += np.append(len(texts) - np.searchsorted(score, at), len(texts))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "n"])

    counted = docs.select(text_of().alias("text")).mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n"))
    n = np.zeros(len(at) + 1, np.int64)
    for r in counted.collect():
        n[r.i] = r.n
    return n[:-1], int(n[-1])


def class_prior(positive: np.ndarray, at: np.ndarray, above_u: np.ndarray, n: int) -> float:
    """The estimated share of positives among the unlabelled: from scores of positives
    and the share of n unlabelled ones that reach each score of ``at``."""
    above_p = 1 - np.searchsorted(np.sort(positive), at) / len(positive)
    margin = np.sqrt(np.log(40) / 2 / len(positive)) + np.sqrt(np.log(40) / 2 / n)
    best = np.argmin((above_u + margin) / above_p)  # the margin settles where to look
    # Too high a prior makes the negative part of the risk vanish early; one that is as much too low does little harm.
    return float(np.clip(above_u[best] / above_p[best] - margin / 2, 0.01, 0.99))


def held_out():
    return id_crc() % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, learnable) -> tuple[Network, float] | None:
    small_batches(docs.sparkSession)
    positives = {i for i, y in label_sample(labels, "quality", learnable & (F.col("quality") == 1), SAMPLE).items() if y == 1}
    others = {r.doc_id for r in smallest_hashes(docs.where(F.col("doc_id").isNotNull() & learnable).select("doc_id"), SAMPLE, SEED).collect()}
    found = features_of(docs, positives | others)
    p, u = ([found[i] for i in sorted(ids) if i in found] for ids in (positives, others))
    if not p or not u:
        return None
    rng = np.random.default_rng(SEED)
    p, u = rng.permutation(np.array(p)), rng.permutation(np.array(u))
    half = train(p[::2], u[::2], None)
    scores = half.score(p[1::2] if len(p) > 1 else p)
    at = cuts(scores)
    above, n = reached(docs.where(F.col("doc_id").isNotNull() & learnable), half, at)
    prior = class_prior(scores, at, above / n, n)
    return train(p, u, prior), prior


def apply(docs: DataFrame, model: tuple[Network, float] | None) -> DataFrame:
    """doc_id, score of each document."""

    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            x = np.array([features(t) for t in texts]).reshape(len(texts), N_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model[0].score(x) if model else np.full(len(texts), 0.5))], ["doc_id", "score"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id long, score double")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    return apply(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
