"""Operator 3: a quality classifier by positive-unlabelled learning.

A text becomes a fixed number of style features (shares of character classes and of pairs of
them, repeated words and lines, lengths). A linear classifier is fitted to the non-negative
unbiased risk with logistic loss,

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)),

over trusted positives (labelled good, outside the held-out fold) and unlabelled texts; where
the second term would fall below zero the step goes up its gradient instead. The class prior
is estimated from scores of a positive-against-unlabelled classifier: over all thresholds, the
least ratio of the unlabelled share to the positive share above it, with a bound for chance
(best bin estimation).

Fitting uses at most ``FIT_ROWS`` positives and as many unlabelled texts, by a hash of doc_id.
Null and empty texts have all features 0 and get the score of those. Without any positive
every score is 0.5. Texts of any length count whole; repeated rows give repeated results; an
empty table gives an empty one; other columns are left out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, sampling, shingles

#: Most positives and most unlabelled texts to fit on; epochs, step, L2 weight.
FIT_ROWS, EPOCHS, STEP, DECAY = 4000, 400, 0.05, 1e-4
_ROWS = 256
#: Marks that are classes of their own.
_MARKS = "!?.,;:-_*%&$#@|/<>()[]{}\"'=+~^\\"
#: Classes of the pairs: other, upper, lower, digit, blank, line end, sentence mark, other mark, beyond ASCII.
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[32], _CLASS[10] = 1, 2, 3, 4, 5
for _c in _MARKS:
    _CLASS[ord(_c)] = 6 if _c in "!?.,;:" else 7
_CLASS[128:] = 8
_N = 9
WIDTH = 256 // 2 + _N * _N * _N + 12


def features(texts: list[str | None]) -> np.ndarray:
    """texts x WIDTH style features, all between 0 and about 1."""
    n = len(texts)
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    size = np.array([len(p) for p in parts], dtype=np.float64)
    own = np.repeat(np.arange(n), (size + 1).astype(int))
    inside = np.ones(len(raw), dtype=bool)
    inside[np.cumsum(size + 1).astype(int) - 1] = False
    raw, own = raw[inside], own[inside]
    low = raw < 128
    byte = np.bincount(own[low] * 128 + raw[low], minlength=n * 128).reshape(n, 128)
    kind = _CLASS[raw]
    triple = kind[:-2] * _N * _N + kind[1:-1] * _N + kind[2:] if len(raw) > 2 else np.zeros(0, int)
    same = own[2:] == own[:-2] if len(raw) > 2 else np.zeros(0, bool)
    pairs = np.bincount((own[:-2] * _N**3 + triple)[same] if len(raw) > 2 else np.zeros(0, int), minlength=n * _N**3).reshape(n, -1)
    words, at = shingles.word_hashes(texts)
    amount = np.diff(at).astype(np.float64)
    again = np.zeros(n)
    doubled = np.zeros(n)
    for i in range(n):
        w = words[at[i] : at[i + 1]]
        if len(w) > 1:
            again[i] = 1 - len(np.unique(w)) / len(w)
            doubled[i] = np.mean(w[1:] == w[:-1])
    lines = [p.split(b"\n") for p in parts]
    rows = np.array([len(x) for x in lines], dtype=np.float64)
    repeats = np.array([1 - len(set(x)) / len(x) for x in lines])
    chars = np.maximum(size, 1)
    length = np.log1p(size) / 12
    extra = [again, doubled, repeats, np.minimum(1, rows / np.maximum(amount, 1)), length, length**2, np.log1p(amount) / 10, np.minimum(1, size / np.maximum(amount, 1) / 20), doubled > 0.1, again > 0.6, repeats > 0.2, amount < 5]
    out = np.concatenate([np.sqrt(byte / chars[:, None]), np.sqrt(pairs / chars[:, None]), np.stack(extra, axis=1)], axis=1)
    out[size == 0] = 0
    return out.astype(np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _adam(grad, width: int, epochs: int, step: float) -> np.ndarray:
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, epochs + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(p: np.ndarray, u: np.ndarray, confidence: float = 0.1) -> float:
    """Best bin estimation: the share of positives among the unlabelled, from held-back scores."""
    cuts = np.quantile(p, np.linspace(0.01, 0.99, 99))
    above_p = np.array([np.mean(p >= c) for c in cuts])
    above_u = np.array([np.mean(u >= c) for c in cuts])
    slack = np.sqrt(np.log(4 / confidence) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    best = int(np.argmin((above_u + slack) / np.maximum(above_p, 1e-9)))
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def fit_risk(p: np.ndarray, u: np.ndarray, prior: float, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the least non-negative unbiased risk; the last one is the bias."""

    def grad(w: np.ndarray) -> np.ndarray:
        sp, su = _sigmoid(_linear(p, w)), _sigmoid(_linear(u, w))
        up = -prior * _pulled(p, 1 - sp)
        rest = np.mean(-np.log(1 - su + 1e-12)) - prior * np.mean(-np.log(1 - sp + 1e-12))
        down = _pulled(u, su) - prior * _pulled(p, sp)
        return (up + down if rest >= 0 else -down) + DECAY * w

    return _adam(grad, p.shape[1] + 1, epochs, STEP)


def _linear(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ weights + bias, without a wider copy of x."""
    return (x @ w[:-1].astype(x.dtype)).astype(float) + w[-1]


def _pulled(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The mean of the rows of x and 1 for the bias, weighted."""
    return np.append((by.astype(x.dtype) @ x).astype(float), by.sum()) / len(x)


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, prior: float):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.clip((features(texts) - self.mean) / self.scale, -5, 5)
        return _sigmoid(x @ self.weights[:-1] + self.weights[-1])


def fit_arrays(p: np.ndarray, u: np.ndarray) -> Model:
    """A model from positives' and unlabelled texts' features."""
    if not len(p) or not len(u):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH + 1), 0.5)
    mean, scale = u.mean(axis=0, dtype=float), u.std(axis=0, dtype=float) + 1e-3
    p, u = _scaled(p, mean, scale), _scaled(u, mean, scale)
    if len(p) < 20 or len(u) < 20:
        prior = 0.5
    else:
        # Against the unlabelled, with the prior set to one half, on every other row; scored on the rest.
        w = _adam(lambda w: _against(p[::2], u[::2], w), p.shape[1] + 1, EPOCHS // 2, STEP)
        prior = estimate_prior(_linear(p[1::2], w), _linear(u[1::2], w))
    return Model(mean, scale, fit_risk(p, u, prior), prior)


def _scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features around 0, cut at 5, in 32 bits: the driver holds no wider copy."""
    out = x.astype(np.float32)
    out -= mean.astype(np.float32)
    out /= scale.astype(np.float32)
    return np.clip(out, -5, 5, out=out)


def _against(p: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    sp, su = _sigmoid(_linear(p, w)), _sigmoid(_linear(u, w))
    return _pulled(u, su) - _pulled(p, 1 - sp) + 1e-2 * w


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1) -> Model:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality) outside the held-out fold."""
    good = labels.where((F.col("quality") == 1) & (sampling.fold(modulus) != held_out)).select("doc_id").distinct()
    everything = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(sampling.fold(modulus) != held_out)
    chosen = sampling.first_by_hash(good, FIT_ROWS).select("doc_id", F.lit(1).alias("kind")).unionByName(
        sampling.first_by_hash(everything, FIT_ROWS).select("doc_id", F.lit(0).alias("kind"))
    ).groupBy("doc_id").agg(F.max("kind").alias("positive"), F.min("kind").alias("lowest"))
    sample = sampling.with_text(docs, chosen).select("doc_id", "text", "positive", "lowest")

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                x = features(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array([row.tobytes() for row in x], pa.binary())], names=["doc_id", "positive", "lowest", "x"])

    rows = sorted(sample.mapInArrow(embed, "doc_id long, positive int, lowest int, x binary").collect(), key=lambda r: r.doc_id)
    of = lambda keep: np.array([np.frombuffer(r.x, dtype=np.float32) for r in rows if keep(r)]).reshape(-1, WIDTH)
    return fit_arrays(of(lambda r: r.positive == 1), of(lambda r: r.lowest == 0))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.slices(batches):
            for k in range(0, len(ids), _ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + _ROWS], pa.int64()), pa.array(shared.value.score(texts[k : k + _ROWS]).astype(float))], names=["doc_id", "score"])

    return common.texts_of(docs).mapInArrow(work, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *[shared.value.score(part) for part in common.by_parts(texts, _ROWS)]]), pa.float64())

    return docs.where(score(F.col("text").cast("string")) >= least)
