"""Operator 8: language identification by nearest centroid.

A text becomes a TF-IDF vector of hashed letter n-grams (one to three letters, words set off
by marks), square roots of counts, of length 1. Each language has several centroids from
spherical k-means over its fitting sample. A text gets the language of the centroid of
largest cosine; it is rejected when that cosine is below the language's limit, or when the
text is null or holds no letter (``und``, score 0).

Document frequencies come from all documents that may be learnt from; the centroids from at
most ``FIT_ROWS`` of them a language, taken by a hash of doc_id.

Null languages are not learnt from. Texts of any length count whole. Repeated rows give
repeated results. An empty table, or one with nothing to learn from, gives every row ``und``.
Other columns are left out of the result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, sampling

#: Hash buckets; centroids a language; most rows a language fits on; rounds of k-means.
BUCKETS, CENTROIDS, FIT_ROWS, ROUNDS = 4096, 3, 400, 12
#: A language's limit is this part of the cosine that all but 1 % of its fitting texts reach.
LIMIT = 0.5
_ROWS = 256
_MARK = 1


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x BUCKETS counts of n-grams, whether each text holds a letter)."""
    lower = [(t or "").lower() for t in texts]
    code = np.frombuffer("\n".join(lower).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    # A mark between texts keeps n-grams inside one.
    own = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lower])[: len(code)]
    letter = _letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of other marks the first stays, as a word's end
    code, own = np.where(letter, code, _MARK)[keep].astype(np.uint64), own[keep]
    out = np.zeros(len(texts) * BUCKETS, dtype=np.float32)
    value = np.zeros(len(code), dtype=np.uint64)
    for n in range(1, 4):
        value = value[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :]
        slot = ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)
        same = own[: len(slot)] == own[n - 1 :]
        out += np.bincount((own[: len(slot)] * BUCKETS + slot)[same], minlength=len(out))
    has = np.bincount(own, weights=letter[keep], minlength=len(texts)) > 0
    return out.reshape(len(texts), BUCKETS), has


def vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.sqrt(count) * idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _parts(batches: Iterator[pa.RecordBatch]):
    for ids, texts in common.slices(batches):
        for k in range(0, len(ids), _ROWS):
            yield ids[k : k + _ROWS], texts[k : k + _ROWS]


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means; the first centre is the mean, the next ones the texts farthest off."""
    centres = [x.mean(axis=0)]
    for _ in range(min(k, len(x)) - 1):
        centres.append(x[np.argmin(np.max(x @ np.array(centres).T, axis=1))])
    c = np.array(centres)
    for _ in range(rounds):
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        near = np.argmax(x @ c.T, axis=1)
        c = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


class Model:
    """What scoring needs: languages, centroids, the language of each, limits, idf."""

    def __init__(self, names: list[str], idf: np.ndarray, centroids: np.ndarray, of: np.ndarray, limits: np.ndarray):
        self.names, self.idf, self.centroids, self.of, self.limits = names, idf, centroids, of, limits

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(languages, scores, rejected)."""
        count, has = counts(texts)
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        cosine = vectors(count, self.idf) @ self.centroids.T
        best = np.argmax(cosine, axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best], 0, 1).astype(float)
        lang = self.of[best]
        names = [self.names[j] if h else "und" for j, h in zip(lang, has, strict=True)]
        return names, np.where(has, score, 0.0), ~has | (score < self.limits[lang])


def fit(docs: DataFrame, modulus: int = 5, held_out: int = 0) -> Model:
    """Learn from the documents of ``docs`` (doc_id, text, lang) outside the held-out fold."""
    train = docs.where((sampling.fold(modulus) != held_out) & F.col("lang").isNotNull() & F.col("text").isNotNull())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for ids, texts in _parts(batches):
            total += (counts(texts)[0] > 0).sum(axis=0)
            n += len(ids)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(BUCKETS), -1)), pa.array(np.append(total, n))], names=["bucket", "n"])

    found = common.texts_of(train).mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    df = {r.bucket: r.n for r in found.collect()}  # BUCKETS + 1 rows
    idf = np.log((1 + df.get(-1, 0)) / (1 + np.array([df.get(b, 0) for b in range(BUCKETS)]))).astype(np.float32) + np.float32(1)

    # The first FIT_ROWS of each language by a hash of the id. Of a language of n rows only those whose
    # hash lies below some three times that share come to the sort, so that no task sorts a language.
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 33) / float(1 << 31)
    named = train.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("label"), place.alias("place"))
    sizes = named.groupBy("label").agg(F.count("*").alias("n"))  # one row a language
    near = named.join(F.broadcast(sizes), "label").where(F.col("place") <= 3.0 * FIT_ROWS / F.col("n") + 1e-6).drop("n")
    order = Window.partitionBy("label").orderBy("place", "doc_id")
    chosen = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= FIT_ROWS).select("doc_id", "label")
    sample = sampling.with_text(docs, chosen).select("doc_id", "text", "label")

    def centre(group: pd.DataFrame) -> pd.DataFrame:
        """At most ``FIT_ROWS`` texts of one language."""
        group = group.sort_values(["doc_id", "text"])
        x = np.concatenate([vectors(counts(group["text"].iloc[k : k + 64].tolist())[0], idf) for k in range(0, len(group), 64)])
        c = k_means(x, CENTROIDS).astype(np.float32)
        limit = LIMIT * float(np.quantile((x @ c.T).max(axis=1), 0.01))
        return pd.DataFrame({"label": group["label"].iloc[0], "place": range(len(c)), "limit": limit, "centroid": [r.tobytes() for r in c]}).astype({"label": object})

    found = sample.groupBy("label").applyInPandas(centre, "label string, place int, limit double, centroid binary")
    rows = sorted(found.collect(), key=lambda r: (r.label, r.place))  # the model: CENTROIDS rows a language
    names = sorted({r.label for r in rows})
    shape = np.array([np.frombuffer(r.centroid, dtype=np.float32) for r in rows]).reshape(len(rows), BUCKETS).astype(np.float32)
    return Model(names, idf, shape, np.array([names.index(r.label) for r in rows], dtype=int), np.array([next(r.limit for r in rows if r.label == n) for n in names]))


SCHEMA = "doc_id long, lang_pred string, score double, rejected boolean"


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size a language

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _parts(batches):
            names, score, rejected = shared.value.predict(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return common.texts_of(docs).mapInArrow(work, SCHEMA)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def rejected(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0, dtype=bool), *[shared.value.predict(part)[2] for part in common.by_parts(texts, _ROWS)]]), pa.bool_())

    return docs.where(~rejected(F.col("text").cast("string")))
