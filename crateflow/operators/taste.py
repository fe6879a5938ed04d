"""A taste learnt from votes: logistic regression over track vectors, and its scores."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fewest examples of either class, and most examples that are fitted on (by a hash of the id).
LEAST, FIT_ROWS = 5, 20_000
#: Parts that a model's ids are cut in before the first of them meet.
SALTS = 64


def examples(embedded: DataFrame, tracks: DataFrame, votes: DataFrame) -> DataFrame:
    """id, model, vector, label: 1 for tracks that are adopted, rated 4 or more or liked, or share their
    source with an adopted one; else 0 for disliked ones. Only vectors of the most frequent model (ties: the
    first by name) are used. ``embedded``: id, model, vector; ``votes``: sc_id, value."""
    main = embedded.groupBy("model").count().agg(F.min_by("model", F.struct(-F.col("count"), "model")).alias("model"))
    vote = votes.groupBy("sc_id").agg(F.bool_or(F.col("value") == "like").alias("liked"), F.bool_or(F.col("value") == "dislike").alias("disliked"))
    kept = tracks.where("adopted is not null and sc_id is not null").select(F.col("sc_id").alias("kept_id")).distinct()
    rows = embedded.join(F.broadcast(main), "model").join(tracks.select("id", "sc_id", "adopted", "feedback", "rb_rating"), "id").join(vote, "sc_id", "left").join(kept, F.col("sc_id") == F.col("kept_id"), "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    good = F.col("adopted").isNotNull() | yes(F.col("rb_rating") >= 4) | yes(F.col("feedback") == "like") | yes(F.col("liked")) | F.col("kept_id").isNotNull()
    bad = yes(F.col("feedback") == "dislike") | yes(F.col("disliked"))
    return rows.select("id", "model", "vector", F.when(good, 1).when(bad, 0).alias("label")).where("label is not null")


def fit_arrays(x: np.ndarray, y: np.ndarray, epochs: int = 500, rate: float = 0.1, l2: float = 0.01) -> dict:
    """Weights, bias, mean and spread (0 counts as 1) by plain gradient descent from zero."""
    if min((y == 1).sum(), (y == 0).sum()) < LEAST:
        raise ValueError(f"at least {LEAST} examples of either class are needed")
    mean, std = x.mean(axis=0), x.std(axis=0)
    std = np.where(std > 0, std, 1.0)
    z, w, b = (x - mean) / std, np.zeros(x.shape[1]), 0.0
    for _ in range(epochs):
        off = 1 / (1 + np.exp(-np.clip(z @ w + b, -50, 50))) - y
        w, b = w - rate * (z.T @ off / len(y) + l2 * w), b - rate * off.mean()
    return {"weights": w.tolist(), "bias": float(b), "mean": mean.tolist(), "std": std.tolist()}


def fit(labelled: DataFrame, epochs: int = 500, rate: float = 0.1, l2: float = 0.01) -> DataFrame:
    """model, parameters (JSON), n of each model's examples (id, model, vector, label), at most ``FIT_ROWS`` of
    them. Models with too few examples of a class have no row; vectors of another length than most are left out."""
    # The first by hash, ids alone, in salted parts before the parts of a model meet.
    ids = labelled.select("model", "id", F.xxhash64("id").alias("h_")).withColumn("salt_", F.pmod(F.col("h_"), F.lit(SALTS)))
    first = lambda df, *by: df.withColumn("k_", F.row_number().over(Window.partitionBy(*by).orderBy("h_", "id"))).where(F.col("k_") <= FIT_ROWS)
    chosen = first(first(ids, "model", "salt_").drop("k_"), "model").select("model", "id").distinct()
    some = labelled.join(chosen, ["model", "id"], "left_semi")

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        size = rows["vector"].map(len).mode().iloc[0]
        rows = rows[rows["vector"].map(len) == size]
        try:
            own = fit_arrays(np.array(rows["vector"].tolist(), dtype=float), rows["label"].to_numpy(), epochs, rate, l2)
        except ValueError:
            return pd.DataFrame({"model": [], "parameters": [], "n": []}, dtype=object)
        return pd.DataFrame({"model": [rows["model"].iloc[0]], "parameters": [json.dumps(own)], "n": [len(rows)]}, dtype=object)

    kind = dict(labelled.dtypes)["model"]
    return some.groupBy("model").applyInPandas(work, f"model {kind}, parameters string, n long")


_PARAMETERS = "struct<weights: array<double>, bias: double, mean: array<double>, std: array<double>>"


def probability(vector: Column, parameters: Column) -> Column:
    """How likely a track pleases, null where the vector's length is not the model's or a value is not finite."""
    m = F.from_json(parameters, _PARAMETERS)
    v = vector.cast("array<double>")
    scaled = F.zip_with(F.zip_with(v, m["mean"], lambda a, b: a - b), m["std"], lambda a, s: a / F.when(s > 0, s).otherwise(1.0))
    z = F.aggregate(F.zip_with(scaled, m["weights"], lambda a, w: a * w), m["bias"], lambda acc, t: acc + t)
    fine = (F.size(v) == F.size(m["weights"])) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, 1 / (1 + F.exp(-F.least(F.lit(50.0), F.greatest(F.lit(-50.0), z)))))


def score(embedded: DataFrame, models: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """id, taste_score of all vectors, or those of ``ids``; null for vectors of a model that was not fitted.
    ``models`` has one row a model."""
    rows = embedded if ids is None else embedded.join(ids.select("id").distinct(), "id", "left_semi")
    return rows.join(F.broadcast(models.select("model", "parameters")), "model", "left").select("id", probability(F.col("vector"), F.col("parameters")).alias("taste_score"))


def run(tracks: DataFrame, embedded: DataFrame, votes: DataFrame, dry_run: bool = False) -> DataFrame:
    """``tracks`` with taste_score anew where a model could be fitted; unchanged otherwise, or on a dry run."""
    if dry_run:
        return tracks
    new = score(embedded, fit(examples(embedded, tracks, votes))).where("taste_score is not null").withColumnRenamed("taste_score", "new_")
    return tracks.join(new, "id", "left").withColumn("taste_score", F.coalesce("new_", "taste_score")).drop("new_")
