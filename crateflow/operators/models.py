"""A registry of fitted models over runs, one row a profile and run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import taste

ROWS = "profile_id string, model string, trained_at string, n long, parameters string"


def entries(fitted: DataFrame, profile: str, trained_at: str) -> DataFrame:
    """Rows of the registry for the models that ``taste.fit`` gave (model, parameters, n)."""
    return fitted.select(F.lit(profile).alias("profile_id"), F.col("model").cast("string").alias("model"), F.lit(trained_at).alias("trained_at"), F.col("n").cast("long").alias("n"), "parameters")


def readable(parameters: Column) -> Column:
    """Whether parameters are JSON of a whole model: as many means and spreads as weights, one at least, and a bias."""
    m = F.from_json(parameters, taste._PARAMETERS)
    n = F.size(m["weights"])
    none = lambda c: F.exists(c, lambda x: x.isNull())
    whole = (n > 0) & (F.size(m["mean"]) == n) & (F.size(m["std"]) == n) & m["bias"].isNotNull() & ~none(m["weights"]) & ~none(m["mean"]) & ~none(m["std"])
    return F.coalesce(whole, F.lit(False))


def current(registry: DataFrame) -> DataFrame:
    """profile_id, model, trained_at, parameters of each profile's newest run (of equals the last model by
    name). A run whose parameters cannot be read counts as no model: parameters are null then."""
    newest = registry.where("profile_id is not null").groupBy("profile_id").agg(F.max_by(F.struct("model", "trained_at", "parameters"), F.struct("trained_at", "model")).alias("m"))
    return newest.select("profile_id", "m.model", "m.trained_at", F.when(readable(F.col("m.parameters")), F.col("m.parameters")).alias("parameters"))


def scores(embedded: DataFrame, registry: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """profile_id, id, taste_score of vectors (profile_id, id, model, vector), all or those of ``ids``, by their profile's
    model; null without a readable one and for vectors of another model. A profile is one row of the model
    side, which is small beside its tracks; a profile of most tracks is a hot key that may be split."""
    rows = embedded if ids is None else embedded.join(ids.select("id").distinct(), "id", "left_semi")
    own = current(registry).select("profile_id", F.col("model").alias("fitted_"), F.col("parameters").alias("with_"))
    fits = F.col("model") == F.col("fitted_")
    return rows.join(own, "profile_id", "left").select("profile_id", "id", F.when(fits, taste.probability(F.col("vector"), F.col("with_"))).alias("taste_score"))


def rescored(tracks: DataFrame, embedded: DataFrame, registry: DataFrame) -> DataFrame:
    """``tracks`` (profile_id, id, taste_score, ...) scored by their profile's model. Profiles without a readable model
    keep the scores they have."""
    new = scores(embedded, registry).select(F.col("profile_id").alias("p_"), F.col("id").alias("i_"), F.col("taste_score").alias("new_"))
    held = current(registry).where("parameters is not null").select(F.col("profile_id").alias("h_"))
    rows = tracks.join(new, (F.col("profile_id") == F.col("p_")) & (F.col("id") == F.col("i_")), "left").join(held, F.col("profile_id") == F.col("h_"), "left")
    return rows.withColumn("taste_score", F.when(F.col("h_").isNotNull(), F.col("new_")).otherwise(F.col("taste_score"))).select(*tracks.columns)
