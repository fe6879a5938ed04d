"""Scores of discovered tracks by percentiles over their pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crateflow.functions import scoring, text, urls

from . import ranking, storage

#: Weights of the five signals.
WEIGHTS = {"like_ratio": 0.35, "repost_ratio": 0.25, "velocity": 0.20, "comment_ratio": 0.10, "recency": 0.10}
PHRASES = ["repost exchange", "promo network", "submit your music"]


def score(items: DataFrame, as_of: Column, reputations: DataFrame | None = None, weights: dict[str, float] = WEIGHTS, apply_filter: bool = True, min_plays: int = 300, min_like_ratio: float = 0.01, min_percentile: float = 40.0,
          most_days: int = 14, reference_boost: float = 15.0, spam_penalty: float = 20.0, phrases: list[str] = PHRASES, blocked: tuple[str, ...] = ()) -> DataFrame:
    """``items`` with ratios, velocity, reasons, score and percentile, best first.

    Columns used: id, plays, likes, reposts, comments, created_at, and where present artist, artist_url,
    title, description, tags (a list, or JSON text of one), reference_hit. ``reputations``: artist_key, likes, downloads, dislikes, stars. With
    ``apply_filter`` blocked accounts and rarely played tracks leave the pool before, and poor ones after
    ranking; lists made by hand are scored without."""
    has = lambda c: F.col(c) if c in items.columns else F.lit(None).cast("string")
    none = F.array().cast("array<string>")
    tags = none
    if "tags" in items.columns:  # a list, or JSON text of one; each tag is searched by itself
        own = F.col("tags") if items.schema["tags"].dataType.typeName() == "array" else text.json_tags(F.col("tags"))
        tags = F.coalesce(own, none)
    pool = items
    if apply_filter:
        slugs = [s.lower().rstrip("/").rsplit("/", 1)[-1] for s in blocked if s]
        if slugs and "artist_url" in items.columns:
            pool = pool.where(~urls.account_slug(F.col("artist_url")).isin(*slugs))
        pool = pool.where(F.col("plays") >= min_plays)
    pool = pool.select(
        "*", scoring.ratio(F.col("likes"), F.col("plays")).alias("like_ratio"), scoring.ratio(F.col("reposts"), F.col("plays")).alias("repost_ratio"), scoring.ratio(F.col("comments"), F.col("plays")).alias("comment_ratio"),
        scoring.velocity(F.col("likes"), F.col("created_at"), as_of).alias("velocity"), scoring.recency(F.col("created_at"), as_of, most_days).alias("recency"),
        scoring.spam_reasons(F.col("reposts"), F.col("likes"), F.col("comments"), F.concat(F.array(has("title"), has("description")), tags), phrases).alias("reasons"),
    )
    if reputations is not None:
        known = reputations.select(F.col("artist_key").alias("key_"), scoring.reputation_delta(F.col("likes"), F.col("downloads"), F.col("dislikes"), F.col("stars")).alias("reputation"))
        pool = pool.join(known, F.lower(F.trim("artist")) == F.col("key_"), "left").drop("key_")
    else:
        pool = pool.withColumn("reputation", F.lit(0.0))
    ranked = ranking.percent_ranks(pool, [c for c in ("like_ratio", "repost_ratio", "velocity", "comment_ratio") if weights.get(c)])
    total = F.lit(0.0)
    for c, w in weights.items():
        total += F.lit(w) * (100.0 * F.col("recency") if c == "recency" else F.col(f"{c}_rank"))
    if "reference_hit" in items.columns:
        total += F.when(F.col("reference_hit"), reference_boost).otherwise(0.0)
    total += F.when(F.size("reasons") > 0, -spam_penalty).otherwise(0.0) + F.coalesce("reputation", F.lit(0.0))
    # Sums of doubles may differ in their last digits, which must not part equal scores.
    scored = ranking.percent_ranks(storage.stored(ranked.withColumn("score", F.round(total, 9)), "scores"), ["score"]).withColumnRenamed("score_rank", "percentile")
    if apply_filter:
        scored = scored.where((F.col("like_ratio") >= min_like_ratio) & (F.col("percentile") >= min_percentile))
    return scored.orderBy(F.desc("score"), "id")


def reputations(tracks: DataFrame, store_votes: DataFrame) -> DataFrame:
    """artist_key, downloads, likes, dislikes, stars by artist. A rated track counts with its stars only;
    others as a like, a dislike, or, kept without a vote, as a download. ``store_votes`` (artist, value)
    add likes and dislikes. Blank artists do not count."""
    key = F.lower(F.trim("artist"))
    rated = F.coalesce(F.col("rb_rating"), F.lit(0)) >= 1
    one = lambda c: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0).cast("long")
    own = tracks.select(
        key.alias("artist_key"), one(~rated & F.col("feedback").isNull() & F.col("status").isin("archive", "inbox")).alias("downloads"), one(~rated & (F.col("feedback") == "like")).alias("likes"),
        one(~rated & (F.col("feedback") == "dislike")).alias("dislikes"), F.when(rated, F.col("rb_rating")).otherwise(0).cast("long").alias("stars"),
    )
    votes = store_votes.select(key.alias("artist_key"), F.lit(0).cast("long").alias("downloads"), one(F.col("value") == "like").alias("likes"), one(F.col("value") == "dislike").alias("dislikes"), F.lit(0).cast("long").alias("stars"))
    sums = [F.sum(c).alias(c) for c in ("downloads", "likes", "dislikes", "stars")]
    return own.union(votes).where(F.coalesce(F.col("artist_key"), F.lit("")) != "").groupBy("artist_key").agg(*sums)
