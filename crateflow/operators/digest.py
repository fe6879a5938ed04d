"""The digest: reported tracks with all that is known of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crateflow.functions import text, urls

from . import fuzzy

SORTS = ("date", "artist", "title", "download_kind", "status", "feedback", "plays", "likes")


def rows(seen: DataFrame, tracks: DataFrame, votes: DataFrame, stores: DataFrame, gates: DataFrame, snapshots: DataFrame, overrides: DataFrame) -> DataFrame:
    """One row for each of ``seen`` (id, url, title, artist, reported_at) with artist, title, vote, kind of
    download, links, newest counts and whether it is in the inbox or the collection.

    A track is there by its id (of the row or in brackets in the path), by its address or by its name;
    an override decides on the collection. ``tracks``: id, path, status, sc_id, source_url, artist, title;
    ``votes``: sc_id, value; ``stores``: sc_id, purchase_url; ``gates``: sc_id, gate_url, done_at;
    ``snapshots``: id, sc_id, plays, likes, reposts, comments, recorded_at; ``overrides``: sc_id, override_type."""
    parsed = text.artist_title(F.coalesce("title", F.lit("")))
    own = F.when(F.trim("artist") != "", F.trim("artist"))
    named = parsed["artist"].isNotNull() | own.isNull()
    base = seen.repartition("id").select(
        F.col("id").alias("sc_id"), "url", "reported_at", F.col("title").alias("raw_title"),
        F.when(named, parsed["artist"]).otherwise(own).alias("artist"), F.when(named, parsed["title"]).otherwise(F.col("title")).alias("title"), urls.normalize_url(F.col("url")).alias("address"),
    )
    side = F.when(F.lower("status") == "inbox", "inbox").when(F.lower("status").isin("archive", "adopted"), "collection")
    library = tracks.select("*", side.alias("side")).where("side is not null")
    ids = library.select("side", F.explode(F.array_compact(F.array("sc_id", text.id_anywhere(F.col("path"))))).alias("sc_id")).groupBy("sc_id").agg(*_sides("by_id"))
    addresses = library.select("side", urls.normalize_url(F.col("source_url")).alias("address")).where("address <> ''").groupBy("address").agg(*_sides("by_url"))
    blank = F.concat(F.coalesce("artist", F.lit("")), F.coalesce("title", F.lit("")))
    stem = F.regexp_replace(F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", ""), r"^\[\d+\]\s*", "")
    keys = library.repartition("id").select("id", "side", F.when(blank == "", text.name_key(F.lit(None).cast("string"), stem)).otherwise(text.name_key(F.col("artist"), F.col("title"))).alias("key")).where(F.size("key.tokens") > 0)
    asked = base.select(F.col("sc_id").alias("id"), F.struct(text.name_tokens(F.concat_ws(" ", "artist", "title")).alias("tokens"), text.remixer_tokens(F.col("title")).alias("remix")).alias("key")).where(F.size("key.tokens") > 0)
    hits = fuzzy.related(asked, keys, "side").groupBy(F.col("left_id").alias("sc_id")).agg(*_sides("by_name"))
    newest = snapshots.groupBy("sc_id").agg(F.max_by(F.struct("plays", "likes", "reposts", "comments"), F.struct("recorded_at", "id")).alias("n")).select("sc_id", "n.*")
    joined = (
        base.join(ids, "sc_id", "left").join(addresses, "address", "left").join(hits, "sc_id", "left")
        .join(votes.groupBy("sc_id").agg(F.max("value").alias("feedback")), "sc_id", "left").join(stores.where("purchase_url <> ''").groupBy("sc_id").agg(F.max("purchase_url").alias("purchase_url")), "sc_id", "left")
        .join(gates.where("gate_url <> ''").groupBy("sc_id").agg(F.max("gate_url").alias("gate_url"), F.max("done_at").alias("gate_done_at")), "sc_id", "left")
        .join(overrides.groupBy("sc_id").agg(F.max("override_type").alias("override_type")), "sc_id", "left").join(newest, "sc_id", "left")
    )
    flag = lambda name: F.coalesce(F.col(f"by_id_{name}"), F.lit(False)) | F.coalesce(F.col(f"by_url_{name}"), F.lit(False)) | F.coalesce(F.col(f"by_name_{name}"), F.lit(False))
    collection = F.when(F.col("override_type") == "already_in_collection", True).when(F.col("override_type") == "not_duplicate", False).otherwise(flag("collection"))
    flagged = joined.select("*", flag("inbox").alias("in_inbox"), collection.alias("in_collection"))
    kind = F.when(F.col("purchase_url").isNotNull(), "store").when(F.col("gate_url").isNotNull(), "gate").when(F.col("in_inbox") | F.col("in_collection"), "native").otherwise("stream")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("plays", "likes", "reposts", "comments")]
    gate = lambda c: F.when(F.col("download_kind") == "gate", F.col(c)).alias(c)
    return flagged.withColumn("download_kind", kind).select("sc_id", "url", "raw_title", "artist", "title", "reported_at", "download_kind", "purchase_url", gate("gate_url"), gate("gate_done_at"), "feedback", "in_inbox", "in_collection", *counts)


def _sides(prefix: str) -> list[Column]:
    return [F.bool_or(F.col("side") == s).alias(f"{prefix}_{s}") for s in ("inbox", "collection")]


def search(digest: DataFrame, query: str = "", status: str = "", kind: str = "", feedback: str = "") -> DataFrame:
    """The rows that hold ``query`` in title, artist or raw title, and are of a status (collection, inbox,
    open), kind and vote (``none``: without one)."""
    out = digest
    if query.strip():
        word = F.lit(query.strip().lower())
        out = out.where(F.contains(F.lower("title"), word) | F.contains(F.lower(F.coalesce("artist", F.lit(""))), word) | F.contains(F.lower("raw_title"), word))
    status, kind, feedback = (s.strip().lower() for s in (status, kind, feedback))
    if status:
        out = out.where({"collection": F.col("in_collection"), "inbox": F.col("in_inbox"), "open": ~(F.col("in_collection") | F.col("in_inbox"))}.get(status, F.lit(True)))
    if kind:
        out = out.where(F.col("download_kind") == kind)
    if feedback:
        out = out.where(F.col("feedback").isNull() if feedback == "none" else F.col("feedback") == feedback)
    return out


def ordered(digest: DataFrame, sort: str = "", descending: bool = False) -> DataFrame:
    """By a column of ``SORTS``, empty values last either way; else, and among equals, newest first."""
    newest = [F.desc("reported_at"), F.desc("sc_id")]
    if sort not in SORTS:
        return digest.orderBy(*newest)
    status = F.when(F.col("in_collection"), "collection").when(F.col("in_inbox"), "inbox").otherwise("open")
    value = {"date": F.col("reported_at").cast("string"), "status": status, "plays": F.col("plays"), "likes": F.col("likes")}.get(sort)
    value = F.lower(F.coalesce(sort, F.lit(""))) if value is None else value
    empty = F.coalesce(value.cast("string"), F.lit("")) == ""
    return digest.orderBy(empty.asc(), value.desc() if descending else value.asc(), *newest)


def page(df: DataFrame, limit: int = 50, offset: int = 0, most: int = 200) -> DataFrame:
    """A page of an ordered table: ``limit`` is cut to 0..``most``, a negative ``offset`` is 0."""
    return df.offset(max(0, int(offset))).limit(max(0, min(int(limit), most)))
