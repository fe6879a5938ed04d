"""Whole runs and reports, put together from the other operators."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crateflow.functions import music, style, text, tracklist, urls

from . import fuzzy, library, lookups, merges, scores, trends


class Discovery(NamedTuple):
    """What a run found: new items with kind and link, items that are there already, and what is reported now."""

    fresh: DataFrame
    duplicates: DataFrame
    seen: DataFrame


def process(items: DataFrame, collection: DataFrame, overrides: DataFrame, most_minutes: float = 12.0) -> DataFrame:
    """``items`` with set_minutes, kind, link and duplicate_of."""
    ms = most_minutes * 60_000
    way = urls.classify_download(F.col("url"), F.col("downloadable"), F.col("has_downloads_left"), F.col("purchase_url"), F.col("description"))
    known = fuzzy.duplicates(items, collection, overrides).select("id", F.lit(True).alias("known_"), "duplicate_of")
    marked = items.withColumn("set_minutes", F.when(F.coalesce(F.col("duration_ms"), F.lit(0)) > ms, F.bround(F.col("duration_ms") / 60_000).cast("int"))).withColumn("way_", way)
    return marked.join(known, "id", "left").withColumns({"kind": F.col("way_.kind"), "link": F.col("way_.link"), "is_duplicate": F.coalesce("known_", F.lit(False))}).drop("way_", "known_")


def discover(found: DataFrame, seen: DataFrame, collection: DataFrame, overrides: DataFrame, as_of: Column, bpm: tuple[float, float] = (150.0, 165.0), keep_unknown: bool = True, most_minutes: float = 12.0, title_patterns: tuple[str, ...] = (), **scoring) -> Discovery:
    """A daily run over items of all sources: first of each id, no long sets or mixes, tempo within bounds,
    scored and gated, not reported before, told apart by what the collection holds."""
    first = found.withColumn("k_", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).where("k_ = 1").drop("k_")
    short = first.where(~(F.coalesce(F.col("duration_ms"), F.lit(0)) > most_minutes * 60_000) & ~lookups.title_matches(F.col("title"), list(title_patterns)))
    tempo = short.withColumn("bpm", music.estimate_bpm(F.col("title"), F.col("tags"), F.col("description")))
    fits = tempo.where(F.col("bpm").between(*bpm) | (F.col("bpm").isNull() if keep_unknown else F.lit(False)))
    new = scores.score(fits, as_of, **scoring).join(seen.select("id"), "id", "left_anti")
    told = process(new, collection, overrides, most_minutes)
    marks = told.select("id", "url", "title", as_of.alias("at"))
    return Discovery(told.where("NOT is_duplicate"), told.where("is_duplicate"), merges.seen_marks(seen.select("id", "url", "title", "at"), marks, keep_first=True))


def trend_report(snapshots: DataFrame, days: int = 7, limit: int = 10) -> DataFrame:
    """section, place, name, delta, rate of tracks, artists and tags that grew."""
    parts = []
    for section, df, name in (("tracks", trends.track_growth(snapshots, days, limit=limit), "title"), ("artists", trends.artist_growth(snapshots, days, limit=limit), "artist"), ("tags", trends.tag_trends(snapshots, days, limit=limit), "tag")):
        place = F.row_number().over(Window.orderBy(F.desc("rate"), F.desc("delta"), name))  # ``limit`` rows at most
        parts.append(df.select(F.lit(section).alias("section"), place.alias("place"), F.col(name).alias("name"), F.col("delta").cast("long").alias("delta"), F.col("rate")))
    return parts[0].union(parts[1]).union(parts[2])


def kpis(runs: DataFrame, tracks: DataFrame, votes: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """kpi, current, before: runs and what they scanned, tracks to the inbox and rejected, votes by value."""
    span = F.make_dt_interval(F.lit(days))

    def counted(df: DataFrame, name: str, at: str, value: Column | None = None) -> DataFrame:
        now, then = F.col(at) > as_of - span, (F.col(at) > as_of - span - span) & (F.col(at) <= as_of - span)
        one = F.lit(1) if value is None else F.coalesce(value, F.lit(0))
        return df.agg(F.coalesce(F.sum(F.when(now, one)), F.lit(0)).cast("long").alias("current"), F.coalesce(F.sum(F.when(then, one)), F.lit(0)).cast("long").alias("before")).select(F.lit(name).alias("kpi"), "current", "before")

    own = runs.where("mode = 'discover'")
    parts = [counted(own, "runs", "finished_at"), counted(own, "scanned", "finished_at", F.col("found")), counted(tracks.where("status = 'inbox'"), "inbox", "created_at"), counted(tracks.where("status = 'rejected'"), "rejected", "created_at")]
    parts += [counted(votes.where(F.col("value") == v), v, "updated_at") for v in ("like", "dislike", "later")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def audit(files: DataFrame, known: DataFrame, window: tuple[float, float] = (150.0, 165.0)) -> DataFrame:
    """path, cached, verdict (ok, reason, clipped), bpm of measured files; unchanged ones keep what is known."""
    fresh = lookups.changed_files(files, known).select("path", F.lit(True).alias("changed_"))
    verdict = lookups.admission(F.col("ending"), F.col("codec"), F.col("bitrate"), F.col("is_vbr"), F.col("cutoff"), F.col("loudness_range"), F.col("true_peak"))
    bpm = music.resolve_bpm(F.col("audio_bpm"), F.col("text_bpm"), window)
    return files.join(fresh, "path", "left").select("path", F.col("changed_").isNull().alias("cached"), verdict.alias("verdict"), bpm["bpm"].alias("bpm"))


def watch(votes: DataFrame, tracks: DataFrame, watched: DataFrame, items: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(the watch table, what became available) after liked tracks were asked for again; ``items`` holds those
    that still exist."""
    asked = merges.watch_candidates(votes, tracks, watched, as_of)
    way = urls.classify_download(F.col("url"), F.col("downloadable"), F.col("has_downloads_left"), F.col("purchase_url"), F.col("description"))
    found = items.join(asked, items["id"] == asked["sc_id"]).select("sc_id", way["kind"].alias("kind"))
    return merges.check_availability(watched, asked, found, as_of)


def setlist_gaps(pages: DataFrame, collection: DataFrame) -> DataFrame:
    """page, pos, artist, title, position, owned of the tracklists on wiki pages (page, text): true, false, or
    null for entries without a name. ``collection``: id, artist, title."""
    lines = pages.select("page", F.posexplode(F.split(tracklist.section(F.col("text")), "\n")).alias("pos", "line"))
    entries = lines.select("page", "pos", tracklist.entry(F.col("line")).alias("e")).where("e is not null")
    named = entries.select(F.concat_ws("/", "page", F.col("pos").cast("string")).alias("id"), "page", "pos", "e.*")
    keys = named.select("id", text.name_key(F.col("artist"), F.col("title")).alias("key"))
    return named.join(fuzzy.owned(keys, fuzzy.keyed(collection, "id", "artist", "title")), "id").select("page", "pos", "artist", "title", "position", "owned")


def status(runs: DataFrame, jobs: DataFrame, as_of: Column) -> DataFrame:
    """name, value, at: the last discovery, jobs by state, and whether the queue is worked on."""
    last = runs.where("mode = 'discover'").agg(F.max_by(F.struct(F.col("found").cast("long").alias("v"), F.col("finished_at").alias("t")), "id").alias("r")).select(F.lit("last discovery").alias("name"), F.col("r.v").alias("value"), F.col("r.t").alias("at"))
    states = jobs.groupBy("status").agg(F.count("*").alias("value"), F.max("updated_at").alias("at")).select(F.concat(F.lit("jobs "), F.col("status")).alias("name"), "value", "at")
    beat = jobs.where("status IN ('running', 'completed')").agg(F.max("updated_at").alias("at"))
    active = beat.select(F.lit("worker active").alias("name"), F.coalesce(F.timestamp_diff("SECOND", F.col("at"), as_of) <= 300, F.lit(False)).cast("long").alias("value"), "at")
    return last.union(states).union(active)


def tag_plan(tracks: DataFrame, existing: DataFrame) -> DataFrame:
    """What to do with the tempo and version tags of tracks (id, title, path, bpm), against those there."""
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    wanted = tracks.select(F.col("id").alias("item"), F.explode(F.array(
        F.struct(F.lit("bpm").alias("category"), music.bpm_range_label(F.col("bpm")).alias("tag")), F.struct(F.lit("version").alias("category"), style.version_tag(F.col("title"), base).alias("tag")),
    )).alias("t")).select("item", "t.category", "t.tag").where("tag is not null")
    return lookups.assignment_diff(wanted, existing)


def cleanup_plan(files: DataFrame) -> DataFrame:
    """id, target of inbox files that another file of the same source makes superfluous."""
    return library.duplicates_by_id(files).where("NOT keeper").select("id", F.lit("_rejected/duplicate").alias("target"))
