"""Lookups of single rows and short lists, rules over measured files, outcomes of runs."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crateflow.functions import urls

LOSSLESS = ("flac", "alac", "wavpack", "ape", "tta")


def by_id(rows: DataFrame, id_: int) -> DataFrame:
    return rows.where(F.col("id") == id_)


def by_path(tracks: DataFrame, path: str, profile: str) -> DataFrame:
    return tracks.where((F.col("path") == path) & (F.col("profile_id") == profile))


def by_url(tracks: DataFrame, url: str) -> DataFrame:
    """The row of smallest id whose address is the same in its comparable form."""
    return tracks.where(urls.normalize_url(F.col("source_url")) == urls.normalize_url(F.lit(url))).orderBy("id").limit(1)


def by_fingerprint(tracks: DataFrame, fingerprint: list[int]) -> DataFrame:
    """The row of smallest id with exactly this fingerprint."""
    return tracks.where(F.col("fingerprint") == F.array(*[F.lit(v).cast("long") for v in fingerprint])).orderBy("id").limit(1)


def fingerprinted(tracks: DataFrame, by: str = "seconds") -> DataFrame:
    """Rows with a fingerprint, in the order of length or path, then id."""
    return tracks.where(F.size("fingerprint") > 0).orderBy(F.col(by).asc_nulls_last(), "id")


def missing(tracks: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Rows without a value, by id."""
    out = tracks.where(F.col(column).isNull()).orderBy("id")
    return out.limit(limit) if limit is not None else out


def adopted(tracks: DataFrame) -> DataFrame:
    """Adopted rows, the newest first."""
    return tracks.where(F.col("adopted_at").isNotNull()).orderBy(F.desc("adopted_at"), "id")


def liked_ids(votes: DataFrame) -> DataFrame:
    return votes.where("value = 'like'").select("sc_id").distinct()


def tags_of(tags: DataFrame) -> DataFrame:
    """track_id, tags: each track's tags in order."""
    return tags.groupBy("track_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def ids_by_tag(tags: DataFrame, tag: str) -> DataFrame:
    return tags.where(F.col("tag") == tag).select("track_id").distinct().orderBy("track_id")


def gate_items(gates: DataFrame, profile: str) -> DataFrame:
    """A profile's gates, the last seen first."""
    return gates.where(F.col("profile_id") == profile).orderBy(F.desc("last_seen"), F.desc("id"))


def gates_to_fill(seen: DataFrame, gates: DataFrame, stores: DataFrame, items: DataFrame) -> DataFrame:
    """id, kind, link of reported items with neither gate nor store row whose way is a gate."""
    left = seen.select("id").join(gates.select(F.col("sc_id").alias("id")), "id", "left_anti").join(stores.select(F.col("sc_id").alias("id")), "id", "left_anti")
    way = urls.classify_download(F.col("url"), F.col("downloadable"), F.col("has_downloads_left"), F.col("purchase_url"), F.col("description"))
    return items.join(left, "id").select("id", way.alias("w")).select("id", "w.kind", "w.link").where(F.col("kind").isin(*urls.GATES.values()))


def title_matches(title: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns that the engine can compile occurs in a title, whatever its case."""
    out, java = F.lit(False), SparkContext._active_spark_context._jvm.java.util.regex
    for p in patterns:
        try:
            java.Pattern.compile(p)
        except IllegalArgumentException:
            continue
        out |= F.coalesce(title, F.lit("")).rlike(f"(?i){p}")
    return out


def genre_relevant(title: Column, genre: Column, tags: Column, keywords: list[str]) -> Column:
    """Whether one of the keywords stands in title, genre or a tag, whatever its case."""
    text = F.lower(F.concat_ws(" ", title, genre, F.array_join(tags, " ")))
    out = F.lit(False)
    for k in keywords:
        out |= F.contains(text, F.lit(k.lower()))
    return out


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files (path, size, modified: seconds) that are new, of another size, or changed by over 0.01 s."""
    old = known.select("path", F.col("size").alias("s_"), F.col("modified").alias("m_"))
    rows = files.join(old, "path", "left")
    return rows.where(F.col("s_").isNull() | (F.col("s_") != F.col("size")) | (F.abs(F.col("m_") - F.col("modified")) > 0.01)).drop("s_", "m_")


def admission(ending: Column, codec: Column, bitrate: Column, is_vbr: Column, cutoff: Column, loudness_range: Column, true_peak: Column, accepted: tuple[str, ...] = ("wav", "aiff", "aif", "flac"), least_bitrate: int = 320, least_lossless: float = 20_000.0, least_mp3: float = 19_500.0, least_range: float = 2.5, most_peak: float = 3.0) -> Column:
    """struct(ok, reason, clipped) of a measured file: lossless endings hold lossless codecs, MP3 has the
    bitrate or a variable one, and the spectrum reaches far enough; silence cannot be measured."""
    lossless_codec = codec.startswith("pcm_") | codec.isin(*LOSSLESS)
    by_ending, mp3 = ending.isin(*accepted), codec == "mp3"
    lossless = by_ending & lossless_codec
    limit = F.when(lossless, least_lossless).otherwise(least_mp3)
    reason = (
        F.when(by_ending & ~lossless_codec, "lossy stream in a lossless container").when(mp3 & ~is_vbr & (bitrate < least_bitrate), "bitrate too low")
        .when(~lossless & ~mp3, "codec not accepted").when(F.coalesce(cutoff, F.lit(0.0)) <= 0, "not measurable").when(cutoff < limit, "spectrum ends too early").otherwise("ok")
    )
    clipped = F.coalesce(loudness_range < least_range, F.lit(False)) | F.coalesce(true_peak >= most_peak, F.lit(False))
    return F.struct((reason == "ok").alias("ok"), reason.alias("reason"), ((reason == "ok") & clipped).alias("clipped"))


def route(verdict: Column, error: Column, duplicate: Column) -> Column:
    """Where a file goes: drop on an error, rejected, unmeasurable, clipped, duplicate or keep."""
    return (
        F.when(error.isNotNull(), "drop").when(~verdict["ok"], F.when(verdict["reason"] == "not measurable", "unmeasurable").otherwise("rejected"))
        .when(verdict["clipped"], "clipped").when(duplicate, "duplicate").otherwise("keep")
    )


def intake_outcome(is_audio: Column, error: Column, duplicate_of: Column) -> Column:
    """One word for each file of an intake."""
    return F.when(~is_audio, "not audio").when(error.isNotNull(), "error").when(duplicate_of.isNotNull(), "duplicate").otherwise("ok")


def exploration_outcomes(used: DataFrame, fresh: DataFrame) -> DataFrame:
    """tag, success for each used tag: whether any fresh item came from it."""
    hit = fresh.select(F.col("source_tag").alias("tag"), F.lit(True).alias("hit")).distinct()
    return used.select("tag").distinct().join(hit, "tag", "left").select("tag", F.coalesce("hit", F.lit(False)).alias("success"))


def operations(disk_free_gb: Column, backup_hours: Column, canary_ok: Column) -> Column:
    """array of struct(card, level) with level ok, warn or bad."""
    level = lambda bad, warn: F.when(bad, "bad").when(warn, "warn").otherwise("ok")
    card = lambda name, value: F.struct(F.lit(name).alias("card"), value.alias("level"))
    return F.array(
        card("disk", level(disk_free_gb < 5, disk_free_gb < 20)), card("backup", level(backup_hours.isNull() | (backup_hours > 72), backup_hours > 36)), card("canary", level(canary_ok.isNull() | ~canary_ok, F.lit(False))),
    )


def preview_start(drop: Column, loudest: Column, riser: float = 8.0) -> Column:
    """Where a preview begins: ``riser`` seconds before the drop, else at the loudest window, else at 0."""
    return F.coalesce(F.when(drop.isNotNull(), F.greatest(F.lit(0.0), drop - riser)), loudest, F.lit(0.0))


def cue_marks(hot: Column, memory: Column) -> Column:
    """Hot and memory cues, arrays of struct(time, name), in one array by time, hot before memory."""
    kind = lambda cues, k: F.transform(F.coalesce(cues, F.expr("cast(array() as array<struct<time:double,name:string>>)")), lambda c: F.struct(c["time"].alias("time"), F.lit(k).alias("kind"), c["name"].alias("name")))
    return F.array_sort(F.concat(kind(hot, 0), kind(memory, 1)))


def assignment_diff(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """item, category, action (insert, delete, replace, unchanged) from tags wanted and tags there (item,
    category, tag)."""
    w, e = wanted.select("item", "category", F.col("tag").alias("w")), existing.select("item", "category", F.col("tag").alias("e"))
    both = w.join(e, ["item", "category"], "full")
    action = F.when(F.col("e").isNull(), "insert").when(F.col("w").isNull(), "delete").when(F.col("w") == F.col("e"), "unchanged").otherwise("replace")
    return both.select("item", "category", F.coalesce("w", "e").alias("tag"), action.alias("action"))


def pending_jobs(jobs: DataFrame, kind: str | None = None) -> DataFrame:
    """n of pending jobs, of a type or all."""
    own = jobs.where("status = 'pending'")
    return (own if kind is None else own.where(F.col("job_type") == kind)).agg(F.count("*").alias("n"))
