"""Growth of tracks, artists and tags between snapshots, and other readings of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ranking

from crateflow.functions import text


def window(snapshots: DataFrame, days: int) -> DataFrame:
    """The snapshots of the last ``days`` days before the newest one, its edge included."""
    newest = snapshots.agg(F.max("recorded_at").alias("newest_"))
    return snapshots.join(F.broadcast(newest), F.col("recorded_at") >= F.col("newest_") - F.make_dt_interval(F.lit(days))).drop("newest_")


def ends(snapshots: DataFrame, days: int) -> DataFrame:
    """For each sc_id the first and last snapshot in the window, by time and id: counts at both ends,
    artist and title of the last, else the first one."""
    order = F.struct("recorded_at", "id")
    both = window(snapshots, days).groupBy("sc_id").agg(F.min_by(F.struct("*"), order).alias("a"), F.max_by(F.struct("*"), order).alias("b"), F.count("*").alias("n"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    engagement = lambda s: zero(f"{s}.likes") + zero(f"{s}.reposts") + zero(f"{s}.comments")
    return both.select(
        "sc_id", "n", zero("a.likes").alias("start_likes"), zero("b.likes").alias("end_likes"), engagement("a").alias("start_engagement"), engagement("b").alias("end_engagement"),
        F.coalesce("b.artist", "a.artist").alias("artist"), F.coalesce("b.title", "a.title").alias("title"),
    )


def track_growth(snapshots: DataFrame, days: int = 7, least: int = 10, limit: int | None = 10) -> DataFrame:
    """Tracks that began with ``least`` likes and gained, by rate, gain and id."""
    delta = F.col("end_likes") - F.col("start_likes")
    grown = ends(snapshots, days).where((F.col("start_likes") >= least) & (delta > 0)).select("sc_id", "title", "artist", "start_likes", "end_likes", delta.alias("delta"), (delta / F.col("start_likes")).alias("rate"))
    out = grown.orderBy(F.desc("rate"), F.desc("delta"), "sc_id")
    return out.limit(limit) if limit is not None else out


def artist_growth(snapshots: DataFrame, days: int = 7, least: int = 20, limit: int | None = 10) -> DataFrame:
    """Artists whose tracks together began with ``least`` likes and gained."""
    sums = ends(snapshots, days).groupBy("artist").agg(F.sum("start_likes").alias("start_likes"), F.sum("end_likes").alias("end_likes"), F.count("*").alias("tracks"), F.min("sc_id").alias("first_"))
    delta = F.col("end_likes") - F.col("start_likes")
    grown = sums.where((F.col("start_likes") >= least) & (delta > 0)).select("artist", "tracks", "start_likes", "end_likes", delta.alias("delta"), (delta / F.col("start_likes")).alias("rate"), "first_")
    out = grown.orderBy(F.desc("rate"), F.desc("delta"), "first_").drop("first_")
    return out.limit(limit) if limit is not None else out


def tag_trends(snapshots: DataFrame, days: int = 7, least: int = 20, least_tracks: int = 2, limit: int | None = 10) -> DataFrame:
    """Tags (a JSON list in ``tags``; of a track those of its newest snapshot that has any) whose tracks
    together began with an engagement of ``least`` and gained."""
    read = window(snapshots, days).withColumn("own", text.json_tags(F.col("tags"))).where(F.size("own") > 0)
    tags = read.groupBy("sc_id").agg(F.max_by("own", F.struct("recorded_at", "id")).alias("own"))
    sums = ends(snapshots, days).join(tags, "sc_id").select("*", F.explode("own").alias("tag")).groupBy("tag").agg(
        F.count("*").alias("tracks"), F.sum("start_engagement").alias("start"), F.sum("end_engagement").alias("stop"))
    delta = F.col("stop") - F.col("start")
    grown = sums.where((F.col("tracks") >= least_tracks) & (F.col("start") >= least) & (delta > 0))
    out = grown.select("tag", "tracks", (F.col("stop") / F.col("tracks")).alias("engagement"), delta.alias("delta"), (delta / F.col("start")).alias("rate")).orderBy(F.desc("rate"), F.desc("delta"), "tag")
    return out.limit(limit) if limit is not None else out


def retention(days: DataFrame, daily: int = 7, weekly: int = 4) -> DataFrame:
    """day, keep (daily, weekly or drop): the newest ``daily`` days stay, and of the others the newest of
    each ISO week, of the newest ``weekly`` weeks. One row a day is little for one task."""
    ranked = days.select("day").distinct().withColumn("k", F.row_number().over(Window.orderBy(F.desc("day"))))
    old = ranked.where(F.col("k") > daily).groupBy(F.date_trunc("week", "day").alias("week")).agg(F.max("day").alias("last"))
    weeks = old.withColumn("w", F.row_number().over(Window.orderBy(F.desc("week")))).where(F.col("w") <= weekly).select(F.col("last").alias("day"), F.lit(True).alias("weekly"))
    return ranked.join(weeks, "day", "left").select("day", F.when(F.col("k") <= daily, "daily").when(F.col("weekly"), "weekly").otherwise("drop").alias("keep"))


def alarms(runs: DataFrame, threshold: int = 3) -> DataFrame:
    """id, mode, message (alarm or recovery) as runs (id, mode, ok, found) go by: an alarm once
    ``threshold`` runs in a row were bad and none is on, a recovery at the next good run.

    A mode's runs are dealt to ranges of ids. What a range needs of those before it is how many bad runs
    they end with, from one row a mode and range."""
    bad = (~F.col("ok")) | (F.col("found") == 0)
    dealt = ranking.dealt(runs.select("id", "mode", bad.alias("bad")), "id")
    inside = Window.partitionBy("mode", "range_").orderBy("id")
    good = F.coalesce(F.sum((~F.col("bad")).cast("int")).over(inside), F.lit(0))
    run = Window.partitionBy("mode", "range_", "good").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumn("good", good).withColumn("own", F.coalesce(F.sum(F.col("bad").cast("int")).over(run), F.lit(0)))
    ends = own.groupBy("mode", "range_", "good").agg(F.max("own").alias("end")).groupBy("mode", "range_").agg(F.max_by("end", "good").alias("end"), F.max("good").alias("good"))
    # Ranges without a good run carry on what the ones before them end with.
    by = Window.partitionBy("mode").orderBy("range_")
    since = ends.withColumn("row", F.sum((F.col("good") > 0).cast("int")).over(by)).withColumn("end", F.sum("end").over(Window.partitionBy("mode", "row").orderBy("range_")))
    before = since.select(F.col("mode").alias("m"), F.col("range_").alias("r"), F.coalesce(F.lag("end").over(by), F.lit(0)).alias("before"))
    rows = own.join(before, F.col("mode").eqNullSafe(F.col("m")) & (F.col("range_") == F.col("r")))
    streaks = rows.withColumn("streak", F.col("own") + F.when(F.col("good") == 0, F.col("before")).otherwise(0))
    counted = streaks.withColumn("was", F.coalesce(F.lag("streak").over(inside), F.col("before")))
    message = F.when(F.col("bad") & (F.col("streak") == max(threshold, 1)), "alarm").when(~F.col("bad") & (F.col("was") >= max(threshold, 1)), "recovery")
    return counted.select("id", "mode", message.alias("message")).where("message is not null")


def kick_segments(peaks: DataFrame, durations: DataFrame, gap: float = 6.0, least: int = 4, edge: float = 6.0) -> DataFrame:
    """track_id, segments (start, stop, label) from times of kicks (track_id, t): runs of ``least`` kicks
    without a pause of ``gap`` seconds are main parts, what lies between them breakdowns, and what
    lies before and after for ``edge`` seconds intro and outro."""
    by = Window.partitionBy("track_id").orderBy("t")
    lagged = peaks.select("track_id", "t", (F.col("t") - F.lag("t").over(by)).alias("step"))
    runs = lagged.withColumn("run", F.sum(F.coalesce((F.col("step") >= gap).cast("int"), F.lit(0))).over(by))
    each = runs.groupBy("track_id", "run").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n"), F.collect_list(F.when((F.col("step") < 1.5) & (F.col("step") < gap), F.col("step"))).alias("steps")).where(F.col("n") >= least)
    # A run's kicks are those of one track: its length bounds them.
    whole = each.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("runs"), F.array_sort(F.flatten(F.collect_list("steps"))).alias("steps"))
    half = F.size("steps") / 2
    middle = F.when(F.size("steps") == 0, 0.4).otherwise((F.try_element_at("steps", (F.floor((F.size("steps") - 1) / 2) + 1).cast("int")) + F.try_element_at("steps", (F.floor(half) + 1).cast("int"))) / 2)
    r3 = lambda c: F.bround(c, 3)
    seg = lambda a, b, name: F.struct(a.cast("double").alias("start"), b.cast("double").alias("stop"), F.lit(name).alias("label"))
    rows = whole.join(durations, "track_id").withColumn("beat", middle)
    first, last = F.col("runs")[0]["a"], F.try_element_at("runs", F.lit(-1))["b"]
    begin = F.when(first >= edge, r3(first)).otherwise(0.0)
    tail = F.least(F.col("duration"), last + F.col("beat"))
    mains = F.transform("runs", lambda r, i: seg(
        F.when(i == 0, begin).otherwise(r3(r["a"])), F.when((i == F.size("runs") - 1) & (F.col("duration") - tail < edge), r3(F.col("duration"))).otherwise(r3(F.least(F.col("duration"), r["b"] + F.col("beat")))), "main"))
    breaks = F.transform(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), lambda r, i: seg(r3(F.least(F.col("duration"), F.get("runs", i)["b"] + F.col("beat"))), r3(r["a"]), "breakdown"))
    ends_ = F.array_compact(F.array(F.when(first >= edge, seg(F.lit(0.0), r3(first), "intro")), F.when(F.col("duration") - tail >= edge, seg(r3(tail), r3(F.col("duration")), "outro"))))
    return rows.select("track_id", F.array_sort(F.concat(mains, breaks, ends_)).alias("segments"))


def period_counts(events: DataFrame, at: str, as_of: Column, days: int) -> list[Column]:
    """Aggregates ``current`` and ``before``: rows of the last ``days`` days, and of as many before."""
    span = F.make_dt_interval(F.lit(days))
    t = F.col(at)
    return [F.count_if(t > as_of - span).alias("current"), F.count_if((t > as_of - span - span) & (t <= as_of - span)).alias("before")]
