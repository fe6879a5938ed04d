"""Changes to tables, as functions from what is there and what comes to what is there then."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pairs


def upsert(current: DataFrame, changes: DataFrame, key: list[str], kept: tuple[str, ...] = (), latest: str | None = None) -> DataFrame:
    """``current`` with ``changes`` (some of its columns): a value that is given overwrites, null does
    not, and columns ``kept`` are only filled. Of several changes to a key the last by ``latest`` with a
    value counts for each column."""
    given = [c for c in changes.columns if c not in key and c in current.columns]
    if latest:
        changes = changes.groupBy(*key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(latest))).alias(c) for c in given])
    new = changes.select(*[F.col(c).alias(f"k_{c}") for c in key], *[F.col(c).alias(f"n_{c}") for c in given])
    # Not a full join, nor one of rows: equal rows of a key are counted, lists of them meet and are dealt to all cores.
    met, names = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in key], [f"k_{c}" for c in key]
    old = pairs.counted(current, pairs.MOST).select(*key, F.struct(*[c for c in current.columns if c not in key], "times_").alias("old_")).withColumn("w_", F.col("old_.times_"))
    more = pairs.counted(new, pairs.MOST).select(*names, F.struct(*[f"n_{c}" for c in given], "times_").alias("new_")).withColumn("w_", F.col("new_.times_"))
    left, right = pairs.lists(old, key, "old_", "w_"), pairs.lists(more, names, "new_", "w_")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema]
    alone = right.join(current.select(*key), met, "left_anti").select(*none, *right.columns)
    some = lambda c, lists: F.coalesce(c, F.array(F.lit(None).cast(lists.schema[c].dataType.elementType))).alias(c)
    # Each row of the table alone, as often as it stands there, so that few rows are held at a time.
    single = F.flatten(F.transform("old_", lambda row: F.array_repeat(F.array(row), F.coalesce(row["times_"], F.lit(1)))))
    both = pairs.each_pair(left.join(right, met, "left").union(alone).select(*key, *names, some("old_", left), some("new_", right)), "old_", "new_", single)

    def value(c: str) -> Column:
        if c in key:
            return F.coalesce(c, f"k_{c}").alias(c)
        if c not in given:
            return F.col("old_")[c].alias(c)
        both_ = (F.col("old_")[c], F.col("new_")[f"n_{c}"])
        return F.coalesce(*(both_ if c in kept else both_[::-1])).alias(c)

    one = both.select(*[value(c) for c in current.columns], F.sequence(F.lit(1), F.coalesce("new_.times_", F.lit(1))).alias("times_"))
    return one.withColumn("times_", F.explode("times_")).drop("times_")


def fold_last(current: DataFrame, changes: DataFrame, key: str, order: str, value: str, cleared: str = "clear") -> DataFrame:
    """key, value after a log of changes: the last one by ``order`` counts, ``cleared`` removes the key."""
    first = current.select(key, value, F.lit(None).cast(dict(changes.dtypes)[order]).alias(order))
    log = first.union(changes.select(key, value, order))
    last = log.groupBy(key).agg(F.max_by(F.struct(value), F.struct(F.col(order).isNotNull(), order)).alias("v")).select(key, f"v.{value}")
    return last.where(F.coalesce(F.col(value) != cleared, F.lit(True)))


def count_uses(current: DataFrame, events: DataFrame) -> DataFrame:
    """tag, uses, successes, last_success after ``events`` (tag, success, at) were added."""
    new = events.select("tag", F.lit(1).cast("long").alias("uses"), F.col("success").cast("long").alias("successes"), F.when(F.col("success"), F.col("at")).alias("last_success"))
    return current.select("tag", "uses", "successes", "last_success").union(new).groupBy("tag").agg(F.sum("uses").alias("uses"), F.sum("successes").alias("successes"), F.max("last_success").alias("last_success"))


def adopt(tracks: DataFrame, adopted: DataFrame) -> DataFrame:
    """``tracks`` after ``adopted`` (id, archive_id, adopted_at): inbox rows are liked, unless disliked, and
    marked; their id and address go to the archive row where it has none."""
    mark = adopted.select("id", F.col("adopted_at").alias("at_"))
    source = adopted.join(tracks.select("id", F.col("sc_id").alias("sc_"), F.col("source_url").alias("url_")), "id").groupBy(F.col("archive_id").alias("id")).agg(F.min("sc_").alias("sc_"), F.min("url_").alias("url_"))
    rows = tracks.join(mark, "id", "left").join(source, "id", "left")
    liked = F.when(F.col("at_").isNotNull() & (F.coalesce("feedback", F.lit("")) != "dislike"), "like").otherwise(F.col("feedback"))
    return rows.withColumns({"feedback": liked, "adopted_at": F.coalesce("at_", "adopted_at"), "sc_id": F.coalesce("sc_id", "sc_"), "source_url": F.coalesce("source_url", "url_")}).select(*tracks.columns)


def mark_done(items: DataFrame, marks: DataFrame, profile: str) -> DataFrame:
    """``items`` with done_at set, or cleared, by ``marks`` (sc_id, done_at) of a profile."""
    own = marks.select("sc_id", F.col("done_at").alias("new_"), F.lit(True).alias("given_"))
    hit = (F.col("profile_id") == profile) & F.coalesce("given_", F.lit(False))
    return items.join(own, "sc_id", "left").withColumn("done_at", F.when(hit, F.col("new_")).otherwise(F.col("done_at"))).select(*items.columns)


def seen_marks(current: DataFrame, new: DataFrame, keep_first: bool) -> DataFrame:
    """``current`` and ``new`` rows (id, at, ...): of an id the first row stays, or the last replaces it."""
    both = current.withColumn("age_", F.lit(0)).unionByName(new.withColumn("age_", F.lit(1)), allowMissingColumns=True)
    row = F.struct(*current.columns)
    order = F.struct("age_", "at")
    pick = F.min_by(row, order) if keep_first else F.max_by(row, order)
    return both.groupBy("id").agg(pick.alias("r")).select("r.*")


def route_outcomes(items: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(rejected rows with their reason, the others)."""
    named = items.withColumn("reason", reason)
    return named.where(F.col("reason").isNotNull()), named.where(F.col("reason").isNull()).drop("reason")


def add_tags(tags: DataFrame, new: DataFrame, tracks: DataFrame) -> DataFrame:
    """track_id, tag with ``new`` ones added once. Tags of tracks that do not exist are refused."""
    lost = new.join(tracks.select(F.col("id").alias("track_id")), "track_id", "left_anti")
    if not lost.isEmpty():
        raise ValueError("tags of tracks that do not exist")
    return tags.select("track_id", "tag").union(new.select("track_id", "tag")).distinct()


def remove_tags(tags: DataFrame, gone: DataFrame) -> DataFrame:
    return tags.join(gone.select("track_id", "tag"), ["track_id", "tag"], "left_anti")


def backfill(tracks: DataFrame, column: str, value: Column, force: bool = False) -> DataFrame:
    """``tracks`` with a missing ``column`` worked out, all of them anew with ``force``."""
    return tracks.withColumn(column, value if force else F.coalesce(F.col(column), value))


def daily_snapshots(current: DataFrame, new: DataFrame) -> DataFrame:
    """``current`` and the first of ``new`` rows (sc_id, recorded_at, ...) for each id and day that has none."""
    day = F.to_date("recorded_at")
    fresh = new.withColumn("day_", day).join(current.select("sc_id", day.alias("day_")).distinct(), ["sc_id", "day_"], "left_anti")
    first = fresh.groupBy("sc_id", "day_").agg(F.min_by(F.struct(*new.columns), "recorded_at").alias("r")).select("r.*")
    return current.unionByName(first, allowMissingColumns=True)


def finish_jobs(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """``jobs`` after ``reports`` (id, status, result, error, at): a result or error that is not given stays."""
    own = reports.select("id", *[F.col(c).alias(f"{c}_") for c in ("status", "result", "error", "at")])
    rows = jobs.join(own, "id", "left")
    return rows.withColumns({"status": F.coalesce("status_", "status"), "result": F.coalesce("result_", "result"), "error": F.coalesce("error_", "error"), "updated_at": F.coalesce("at_", "updated_at")}).select(*jobs.columns)


def requeue_stale(jobs: DataFrame, as_of: Column, minutes: dict[str, int], default: int = 30) -> DataFrame:
    """``jobs`` with running ones that were last heard of longer ago than their type allows pending again."""
    allowed = F.lit(default)
    for kind, m in minutes.items():
        allowed = F.when(F.col("job_type") == kind, m).otherwise(allowed)
    stale = (F.col("status") == "running") & (F.timestamp_diff("MICROSECOND", F.col("updated_at"), as_of) > allowed.cast("long") * 60_000_000)
    return jobs.withColumn("status", F.when(stale, "pending").otherwise(F.col("status")))


def retries(log: DataFrame, most: int = 5) -> DataFrame:
    """sc_id, attempts, last_error, status from a log (sc_id, at, ok, error): failures since the last
    success; none after it. ``failed`` from ``most`` attempts on, ``pending`` before."""
    last_ok = log.where("ok").groupBy("sc_id").agg(F.max("at").alias("ok_at"))
    open_ = log.where("NOT ok").join(last_ok, "sc_id", "left").where(F.col("ok_at").isNull() | (F.col("at") > F.col("ok_at")))
    counted = open_.groupBy("sc_id").agg(F.count("*").alias("attempts"), F.substring(F.max_by("error", "at"), 1, 300).alias("last_error"))
    return counted.withColumn("status", F.when(F.col("attempts") >= most, "failed").otherwise("pending"))


def watch_candidates(votes: DataFrame, tracks: DataFrame, watch: DataFrame, as_of: Column, days: int = 180) -> DataFrame:
    """sc_id of liked tracks that are not in the library and are not watched yet, or still are without being
    available, first checked within ``days``."""
    liked = votes.where("value = 'like'").select("sc_id").distinct().join(tracks.where("sc_id is not null").select("sc_id"), "sc_id", "left_anti")
    state = watch.select("sc_id", "available_at", "first_checked", F.lit(True).alias("watched"))
    open_ = F.col("watched").isNull() | (F.col("available_at").isNull() & (F.col("first_checked") >= as_of - F.make_dt_interval(F.lit(days))))
    return liked.join(state, "sc_id", "left").where(open_).select("sc_id")


def check_availability(watch: DataFrame, asked: DataFrame, found: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(the watch table, sc_id and kind of what became available). ``watch``: sc_id, first_checked,
    last_checked, last_kind, available_at; ``asked``: sc_id; ``found``: sc_id, kind of those that still
    exist. A first check only records; one that found nothing before and a way now is reported; what is
    gone keeps its kind."""
    now = asked.join(found.select("sc_id", "kind", F.lit(True).alias("exists_")), "sc_id", "left").withColumn("asked_", F.lit(True))
    rows = watch.withColumn("old_", F.lit(True)).join(now, "sc_id", "full")
    there = F.coalesce(F.col("kind") != "none", F.lit(False))
    opened = F.col("old_") & F.col("asked_") & (F.col("last_kind") == "none") & there
    fresh = F.col("old_").isNull()
    new = rows.select(
        "sc_id", F.coalesce("first_checked", as_of).alias("first_checked"), F.when(F.col("asked_"), as_of).otherwise(F.col("last_checked")).alias("last_checked"),
        F.coalesce(F.when(F.col("exists_"), F.col("kind")), "last_kind", F.lit("none")).alias("last_kind"), F.when((fresh & there) | F.coalesce(opened, F.lit(False)), as_of).otherwise(F.col("available_at")).alias("available_at"),
    )
    return new, rows.where(opened).select("sc_id", "kind")
