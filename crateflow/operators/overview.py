"""Reports that draw on many tables: the week, curators, the watch list, a track's life, a set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crateflow.functions import text, urls

from . import library, reports

#: What counts as measured surely.
SURE_BPM, SURE_KEY = 0.5, 0.05
#: Steps of a track's life in order.
STEPS = ("found", "rated", "gate", "store", "rejected", "inbox", "analyzed", "archive", "adopted")


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def _full(c: Column) -> Column:
    """A text that is not blank, else null."""
    return F.when(~_blank(c), c)


def weekly(runs: DataFrame, tracks: DataFrame, votes: DataFrame, as_of: Column, days: int = 7, artists: int = 10) -> DataFrame:
    """section, place, name, current, before: the figures of ``reports.kpis``, the quality of tracks that were
    rejected, and the artists of most tracks that came in (ties by name); both of the last ``days``."""
    kpis = reports.kpis(runs, tracks, votes, as_of, days).select(F.lit("kpi").alias("section"), F.lit(0).alias("place"), F.col("kpi").alias("name"), "current", "before")
    new = tracks.where(F.col("created_at") > as_of - F.make_dt_interval(F.lit(days)))
    none = F.lit(None).cast("long")
    quality = new.where("status = 'rejected'").groupBy(F.coalesce("quality_status", F.lit("unknown")).alias("name")).agg(F.count("*").alias("current"))
    top = new.where("status = 'inbox' and artist is not null").groupBy(F.col("artist").alias("name")).agg(F.count("*").alias("current")).orderBy(F.desc("current"), "name").limit(artists)
    place = F.row_number().over(Window.orderBy(F.desc("current"), "name"))  # ``artists`` rows
    parts = [kpis, quality.select(F.lit("quality").alias("section"), F.lit(0).alias("place"), "name", "current", none.alias("before")), top.select(F.lit("artist").alias("section"), place.alias("place"), "name", "current", none.alias("before"))]
    return reduce(DataFrame.unionByName, parts)


def curators(fans: DataFrame, liked: DataFrame, favourites: DataFrame, known: DataFrame, least: int = 2) -> DataFrame:
    """source, slug, name, n of accounts worth following, without ``known`` ones (account: address or name).

    Fans (track_id, kind, pos, permalink, username) of ``liked`` tracks (sc_id) count once for each track and
    kind; ``least`` times or more makes a candidate, under the name and spelling it was first met with.
    Then the collection's favourites (artist, n) whose address is neither known nor a candidate."""
    names = known.select(F.explode(F.array(urls.account_slug(F.col("account")), text.artist_slug(urls.account_slug(F.col("account"))))).alias("slug")).where("slug <> ''").distinct()
    met = fans.join(liked.select(F.col("sc_id").alias("track_id")).distinct(), "track_id", "left_semi").withColumn("spelt", F.element_at(F.split(F.regexp_replace(F.trim("permalink"), "/+$", ""), "/"), -1)).where(~_blank(F.col("spelt")))
    counted = met.withColumn("slug", F.lower("spelt")).join(names, "slug", "left_anti").groupBy("slug").agg(
        F.count("*").alias("n"), F.min_by(F.coalesce(_full(F.col("username")), F.col("spelt")), F.struct("track_id", F.when(F.col("kind") == "like", 0).otherwise(1), "pos")).alias("name")
    ).where(F.col("n") >= least)
    own = favourites.select(text.artist_slug(F.col("artist")).alias("slug"), F.col("artist").alias("name"), F.col("n").cast("long").alias("n")).where("slug <> ''")
    rest = own.groupBy("slug").agg(F.max_by(F.struct("name", "n"), F.struct("n", "name")).alias("b")).select("slug", "b.name", "b.n").join(names, "slug", "left_anti").join(counted.select("slug"), "slug", "left_anti")
    return counted.select(F.lit("fans").alias("source"), "slug", "name", "n").union(rest.select(F.lit("collection").alias("source"), "slug", "name", "n"))


def watch_list(watch: DataFrame, snapshots: DataFrame, stores: DataFrame) -> DataFrame:
    """place, sc_id, artist, title, last_kind, available_at, is_available of watched tracks: newly available ones first,
    the latest of them at the top, then by the last check and id. Names come from the newest snapshot, else
    from the store (of several rows the first by name)."""
    newest = snapshots.groupBy("sc_id").agg(F.max_by(F.struct("artist", "title"), "id").alias("s"))
    shops = stores.groupBy("sc_id").agg(F.min(F.struct("artist", "title")).alias("t"))
    rows = watch.join(newest, "sc_id", "left").join(shops, "sc_id", "left")
    named = rows.select("sc_id", *[F.coalesce(_full(F.col(f"s.{c}")), F.col(f"t.{c}")).alias(c) for c in ("artist", "title")], F.coalesce("last_kind", F.lit("")).alias("last_kind"), "last_checked", "available_at", F.col("available_at").isNotNull().alias("is_available"))
    return named.orderBy(F.desc("is_available"), F.desc("available_at"), F.desc("last_checked"), "sc_id").drop("last_checked")


def backfill_artists(rows: DataFrame, tracks: DataFrame) -> DataFrame:
    """id, artist, how of ``rows`` (id, url, artist): kept where there is one; else that of the tracks (id, sc_id,
    source_url, artist) of the same sc_id, or, where no track has it, of the same comparable address. Of
    several tracks the first with an artist by id counts; none where the tracks met have no artist."""
    def first(key: Column) -> DataFrame:
        own = tracks.select(key.alias("k"), "id", F.trim(F.coalesce("artist", F.lit(""))).alias("a")).where(F.col("k").isNotNull())
        return own.groupBy("k").agg(F.min_by("a", F.struct(F.col("a") == "", F.col("id"))).alias("a"))

    by_id = first(F.col("sc_id")).select(F.col("k").alias("i"), F.col("a").alias("by_id"))
    by_url = first(F.nullif(urls.normalize_url(F.col("source_url")), F.lit(""))).select(F.col("k").alias("u"), F.col("a").alias("by_url"))
    met = rows.withColumn("address", urls.normalize_url(F.col("url"))).join(by_id, F.col("id") == F.col("i"), "left").join(by_url, F.col("address") == F.col("u"), "left")
    own, found = _full(F.col("artist")), F.when(F.col("i").isNotNull(), F.col("by_id")).otherwise(F.col("by_url"))
    how = F.when(own.isNotNull(), "kept").when(F.coalesce(found, F.lit("")) == "", "none").when(F.col("i").isNotNull(), "id").otherwise("url")
    return met.select("id", F.coalesce(own, F.nullif(found, F.lit(""))).alias("artist"), how.alias("how"))


def track_life(ids: DataFrame, seen: DataFrame, rejected: DataFrame, votes: DataFrame, gates: DataFrame, stores: DataFrame, tracks: DataFrame) -> DataFrame:
    """sc_id, place, step, at, detail of the steps that each of ``ids`` (sc_id) has reached, in the order of ``STEPS``.

    Of its gates and stores the earliest counts. Of its library rows one tells the rest: a row with the id
    before one with the id in its path; adopted before inbox, archive and others; then the least id.
    ``seen``: id, reported_at; ``rejected``: id, rejected_at, reason; ``votes``: sc_id, value, updated_at; ``gates`` and
    ``stores``: sc_id, first_seen, link; ``tracks``: id, sc_id, path, status, adopted_at, bpm, key_camelot, modified."""
    wanted = ids.select("sc_id").where("sc_id is not null").distinct()
    t = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    step = lambda df, k, name, at, detail: df.select(k.alias("sc_id"), F.lit(STEPS.index(name)).alias("place"), F.lit(name).alias("step"), at.alias("at"), detail.alias("detail"))
    earliest = lambda df: df.groupBy("sc_id").agg(F.min(F.struct(F.col("first_seen").isNull().alias("z"), t("first_seen").alias("at"), t("link").alias("link"))).alias("e"))
    state = F.when(F.col("adopted_at").isNotNull(), 0).when(F.col("status") == "inbox", 1).when(F.col("status") == "archive", 2).otherwise(3)
    row = F.struct("path", "status", t("adopted_at").alias("adopted_at"), F.col("bpm").cast("double").alias("bpm"), "key_camelot", t("modified").alias("modified"))
    ways = F.explode(F.array(F.struct(F.col("sc_id").cast("long").alias("k"), F.lit(0).alias("way")), F.struct(text.id_anywhere(F.col("path")).alias("k"), F.lit(1).alias("way"))))
    told = tracks.select("*", ways.alias("w")).where("w.k is not null").groupBy(F.col("w.k").alias("sc_id")).agg(F.min_by(row, F.struct("w.way", state, "id")).alias("r")).select("sc_id", "r.*")
    inbox, adopted = F.col("status") == "inbox", F.col("adopted_at").isNotNull()
    parts = [
        step(seen.groupBy("id").agg(F.min(t("reported_at")).alias("at")), F.col("id"), "found", F.col("at"), none),
        step(votes.groupBy("sc_id").agg(F.max_by(F.struct("value", t("updated_at").alias("at")), F.struct("updated_at", "value")).alias("v")), F.col("sc_id"), "rated", F.col("v.at"), F.col("v.value")),
        step(earliest(gates), F.col("sc_id"), "gate", F.col("e.at"), F.col("e.link")), step(earliest(stores), F.col("sc_id"), "store", F.col("e.at"), F.col("e.link")),
        step(rejected.groupBy("id").agg(F.min(F.struct(t("rejected_at").alias("at"), "reason")).alias("v")), F.col("id"), "rejected", F.col("v.at"), F.col("v.reason")),
        step(told.where(inbox | adopted), F.col("sc_id"), "inbox", F.col("modified"), F.col("path")),
        step(told.where(F.col("bpm").isNotNull() & ~_blank(F.col("key_camelot"))), F.col("sc_id"), "analyzed", none, F.concat(F.format_string("%.0f", F.bround("bpm")), F.lit(" BPM · "), F.col("key_camelot"))),
        step(told.where((F.col("status") == "archive") & ~adopted), F.col("sc_id"), "archive", none, F.col("path")), step(told.where(adopted), F.col("sc_id"), "adopted", F.col("adopted_at"), none),
    ]
    return reduce(DataFrame.unionByName, parts).join(wanted, "sc_id", "left_semi")


def set_report(pool: DataFrame, ordered: DataFrame, transitions: DataFrame) -> DataFrame:
    """section, name, n, share, detail about a set: how many tracks of the pool have tempo and key, and surely;
    its length, segments and steps with a warning; its range of tempo; how often each relation and key
    occurs; and the pool's tracks that should be looked at.

    ``pool``: id, bpm, bpm_confidence, key_camelot, key_margin; ``ordered`` and ``transitions`` as of ``sets``."""
    none, text_ = F.lit(None).cast("double"), F.lit(None).cast("string")
    row = lambda section, name, n, share=none, detail=text_: F.struct(F.lit(section).alias("section"), name.cast("string").alias("name"), n.cast("long").alias("n"), share.cast("double").alias("share"), detail.cast("string").alias("detail"))
    has_bpm, has_key = F.col("bpm").isNotNull(), ~_blank(F.col("key_camelot"))
    sure_bpm, sure_key = has_bpm & F.coalesce(F.col("bpm_confidence") >= SURE_BPM, F.lit(False)), has_key & F.coalesce(F.col("key_margin") >= SURE_KEY, F.lit(False))
    share = lambda n: F.when(F.col("all") > 0, F.bround(100.0 * n / F.col("all"), 4))
    counts = pool.agg(F.count("*").alias("all"), *[F.count_if(c).alias(n) for n, c in (("bpm", has_bpm), ("key", has_key), ("sure_bpm", sure_bpm), ("sure_key", sure_key), ("anchors", sure_bpm & sure_key))])
    pooled = counts.select(F.explode(F.array(row("pool", F.lit("tracks"), F.col("all")), *[row("pool", F.lit(c), F.col(c), share(F.col(c))) for c in ("bpm", "key", "sure_bpm", "sure_key", "anchors")])).alias("r"))
    listed = ordered.join(pool.select("id", "bpm", "key_camelot"), "id")
    ends = listed.agg(F.count("*").alias("n"), F.count_distinct("pool", "segment").alias("segments"), F.min("bpm").alias("low"), F.max("bpm").alias("high"), F.median("bpm").alias("middle"))
    shape = ends.select(F.explode(F.array(row("set", F.lit("tracks"), F.col("n")), row("set", F.lit("segments"), F.col("segments")), *[row("tempo", F.lit(c), F.lit(None), F.col(c)) for c in ("low", "high", "middle")])).alias("r"))
    steps = transitions.where("kind = 'step'")
    warned = steps.agg(row("set", F.lit("steps"), F.count("*")).alias("a"), row("set", F.lit("warnings"), F.count_if(F.col("warning") != "")).alias("b")).select(F.explode(F.array("a", "b")).alias("r"))
    relations = steps.groupBy("relation").agg(F.count("*").alias("n")).select(row("relation", F.col("relation"), F.col("n")).alias("r"))
    keys = listed.where(has_key).groupBy("key_camelot").agg(F.count("*").alias("n")).select(row("key", F.col("key_camelot"), F.col("n")).alias("r"))
    reasons = F.concat_ws("; ", F.when(~sure_bpm, F.concat(F.lit("tempo "), F.when(has_bpm, F.format_string("%.1f", "bpm")).otherwise("--"))), F.when(~sure_key, F.concat(F.lit("key "), F.coalesce(_full(F.col("key_camelot")), F.lit("--")))))
    unsure = pool.where(~sure_bpm | ~sure_key).select(row("unsure", F.col("id"), F.lit(None), none, reasons).alias("r"))
    return reduce(DataFrame.union, [pooled, shape, warned, relations, keys, unsure]).select("r.*")


def collectors(tracks: DataFrame, least: int = 3, most_tracks: int = 5) -> DataFrame:
    """artist, n, liked_share, tracks of artists with ``least`` tracks in the library: their first ``most_tracks`` (id,
    title, rating), the best rated first, then by id."""
    own = tracks.where(F.col("status").isin("archive", "inbox") & F.col("artist").isNotNull() & library.admitted())
    k = F.row_number().over(Window.partitionBy("artist").orderBy(F.desc_nulls_last("rb_rating"), "id"))
    some = own.withColumn("k", k).where(F.col("k") <= most_tracks).groupBy("artist").agg(F.array_sort(F.collect_list(F.struct("k", "id", "title", F.col("rb_rating").alias("rating")))).alias("t"))
    counts = own.groupBy("artist").agg(F.count("*").alias("n"), (F.count_if(F.col("rb_rating") >= 4) / F.count("*")).alias("liked_share")).where(F.col("n") >= least)
    return counts.join(some, "artist").select("artist", "n", "liked_share", F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"), x["rating"].alias("rating"))).alias("tracks"))


def top_exploration(counters: DataFrame, as_of: Column, days: int = 30, least: int = 2) -> DataFrame:
    """Tags (tag, uses, successes, last_success) with ``least`` successes, the last within ``days``, best first."""
    recent = F.col("last_success") >= as_of - F.make_dt_interval(F.lit(days))
    return counters.where((F.col("successes") >= least) & recent).orderBy(F.desc("successes"), "tag")
