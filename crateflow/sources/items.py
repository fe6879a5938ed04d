"""Discovered items from recorded answers: paged JSON, feeds, chart pages, libraries as XML."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import collect


def read_pages(spark: SparkSession, starts: list[str], limit: int = 200, most_pages: int = collect.MOST_PAGES) -> DataFrame:
    """start, pos, item (JSON) of the recorded pages that begin at ``starts``, files of one folder or of
    folders below it, by any path that Spark can read; next pages lie beside the first. A source that
    fails has no items here; ``collect`` gives the outcomes as well."""
    folder = starts[0].rpartition("/")[0]
    while not all(s.startswith(folder + "/") for s in starts):
        folder = folder.rpartition("/")[0]
    first = [(k, s, s[len(folder) + 1 :]) for k, s in enumerate(starts)]
    found, _ = collect.collect(collect.read_pages(spark, folder), spark.createDataFrame(first, "place int, source string, path string"), most_pages, limit)
    return found.select(F.col("place").alias("start"), "pos", "item")


_ITEM = """kind string, id long, title string, permalink_url string, user struct<username: string, permalink_url: string>, created_at string, full_duration long, duration long,
genre string, tag_list string, description string, playback_count long, likes_count long, favoritings_count long, reposts_count long, comment_count long, downloadable boolean, has_downloads_left boolean, purchase_url string, purchase_title string"""


def tag_list(raw: Column) -> Column:
    """Tags of a list in which those with blanks stand in quotes."""
    parts = F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(r'"[^"]+"|\S+'), F.lit(0))
    return F.transform(parts, lambda t: F.regexp_replace(t, '^"([^"]+)"$', "$1"))


def tracks_of(items: DataFrame, column: str = "item") -> DataFrame:
    """Tracks from JSON items, with the other columns; stubs, lists and untitled ones are left out, and
    missing counts are 0."""
    others = [c for c in items.columns if c != column]
    d = items.select(*others, F.from_json(column, _ITEM).alias("d")).where((F.col("d.kind") == "track") & (F.coalesce("d.title", F.lit("")) != ""))
    text = lambda c: F.coalesce(f"d.{c}", F.lit(""))
    count = lambda *c: F.coalesce(*[F.nullif(F.col(f"d.{x}"), F.lit(0)) for x in c], F.lit(0)).cast("long")
    return d.select(
        *others, F.col("d.id").alias("id"), F.col("d.title").alias("title"), text("permalink_url").alias("url"), text("user.username").alias("artist"), text("user.permalink_url").alias("artist_url"), text("created_at").alias("created_at"),
        count("full_duration", "duration").alias("duration_ms"), text("genre").alias("genre"), tag_list(F.col("d.tag_list")).alias("tags"), text("description").alias("description"), count("playback_count").alias("plays"),
        count("likes_count", "favoritings_count").alias("likes"), count("reposts_count").alias("reposts"), count("comment_count").alias("comments"), F.coalesce("d.downloadable", F.lit(False)).alias("downloadable"),
        F.coalesce("d.has_downloads_left", F.lit(True)).alias("has_downloads_left"), F.col("d.purchase_url").alias("purchase_url"), F.col("d.purchase_title").alias("purchase_title"),
    )


def newer_than(tracks: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Tracks created within ``days`` days; those without a readable time go."""
    created = F.try_to_timestamp(F.col("created_at"))
    return tracks.where(created >= as_of - F.make_dt_interval(F.lit(days)))


def uploads(profiles: DataFrame, tracks: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Recent tracks of profiles (artist_url), each once."""
    return newer_than(tracks.join(profiles.select("artist_url").distinct(), "artist_url", "left_semi"), as_of, days)


def playlist(entries: DataFrame, tracks: DataFrame) -> DataFrame:
    """Tracks of a list (pos, id) in its order; ids that nothing is known of are left out."""
    return entries.select("pos", "id").join(tracks, "id").orderBy("pos")


def activity(reposts: DataFrame, likes: DataFrame, since: Column, limit: int = 50) -> DataFrame:
    """account, id, at, feed: each account's newest ``limit`` reposts and likes since a time, marked as a hit
    of a reference account."""
    both = reposts.select("account", "id", "at", F.lit("repost").alias("feed")).union(likes.select("account", "id", "at", F.lit("like").alias("feed")))
    k = F.row_number().over(Window.partitionBy("account", "feed").orderBy(F.desc("at"), "id"))
    return both.where(F.col("at") >= since).withColumn("k", k).where(F.col("k") <= limit).drop("k").withColumn("reference_hit", F.lit(True))


def station(seed: DataFrame, station_items: DataFrame, related: DataFrame) -> DataFrame:
    """pos, id: the seed, then its station, or where that is empty related tracks, without the seed again."""
    chosen = station_items.select("pos", "id", F.lit(0).alias("way")).union(related.select("pos", "id", F.lit(1).alias("way")))
    best = chosen.agg(F.min("way").alias("best"))
    rest = chosen.join(F.broadcast(best), F.col("way") == F.col("best")).join(seed.select("id"), "id", "left_anti")
    return seed.select(F.lit(0).alias("pos"), "id").union(rest.select((F.col("pos") + 1).alias("pos"), "id"))


def fans(edges: DataFrame, most: int = 200) -> DataFrame:
    """track_id, user_id, kind: at most the first ``most`` users (by pos) of each track and kind."""
    k = F.row_number().over(Window.partitionBy("track_id", "kind").orderBy("pos", "user_id"))
    return edges.withColumn("k", k).where(F.col("k") <= most).drop("k")


def exploration_tag(tags: list[str], used: list[str], chance: float, seed: int) -> str | None:
    """With a chance one tag that is not used yet, the same for the same seed."""
    import random

    rng, left = random.Random(seed), sorted(set(tags) - set(used))
    return rng.choice(left) if left and rng.random() < chance else None


def _hash_id(url: Column) -> Column:
    return F.conv(F.substring(F.sha1(url.cast("binary")), 1, 15), 16, 10).cast("long")


def feed_items(feeds: DataFrame) -> DataFrame:
    """Tracks of feeds (url, xml): items with a link, whose hash is their id."""
    text = "array<struct<title: string, link: string, creator: string, genre: string, pubDate: string, description: string, subject: array<string>>>"
    plain = F.regexp_replace(F.regexp_replace("xml", r"<(/?)dc:", "<$1"), r"(?s)^\s*<\?xml.*?\?>", "")
    parsed = F.from_xml(plain, f"channel struct<item: {text}>", {"mode": "PERMISSIVE"})
    each = feeds.select("url", F.explode("channel.item").alias("i")) if "channel" in feeds.columns else feeds.select(F.col("url").alias("feed"), F.explode(parsed["channel"]["item"]).alias("i"))
    link, none = F.trim("i.link"), F.lit("")
    rows = each.where(F.coalesce(link, none) != "")
    tags = F.filter(F.transform(F.coalesce("i.subject", F.array().cast("array<string>")), F.trim), lambda t: t != "")
    return rows.select(_hash_id(link).alias("id"), F.coalesce(F.trim("i.title"), none).alias("title"), link.alias("url"), F.coalesce(F.trim("i.creator"), none).alias("artist"), F.coalesce(F.trim("i.genre"), none).alias("genre"), tags.alias("tags"), F.coalesce(F.trim("i.description"), none).alias("description"), F.coalesce(F.trim("i.pubDate"), none).alias("published"))


class _Chart(HTMLParser):
    """Links, titles and artists of blocks ``<div class="... track ...">``."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.depth, self.field, self.field_depth = [], [], None, 0

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        classes = (own.get("class") or "").split()
        if tag == "div" and "track" in classes:
            self.rows.append({"link": None, "title": "", "artist": ""})
            self.depth.append(0)
        elif self.depth and tag == "div":
            self.depth[-1] += 1
        if self.depth:
            row = self.rows[-1]
            if tag == "a" and row["link"] is None and own.get("href"):
                row["link"] = own["href"].strip()
            for name, mark in (("title", "buk-track-title"), ("artist", "buk-track-artists")):
                if mark in classes and not row[name]:
                    self.field, self.field_tag = name, tag

    def handle_endtag(self, tag):
        if self.field and tag == self.field_tag:
            self.field = None
        if self.depth and tag == "div":
            if self.depth[-1] == 0:
                self.depth.pop()
            else:
                self.depth[-1] -= 1

    def handle_data(self, data):
        if self.field and self.depth:
            self.rows[-1][self.field] += data.strip()


def chart_tracks(pages: DataFrame, host: str = "beatport.com") -> DataFrame:
    """id, url, title, artist of the tracks on chart pages (url, html) whose links lead to ``host``."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for url, html in zip(batch["url"], batch["html"], strict=True):
                chart = _Chart()
                chart.feed(html or "")
                for row in chart.rows:
                    link = urljoin(url or "", row["link"]) if row["link"] else ""
                    own = (urlparse(link).hostname or "").lower()
                    if own == host or own.endswith("." + host):
                        out.append((url, link, row["title"], row["artist"]))
            yield pd.DataFrame(out, columns=["chart", "url", "title", "artist"], dtype=object)

    found = pages.select("url", "html").mapInPandas(work, "chart string, url string, title string, artist string")
    return found.select("chart", _hash_id(F.col("url")).alias("id"), "url", "title", "artist")


def read_library_xml(spark: SparkSession, path: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """id, path, artist, title, bpm, key, rating (0..5 stars), plays and cues of the tracks of a library file;
    ``mapping`` turns its paths into those here."""
    from crateflow.functions import music
    from crateflow.operators import library

    schema = "_TrackID long, _Name string, _Artist string, _AverageBpm string, _Tonality string, _Rating string, _PlayCount string, _Location string, POSITION_MARK array<struct<_Name: string, _Start: double, _Num: int>>"
    raw = spark.read.format("xml").option("rowTag", "TRACK").schema(schema).load(path).where("_Location is not null")
    location = F.url_decode(F.replace(F.regexp_replace("_Location", "^file://localhost(?=/)", ""), F.lit("+"), F.lit("%2B")))
    rows = raw.withColumn("path", F.regexp_replace(location, "^/([A-Za-z]:)", "$1"))
    mapped = F.coalesce(library.map_paths(rows, mapping), F.col("path")) if mapping else F.col("path")
    bpm = F.col("_AverageBpm").try_cast("double")
    return rows.select(
        F.col("_TrackID").alias("id"), mapped.alias("path"), F.col("_Artist").alias("artist"), F.col("_Name").alias("title"), F.when(bpm > 0, bpm).alias("bpm"), music.normal_key(F.col("_Tonality")).alias("key_camelot"),
        music.rating_stars(F.col("_Rating").try_cast("int")).alias("rb_rating"), F.col("_PlayCount").try_cast("int").alias("rb_play_count"),
        F.transform(F.coalesce("POSITION_MARK", F.array().cast("array<struct<_Name: string, _Start: double, _Num: int>>")), lambda m: F.struct(m["_Name"].alias("name"), m["_Start"].alias("time"), m["_Num"].alias("pad"))).alias("cues"),
    )
