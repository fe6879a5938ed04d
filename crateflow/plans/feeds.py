"""Queries over items of sources, file listings, messages and measures of tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from crateflow.functions import music, segments, style, text, urls
from crateflow.operators import jobs, library, lookups, merges, ranking, reports, trends
from crateflow.sinks import files
from crateflow.sources import items, tables

from .operations import KEYS, query, r6
from .workflows import ntz


# --- items of sources --------------------------------------------------------------------------
@query("SELECT id, list_value('a' || id, 'b c', 'd') AS tags, 'T' || id AS title, CASE WHEN id % 3 = 0 THEN 5 ELSE likes END AS likes, plays FROM items WHERE id % 4 <> 0")
def items_of_json(table):
    i = table("items")
    item = F.to_json(F.struct(
        F.when(F.col("id") % 4 == 0, "playlist").otherwise("track").alias("kind"), "id", F.concat(F.lit("T"), F.col("id").cast("string")).alias("title"), F.concat(F.lit("a"), F.col("id").cast("string"), F.lit(' "b c" d')).alias("tag_list"),
        F.when(F.col("id") % 3 != 0, F.col("likes")).alias("likes_count"), F.when(F.col("id") % 3 == 0, 5).alias("favoritings_count"), F.col("plays").alias("playback_count")))
    return items.tracks_of(i.select(item.alias("item"))).select("id", "tags", "title", "likes", "plays")


@query("SELECT id FROM items WHERE created_at >= (SELECT max(created_at) FROM items) - INTERVAL 1 DAY")
def recent_items(table):
    i = table("items")
    newest = i.agg(F.max("created_at").alias("newest_"))
    told = i.select("id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"))
    return items.newer_than(told.join(F.broadcast(newest)), F.col("newest_").cast("timestamp"), 1).select("id")


@query("""
WITH b AS (SELECT user_id AS account, event_id AS id, ts AS at, CASE WHEN event_type = 'view' THEN 'repost' ELSE 'like' END AS feed FROM events WHERE event_type IN ('view', 'click') AND ts >= TIMESTAMP '2024-01-05')
SELECT account, id, feed FROM b QUALIFY row_number() OVER (PARTITION BY account, feed ORDER BY b.at DESC, id) <= 3""")
def account_activity(table):
    s = table("snapshots").select(F.col("sc_id").alias("account"), "id", F.col("recorded_at").alias("at"), "tag")
    return items.activity(s.where("tag = 'view'").drop("tag"), s.where("tag = 'click'").drop("tag"), ntz("2024-01-05 00:00:00"), 3).select("account", "id", "feed")


@query("""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY user_id) AS k FROM edges) SELECT track_id, user_id FROM k WHERE k <= 4""")
def first_fans(table):
    e = table("edges").select("track_id", "user_id", F.lit("like").alias("kind"), F.lit(0).alias("pos"))
    return items.fans(e, 4).select("track_id", "user_id")


@query("SELECT 0 AS pos, 1 AS id UNION ALL SELECT id, id FROM tracks WHERE id % 5 = 0 AND id <> 1")
def station_items(table):
    t = table("tracks")
    seed = t.where("id = 1").select("id")
    related = t.where("id % 5 = 0").select((F.col("id") - 1).cast("int").alias("pos"), "id")
    return items.station(seed, related.where("false"), related.union(seed.select(F.lit(7), "id")))


@query("SELECT t.id, title FROM tracks t WHERE t.id % 3 = 0")
def playlist_tracks(table):
    t = table("tracks")
    entries = t.where("id % 3 = 0").select((-F.col("id")).alias("pos"), "id").union(t.agg(F.lit(5), F.max("id") + 10))
    return items.playlist(entries, t.select("id", "title")).select("id", "title")


@query("SELECT id FROM items WHERE artist = 'artist 3' AND created_at >= TIMESTAMP '2020-01-01'")
def profile_uploads(table):
    i = table("items").withColumns({"artist_url": F.col("artist"), "created_at": F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")})
    profiles = i.where("artist = 'artist 3'").select("artist_url")
    return items.uploads(profiles, i, F.expr("TIMESTAMP '2020-01-01 00:00:00Z'"), 0).select("id")


@query("SELECT 'items' AS source, count(*) AS n, count(plays) AS plays FROM items UNION ALL SELECT 'tracks', count(*), 0 FROM tracks")
def united_sources(table):
    both = tables.union_sources(("items", table("items").select("id", "plays")), ("tracks", table("tracks").select("id")))
    return both.groupBy("source").agg(F.count("*").alias("n"), F.count("plays").alias("plays"))


@query("SELECT DISTINCT id FROM (SELECT sc_id AS id FROM tracks UNION ALL SELECT sc_id FROM votes) x WHERE id IS NOT NULL")
def known_ids(table):
    return tables.ids_of((table("tracks"), "sc_id"), (table("votes"), "sc_id"))


@query("SELECT id, size FROM tracks WHERE id % 7 >= 2")
def ready_files(table):
    f = table("tracks").select("id", "size", (ntz("2024-01-01 00:10:00") - F.make_dt_interval(secs=(F.col("id") % 7 * 30).cast("decimal(18,6)"))).alias("modified"))
    return tables.ready_files(f, ntz("2024-01-01 00:10:00")).select("id", "size")


# --- messages and exports ------------------------------------------------------------------------
@query("SELECT artist AS folder, artist || ' (' || count(*) || ')' || chr(10) || string_agg(artist || ' - ' || title, chr(10) ORDER BY artist || ' - ' || title) AS body FROM tracks GROUP BY artist")
def folder_lists(table):
    return files.text_export(table("tracks"), F.col("artist"))


@query("""
WITH n AS (SELECT artist AS g, id, row_number() OVER (PARTITION BY artist ORDER BY id) AS k FROM tracks)
SELECT g, CAST((k - 1) // 10 + 1 AS INT) AS page, string_agg('line ' || id, chr(10) ORDER BY k) AS message FROM n GROUP BY 1, 2""")
def message_pages(table):
    return files.pack(table("tracks").withColumn("g", F.col("artist")), "g", ["id"], F.concat(F.lit("line "), F.col("id").cast("string"))).select("g", "page", "message")


@query("""
WITH t AS (SELECT id, row_number() OVER (ORDER BY id) AS k, artist, title, path, duration FROM tracks WHERE artist = 'Brand#11')
SELECT '#EXTM3U' AS line UNION ALL SELECT '#EXTINF:' || CAST(round(duration) AS BIGINT) || ',' || artist || ' - ' || title FROM t UNION ALL SELECT path FROM t""")
def playlist_lines(table):
    return files.m3u8_lines(table("tracks").where("artist = 'Brand#11'"), ["id"]).select("line")


@query("""
WITH t AS (SELECT id, genre, CASE WHEN bpm IS NULL THEN 'unknown' ELSE CAST(CAST(floor(bpm / 5) * 5 AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(floor(bpm / 5) * 5 AS BIGINT) + 5 AS VARCHAR) END AS b, coalesce(key_camelot, 'unknown') AS k FROM tracks)
SELECT kind, name, count(*) AS n FROM (SELECT 'bpm' AS kind, b AS name FROM t UNION ALL SELECT 'key', k FROM t UNION ALL SELECT 'style', genre FROM t UNION ALL SELECT 'week', '2024-01' FROM t) x GROUP BY 1, 2""")
def playlist_sizes(table):
    t = table("tracks").withColumn("created_at", ntz("2024-01-03 00:00:00"))
    return files.playlists(t).groupBy("kind", "name").agg(F.count("*").alias("n"))


@query("SELECT section, count(*) AS n FROM (SELECT unnest([0, 0, 1, 3, 3, 12]) AS section UNION ALL SELECT 2 FROM tracks WHERE coalesce(status, '') <> 'rejected' AND coalesce(quality_status, '') NOT IN ('fake_transcode', 'clipped', 'corrupt')) x GROUP BY 1")
def library_file_lines(table):
    t = table("tracks").withColumns({"created_at": ntz("2024-01-03 00:00:00"), "cues": F.lit(None).cast("array<struct<name: string, time: double, pad: int>>"), "path": F.concat(F.lit("/music/"), F.col("id").cast("string"), F.lit(".mp3"))})
    return files.library_lines(t, {"/music": "C:/m"}).where("section in (0, 1, 2, 3, 12)").groupBy("section").agg(F.count("*").alias("n"))


# --- measures and plans ---------------------------------------------------------------------------
@query("""
SELECT id, CASE WHEN id % 3 = 0 THEN 'Hardgroove' WHEN id % 3 = 1 THEN 'Acid' ELSE 'Classic' END AS label FROM tracks""")
def keyword_styles(table):
    k = F.col("id") % 3
    title = F.when(k == 0, "big Hard-Groove tool").when(k == 1, "no word").otherwise("nothing here")
    tags = F.when(k == 1, F.array(F.lit("x"), F.lit(" ACID "), F.lit("hardgroove")))
    none = F.lit(None).cast("double")
    c = style.classify(title, tags, none, none, none, none, none)
    label = F.when(c["subgenre"] == "hardgroove", "Hardgroove").when(c["subgenre"] == "acid", "Acid").otherwise("Classic")
    return table("tracks").select("id", label.alias("label"))


@query("""
SELECT id, '[' || concat_ws('|', CASE WHEN bpm IS NOT NULL THEN CAST(CAST(bpm AS INT) AS VARCHAR) END, key_camelot, 'Classic', 'D1:1:' || lpad(CAST(id % 60 AS VARCHAR), 2, '0'), printf('L%.1f', lufs)) || ']' AS note FROM tracks""")
def compact_comments(table):
    none = F.lit(None).cast("double")
    c = style.classify(F.lit("plain"), F.lit(None).cast("array<string>"), none, none, none, none, none)
    return table("tracks").select("id", style.compact_comment(c, F.col("bpm"), F.col("key_camelot"), 60.0 + F.col("id") % 60, none, F.col("lufs")).alias("note"))


@query("SELECT id, printf('%.2f dB', -18.0 - lufs) AS gain, printf('%.1f', lufs) AS lufs, 1 + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END + 1 AS n FROM tracks")
def loudness_tag_values(table):
    m = music.loudness_tags(F.col("lufs"), F.when(F.col("id") % 2 == 0, -0.5), F.lit(None).cast("double"))
    return table("tracks").select("id", m.alias("m")).select("id", F.col("m")["REPLAYGAIN_TRACK_GAIN"].alias("gain"), F.col("m")["LUFS"].alias("lufs"), F.size("m").alias("n"))


@query("""
WITH t AS (SELECT id, bpm::DOUBLE AS b, 60.0::DOUBLE / bpm AS beat FROM tracks WHERE bpm IS NOT NULL)
SELECT id, 7 AS n, round(greatest(CASE WHEN 120 - 128 * beat < 1 THEN 1.0 ELSE 120 - 128 * beat END, 0), 6) AS entry, round(120 - 64 * beat, 6) AS late, round(120 - beat, 6) AS fill, round(400 - 64 * beat, 6) AS outro FROM t""")
def pad_layout(table):
    t = table("tracks").where("bpm is not null")
    none = F.lit(None).cast("double")
    pads = segments.hot_cues(F.col("bpm"), F.lit(400.0), F.lit(1.0), F.lit(120.0), F.lit(250.0), F.lit(90.0), none, none, none)
    at = lambda k: r6(F.element_at(F.filter("p", lambda x: x["pad"] == k), 1)["time"])
    return t.select("id", pads.alias("p")).select("id", F.size("p").alias("n"), at(0).alias("entry"), at(1).alias("late"), at(6).alias("fill"), at(7).alias("outro"))


@query("SELECT id, '_rejected/duplicate' AS target FROM tracks WHERE id % 4 = 1")
def cleanup_targets(table):
    k = F.col("id")
    f = table("tracks").select("id", F.concat(F.lit("/m/["), F.floor(k / 2).cast("string"), F.lit("] x"), F.when(k % 2 == 1, "_2").otherwise(""), F.lit(".mp3")).alias("path"), F.lit("8A").alias("key_camelot"), F.lit(None).cast("double").alias("bpm"))
    pairs = f.where("id % 4 IN (0, 1)")
    return reports.cleanup_plan(pairs)


@query(KEYS + """, f AS (SELECT id, min(other) AS first FROM m WHERE duration_ms = 0 OR seconds IS NULL OR abs(seconds - duration_ms / 1000.0) <= 5 GROUP BY id)
SELECT n.id, f.first AS duplicate_of, f.first IS NOT NULL AS is_duplicate, CASE WHEN duration_ms > 204000 THEN CAST(round(duration_ms / 60000.0) AS INT) END AS set_minutes FROM n LEFT JOIN f ON f.id = n.id WHERE side = 'asked'""")
def processed_items(table):
    n = table("names")
    found = n.where("side = 'asked'").select("id", "artist", "title", "duration_ms", F.lit("https://x").alias("url"), F.lit(False).alias("downloadable"), F.lit(True).alias("has_downloads_left"), F.lit(None).cast("string").alias("purchase_url"), F.lit("").alias("description"))
    none = n.select("id", F.lit("x").alias("override_type")).where("false")
    return reports.process(found, n.where("side = 'held'"), none, most_minutes=3.4).select("id", "duplicate_of", "is_duplicate", "set_minutes")


@query("SELECT o.id, CASE id % 6 WHEN 0 THEN 'hypeddit' ELSE 'toneden' END AS kind FROM offers o WHERE NOT (id % 11 = 0 AND id % 22 <> 0) AND id % 5 <> 0 AND id % 4 <> 3 AND (id % 6 = 0 OR id % 7 = 5)")
def gates_to_fill(table):
    o = table("offers").withColumn("has_downloads_left", F.col("id") % 22 != 0).withColumn("description", F.when(F.col("id") % 7 == 5, "https://sub.toneden.io/x").otherwise(""))
    gates, stores = o.where("id % 5 = 0").select(F.col("id").alias("sc_id")), o.where("id % 4 = 3").select(F.col("id").alias("sc_id"))
    return lookups.gates_to_fill(o.select("id"), gates, stores, o.withColumn("downloadable", (F.col("id") % 11 == 0))).select("id", "kind")


@query("SELECT id, job_type FROM jobs WHERE status = 'pending' AND job_type = 'cues' ORDER BY id LIMIT 25")
def next_jobs(table):
    return jobs.next_pending(table("jobs"), 25, "cues").select("id", "job_type")


@query("SELECT id, CASE WHEN id % 8 = 1 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN id % 8 = 1 THEN 'odd ' || id END AS error, CASE WHEN id % 8 <> 1 THEN CAST(2 * id AS VARCHAR) END AS result FROM jobs WHERE status = 'pending' AND job_type = 'cues'")
def job_outcomes(table):
    def cues(payload):
        if payload["job_id"] % 8 == 1:
            raise ValueError(f"odd {payload['job_id']}")
        return 2 * payload["job_id"]

    pending = table("jobs").where("status = 'pending' and job_type = 'cues'").withColumn("payload", F.lit("{}"))
    # A count of its own: small rows may be long jobs, and are not to be drawn together.
    tasks = 2 * pending.sparkSession.sparkContext.defaultParallelism
    return jobs.run(pending.repartition(tasks, "id"), {"cues": cues}).select("id", "status", "error", "result")


@query("""
WITH s AS (SELECT user_id, event_id, ts FROM events), d AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS k FROM s)
SELECT user_id AS sc_id, event_id AS id FROM d WHERE k = 1 AND event_id % 1 = 0""")
def first_snapshots(table):
    s = table("snapshots").select("sc_id", "id", F.struct("recorded_at", "id").alias("o"), "recorded_at")
    first = s.groupBy("sc_id", F.to_date("recorded_at").alias("day")).agg(F.min("o").alias("o")).select("sc_id", F.col("o.id").alias("id"), F.col("o.recorded_at").alias("recorded_at"))
    return merges.daily_snapshots(first.where("false"), first).select("sc_id", "id")


@query("SELECT id FROM tracks WHERE bpm IS NOT NULL AND key_camelot IS NOT NULL AND (bpm_confidence IS NULL OR bpm_confidence >= 0.5)")
def sure_set_candidates(table):
    return library.set_candidates(table("tracks"), avoid_uncertain=True).select("id")


@query("SELECT page_id AS id, lower(regexp_extract(url, '^https?://[^/?#]+/([^/?#]*)', 1)) AS slug FROM pages")
def permalink_slugs(table):
    return table("offers").select("id", urls.permalink_slug(F.col("url")).alias("slug"))


@query("SELECT id, 'Some Name' AS artist, title FROM tracks")
def file_name_parts(table):
    path = F.concat(F.lit("/x/["), F.col("id").cast("string"), F.lit("] Some Name - "), "title", F.lit(".mp3"))
    return table("tracks").select("id", text.from_file_name(path).alias("a")).select("id", "a.artist", "a.title")


@query("""
WITH e AS (SELECT user_id, floor(epoch(ts) / 3600)::BIGINT AS t FROM events WHERE event_type = 'click'), g AS (SELECT DISTINCT user_id, t FROM e),
r AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 6 THEN 0 ELSE 1 END AS fresh FROM g), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t) AS run FROM r),
k AS (SELECT user_id, run FROM s GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT user_id AS track_id, count(*) AS mains FROM k GROUP BY 1""")
def kick_parts(table):
    e = table("snapshots").where("tag = 'click'").select(F.col("sc_id").alias("track_id"), F.floor(F.unix_seconds(F.col("recorded_at").cast("timestamp")) / 3600).cast("double").alias("t")).distinct()
    ends = e.select("track_id", F.lit(1e9).alias("duration")).distinct()
    s = trends.kick_segments(e, ends, gap=6.0, least=2)
    return s.select("track_id", F.size(F.filter("segments", lambda x: x["label"] == "main")).cast("long").alias("mains")).where("mains > 0")


@query("SELECT id, sum(size) OVER (ORDER BY id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newer FROM tracks")
def newer_sizes(table):
    t = table("tracks").select("id", "size")
    return ranking.running_sum(t, "size", "id", "n", descending=True).select("id", F.when(F.col("n") > 0, F.col("n")).alias("newer"))
