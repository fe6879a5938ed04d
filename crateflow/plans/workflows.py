"""Queries over lookups, merges, queues, the digest and whole runs. Each calls its operator; its SQL is
written apart from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from crateflow.functions import music, scoring, segments, style, text, urls
from crateflow.operators import components, digest, fuzzy, library, lookups, merges, models, overview, ranking, reports, sets, taste
from crateflow.sinks import tables
from crateflow.streaming import states

from .operations import KEYS, query, r6


def ntz(t: str):
    return F.expr(f"TIMESTAMP_NTZ '{t}'")


# --- predicates and lookups ------------------------------------------------------------------
@query("SELECT id, genre FROM tracks WHERE contains(lower(title), 'steel') OR contains(lower(genre), 'steel') OR contains(lower(title), 'tin') OR contains(lower(genre), 'tin') OR energy = 5")
def genre_relevant(table):
    tags = F.when(F.col("energy") == 5, F.array(F.lit("x"), F.lit("TIN drum"))).otherwise(F.array().cast("array<string>"))
    return table("tracks").where(lookups.genre_relevant(F.col("title"), F.col("genre"), tags, ["Steel", "tin"])).select("id", "genre")


@query("SELECT id FROM tracks WHERE regexp_matches(title, '^s.*l$', 'i') OR regexp_matches(title, '[0-9]{2}', 'i')")
def title_patterns(table):
    return table("tracks").where(lookups.title_matches(F.col("title"), ["^S.*L$", "[0-9]{2}", "(broken"])).select("id")


@query("SELECT id, CASE WHEN id % 4 = 0 THEN 'new' WHEN id % 9 = 0 THEN 'size' ELSE 'time' END AS why FROM tracks WHERE id % 4 = 0 OR id % 9 = 0 OR id % 14 = 0")
def needs_audit(table):
    files = table("tracks").select("id", F.concat("path", F.col("id").cast("string")).alias("path"), "size", (F.col("id") * 10.0).alias("modified"))
    known = files.where("id % 4 <> 0").select("path", F.when(F.col("id") % 9 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(F.col("id") % 14 == 0, F.col("modified") + 0.02).otherwise(F.col("modified") + 0.005).alias("modified"))
    return lookups.changed_files(files, known).select("id", F.when(F.col("id") % 4 == 0, "new").when(F.col("id") % 9 == 0, "size").otherwise("time").alias("why"))


@query("""
SELECT id, CASE WHEN quality_status = 'corrupt' THEN 'drop' WHEN quality_status = 'fake_transcode' THEN 'rejected' WHEN quality_status IS NULL THEN 'unmeasurable' WHEN quality_status = 'clipped' THEN 'clipped'
  WHEN feedback = 'dislike' THEN 'duplicate' ELSE 'keep' END AS route FROM tracks""")
def quality_routing(table):
    q = F.coalesce("quality_status", F.lit("none"))
    verdict = F.struct(q.isin("ok", "clipped").alias("ok"), F.when(q == "none", "not measurable").otherwise("x").alias("reason"), (q == "clipped").alias("clipped"))
    return table("tracks").select("id", lookups.route(verdict, F.when(q == "corrupt", "e"), F.coalesce(F.col("feedback") == "dislike", F.lit(False))).alias("route"))


@query("""
WITH f AS (SELECT id, CASE id % 5 WHEN 0 THEN 'wav' WHEN 1 THEN 'mp3' WHEN 2 THEN 'flac' WHEN 3 THEN 'm4a' ELSE 'wav' END AS e, CASE id % 5 WHEN 0 THEN 'pcm_s16le' WHEN 2 THEN 'flac' WHEN 3 THEN 'aac' ELSE 'mp3' END AS c,
  CASE WHEN id % 3 = 0 THEN 320 ELSE 192 END AS b, id % 7 = 0 AS v, CASE WHEN id % 11 = 0 THEN NULL ELSE 18000.0 + id % 50 * 50 END AS x, CASE WHEN id % 13 = 0 THEN 2.0 END AS r, id % 8.0 / 2 AS p FROM tracks),
g AS (SELECT *, e IN ('wav', 'flac') AND c <> 'mp3' AS lossless FROM f),
h AS (SELECT *, CASE WHEN e IN ('wav', 'flac') AND c = 'mp3' THEN 'lossy stream in a lossless container' WHEN c = 'mp3' AND NOT v AND b < 320 THEN 'bitrate too low' WHEN NOT lossless AND c <> 'mp3' THEN 'codec not accepted'
  WHEN x IS NULL THEN 'not measurable' WHEN x < CASE WHEN lossless THEN 20000 ELSE 19500 END THEN 'spectrum ends too early' ELSE 'ok' END AS reason FROM g)
SELECT id, reason, reason = 'ok' AS ok, reason = 'ok' AND (coalesce(r < 2.5, FALSE) OR p >= 3.0) AS clipped FROM h""")
def admission_verdicts(table):
    k = F.col("id")
    ending = F.when(k % 5 == 1, "mp3").when(k % 5 == 2, "flac").when(k % 5 == 3, "m4a").otherwise("wav")
    codec = F.when(k % 5 == 0, "pcm_s16le").when(k % 5 == 2, "flac").when(k % 5 == 3, "aac").otherwise("mp3")
    v = lookups.admission(ending, codec, F.when(k % 3 == 0, 320).otherwise(192), k % 7 == 0, F.when(k % 11 != 0, 18000.0 + k % 50 * 50), F.when(k % 13 == 0, 2.0), k % 8 / 2)
    return table("tracks").select("id", v.alias("v")).select("id", "v.reason", "v.ok", "v.clipped")


@query("SELECT min(id) AS id FROM tracks WHERE id % 50 = 7 HAVING count(*) > 0")
def track_by_url(table):
    t = table("tracks").withColumn("source_url", F.concat(F.lit("http://WWW.sc.com/a/"), (F.col("id") % 50).cast("string"), F.lit("/?utm=1")))
    return lookups.by_url(t, "https://m.sc.com/A/7").select("id")


@query("SELECT id, energy FROM tracks WHERE adopted IS NOT NULL ORDER BY energy DESC NULLS LAST, id")
def adopted_tracks(table):
    return lookups.adopted(table("tracks").withColumn("adopted_at", F.when(F.col("adopted").isNotNull(), F.coalesce("energy", F.lit(0))))).select("id", "energy")


@query("SELECT sc_id AS track_id, list_sort(list_distinct(list(tag))) AS tags FROM snapshots GROUP BY sc_id")
def tags_of_tracks(table):
    return lookups.tags_of(table("snapshots").select(F.col("sc_id").alias("track_id"), "tag"))


@query("SELECT DISTINCT sc_id AS track_id FROM snapshots WHERE tag = 'purchase'")
def tracks_of_tag(table):
    return lookups.ids_by_tag(table("snapshots").select(F.col("sc_id").alias("track_id"), "tag"), "purchase")


@query("SELECT sc_id, last_seen FROM store_items WHERE profile_id = 'p1'")
def profile_gates(table):
    return lookups.gate_items(table("store_items"), "p1").select("sc_id", "last_seen")


@query("SELECT count(*) AS n FROM jobs WHERE status = 'pending' AND job_type = 'cues'")
def pending_of_type(table):
    return lookups.pending_jobs(table("jobs"), "cues")


@query("SELECT DISTINCT tag, tag IN (SELECT tag FROM snapshots WHERE likes > 95) AS success FROM snapshots")
def exploration_outcomes(table):
    s = table("snapshots")
    return lookups.exploration_outcomes(s.select("tag"), s.where("likes > 95").select(F.col("tag").alias("source_tag")))


@query("SELECT id, CASE WHEN id % 9 = 0 THEN 'not audio' WHEN quality_status = 'corrupt' THEN 'error' WHEN feedback = 'dislike' THEN 'duplicate' ELSE 'ok' END AS outcome FROM tracks")
def intake_outcomes(table):
    return table("tracks").select("id", lookups.intake_outcome(F.col("id") % 9 != 0, F.when(F.col("quality_status") == "corrupt", "x"), F.when(F.col("feedback") == "dislike", F.col("id"))).alias("outcome"))


@query("""
SELECT action, count(*) AS n FROM (SELECT CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'delete' WHEN o.v = n.v THEN 'unchanged' ELSE 'replace' END AS action
  FROM (SELECT id, genre AS v FROM tracks WHERE id % 3 <> 0) n FULL OUTER JOIN (SELECT id, CASE WHEN id % 7 = 0 THEN 'old' ELSE genre END AS v FROM tracks WHERE id % 4 <> 0) o ON o.id = n.id) x GROUP BY action""")
def assignment_diff(table):
    t = table("tracks").select(F.col("id").alias("item"), F.lit("genre").alias("category"), F.col("genre").alias("tag"))
    there = t.where("item % 4 <> 0").withColumn("tag", F.when(F.col("item") % 7 == 0, "old").otherwise(F.col("tag")))
    return lookups.assignment_diff(t.where("item % 3 <> 0"), there).groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT id, artist, bpm FROM tracks ORDER BY lower(artist) ASC NULLS LAST, id LIMIT 100 OFFSET 50")
def sorted_page(table):
    return digest.page(library.ordered(table("tracks"), "artist"), 100, 50).select("id", "artist", "bpm")


@query("""
SELECT t.id, v.value AS vote FROM (SELECT id, artist, CASE WHEN id % 3 = 0 THEN id ELSE sc_id END AS k FROM tracks WHERE status = 'inbox' AND bpm >= 130 ORDER BY lower(artist) DESC, id LIMIT 30 OFFSET 10) t LEFT JOIN votes v ON v.sc_id = t.k""")
def explorer_page(table):
    page, _ = library.explore(table("tracks"), table("votes"), table("snapshots"), "artist", True, 30, 10, status="inbox", bpm_min=130)
    return page.select("id", "vote")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'D:/own/' || substr(path, 8) ELSE 'C:/m/' || substr(path, 8) END AS mapped FROM tracks")
def mapped_paths(table):
    t = table("tracks").select("id", F.when(F.col("id") % 3 == 0, F.replace("path", F.lit("/music/"), F.lit("/music/own/"))).otherwise(F.replace("path", F.lit("/"), F.lit("\\"))).alias("path"))
    return t.select("id", library.map_paths(t, {"/music": "C:/m", "/music/own/": "D:\\own", "/mus": "X:"}).alias("mapped"))


# --- functions of names, addresses and measures --------------------------------------------------
@query("SELECT id, CASE WHEN id % 2 = 0 THEN artist END AS artist, title FROM tracks")
def artist_title(table):
    raw = F.when(F.col("id") % 2 == 0, F.concat(F.lit(" [Free DL] (FREE DOWNLOAD) "), "artist", F.lit(" - "), "title", F.lit(" "))).otherwise(F.concat(F.lit(" "), "title"))
    return table("tracks").select("id", text.artist_title(raw).alias("a")).select("id", "a.artist", "a.title")


@query("SELECT id, trim(regexp_replace(lower(title), ' +', ' ', 'g')) AS tag FROM tracks WHERE length(title) <= 40 AND id % 3 <> 0")
def plain_tags(table):
    raw = F.when(F.col("id") % 3 == 0, F.concat("title", F.lit("!"))).otherwise(F.concat(F.lit("  "), F.upper("title"), F.lit("\t")))
    return table("tracks").select("id", text.normalize_tag(raw).alias("tag")).where("tag is not null")


@query("SELECT id, '/music/a/' || id || '.mp3' AS path FROM tracks")
def plain_paths(table):
    return table("tracks").select("id", text.normalize_path(F.concat(F.lit("/x/..//music\\.\\b/../a/"), F.col("id").cast("string"), F.lit(".mp3"))).alias("path"))


@query("SELECT id, trim(regexp_replace(lower(artist || ' ' || title), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM tracks WHERE length(trim(regexp_replace(lower(artist || ' ' || title), '[^a-z0-9]+', '-', 'g'), '-')) <= 60")
def slugs(table):
    return table("tracks").select("id", text.artist_slug(F.concat_ws(" ", "artist", "title")).alias("slug")).where("slug <> ''")


@query("SELECT id, recorded_at AS at FROM snapshots")
def parsed_times(table):
    form = F.when(F.col("id") % 3 == 0, F.date_format("recorded_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(F.col("id") % 3 == 1, F.date_format("recorded_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise(F.date_format("recorded_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS+00:00"))
    return table("snapshots").select("id", text.parse_timestamp(form).cast("timestamp_ntz").alias("at"))


@query("SELECT id, 'user bot*** says &lt;b&gt; oauth_token=*** &amp; more' AS line FROM tracks")
def redacted_lines(table):
    raw = F.concat(F.lit("user bot1234567:"), F.lpad(F.col("id").cast("string"), 24, "A"), F.lit(" says <b> oauth_token=tok"), F.lpad(F.col("id").cast("string"), 9, "0"), F.lit(" & more"))
    return table("tracks").select("id", text.html_escape(text.redact(raw)).alias("line"))


@query("""
SELECT id, CASE id % 4 WHEN 0 THEN 'https://www.dropbox.com/s/' || id || '/a.mp3?dl=1' WHEN 1 THEN 'https://drive.usercontent.google.com/download?id=file' || lpad(CAST(id AS VARCHAR), 8, '0') || '&export=download&confirm=t' END AS direct FROM tracks""")
def direct_links(table):
    k = F.col("id").cast("string")
    link = F.when(F.col("id") % 4 == 0, F.concat(F.lit(" https://www.dropbox.com/s/"), k, F.lit("/a.mp3?dl=0"))).when(F.col("id") % 4 == 1, F.concat(F.lit("https://drive.google.com/file/d/file"), F.lpad(k, 8, "0"), F.lit("/view?usp=x"))).otherwise(F.concat(F.lit("https://example.org/"), k))
    return table("tracks").select("id", urls.direct_url(link).alias("direct"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'remix' WHEN id % 3 = 1 THEN 'original' ELSE 'remix' END AS version FROM tracks")
def version_kinds(table):
    title = F.when(F.col("id") % 3 == 0, F.concat("title", F.lit(" (Some Remix)"))).otherwise(F.col("title"))
    return table("tracks").select("id", style.version_tag(title, F.when(F.col("id") % 3 == 2, "a remix.mp3").otherwise("a.mp3")).alias("version"))


@query("""
SELECT id, CASE WHEN id % 5 = 0 THEN 'cutoff' WHEN id % 5 = 1 THEN 'quality check not passed' WHEN id % 5 = 2 THEN 'net ' || id WHEN id % 5 = 3 THEN 'Download failed 2' END AS reason FROM tracks""")
def rejection_reasons(table):
    k = F.col("id") % 5
    notes = F.when(k == 3, F.array(F.lit("Download failed 1"), F.lit("ok"), F.lit("Download failed 2"))).otherwise(F.array(F.lit("fine")))
    reason = scoring.rejection_reason(k > 1, F.when(k == 0, "cutoff").otherwise(""), F.when(k == 2, F.concat(F.lit("net "), F.col("id").cast("string"))), notes)
    return table("tracks").select("id", reason.alias("reason"))


@query("""
WITH t AS (SELECT id, bpm / 2 AS a, CASE WHEN id % 3 = 0 THEN bpm + 1 END AS x FROM tracks WHERE bpm IS NOT NULL AND bpm < 165)
SELECT id, CASE WHEN x IS NOT NULL THEN round(a * 2, 1) WHEN a * 2 BETWEEN 150 AND 165 THEN round(a * 2, 1) ELSE round(a * 2, 1) END AS bpm, CASE WHEN x IS NOT NULL THEN 'audio near text' WHEN a * 2 BETWEEN 150 AND 165 THEN 'audio in window' ELSE 'audio plausible' END AS source FROM t""")
def resolved_bpm(table):
    t = table("tracks").where("bpm < 165")
    return t.select("id", music.resolve_bpm(F.col("bpm") / 2, F.when(F.col("id") % 3 == 0, F.col("bpm") + 1), (150.0, 165.0)).alias("r")).select("id", "r.bpm", "r.source")


@query("SELECT id, CASE WHEN b >= 0 THEN round(b * 60.0::DOUBLE / bpm, 3) END AS start, CASE WHEN b >= 0 THEN round((b + 16) * 60.0::DOUBLE / bpm, 3) END AS stop FROM (SELECT id, bpm, 4 * floor((duration - 16 * (60.0::DOUBLE / bpm)) / (4 * (60.0::DOUBLE / bpm))) AS b FROM tracks) x WHERE bpm IS NOT NULL")
def outro_loops(table):
    return table("tracks").where("bpm is not null").select("id", music.active_loop(F.lit(0.0), F.col("bpm"), F.col("duration")).alias("l")).select("id", "l.start", "l.stop")


SEGMENTS = "WITH s AS (SELECT id, 10.0 + id % 7 AS a, 60.0 + id % 11 AS b, 90.0 + id % 5 AS c, 150.0 + id % 3 AS d, 200.0 AS e FROM tracks) "


def _segments(table):
    k = F.col("id")
    at = [F.lit(0.0), 10.0 + k % 7, 60.0 + k % 11, 90.0 + k % 5, 150.0 + k % 3, F.lit(200.0)]
    names = ["intro", "main", "breakdown", "drop", "outro"]
    return table("tracks").select("id", F.array(*[F.struct(a.cast("double").alias("start"), b.cast("double").alias("stop"), F.lit(n).alias("label")) for a, b, n in zip(at, at[1:], names)]).alias("s"))


@query(SEGMENTS + "SELECT id, c::DOUBLE AS drop_at, round((c - b) / (d - a), 4) AS ratio FROM s")
def drop_starts(table):
    return _segments(table).select("id", segments.drop_start(F.col("s")).alias("drop_at"), segments.breakdown_ratio(F.col("s")).alias("ratio"))


@query(SEGMENTS + "SELECT id, a::DOUBLE AS first_kick, c::DOUBLE AS \"drop\", b::DOUBLE AS breakdown, round((c - b) / 200, 3) AS ratio, 3 AS marks FROM s")
def cue_points(table):
    s = _segments(table)
    beats = F.array(5.0 + F.col("id") * 0, 10.0 + F.col("id") % 7)
    sounding = F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), F.when(x["label"] == "intro", "silence").otherwise(x["label"]).alias("label")))
    c = segments.cues(sounding, beats, F.lit(200.0))
    return s.select("id", c.alias("c")).select("id", "c.first_kick", "c.drop", "c.breakdown", F.col("c.breakdown_ratio").alias("ratio"), F.size("c.marks").alias("marks"))


# --- merges ------------------------------------------------------------------------------------------
@query("""
SELECT coalesce(n.path, o.path) AS path, coalesce(n.bpm, o.bpm) AS bpm, coalesce(o.title, n.title) AS title, o.feedback
FROM (SELECT * FROM tracks WHERE id % 3 <> 1) o FULL OUTER JOIN (SELECT path, CASE WHEN id % 2 = 0 THEN bpm + 1 END AS bpm, title || '!' AS title FROM tracks WHERE id % 4 <> 0) n ON n.path = o.path""")
def track_upsert(table):
    t = table("tracks").select("id", "path", "bpm", "title", "feedback")
    new = t.where("id % 4 <> 0").select("path", F.when(F.col("id") % 2 == 0, F.col("bpm") + 1).alias("bpm"), F.concat("title", F.lit("!")).alias("title"))
    return merges.upsert(t.where("id % 3 <> 1").drop("id"), new, ["path"], kept=("title",))


@query("SELECT sc_id, CASE WHEN sc_id % 5 = 0 THEN 'later' ELSE value END AS value, url FROM votes")
def vote_upsert(table):
    v = table("votes")
    changes = v.where("sc_id % 5 = 0").select("sc_id", F.explode(F.array(F.struct(F.lit("like").alias("value"), F.lit(1).alias("at")), F.struct(F.lit("later").alias("value"), F.lit(2).alias("at")), F.struct(F.lit(None).cast("string").alias("value"), F.lit(3).alias("at")))).alias("c"))
    return merges.upsert(v, changes.select("sc_id", "c.*", F.lit(None).cast("string").alias("url")), ["sc_id"], latest="at")


@query("""
WITH a AS (SELECT sc_id, first_seen, last_seen, id FROM store_items WHERE profile_id = 'p0'), b AS (SELECT sc_id, first_seen, last_seen, CASE WHEN sc_id % 3 <> 0 THEN id END AS id FROM store_items WHERE profile_id = 'p1')
SELECT coalesce(a.sc_id, b.sc_id) AS sc_id, least(a.first_seen, b.first_seen) AS first_seen, greatest(a.last_seen, b.last_seen) AS last_seen, coalesce(b.id, a.id) AS id FROM a FULL JOIN b ON a.sc_id = b.sc_id""")
def store_upsert(table):
    s = table("store_items").select("sc_id", "first_seen", "last_seen", "id", "profile_id")
    new = s.where("profile_id = 'p1'").withColumn("id", F.when(F.col("sc_id") % 3 != 0, F.col("id"))).drop("profile_id")
    return tables.sightings(["sc_id"], "first_seen", "last_seen")(s.where("profile_id = 'p0'").drop("profile_id"), new)


@query("""
WITH t AS (SELECT id, feedback, CASE WHEN id % 10 = 5 THEN id * 10 ELSE sc_id END AS sc_id, CASE WHEN id % 10 = 5 THEN 'u' || id END AS source_url FROM tracks), a AS (SELECT id, id + 5 AS archive_id FROM t WHERE id % 10 = 5)
SELECT t.id, CASE WHEN a.id IS NOT NULL AND coalesce(t.feedback, '') <> 'dislike' THEN 'like' ELSE t.feedback END AS feedback, CASE WHEN a.id IS NOT NULL THEN 7 END AS adopted_at, coalesce(t.sc_id, s.sc_id) AS sc_id, coalesce(t.source_url, s.source_url) AS source_url
FROM t LEFT JOIN a ON a.id = t.id LEFT JOIN a b ON b.archive_id = t.id LEFT JOIN t s ON s.id = b.id""")
def adoption_update(table):
    five = F.col("id") % 10 == 5
    t = table("tracks").select("id", "feedback", F.when(five, F.col("id") * 10).otherwise(F.col("sc_id")).alias("sc_id"), F.when(five, F.concat(F.lit("u"), F.col("id").cast("string"))).alias("source_url"), F.lit(None).cast("int").alias("adopted_at"))
    return merges.adopt(t, t.where(five).select("id", (F.col("id") + 5).alias("archive_id"), F.lit(7).alias("adopted_at"))).select("id", "feedback", "adopted_at", "sc_id", "source_url")


@query("SELECT sc_id, profile_id, CASE WHEN profile_id <> 'p0' OR sc_id % 2 = 1 THEN last_seen WHEN sc_id % 4 = 0 THEN first_seen END AS done_at FROM store_items")
def done_marks(table):
    s = table("store_items")
    marks = s.where("sc_id % 2 = 0 AND profile_id = 'p0'").select("sc_id", F.when(F.col("sc_id") % 4 == 0, F.col("first_seen")).alias("done_at"))
    return merges.mark_done(s.withColumn("done_at", F.col("last_seen")), marks, "p0").select("sc_id", "profile_id", "done_at")


@query("SELECT sc_id AS id, min_by(id, (recorded_at, id)) AS first, max_by(id, (recorded_at, id)) AS last FROM snapshots GROUP BY sc_id")
def seen_marks(table):
    s = table("snapshots").select(F.col("sc_id").alias("id"), F.struct("recorded_at", "id").alias("at"))
    none = s.limit(0)
    first, last = merges.seen_marks(none, s, True), merges.seen_marks(none, s, False)
    return first.select("id", F.col("at.id").alias("first")).join(last.select("id", F.col("at.id").alias("last")), "id")


@query("SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM seen GROUP BY 1")
def routed_outcomes(table):
    gone, kept = merges.route_outcomes(table("seen").drop("reason"), F.when(F.col("id") % 3 == 0, "cutoff too low"))
    return gone.groupBy("reason").agg(F.count("*").alias("n")).union(kept.agg(F.lit("kept").alias("reason"), F.count("*").alias("n")))


@query("SELECT id, coalesce(energy, CASE WHEN bpm >= 150 THEN 5 ELSE 2 END) AS energy FROM tracks")
def energy_backfill(table):
    return merges.backfill(table("tracks"), "energy", F.when(F.col("bpm") >= 150, 5).otherwise(2)).select("id", "energy")


@query("SELECT tag, count(*) + 10 AS uses, count(*) FILTER (WHERE likes > 50) + 1 AS successes, max(CASE WHEN likes > 50 THEN recorded_at END) AS last_success FROM snapshots GROUP BY tag")
def counter_upsert(table):
    s = table("snapshots")
    current = s.select("tag").distinct().select("tag", F.lit(10).cast("long").alias("uses"), F.lit(1).cast("long").alias("successes"), F.lit(None).cast("timestamp_ntz").alias("last_success"))
    return merges.count_uses(current, s.select("tag", (F.col("likes") > 50).alias("success"), F.col("recorded_at").alias("at")))


@query("SELECT id, CASE WHEN id % 4 = 0 THEN 'completed' WHEN id % 6 = 0 THEN 'failed' ELSE status END AS status, CASE WHEN id % 4 = 0 THEN 'r' END AS result, CASE WHEN id % 4 <> 0 AND id % 6 = 0 THEN 'e' ELSE 'old' END AS error FROM jobs")
def finished_jobs(table):
    j = table("jobs").withColumns({"result": F.lit(None).cast("string"), "error": F.lit("old")})
    four = F.col("id") % 4 == 0
    done = j.where("id % 4 = 0 OR id % 6 = 0").select("id", F.when(four, "completed").otherwise("failed").alias("status"), F.when(four, "r").alias("result"), F.when(~four, "e").alias("error"), F.lit(None).cast("date").alias("at"))
    return merges.finish_jobs(j, done).select("id", "status", "result", "error")


@query("""
WITH w AS (SELECT sc_id, first_seen, CASE sc_id % 3 WHEN 0 THEN 'none' ELSE 'gate' END AS k FROM store_items WHERE profile_id = 'p0'), c AS (SELECT v.sc_id FROM votes v WHERE value = 'like' AND NOT EXISTS (SELECT 1 FROM tracks t WHERE t.sc_id = v.sc_id))
SELECT c.sc_id FROM c LEFT JOIN w ON w.sc_id = c.sc_id WHERE w.sc_id IS NULL OR (w.k = 'none' AND w.first_seen >= TIMESTAMP '1998-01-01' - INTERVAL 1500 DAY)""")
def watch_candidates(table):
    w = table("store_items").where("profile_id = 'p0'").select("sc_id", F.when(F.col("sc_id") % 3 != 0, F.col("last_seen")).alias("available_at"), F.col("first_seen").alias("first_checked"))
    return merges.watch_candidates(table("votes"), table("tracks"), w, ntz("1998-01-01 00:00:00"), 1500)


@query("""
WITH w AS (SELECT sc_id, CASE WHEN sc_id % 3 = 0 THEN 'none' ELSE 'gate' END AS last_kind FROM store_items WHERE profile_id = 'p0'), a AS (SELECT id AS sc_id, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 4 = 0 THEN 'none' ELSE 'store' END AS kind FROM tracks WHERE id % 2 = 0),
b AS (SELECT coalesce(w.sc_id, a.sc_id) AS sc_id, w.sc_id IS NULL AS fresh, a.sc_id IS NOT NULL AS asked, last_kind, kind FROM w FULL JOIN a ON a.sc_id = w.sc_id)
SELECT sc_id, coalesce(kind, last_kind, 'none') AS last_kind, coalesce(kind, 'none') <> 'none' AND (fresh OR last_kind = 'none') AS available, NOT fresh AND asked AND last_kind = 'none' AND coalesce(kind, 'none') <> 'none' AS reported FROM b""")
def availability_check(table):
    now = ntz("2024-01-01 00:00:00")
    none = F.lit(None).cast("timestamp_ntz")
    w = table("store_items").where("profile_id = 'p0'").select("sc_id", none.alias("first_checked"), none.alias("last_checked"), F.when(F.col("sc_id") % 3 == 0, "none").otherwise("gate").alias("last_kind"), none.alias("available_at"))
    asked = table("tracks").where("id % 2 = 0").select(F.col("id").alias("sc_id"))
    found = asked.where("sc_id % 5 <> 0").select("sc_id", F.when(F.col("sc_id") % 4 == 0, "none").otherwise("store").alias("kind"))
    state, opened = merges.check_availability(w, asked, found, now)
    told = opened.select("sc_id", F.lit(True).alias("told"))
    return state.join(told, "sc_id", "left").select("sc_id", "last_kind", F.col("available_at").isNotNull().alias("available"), F.coalesce("told", F.lit(False)).alias("reported"))


@query("""
WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'store' WHEN 'signup' THEN 'gate' WHEN 'error' THEN NULL ELSE 'none' END AS kind FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, last_value(kind IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
SELECT user_id AS sc_id, event_id AS at, kind FROM k WHERE n > 1 AND coalesce(before, 'none') = 'none' AND kind <> 'none'""")
def availability_transitions(table):
    e = table("snapshots").select("sc_id", F.col("id").alias("at"), F.when(F.col("tag") == "purchase", "store").when(F.col("tag") == "signup", "gate").when(F.col("tag") != "error", "none").alias("kind"))
    return states.availability_of(e)


@query("""
WITH e AS (SELECT user_id, event_id, event_type = 'purchase' AS ok FROM events WHERE event_type IN ('purchase', 'error')),
o AS (SELECT user_id, max(event_id) FILTER (WHERE ok) AS good FROM e GROUP BY 1)
SELECT e.user_id AS sc_id, count(*) AS attempts, 'e' || max(event_id) AS last_error, CASE WHEN count(*) >= 2 THEN 'failed' ELSE 'pending' END AS status FROM e JOIN o USING (user_id) WHERE NOT ok AND (good IS NULL OR event_id > good) GROUP BY 1""")
def retry_queue(table):
    log = table("snapshots").where("tag IN ('purchase', 'error')").select("sc_id", F.col("id").alias("at"), (F.col("tag") == "purchase").alias("ok"), F.concat(F.lit("e"), F.col("id").cast("string")).alias("error"))
    return merges.retries(log, 2)


# --- learning ------------------------------------------------------------------------------------------
@query("""
WITH m AS (SELECT label % 2 AS model FROM embeddings GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), k AS (SELECT DISTINCT sc_id FROM tracks WHERE adopted IS NOT NULL AND sc_id IS NOT NULL),
r AS (SELECT t.id, t.adopted IS NOT NULL OR t.rb_rating >= 4 OR coalesce(t.feedback = 'like', FALSE) OR coalesce(v.value = 'like', FALSE) OR k.sc_id IS NOT NULL AS good, coalesce(t.feedback = 'dislike', FALSE) OR coalesce(v.value = 'dislike', FALSE) AS bad
  FROM embeddings e JOIN m ON e.label % 2 = m.model JOIN tracks t ON t.id = e.vec_id LEFT JOIN votes v ON v.sc_id = t.sc_id LEFT JOIN k ON k.sc_id = t.sc_id)
SELECT id, CASE WHEN good THEN 1 ELSE 0 END AS label FROM r WHERE good OR bad""")
def training_labels(table):
    e = table("embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 2).alias("model"), F.col("embedding").alias("vector"))
    return taste.examples(e, table("tracks"), table("votes")).select("id", "label")


MODELS = """
WITH r AS (SELECT 'p' || (vec_id % 3) AS profile, vec_id AS run, embedding AS w FROM embeddings WHERE vec_id < 12), n AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY profile ORDER BY run DESC) = 1),
"""


@query(MODELS + """
s AS (SELECT 'p' || (vec_id % 4) AS profile, vec_id, embedding AS v FROM embeddings)
SELECT s.profile AS profile_id, vec_id AS id, CASE WHEN n.run % 3 <> 2 THEN round(1 / (1 + exp(-(0.25 + list_sum([CAST(v[i] AS DOUBLE) * CAST(w[i] AS DOUBLE) FOR i IN range(1, 65)])))), 6) END AS taste_score FROM s LEFT JOIN n ON n.profile = s.profile""")
def model_scores(table):
    """Models of four runs a profile; the newest of one profile is broken, and one profile has none."""
    e = table("embeddings")
    zero, one = F.array_repeat(F.lit(0.0), 64), F.array_repeat(F.lit(1.0), 64)
    good = F.to_json(F.struct(F.col("embedding").cast("array<double>").alias("weights"), F.lit(0.25).alias("bias"), zero.alias("mean"), one.alias("std")))
    broken = (F.col("vec_id") % 3 == 2) & (F.col("vec_id") > 9)
    runs = e.where("vec_id < 12").select(F.concat(F.lit("p"), (F.col("vec_id") % 3).cast("string")).alias("profile_id"), F.lit("m").alias("model"), F.lpad(F.col("vec_id").cast("string"), 4, "0").alias("trained_at"), F.lit(1).cast("long").alias("n"), F.when(broken, '{"weights": [1').otherwise(good).alias("parameters"))
    own = e.select(F.concat(F.lit("p"), (F.col("vec_id") % 4).cast("string")).alias("profile_id"), F.col("vec_id").alias("id"), F.lit("m").alias("model"), F.col("embedding").alias("vector"))
    return models.scores(own, runs).select("profile_id", "id", r6(F.col("taste_score")).alias("taste_score"))


# --- names, digest, runs ------------------------------------------------------------------------------
@query(KEYS + """, b AS (SELECT id, other, k, row_number() OVER (PARTITION BY id ORDER BY k DESC, other) AS r, count(*) OVER (PARTITION BY id) AS n, max(k) OVER (PARTITION BY id) AS best FROM m WHERE id % 3 <> 0 AND other % 7 <> 1)
SELECT id AS record_id, other AS candidate_id, CAST(best AS INT) AS overlap, n > 1 AS ambiguous FROM b WHERE r = 1""")
def link_proposals(table):
    """Records without an address and the candidates of most shared words; titles hold the artist here."""
    n = table("names")
    records = n.where("side = 'asked'").select("id", "artist", "title", F.lit("/m/x.mp3").alias("path"), F.when(F.col("id") % 3 == 0, "https://x").alias("source_url"))
    held = n.where("side = 'held'").select("id", F.lit(None).cast("string").alias("artist"), F.concat_ws(" ", "artist", "title").alias("title"))
    return fuzzy.proposals(records, held, held.where("id % 7 = 1").select("id"))


@query(KEYS + "SELECT n.id, EXISTS (SELECT 1 FROM m WHERE m.id = n.id) AS owned FROM n WHERE side = 'asked'")
def owned_names(table):
    n = table("names")
    asked = n.where("side = 'asked'").repartition("id").select("id", text.name_key(F.col("artist"), F.col("title")).alias("key"))
    return fuzzy.owned(asked, fuzzy.keyed(n.where("side = 'held'"), "id", "artist", "title"))


@query(KEYS + """, l AS (SELECT id AS other, CASE id % 3 WHEN 0 THEN 'inbox' WHEN 1 THEN 'collection' END AS side, id % 5 = 0 AS by_id, id % 11 = 0 AS by_url FROM names WHERE side = 'held'),
h AS (SELECT m.id, l.side FROM m JOIN l ON l.other = m.other UNION ALL SELECT other - 1, side FROM l WHERE by_id UNION ALL SELECT other + 1, side FROM l WHERE by_url),
a AS (SELECT n.id, coalesce(bool_or(h.side = 'inbox'), FALSE) AS i, coalesce(bool_or(h.side = 'collection'), FALSE) AS c FROM names n LEFT JOIN h ON h.id = n.id WHERE n.side = 'asked' GROUP BY n.id),
d AS (SELECT id, i AS in_inbox, CASE WHEN id % 26 = 0 THEN TRUE WHEN id % 34 = 0 THEN FALSE ELSE c END AS in_collection FROM a)
SELECT d.id AS sc_id, in_inbox, in_collection, CASE WHEN d.id % 4 = 0 THEN 'store' WHEN d.id % 6 = 0 THEN 'gate' WHEN in_inbox OR in_collection THEN 'native' ELSE 'stream' END AS download_kind, v.value AS feedback FROM d LEFT JOIN votes v ON v.sc_id = d.id""")
def digest_rows(table):
    n = table("names")
    k = F.col("id")
    seen = n.where("side = 'asked'").select("id", F.concat(F.lit("http://host.example/"), k.cast("string")).alias("url"), "title", "artist", F.lit("2024").alias("reported_at"))
    held = n.where("side = 'held'").select(
        "id", F.lit("/m/x.mp3").alias("path"), F.when(k % 3 == 0, "inbox").when(k % 3 == 1, "archive").otherwise("rejected").alias("status"), F.when(k % 5 == 0, k - 1).alias("sc_id"),
        F.when(k % 11 == 0, F.concat(F.lit("https://WWW.host.example/"), (k + 1).cast("string"), F.lit("/?x=1"))).alias("source_url"), "artist", "title")
    asked = n.where("side = 'asked'")
    stores = asked.where("id % 4 = 0").select(k.alias("sc_id"), F.lit("https://s").alias("purchase_url"))
    gates = asked.where("id % 6 = 0").select(k.alias("sc_id"), F.lit("https://g").alias("gate_url"), F.lit(None).cast("string").alias("done_at"))
    overrides = asked.where("id % 26 = 0 OR id % 34 = 0").select(k.alias("sc_id"), F.when(k % 26 == 0, "already_in_collection").otherwise("not_duplicate").alias("override_type"))
    counts = table("snapshots").select("id", "sc_id", F.col("likes").alias("plays"), "likes", "reposts", "comments", "recorded_at")
    rows = digest.rows(seen, held, table("votes"), stores, gates, counts, overrides)
    return digest.search(rows).select("sc_id", "in_inbox", "in_collection", "download_kind", "feedback")


@query("SELECT p_partkey AS node, (p_partkey - 1) // 6 * 6 + 1 AS root FROM part WHERE p_partkey > 0 AND NOT (p_partkey % 6 = 1 AND p_partkey = (SELECT max(p_partkey) FROM part))")
def link_components(table):
    t = table("tracks").select("id")
    links = t.where("id > 1 AND id % 6 <> 1").select((F.col("id") - 1).alias("a"), F.col("id").alias("b"))
    return components.components(links)


@query("""
WITH p AS (SELECT TIMESTAMP '1998-08-01' AS t), r AS (SELECT CAST(finished_at AS TIMESTAMP) AS "at", found FROM runs WHERE mode = 'discover'), v AS (SELECT value, TIMESTAMP '1998-08-01' - to_hours(sc_id) AS "at" FROM votes),
k AS (SELECT 'runs' AS kpi, r."at", 1 AS n FROM r UNION ALL SELECT 'scanned', r."at", found FROM r UNION ALL SELECT status, TIMESTAMP '1998-08-01' - to_hours(id), 1 FROM tracks WHERE status IN ('inbox', 'rejected') UNION ALL SELECT value, v."at", 1 FROM v)
SELECT kpi, CAST(coalesce(sum(n) FILTER (WHERE k."at" > t - INTERVAL 30 DAY), 0) AS BIGINT) AS current, CAST(coalesce(sum(n) FILTER (WHERE k."at" > t - INTERVAL 60 DAY AND k."at" <= t - INTERVAL 30 DAY), 0) AS BIGINT) AS before
FROM (SELECT unnest(['runs', 'scanned', 'inbox', 'rejected', 'like', 'dislike', 'later']) AS kpi) n LEFT JOIN k USING (kpi) CROSS JOIN p GROUP BY kpi""")
def period_kpis(table):
    now = ntz("1998-08-01 00:00:00")
    at = lambda c: (now - F.make_dt_interval(hours=F.col(c).cast("int")))
    runs = table("runs").withColumn("finished_at", F.col("finished_at").cast("timestamp_ntz"))
    return reports.kpis(runs, table("tracks").withColumn("created_at", at("id")), table("votes").withColumn("updated_at", at("sc_id")), now, 30)


@query("SELECT id AS item, category, tag, CASE WHEN id % 4 = 0 THEN 'insert' WHEN id % 5 = 0 THEN 'replace' ELSE 'unchanged' END AS action FROM (SELECT id, 'version' AS category, 'original' AS tag FROM tracks) x")
def version_tag_plan(table):
    t = table("tracks").select("id", "title", F.lit("/m/x.mp3").alias("path"), F.lit(None).cast("double").alias("bpm"))
    there = t.where("id % 4 <> 0").select(F.col("id").alias("item"), F.lit("version").alias("category"), F.when(F.col("id") % 5 == 0, "edit").otherwise("original").alias("tag"))
    return reports.tag_plan(t, there)


@query("""
SELECT 'jobs ' || status AS name, count(*) AS value FROM jobs GROUP BY 1 UNION ALL SELECT 'last discovery', max_by(found, id) FROM runs WHERE mode = 'discover'
UNION ALL SELECT 'worker active', CAST(date_diff('second', (max(updated_at) FILTER (WHERE status IN ('running', 'completed')))::TIMESTAMP, TIMESTAMP '1998-08-02') <= 300 AS BIGINT) FROM jobs""")
def status_page(table):
    j = table("jobs").withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))
    return reports.status(table("runs"), j, ntz("1998-08-02 00:00:00")).select("name", "value")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN greatest(0.0, id % 20 - 8.0) WHEN id % 3 = 1 THEN CAST(id % 50 AS DOUBLE) ELSE 0.0 END AS start FROM tracks")
def preview_starts(table):
    k = F.col("id")
    return table("tracks").select("id", lookups.preview_start(F.when(k % 3 == 0, (k % 20).cast("double")), F.when(k % 3 == 1, (k % 50).cast("double"))).alias("start"))


@query("SELECT id, sum(size) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM tracks WHERE size IS NOT NULL")
def running_sizes(table):
    t = table("tracks").select("id", "size")
    return ranking.running_sum(t, "size", "id", "b").select("id", F.when(F.col("b") > 0, F.col("b")).alias("before"))


# --- reports over many tables ----------------------------------------------------------------------------
@query("""
WITH t AS (SELECT *, TIMESTAMP '1998-08-01' - to_hours(id) AS made FROM tracks), n AS (SELECT * FROM t WHERE made > TIMESTAMP '1998-08-01' - INTERVAL 30 DAY),
a AS (SELECT artist AS name, count(*) AS current FROM n WHERE status = 'inbox' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT 'quality' AS section, 0 AS place, coalesce(quality_status, 'unknown') AS name, count(*) AS current FROM n WHERE status = 'rejected' GROUP BY 3
UNION ALL SELECT 'artist', CAST(row_number() OVER (ORDER BY current DESC, name) AS INT), name, current FROM a""")
def weekly_breakdown(table):
    now = ntz("1998-08-01 00:00:00")
    at = lambda c: (now - F.make_dt_interval(hours=F.col(c).cast("int")))
    runs = table("runs").withColumn("finished_at", F.col("finished_at").cast("timestamp_ntz"))
    rows = overview.weekly(runs, table("tracks").withColumn("created_at", at("id")), table("votes").withColumn("updated_at", at("sc_id")), now, 30)
    return rows.where("section <> 'kpi'").select("section", "place", "name", "current")


@query("""
WITH f AS (SELECT e.track_id, e.user_id, 'Fan' || e.user_id AS spelt, CASE WHEN e.user_id % 3 = 0 THEN 2 ELSE 1 END AS kinds FROM edges e JOIN tracks t ON t.id = e.track_id AND t.feedback = 'like'),
c AS (SELECT lower(spelt) AS slug, CAST(sum(kinds) AS BIGINT) AS n, CASE WHEN user_id % 2 = 0 THEN 'User ' || user_id ELSE any_value(spelt) END AS name FROM f WHERE user_id % 50 <> 0 GROUP BY 1, user_id HAVING sum(kinds) >= 2),
a AS (SELECT artist, lower(replace(artist, '#', '-')) AS slug, count(*) AS n FROM tracks WHERE status = 'archive' GROUP BY 1, 2)
SELECT 'fans' AS source, slug, name, n FROM c UNION ALL SELECT 'collection', slug, artist, n FROM a WHERE slug <> 'brand-11'""")
def curator_candidates(table):
    e = table("edges")
    link = F.concat(F.lit("https://sc.com/Fan"), F.col("user_id").cast("string"), F.lit("/"))
    user = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("User "), F.col("user_id").cast("string")))
    fans = e.select("track_id", F.lit("like").alias("kind"), F.col("user_id").alias("pos"), link.alias("permalink"), user.alias("username")).union(e.where("user_id % 3 = 0").select("track_id", F.lit("repost"), "user_id", link, user))
    liked = table("tracks").where("feedback = 'like'").select(F.col("id").alias("sc_id"))
    known = e.where("user_id % 50 = 0").select(F.concat(F.lit("http://sc.com/FAN"), F.col("user_id").cast("string")).alias("account")).distinct().union(table("tracks").limit(1).select(F.lit("Brand-11").alias("account")))
    favourites = table("tracks").where("status = 'archive'").groupBy("artist").agg(F.count("*").alias("n"))
    return overview.curators(fans, liked, favourites, known)


@query("""
WITH w AS (SELECT sc_id, last_seen, CASE WHEN sc_id % 4 = 0 THEN first_seen END AS available_at, CASE WHEN sc_id % 4 = 0 THEN 'store' ELSE 'none' END AS k FROM store_items WHERE profile_id = 'p0'),
s AS (SELECT sc_id, max_by(artist, id) AS artist, max_by(title, id) AS title FROM snapshots GROUP BY 1)
SELECT w.sc_id, coalesce(s.artist, t.artist) AS artist, coalesce(s.title, t.title) AS title, k AS last_kind, available_at, available_at IS NOT NULL AS is_available FROM w LEFT JOIN s USING (sc_id) LEFT JOIN tracks t ON t.id = w.sc_id
ORDER BY available_at IS NULL, available_at DESC, last_seen DESC, w.sc_id""")
def watch_list(table):
    s = table("store_items").where("profile_id = 'p0'")
    four = F.col("sc_id") % 4 == 0
    w = s.select("sc_id", F.col("last_seen").alias("last_checked"), F.when(four, F.col("first_seen")).alias("available_at"), F.when(four, "store").otherwise("none").alias("last_kind"))
    return overview.watch_list(w, table("snapshots"), table("tracks").select(F.col("id").alias("sc_id"), "artist", "title"))


@query("""
WITH r AS (SELECT id, CASE WHEN id % 5 = 0 THEN ' ' WHEN id % 5 = 1 THEN 'own' END AS artist FROM seen), t AS (SELECT id, CASE WHEN id % 3 = 0 THEN id END AS sc_id, CASE WHEN id % 2 = 0 THEN id END AS u, CASE WHEN id % 9 <> 0 THEN artist END AS artist FROM tracks)
SELECT r.id, CASE WHEN r.artist = 'own' THEN 'own' WHEN a.id IS NOT NULL THEN a.artist ELSE b.artist END AS artist,
  CASE WHEN r.artist = 'own' THEN 'kept' WHEN a.id IS NOT NULL THEN CASE WHEN a.artist IS NULL THEN 'none' ELSE 'id' END WHEN b.artist IS NULL THEN 'none' ELSE 'url' END AS how FROM r LEFT JOIN t a ON a.sc_id = r.id LEFT JOIN t b ON b.u = r.id""")
def artist_backfill(table):
    k = F.col("id")
    rows = table("seen").select("id", F.concat(F.lit("https://www.sc.com/T/"), k.cast("string"), F.lit("/?a=b")).alias("url"), F.when(k % 5 == 0, " ").when(k % 5 == 1, "own").alias("artist"))
    tracks = table("tracks").select("id", F.when(k % 3 == 0, k).alias("sc_id"), F.when(k % 2 == 0, F.concat(F.lit("http://m.sc.com/t/"), k.cast("string"))).alias("source_url"), F.when(k % 9 != 0, F.concat(F.lit(" "), "artist")).alias("artist"))
    return overview.backfill_artists(rows, tracks)


@query("""
WITH t AS (SELECT id, path, status, CASE WHEN id % 15 = 0 THEN 'day ' || id END AS adopted_at, bpm, key_camelot, 'm' || id AS modified, CASE WHEN id % 10 = 3 THEN id WHEN id % 10 = 5 THEN id - 2 END AS own, CASE WHEN id % 3 = 0 THEN id END AS named FROM tracks),
w AS (SELECT own AS sc_id, 0 AS way, * EXCLUDE (own, named) FROM t WHERE own IS NOT NULL UNION ALL SELECT named, 1, * EXCLUDE (own, named) FROM t WHERE named IS NOT NULL),
r AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY sc_id ORDER BY way, CASE WHEN adopted_at IS NOT NULL THEN 0 WHEN status = 'inbox' THEN 1 WHEN status = 'archive' THEN 2 ELSE 3 END, id) = 1),
x AS (SELECT sc_id, min(first_seen) AS "at" FROM store_items GROUP BY 1),
l AS (SELECT id AS sc_id, 'found' AS step, 'r' || id AS "at", NULL AS detail FROM seen UNION ALL SELECT sc_id, 'rated', NULL, value FROM votes UNION ALL SELECT sc_id, 'store', CAST("at" AS VARCHAR), 'p' || sc_id FROM x
  UNION ALL SELECT id, 'rejected', 'x' || id, reason FROM seen WHERE reason IS NOT NULL UNION ALL SELECT sc_id, 'inbox', modified, path FROM r WHERE status = 'inbox' OR adopted_at IS NOT NULL
  UNION ALL SELECT sc_id, 'analyzed', NULL, CAST(bpm AS INT) || ' BPM · ' || key_camelot FROM r WHERE bpm IS NOT NULL AND key_camelot IS NOT NULL UNION ALL SELECT sc_id, 'archive', NULL, path FROM r WHERE status = 'archive' AND adopted_at IS NULL UNION ALL SELECT sc_id, 'adopted', adopted_at, NULL FROM r WHERE adopted_at IS NOT NULL)
SELECT sc_id, step, "at", detail FROM l WHERE sc_id % 2 = 1""")
def track_life(table):
    k, s = F.col("id"), lambda p: F.concat(F.lit(p), F.col("id").cast("string"))
    seen = table("seen")
    tracks = table("tracks").withColumns({"adopted_at": F.when(k % 15 == 0, s("day ")), "modified": s("m"), "sc_id": F.when(k % 10 == 3, k).when(k % 10 == 5, k - 2)})
    ids = table("tracks").select(k.alias("sc_id")).union(seen.select("id")).union(table("votes").select("sc_id")).where("sc_id % 2 = 1")
    stores = table("store_items").select("sc_id", F.col("first_seen"), F.concat(F.lit("p"), F.col("sc_id").cast("string")).alias("link"))
    life = overview.track_life(ids, seen.select("id", s("r").alias("reported_at")), seen.where("reason is not null").select("id", s("x").alias("rejected_at"), "reason"), table("votes").withColumn("updated_at", F.lit(None).cast("string")), stores.where("false"), stores, tracks)
    return life.select("sc_id", "step", "at", "detail")


@query("""
WITH o AS (SELECT id, artist, title, rb_rating FROM tracks WHERE status IN ('archive', 'inbox') AND coalesce(quality_status, '') NOT IN ('fake_transcode', 'clipped', 'corrupt')),
k AS (SELECT *, row_number() OVER (PARTITION BY artist ORDER BY rb_rating DESC, id) AS k FROM o)
SELECT artist, count(*) AS n, count(*) FILTER (WHERE rb_rating >= 4) / count(*) AS liked_share, list_slice(list(id ORDER BY k), 1, 5) AS ids FROM k GROUP BY artist HAVING count(*) >= 3""")
def collectors(table):
    return overview.collectors(table("tracks")).select("artist", "n", "liked_share", F.transform("tracks", lambda t: t["id"]).alias("ids"))


@query("SELECT tag, uses, successes FROM (SELECT tag, count(*) AS uses, count(*) FILTER (WHERE likes > 50) AS successes, max(CASE WHEN likes > 50 THEN recorded_at END) AS last_at FROM snapshots GROUP BY tag) x WHERE successes >= 2 AND last_at >= (SELECT max(recorded_at) FROM snapshots) - INTERVAL 1 DAY")
def top_exploration(table):
    s = table("snapshots")
    none = s.limit(0).select("tag", F.lit(0).cast("long").alias("uses"), F.lit(0).cast("long").alias("successes"), F.lit(None).cast("timestamp_ntz").alias("last_success"))
    newest = s.agg(F.max("recorded_at").alias("newest_"))
    counted = merges.count_uses(none, s.select("tag", (F.col("likes") > 50).alias("success"), F.col("recorded_at").alias("at")))
    return overview.top_exploration(counted.join(F.broadcast(newest)), F.col("newest_"), 1).select("tag", "uses", "successes")


@query("""
SELECT section, name, n, share, detail FROM (
  SELECT 'pool' AS section, unnest(['tracks', 'bpm', 'key', 'sure_bpm', 'sure_key', 'anchors']) AS name, unnest([c, b, k, sb, sk, an]) AS n, unnest([NULL, round(100.0 * b / c, 4), round(100.0 * k / c, 4), round(100.0 * sb / c, 4), round(100.0 * sk / c, 4), round(100.0 * an / c, 4)])::DOUBLE AS share, NULL AS detail FROM (
    SELECT count(*) AS c, count(bpm) AS b, count(key_camelot) AS k, count(*) FILTER (WHERE bpm IS NOT NULL AND bpm_confidence >= 0.5) AS sb, count(*) FILTER (WHERE key_camelot IS NOT NULL AND id % 10 >= 5) AS sk,
      count(*) FILTER (WHERE bpm IS NOT NULL AND bpm_confidence >= 0.5 AND key_camelot IS NOT NULL AND id % 10 >= 5) AS an FROM tracks) x
  UNION ALL SELECT 'unsure', CAST(id AS VARCHAR), NULL, NULL, concat_ws('; ', CASE WHEN bpm IS NULL OR bpm_confidence IS NULL OR bpm_confidence < 0.5 THEN 'tempo ' || coalesce(printf('%.1f', bpm), '--') END, CASE WHEN key_camelot IS NULL OR id % 10 < 5 THEN 'key ' || coalesce(key_camelot, '--') END)
    FROM tracks WHERE bpm IS NULL OR bpm_confidence IS NULL OR bpm_confidence < 0.5 OR key_camelot IS NULL OR id % 10 < 5
  UNION ALL SELECT 'key', key_camelot, count(*), NULL, NULL FROM tracks WHERE bpm IS NOT NULL AND key_camelot IS NOT NULL GROUP BY 2) y""")
def set_report_rows(table):
    """The report of sets over pools of fifty ids; shape, relations and warnings are left to the tests."""
    pool = table("tracks").withColumn("key_margin", F.col("id") % 10 / 100)
    own = library.set_candidates(pool).withColumn("pool", F.floor(F.col("id") / 50).cast("long"))
    ordered = sets.order(own.withColumn("pos", F.col("id")))
    rows = overview.set_report(pool, ordered, sets.transitions(ordered, own))
    return rows.where("section in ('pool', 'unsure', 'key')")
