"""Reading recorded answers and files, writing playlists and libraries, and streams against batches."""

import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from crateflow.functions import music
from crateflow.operators import merges
from crateflow.sinks import files
from crateflow.sources import config, items, tables
from crateflow.streaming import events


def test_missing_tables_are_empty(spark, tmp_path):
    spark.range(2).selectExpr("id", "'x' AS a").write.parquet(f"{tmp_path}/t.parquet")
    assert tables.table_exists(spark, str(tmp_path), "t") and not tables.table_exists(spark, str(tmp_path), "u")
    assert tables.read_table(spark, str(tmp_path), "u", "id long, b string").dtypes == [("id", "bigint"), ("b", "string")]
    assert sorted(tuple(r) for r in tables.read_table(spark, str(tmp_path), "t", "id long, b string").collect()) == [(0, "x", None), (1, "x", None)]
    with pytest.raises(Exception, match="no table"):
        tables.read_table(spark, str(tmp_path), "u")


def test_files_in_folders(spark, tmp_path):
    for name in ("a.mp3", "sub/b.WAV", "_rejected/c.mp3", ".hidden/d.mp3", "sub/_e.mp3", "note.txt", "sub/ä b+c.flac"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 5)
    os.utime(tmp_path / "a.mp3", (time.time() - 900, time.time() - 900))
    found = tables.scan_files(spark, str(tmp_path))
    assert sorted((r.relative, r.size) for r in found.collect()) == [("a.mp3", 5), ("sub/b.WAV", 5), ("sub/ä b+c.flac", 5)]
    assert [r.relative for r in tables.ready_files(found, F.current_timestamp(), 600).collect()] == ["a.mp3"]


def test_set_lists(spark, tmp_path):
    (tmp_path / "s.csv").write_text("artist,title,bpm,camelot,path\nA,T,150,8A,/x\n,U,,,\nB,V,junk,9A,/z\n")
    got = sorted(tuple(r) for r in tables.read_set(spark, str(tmp_path / "s.csv")).collect())
    assert got == [(0, "", "", "U", None, "", None), (0, "/x", "A", "T", 150.0, "8A", None), (0, "/z", "B", "V", None, "9A", None)]
    both = tables.union_sources(("one", spark.range(1)), ("two", spark.range(1).selectExpr("id", "'x' AS y")))
    assert sorted((r.id, r.source, r.y) for r in both.collect()) == [(0, "one", None), (0, "two", "x")]
    assert sorted(r.id for r in tables.ids_of((spark.range(3), "id"), (spark.range(2, 4), "id")).collect()) == [0, 1, 2, 3]


def item(k, **more):
    return {"kind": "track", "id": k, "title": f"T{k}", "user": {"username": "A"}, "tag_list": 'techno "hard techno" x', "likes_count": None, "favoritings_count": 3, **more}


def test_pages_and_items(spark, tmp_path):
    pages = [{"collection": [item(1), {"kind": "playlist", "id": 9}], "next_href": "p2.json"}, {"collection": [item(2, title=""), item(3, full_duration=5, downloadable=True, has_downloads_left=False)], "next_href": "p1.json"}]
    for k, p in enumerate(pages):
        (tmp_path / f"p{k + 1}.json").write_text(json.dumps(p))
    (tmp_path / "q1.json").write_text(json.dumps({"collection": [item(k) for k in range(10, 20)]}))
    read = items.read_pages(spark, [str(tmp_path / "p1.json"), str(tmp_path / "q1.json")], limit=6)
    assert sorted((r.start, r.pos) for r in read.collect()) == [(0, k) for k in range(4)] + [(1, k) for k in range(6)]
    got = {r.id: r for r in items.tracks_of(read).collect()}
    assert sorted(got) == [1, 3, 10, 11, 12, 13, 14, 15]
    assert list(got[1].tags) == ["techno", "hard techno", "x"] and (got[1].likes, got[1].plays, got[1].url, got[1].has_downloads_left) == (3, 0, "", True)
    assert (got[3].duration_ms, got[3].downloadable, got[3].has_downloads_left) == (5, True, False)


def test_lists_activity_and_stations(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    tracks = spark.createDataFrame([(1, "u1", "2024-01-09T00:00:00Z"), (2, "u2", "2023-01-01T00:00:00Z"), (3, "u1", "junk")], "id long, artist_url string, created_at string")
    assert [r.id for r in items.newer_than(tracks, F.lit(t(10)), 7).collect()] == [1]
    assert [r.id for r in items.uploads(spark.createDataFrame([("u1",), ("u2",)], "artist_url string"), tracks, F.lit(t(10)), 7).collect()] == [1]
    assert [r.id for r in items.playlist(spark.createDataFrame([(0, 3), (1, 9), (2, 1), (3, 3)], "pos int, id long"), tracks).collect()] == [3, 1, 3]
    feed = spark.createDataFrame([("a", k, t(k)) for k in range(1, 9)], "account string, id long, at timestamp_ntz")
    got = items.activity(feed, feed.where("id > 7"), F.lit(t(3)), limit=2).collect()
    assert sorted((r.id, r.feed) for r in got) == [(7, "repost"), (8, "like"), (8, "repost")]
    seed = spark.createDataFrame([(5,)], "id long")
    empty, some = spark.createDataFrame([], "pos int, id long"), spark.createDataFrame([(0, 5), (1, 6)], "pos int, id long")
    assert sorted(tuple(r) for r in items.station(seed, empty, some).collect()) == [(0, 5), (2, 6)] and sorted(r.id for r in items.station(seed, some.where("id = 6"), spark.createDataFrame([(0, 8)], "pos int, id long")).collect()) == [5, 6]
    edges = spark.createDataFrame([(1, k, "like", k) for k in range(5)], "track_id long, user_id long, kind string, pos int")
    assert sorted(r.user_id for r in items.fans(edges, 2).collect()) == [0, 1]
    picks = {items.exploration_tag(["a", "b", "c"], ["a"], 0.5, s) for s in range(50)}
    assert picks == {None, "b", "c"} and items.exploration_tag(["a"], ["a"], 1.0, 1) is None


def test_feeds_and_charts(spark):
    import hashlib

    xml = '<?xml version="1.0"?><rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><item><title>One</title><link> https://x/1 </link><dc:creator>Me</dc:creator><dc:subject>a</dc:subject><dc:subject> b </dc:subject></item><item><title>No link</title></item></channel></rss>'
    got = items.feed_items(spark.createDataFrame([("f", xml)], "url string, xml string")).collect()
    assert [(r.id, r.title, r.url, r.artist, list(r.tags)) for r in got] == [(int(hashlib.sha1(b"https://x/1").hexdigest()[:15], 16), "One", "https://x/1", "Me", ["a", "b"])]
    html = '<div class="bucket-item track"><div><a href="/track/x/1">i</a></div><span class="buk-track-title">T<b>!</b></span><p class="buk-track-artists"> A </p></div><div class="track"><a href="https://evil.com/1">e</a></div><div class="other"><a href="/z">z</a></div>'
    rows = items.chart_tracks(spark.createDataFrame([("https://www.beatport.com/c", html), ("u", None)], "url string, html string")).collect()
    assert [(r.url, r.title, r.artist) for r in rows] == [("https://www.beatport.com/track/x/1", "T!", "A")]


def test_library_file_round_trip(spark, tmp_path):
    tracks = spark.createDataFrame([
        (1, "/music/[5] ä b.mp3", "A", "T", 150.0, "8A", 200.4, 4, "archive", "ok", [("Drop", 80.0, 2), ("Kick", 1.0, 0)]), (2, "/music/x/[5] c.mp3", "A", "T2", 151.0, "9A", 100.0, None, "inbox", None, []),
        (3, "/music/d.mp3", "B", "U", None, None, 50.0, 0, "rejected", "ok", []), (4, "/music/e.mp3", "B", "V", 140.0, "1A", 50.0, 0, "archive", "clipped", []), (5, "/other/f.mp3", "B", "W", 140.0, "1A", 50.0, 0, "archive", None, []), (6, "/music/g.mp3", "C", "X", None, None, 60.0, 5, "archive", None, []),
    ], "id long, path string, artist string, title string, bpm double, key_camelot string, duration double, rb_rating int, status string, quality_status string, cues array<struct<name: string, time: double, pad: int>>")
    out = files.library_tracks(tracks, {"/music": "C:/m"})
    files.write_library_xml(out, str(tmp_path / "lib"))
    got = {r.id: r for r in items.read_library_xml(spark, str(tmp_path / "lib"), {"C:/m": "/music"}).collect()}
    assert sorted(got) == [2, 6] and got[2].path == "/music/x/[5] c.mp3" and (got[2].bpm, got[2].key_camelot, got[2].rb_rating, got[6].rb_rating, got[6].bpm) == (151.0, "9A", 0, 5, None)
    files.write_library_xml(files.library_tracks(tracks.where("id <> 2"), {"/music": "C:/m"}, archive_only=True), str(tmp_path / "lib2"))
    again = {r.id: r for r in items.read_library_xml(spark, str(tmp_path / "lib2"), {"C:/m": "/music"}).collect()}
    assert sorted(again) == [1, 6] and again[1].path == "/music/[5] ä b.mp3" and [(c.name, c.time, c.pad) for c in again[1].cues] == [("Kick", 1.0, 0), ("Drop", 80.0, 2)]


def test_playlists_tables_and_pages(spark, tmp_path):
    tracks = spark.createDataFrame([(1, "/a", "A", "T", 200.4, 1, 150.0, "8A", dt.date(2024, 1, 1), "g"), (2, "/b", "", "U", None, 1, None, "10B", dt.date(2023, 12, 31), None), (3, "/c", "C", "V", 60.0, 2, 152.0, None, dt.date(2024, 1, 2), "g")], "id long, path string, artist string, title string, duration double, segment int, bpm double, key_camelot string, created_at date, genre string")
    lines = files.m3u8_lines(tracks, ["id"], "segment")
    assert [r.line for r in lines.orderBy("place").collect()] == ["#EXTM3U", "# segment 1", "#EXTINF:200,A - T", "/a", "#EXTINF:-1,U", "/b", "# segment 2", "#EXTINF:60,C - V", "/c"]
    files.write_lines(lines, str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()][:2] == ["#EXTM3U", "# segment 1"]
    files.write_csv(tracks, str(tmp_path / "c"), separator=";")
    assert spark.read.option("header", "true").option("sep", ";").csv(str(tmp_path / "c")).columns == list(files.SET_COLUMNS)
    lists = [(r.kind, r.name) for r in files.playlists(tracks).orderBy("kind", "sort", "name", "id").collect()]
    assert [n for k, n in lists if k == "week"] == ["2024-01", "2024-01", "2023-52"] and [n for k, n in lists if k == "key"] == ["8A", "10B", "unknown"] and [n for k, n in lists if k == "bpm"] == ["150-155", "150-155", "unknown"]
    packed = files.pack(spark.range(25).selectExpr("id % 2 AS g", "id", "repeat('x', 30) AS l"), "g", ["id"], F.col("l"), most_chars=100, most_lines=10).collect()
    assert sorted((r.g, r.page, len(r.message)) for r in packed) == [("0", k, 92) for k in range(1, 5)] + [("0", 5, 30)] + [("1", k, 92) for k in range(1, 5)]
    assert sorted(r.body for r in files.text_export(tracks, music.bpm_bucket(F.col("bpm"))).collect()) == ["150-155 (2)\nA - T\nC - V", "unknown-bpm (1)\n - U"]


def test_settings():
    base = {"a": {"b": 1, "c": 2}, "d": [1]}
    assert config.deep_merge(base, {"a": {"b": 5}, "e": 1}) == {"a": {"b": 5, "c": 2}, "d": [1], "e": 1} and base["a"]["b"] == 1
    assert config.profiles({"x": 1, "profiles": {"p": {"x": 2}, "q": None}}) == {"p": {"x": 2}, "q": {"x": 1}} and config.profiles({"x": 1}) == {"default": {"x": 1}}
    new = {"a": {"b": 1, "c": 3}, "d": [1], "z": None}
    assert config.diff(base, new) == [("a.c", 2, 3), ("z", None, None)] and config.minimal_override(base, new) == {"a": {"c": 3}, "z": None}
    schema = {"s.bpm_min": {"type": float, "least": 60}, "s.bpm_max": {"type": float}, "s.mode": {"type": str, "choices": ["a"]}, "s.host": {"type": str, "pattern": "[a-z]+"}, "s.n": {"type": int}}
    problems, warnings = config.check({"s": {"bpm_min": 170, "bpm_max": 150, "mode": "b", "host": "X!", "n": True, "other": 1, "weights": {"x": 0.5, "y": 0.4}}}, schema)
    assert [p.split(":")[0] for p in problems] == ["s.mode", "s.host", "s.n", "s.bpm_min", "weights"] and warnings == ["s.other: unknown", "s.weights.x: unknown", "s.weights.y: unknown"]
    assert config.missing_fields({"a": {"b": None}, "c": 1}, ["a.b", "c", "a.x", "d", "c.e"]) == ["a.x", "d", "c.e"]


def run_stream(spark, build, folder, schema, name):
    """Everything a stream gives over a folder of files, with a late row that closes all windows."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = build(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


def test_streams_give_what_batches_give(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, k % 3, t0 + dt.timedelta(minutes=137 * k)) for k in range(120)]
    end = [(999, 99, t0 + dt.timedelta(days=60)), (1000, 99, t0 + dt.timedelta(days=90))]
    schema = "event_id long, user_id long, ts timestamp_ntz"
    df = spark.createDataFrame(rows, schema)
    folder = str(tmp_path / "e")
    for k in range(3):  # in the order of time, a file each
        spark.createDataFrame(rows[40 * k : 40 * k + 40], schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    for row in end:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    batch = df.groupBy(F.to_date("ts").alias("day"), "user_id").count()
    got = [r for r in run_stream(spark, events.daily_counts, folder, schema, "daily_counts") if r[1] != 99]
    assert sorted(got) == sorted(tuple(r) for r in batch.collect())
    got = [r for r in run_stream(spark, lambda s: events.sessions(s, "8 hours"), folder, schema, "sessions_of") if r[0] != 99]
    want = []
    for u in range(3):
        run = []
        for _, _, ts in [r for r in rows if r[1] == u] + [(0, u, None)]:
            if run and (ts is None or ts - run[-1] >= dt.timedelta(hours=8)):
                want += [(u, run[0], run[-1], len(run))] if len(run) >= 3 else []
                run = []
            run.append(ts)
    assert sorted(got) == sorted(want)
    snaps = lambda s: s.select(F.col("user_id").alias("sc_id"), F.col("ts").alias("recorded_at"), F.col("event_id").alias("likes"))
    got = [r[:3] for r in run_stream(spark, lambda s: events.first_of_day(snaps(s)), folder, schema, "first_of") if r[0] != 99]
    day = lambda r: (r[0], r[1].date())
    first = merges.daily_snapshots(snaps(df).limit(0), snaps(df)).collect()
    assert sorted(map(day, got)) == sorted(map(day, [tuple(r) for r in first]))


def test_gaps_of_answers(spark):
    track = {"id": 1, "kind": "track", "title": None, "user": {"username": "x"}}
    answers = [json.dumps(a) if not isinstance(a, str) else a for a in ({"collection": [{"kind": "playlist"}, track, {"kind": "track"}]}, {"collection": []}, {"collection": {"a": 1}}, {"collection": [{"kind": "user"}, 5]}, [], "{broken")] + [None]
    need = ["id", "title", "user.username", "user.permalink_url", "media.transcodings", "title.x"]
    got = spark.createDataFrame(list(enumerate(answers)), "k int, a string").select("k", config.payload_gaps(F.col("a"), need).alias("g")).orderBy("k").collect()
    whole = ["search.collection"]
    assert [list(r.g) for r in got] == [["search[0].user.permalink_url", "search[0].media.transcodings", "search[0].title.x"], whole, whole, ["search.collection[kind=track]"], whole, whole, whole]


def test_wiki_answers(spark):
    from crateflow.functions import tracklist

    pages = [{"parse": {"wikitext": {"*": "== x =="}}}, {"parse": {"wikitext": "plain"}}, {"error": {"code": "missingtitle"}}, {"parse": {"wikitext": 5}}, {"query": {"search": [{"title": "B"}, {"x": 1}, {"title": "A"}, 7]}}]
    df = spark.createDataFrame([(k, json.dumps(p)) for k, p in enumerate(pages)] + [(5, "no json"), (6, None)], "k int, a string")
    got = df.select("k", tracklist.page_text(F.col("a")).alias("t"), tracklist.found_pages(F.col("a")).alias("f")).orderBy("k").collect()
    assert [r.t for r in got] == ["== x ==", "plain", None, None, None, None, None] and [list(r.f) for r in got] == [[], [], [], [], ["B", "A"], [], []]


def test_titles_guessed_from_file_names(spark):
    from crateflow.functions import text

    names = [("A-B - C – D", "A-B", "C – D"), ("A – B — C-D", "A", "B — C-D"), ("A — B-C", "A", "B-C"), (" A-B-C ", "A", "B-C"), (" plain ", "", "plain"), ("", "", "")]
    got = spark.createDataFrame([(k, n[0]) for k, n in enumerate(names)], "k int, n string").select("k", text.guessed_artist_title(F.col("n")).alias("g")).orderBy("k").collect()
    assert [(r.g.artist, r.g.title) for r in got] == [n[1:] for n in names]
