"""Lookups, whole runs and measures of sound on small inputs."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from crateflow.functions import signal
from crateflow.operators import lookups, reports

T = lambda d, h=0: dt.datetime(2024, 1, d, h)


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_lookups(spark):
    tracks = spark.createDataFrame([(1, "/a", "p0", "https://SC.com/x/", [1, 2], 9.0, None), (2, "/b", "p1", "http://www.sc.com/X", [1, 2], 5.0, T(2)), (3, "/c", "p0", None, [], None, T(3))], "id long, path string, profile_id string, source_url string, fingerprint array<long>, seconds double, adopted_at timestamp_ntz")
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(lookups.by_id(tracks, 2)) == [2] and ids(lookups.by_path(tracks, "/b", "p0")) == [] and ids(lookups.by_url(tracks, "https://sc.com/x")) == [1] and ids(lookups.by_fingerprint(tracks, [1, 2])) == [1]
    assert ids(lookups.fingerprinted(tracks)) == [2, 1] and ids(lookups.fingerprinted(tracks, "path")) == [1, 2] and ids(lookups.missing(tracks, "seconds")) == [3] and ids(lookups.adopted(tracks)) == [3, 2]
    tags = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "a")], "track_id long, tag string")
    assert rows(lookups.tags_of(tags)) == [(1, ["a", "b"]), (2, ["a"])] and [r.track_id for r in lookups.ids_by_tag(tags, "a").collect()] == [1, 2]
    titles = spark.createDataFrame([("DJ Mix 3",), ("Song",), (None,)], "t string")
    assert [r.m for r in titles.select(lookups.title_matches(F.col("t"), ["mix \\d", "(broken"]).alias("m")).collect()] == [True, False, False]
    assert [r.m for r in titles.select(lookups.genre_relevant(F.col("t"), F.lit("Techno"), F.array(F.lit("a")), ["SONG", "hard"]).alias("m")).collect()] == [False, True, False]
    files, known = spark.createDataFrame([("a", 1, 5.0), ("b", 1, 5.0), ("c", 1, 5.005), ("d", 2, 5.0)], "path string, size long, modified double"), spark.createDataFrame([("a", 1, 6.0), ("c", 1, 5.0), ("d", 1, 5.0)], "path string, size long, modified double")
    assert [r[0] for r in rows(lookups.changed_files(files, known))] == ["a", "b", "d"]
    assert rows(lookups.assignment_diff(spark.createDataFrame([(1, "c", "x"), (2, "c", "y"), (3, "c", "z")], "item int, category string, tag string"), spark.createDataFrame([(1, "c", "x"), (2, "c", "q"), (4, "c", "z")], "item int, category string, tag string")), "item", "action") == [(1, "unchanged"), (2, "replace"), (3, "insert"), (4, "delete")]
    assert rows(lookups.exploration_outcomes(spark.createDataFrame([("a",), ("b",)], "tag string"), spark.createDataFrame([("a",)], "source_tag string"))) == [("a", True), ("b", False)]


def test_admission_and_routes(spark):
    data = [("flac", "flac", 900, False, 21000.0, 5.0, 0.0, "ok"), ("wav", "aac", 256, False, 21000.0, 5.0, 0.0, "lossy stream in a lossless container"), ("mp3", "mp3", 192, False, 20000.0, 5.0, 0.0, "bitrate too low"), ("mp3", "mp3", 192, True, 20000.0, 2.0, 0.0, "ok"), ("m4a", "aac", 256, False, 20000.0, 5.0, 0.0, "codec not accepted"), ("flac", "flac", 900, False, 0.0, 5.0, 0.0, "not measurable"), ("wav", "pcm_s16le", 1411, False, 16000.0, None, None, "spectrum ends too early")]
    df = spark.createDataFrame(data, "ending string, codec string, bitrate int, vbr boolean, cutoff double, lra double, peak double, want string")
    v = lookups.admission(*[F.col(c) for c in ("ending", "codec", "bitrate", "vbr", "cutoff", "lra", "peak")])
    got = df.select("want", v.alias("v"), lookups.route(v, F.lit(None).cast("string"), F.lit(False)).alias("r")).collect()
    assert all(r.v.reason == r.want for r in got) and [r.r for r in got] == ["keep", "rejected", "rejected", "clipped", "rejected", "unmeasurable", "rejected"]


def test_a_daily_run(spark):
    item = lambda k, title, **m: {"id": k, "pos": k, "title": title, "url": f"u{k}", "artist": "A", "artist_url": "x/a", "tags": [], "description": "", "duration_ms": 200_000, "plays": 1000, "likes": 100, "reposts": 5, "comments": 5, "created_at": T(9), "downloadable": False, "has_downloads_left": True, "purchase_url": "https://bandcamp.com/x"} | m
    schema = "id long, pos int, title string, url string, artist string, artist_url string, tags array<string>, description string, duration_ms long, plays long, likes long, reposts long, comments long, created_at timestamp_ntz, downloadable boolean, has_downloads_left boolean, purchase_url string"
    found = spark.createDataFrame([item(1, "New Song 155 bpm"), item(1, "Again", pos=9), item(2, "Long Set", duration_ms=10**7), item(3, "Live Mix"), item(4, "Slow 120 bpm"), item(5, "Known Song"), item(6, "Reported"), item(7, "Rare", plays=5), item(8, "Other Thing", downloadable=True)], schema)
    seen = spark.createDataFrame([(6, "u6", "Reported", T(1))], "id long, url string, title string, at timestamp_ntz")
    collection = spark.createDataFrame([(50, "A", "Known Song", 200.0)], "id long, artist string, title string, seconds double")
    overrides = spark.createDataFrame([], "id long, override_type string")
    got = reports.discover(found, seen, collection, overrides, F.lit(T(10)), title_patterns=("\\bmix\\b",), min_percentile=0.0)
    assert rows(got.fresh, "id", "kind", "bpm") == [(1, "store", 155.0), (8, "native", None)] and rows(got.duplicates, "id", "duplicate_of") == [(5, 50)]
    assert rows(got.seen, "id", "at") == [(1, T(10)), (5, T(10)), (6, T(1)), (8, T(10))]


def test_reports(spark):
    runs = spark.createDataFrame([(1, "discover", T(1), 5), (2, "discover", T(9), None), (3, "scout", T(9), 7), (4, "discover", T(10), 4)], "id long, mode string, finished_at timestamp_ntz, found long")
    tracks = spark.createDataFrame([("inbox", T(9)), ("inbox", T(2)), ("rejected", T(3))], "status string, created_at timestamp_ntz")
    votes = spark.createDataFrame([("like", T(4)), ("later", T(3))], "value string, updated_at timestamp_ntz")
    k = {r.kpi: (r.current, r.before) for r in reports.kpis(runs, tracks, votes, F.lit(T(10)), 7).collect()}
    assert k == {"runs": (2, 1), "scanned": (4, 5), "inbox": (1, 1), "rejected": (0, 1), "like": (1, 0), "dislike": (0, 0), "later": (0, 1)}
    jobs = spark.createDataFrame([("running", T(10)), ("pending", T(1))], "status string, updated_at timestamp_ntz")
    assert rows(reports.status(runs, jobs, F.lit(T(10)))) == sorted([("last discovery", 4, T(10)), ("jobs running", 1, T(10)), ("jobs pending", 1, T(1)), ("worker active", 1, T(10))], key=str)
    page = "== Tracklist ==\n# Artist - Dark Matter\n# ?\n[010] Nobody - Nothing Here\n"
    gaps = reports.setlist_gaps(spark.createDataFrame([("p", page)], "page string, text string"), spark.createDataFrame([(1, "Artist", "Dark Matter (Free DL)")], "id long, artist string, title string"))
    assert rows(gaps, "pos", "title", "owned") == [(1, "Dark Matter", True), (2, "", None), (3, "Nothing Here", False)] or rows(gaps, "pos", "title", "owned") == [(0, "Dark Matter", True), (1, "", None), (2, "Nothing Here", False)]
    plan = reports.tag_plan(spark.createDataFrame([(1, "Song (X Edit)", "/a.mp3", 79.0)], "id int, title string, path string, bpm double"), spark.createDataFrame([(1, "bpm", "155-160"), (1, "version", "original")], "item int, category string, tag string"))
    assert rows(plan, "category", "tag", "action") == [("bpm", "155-160", "unchanged"), ("version", "edit", "replace")]


@pytest.mark.parametrize("bpm", [128.0, 155.0])
def test_tempo_of_clicks(bpm):
    rate = 22_050
    y = np.zeros(rate * 20, dtype=np.float32)
    for k in range(int(20 * bpm / 60)):
        a = int(k * 60 / bpm * rate)
        y[a : a + 400] = np.sin(np.arange(min(400, len(y) - a)) * 0.05) * np.exp(-np.arange(min(400, len(y) - a)) / 80)
    found, sure = signal.tempo_of(y, rate)
    assert abs(found - bpm) < 1.0 and 0 < sure <= 1
    assert abs(signal.tempo_of(y, rate, window=(150.0, 165.0))[0] - bpm) < 1.0


def test_key_brightness_and_cutoff(spark):
    rate = 22_050
    t = np.arange(rate * 6) / rate
    chord = lambda notes: sum(np.sin(2 * np.pi * 440 * 2 ** ((n - 69) / 12) * t) for n in notes).astype(np.float32) / 4
    assert signal.key_of(chord([60, 64, 67, 72, 65, 69, 71, 74]), rate)[0] == "8B" and signal.key_of(chord([57, 60, 64, 69, 57, 64]), rate)[0] in ("8A", "8B")
    low, high = signal.centroid_of(chord([45]), rate)[0], signal.centroid_of(chord([93]), rate)[0]
    assert low < high and signal.cutoff_of(np.zeros(9000), rate) == 0.0 and signal.centroid_of(np.zeros(0), rate) == (None, None)
    noise = np.random.default_rng(1).normal(0, 0.1, rate * 4)
    spec = np.fft.rfft(noise)
    spec[np.fft.rfftfreq(len(noise), 1 / rate) > 6000] = 0
    assert abs(signal.cutoff_of(np.fft.irfft(spec), rate) - 6000) < 200
    df = spark.createDataFrame([(1, chord([57, 60, 64]).tolist()), (2, None), (3, [0.1] * 10)], "id int, y array<float>")
    got = {r.id: r.a for r in df.select("id", signal.analysis("y", rate).alias("a")).collect()}
    assert got[1].centroid > 0 and got[2].bpm is None and got[3].rms is None


def test_cutoff_is_the_widest_of_several_windows(spark):
    rate = 1000 * 18
    rng = np.random.default_rng(2)

    def band(top, seconds):
        spec = np.fft.rfft(rng.normal(0, 0.1, rate * seconds))
        spec[np.fft.rfftfreq(rate * seconds, 1 / rate) > top] = 0
        return np.fft.irfft(spec).astype(np.float32)

    assert signal.cutoff_windows(149.9) == (60,) and signal.cutoff_windows(300) == (60, 180) and signal.cutoff_windows(150) == (60, 90) and signal.cutoff_windows(155) == (60, 93)
    y = np.concatenate([np.zeros(rate * 4, np.float32), band(5000, 6), band(7000, 6)])
    wide = lambda *starts, seconds=6: signal.widest_cutoff(y, rate, starts, seconds)
    assert abs(wide(4) - 5000) < 200 and abs(wide(4, 10) - 7000) < 200 and abs(wide(10, 4, 4, -3) - 7000) < 200
    assert abs(wide(4, 13) - 5000) < 200  # the second window has three seconds left, too few
    assert wide(99, seconds=4) == 0.0  # behind the end: the silent beginning is measured
    assert abs(signal.widest_cutoff(band(5000, 4), rate) - 5000) < 200 and signal.widest_cutoff(band(5000, 2), rate) == 0.0
    df = spark.createDataFrame([(1, band(6000, 4).tolist()), (2, None), (3, [])], "id int, y array<float>")
    got = {r.id: r.c for r in df.select("id", signal.cutoff("y", rate).alias("c")).collect()}
    assert abs(got[1] - 6000) < 200 and got[2] == got[3] == 0.0
