"""Overviews on small tables: nulls, ties, repeated rows and empty tables."""

from pyspark.sql import functions as F

from crateflow.operators import overview, sets


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_curators(spark):
    fans = spark.createDataFrame([
        (1, "like", 0, "https://sc.com/Ann/", None), (2, "repost", 0, "ANN", "Ann B"), (1, "repost", 3, "bob", " "), (3, "like", 0, "bob", "Robert"), (1, "like", 1, "known", "K"), (2, "like", 1, "sc.com/known", "K"), (1, "like", 2, None, "x"), (1, "like", 4, " ", "x"), (9, "like", 0, "bob", "x"),
    ], "track_id long, kind string, pos int, permalink string, username string")
    liked = spark.createDataFrame([(1,), (2,), (3,), (3,)], "sc_id long")
    favourites = spark.createDataFrame([("Bob", 9), ("Ümlaut Süd", 4), ("!!!", 5), (None, 3), ("The Known", 3)], "artist string, n long")
    known = spark.createDataFrame([("https://soundcloud.com/Known?x",), ("The Known",), (None,)], "account string")
    got = rows(overview.curators(fans, liked, favourites, known))
    assert got == [("collection", "uemlaut-sued", "Ümlaut Süd", 4), ("fans", "ann", "Ann", 2), ("fans", "bob", "bob", 2)]
    assert overview.curators(fans.limit(0), liked, favourites.limit(0), known).count() == 0


def test_watch_list_order_and_names(spark):
    watch = spark.createDataFrame([(1, None, "05", None), (2, "none", "04", None), (3, "gate", "01", "02"), (4, "store", "01", "03"), (5, "none", "04", None)], "sc_id long, last_kind string, last_checked string, available_at string")
    snaps = spark.createDataFrame([(1, 1, "old", "Old"), (2, 1, " ", "New"), (3, 3, None, None)], "id long, sc_id long, artist string, title string")
    stores = spark.createDataFrame([(1, "shop", "Shop"), (3, "b", "B"), (3, "a", "A")], "sc_id long, artist string, title string")
    got = [tuple(r) for r in overview.watch_list(watch, snaps, stores).collect()]
    assert [g[0] for g in got] == [4, 3, 1, 2, 5] and got[1][1:3] == ("a", "A") and got[2] == (1, "shop", "New", "", None, False)


def test_backfill_by_two_keys(spark):
    kept = spark.createDataFrame([(1, "https://sc.com/a", None), (2, "https://www.sc.com/B/?x", " "), (3, None, "own"), (4, "", None), (5, "https://sc.com/e", None)], "id long, url string, artist string")
    tracks = spark.createDataFrame([(10, 1, "https://sc.com/zzz", None), (11, 1, None, " By Id "), (12, 1, None, "later"), (13, None, "http://m.sc.com/b", "By Url"), (14, 5, None, " "), (15, None, "https://sc.com/e", "not used"), (16, None, " ", "blank")], "id long, sc_id long, source_url string, artist string")
    assert rows(overview.backfill_artists(kept, tracks)) == [(1, "By Id", "id"), (2, "By Url", "url"), (3, "own", "kept"), (4, None, "none"), (5, None, "none")]


def test_one_row_tells_a_life(spark):
    none = spark.createDataFrame([], "id long, reported_at string, rejected_at string, reason string")
    marks = spark.createDataFrame([(7, "later", "02"), (7, "like", "05")], "sc_id long, value string, updated_at string")
    shops = spark.createDataFrame([(7, None, "x"), (7, "03", "z"), (7, "03", "y"), (8, None, "only")], "sc_id long, first_seen string, link string")
    tracks = spark.createDataFrame([
        (1, 7, "/a.mp3", "archive", None, 150.0, "8A", "m1"), (2, 7, "/b.mp3", "inbox", None, 151.0, None, "m2"), (3, 7, "/c.mp3", "inbox", "day", 152.5, "9A", "m3"), (4, None, "/[7] d.mp3", "inbox", "day", 1.0, "1A", "m4"), (5, None, "/[8] e.mp3", "rejected", None, None, None, None),
    ], "id long, sc_id long, path string, status string, adopted_at string, bpm double, key_camelot string, modified string")
    ids = spark.createDataFrame([(7,), (8,), (9,), (7,), (None,)], "sc_id long")
    got = [tuple(r) for r in overview.track_life(ids, none.select("id", "reported_at"), none.select("id", "rejected_at", "reason"), marks, shops.limit(0), shops, tracks).orderBy("sc_id", "place").collect()]
    assert [(g[0], *g[2:]) for g in got] == [(7, "rated", "05", "like"), (7, "store", "03", "y"), (7, "inbox", "m3", "/c.mp3"), (7, "analyzed", None, "152 BPM · 9A"), (7, "adopted", "day", None), (8, "store", None, "only")]


def test_set_report(spark):
    pool = spark.createDataFrame([(1, 150.0, 0.9, "8A", 0.2, 1), (2, 151.0, 0.4, "9A", 0.2, 2), (3, 150.5, None, " ", None, 3), (4, None, 0.9, "8A", 0.01, 4), (5, 152.0, 0.8, "8A", 0.3, 5)], "id int, bpm double, bpm_confidence double, key_camelot string, key_margin double, pos int").withColumn("pool", F.lit(1))
    own = pool.where("bpm is not null and trim(key_camelot) <> ''")
    ordered = sets.order(own)
    got = {(r.section, r.name): (r.n, r.share, r.detail) for r in overview.set_report(pool, ordered, sets.transitions(ordered, own)).collect()}
    assert got["pool", "tracks"][0] == 5 and got["pool", "bpm"][:2] == (4, 80.0) and got["pool", "key"][0] == 4 and got["pool", "anchors"][:2] == (2, 40.0)
    assert got["set", "tracks"][0] == 3 and got["set", "segments"][0] == 1 and got["set", "steps"][0] == 2 and got["tempo", "middle"][1] == 151.0
    assert sum(n for (s, _), (n, _, _) in got.items() if s == "relation") == 2 and got["key", "8A"][0] == 2
    assert {k: v[2] for (s, k), v in got.items() if s == "unsure"} == {"2": "tempo 151.0", "3": "tempo 150.5; key --", "4": "tempo --; key 8A"}
    empty = overview.set_report(pool.limit(0), ordered.limit(0), sets.transitions(ordered, own).limit(0))
    assert {r.n for r in empty.where("section = 'pool'").collect()} == {0}


def test_collectors_and_exploration(spark):
    tracks = spark.createDataFrame([(k, "a" if k < 5 else "b", f"t{k}", "archive" if k != 4 else "rejected", None, [5, 3, None, 4, 5, 1, 1][k]) for k in range(7)] + [(8, None, "t", "archive", None, 5)], "id long, artist string, title string, status string, quality_status string, rb_rating int")
    (r,) = overview.collectors(tracks, least=3, most_tracks=2).collect()
    assert (r.artist, r.n, r.liked_share, [(t.id, t.rating) for t in r.tracks]) == ("a", 4, 0.5, [(0, 5), (3, 4)])
    counters = spark.createDataFrame([("x", 5, 3, "2024-01-10"), ("y", 9, 3, "2024-01-10"), ("old", 9, 9, "2023-01-01"), ("few", 9, 1, "2024-01-10"), ("none", 3, 2, None)], "tag string, uses long, successes long, last string").withColumn("last_success", F.to_timestamp("last"))
    assert [r.tag for r in overview.top_exploration(counters, F.lit("2024-01-20").cast("timestamp"), 30).collect()] == ["x", "y"]
