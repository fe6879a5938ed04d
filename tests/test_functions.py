"""Functions over columns, against values worked out from their definitions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crateflow.functions import music, scoring, segments, style, text, tracklist, urls


def one(spark, column, **values):
    """The value of a column over one row of ``values`` (each with its type, or a plain literal)."""
    cols = [v.alias(k) if not isinstance(v, (str, int, float, type(None), bool)) else F.lit(v).alias(k) for k, v in values.items()]
    out = spark.range(1).select(*cols).select(column.alias("out")).first().out
    return out


def col_of(spark, column, kind, values):
    """The values of a column over rows with one field v."""
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.out for r in rows.select("k", column.alias("out")).orderBy("k").collect()]


V = None  # the column v, once there is a session


@pytest.fixture(autouse=True, scope="module")
def _column(spark):
    global V
    V = F.col("v")


def test_fold_and_tokens(spark):
    names = ["VRTGØ & Ümläut", "Zażółć Łódź", "Straße œuvre æther", "ﬁre été ä", "Don’t `Stop'", None, ""]
    assert col_of(spark, text.fold(V), "string", names)[:4] == ["vrtgo & uemlaeut", "zazolc lodz", "strasse oeuvre aether", "fire ete ae"]
    assert col_of(spark, text.words(V), "string", names)[3:5] == [["fire", "ete", "ae"], ["dont", "stop"]]
    titles = ["Dark Matter (Free Download)", "Original Mix", "A x B - Foo Remix", "", "Foo foo FOO"]
    assert col_of(spark, text.name_tokens(V), "string", titles) == [["dark", "matter"], ["original", "mix"], ["a", "b", "foo"], [], ["foo"]]
    brackets = ["Song (VRTGØ Edit)", "Song (EXCLU)", "Song [Original Mix]", "Song (Final Round Edit) [Premiere]", "Song"]
    assert [sorted(x) for x in col_of(spark, text.remixer_tokens(V), "string", brackets)] == [["vrtgo"], [], [], ["final", "round"], []]


@pytest.mark.parametrize(("a", "b", "same"), [
    (("Artist", "Track"), ("artist", "track (Free DL)"), True), (("Artist", "Track"), ("Artist", "Track (Other Edit)"), False), (("Artist", "Track (X1 Edit)"), ("Artist", "Track (Y2 Edit)"), False),
    (("Artist", "Track (X1 Edit)"), ("Artist", "Track (X1 Remix)"), True), (("One", "Word"), ("Other", "Thing"), False), ((None, "Solo"), (None, "Solo"), True), ((None, "Solo"), (None, "Solo Two"), False), (("", ""), ("", ""), False),
    (("A B", "C D"), ("A B", "E F"), True),
])
def test_names_match_both_ways(spark, a, b, same):
    key = lambda t: text.name_key(F.lit(t[0]).cast("string"), F.lit(t[1]))
    assert one(spark, text.names_match(key(a), key(b))) is same and one(spark, text.names_match(key(b), key(a))) is same


def test_artist_title(spark):
    raw = ["Artist - Title - More", "Artist – Title", "No separator ", "(FREE DL) [Free Download] Artist - T", "Free Spirit - T", "(freedl) - T", "Artist (FREE DL) - T"]
    got = col_of(spark, text.artist_title(V), "string", raw)
    assert [(r.artist, r.title) for r in got] == [("Artist", "Title - More"), ("Artist", "Title"), (None, "No separator"), ("Artist", "T"), ("Free Spirit", "T"), (None, "T"), ("Artist (FREE DL)", "T")]
    got = one(spark, text.from_file_name(F.lit("/music/[12] A - B (Edit).mp3")))
    assert (got.artist, got.title) == ("A", "B (Edit)")


def test_ids_tags_paths_and_slugs(spark):
    paths = ["/m/[123] a.mp3", "/m/[5]/a.mp3", "[7]x.wav", "/m/a [9].mp3", None]
    assert col_of(spark, text.id_from_file_name(V), "string", paths) == [123, None, 7, None, None]
    assert col_of(spark, text.id_anywhere(V), "string", paths) == [123, 5, 7, 9, None]
    assert col_of(spark, text.normalize_tag(V), "string", ["  Hard   Techno ", "Ü-Tag_1", "ä", "bad!", "", "x" * 41, None]) == ["hard techno", "ü-tag_1", "ä", None, None, None, None]
    assert col_of(spark, text.normalize_path(V), "string", ["a\\b/../c", "/x//y/./z", "../a", "/../a", "", "."]) == ["a/c", "/x/y/z", "../a", "/a", ".", "."]
    assert col_of(spark, text.artist_slug(V), "string", [" DJ Müller! ", "---", "x" * 61]) == ["dj-mueller", "", ""]
    assert col_of(spark, text.redact(V), "string", ["bot12345:ABCDEFGHIJKLMNOPQRSTUV x", "OAuth required", "OAuth 2-abc12345 x", "a?oauth_token=abcdefg1&b", "--auth-token abcdefgh9"]) == ["bot*** x", "OAuth required", "OAuth *** x", "a?oauth_token=***&b", "--auth-token ***"]
    assert col_of(spark, text.html_escape(V), "string", ["a<b>&c"]) == ["a&lt;b&gt;&amp;c"]


def test_times_and_json_tags(spark):
    t = dt.datetime(2024, 1, 2, 3, 4, 5)
    got = col_of(spark, text.parse_timestamp(V), "string", ["2024-01-02 03:04:05", "2024-01-02T03:04:05", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05.250000+00:00", "junk", None])
    assert got == [t, t, t, t.replace(microsecond=250000), None, None]
    raw = ['["Techno ", "techno", 5, null, " Acid"]', "[]", "not json", '{"a": 1}', None, '["", ["x"]]']
    assert col_of(spark, text.json_tags(V), "string", raw) == [["techno", "acid"], [], [], [], [], []]


def test_words_anywhere(spark):
    rows = spark.createDataFrame([("Brand#1", "50% Off"), ("x", "brand"), (None, "off brand")], "artist string, title string")
    assert [r.t for r in rows.select(text.contains_words("BRAND off", F.col("artist"), F.col("title")).alias("t")).collect()] == [True, False, True]


def test_urls(spark):
    given = ["https://www.Hypeddit.com/x", "http://sub.bandcamp.com", "https://notbandcamp.com", "https://we.tl/t", "https://mega.nz/f", "https://drive.google.com/x", "https://user@dropbox.com:8/x", "no url", None, "https://bandcamp.com.evil.tld"]
    assert col_of(spark, urls.host(V), "string", given) == ["hypeddit.com", "sub.bandcamp.com", "notbandcamp.com", "we.tl", "mega.nz", "drive.google.com", "dropbox.com", "", "", "bandcamp.com.evil.tld"]
    assert col_of(spark, urls.classify_url(V), "string", given) == ["hypeddit", "store", "none", "wetransfer", "mega", "cloud", "cloud", "none", "none", "none"]
    assert col_of(spark, urls.account_slug(V), "string", ["https://sc.com/Name/?a=1", "Name ", "", None, "sc.com/a/B/"]) == ["name", "name", "", "", "b"]
    assert col_of(spark, urls.permalink_slug(V), "string", ["https://sc.com/Name/sets", "sc.com/Name?x", "Name#y", ""]) == ["name", "name", "name", ""]
    assert col_of(spark, urls.normalize_url(V), "string", ["http://www.SC.com/A/B/?q=1#f", " https://m.sc.com/a ", "", None]) == ["https://sc.com/a/b", "https://sc.com/a", "", ""]
    assert col_of(spark, urls.direct_url(V), "string", ["http://www.dropbox.com/s/a?x=1&dl=0", "https://dropbox.com/a", "https://drive.google.com/file/d/abcdefghij12/view", "https://drive.google.com/open?id=abcdefghij", "https://drive.google.com/drive/x", "https://evil.com/?u=dropbox.com"]) == [
        "https://www.dropbox.com/s/a?x=1&dl=1", "https://dropbox.com/a?dl=1", "https://drive.usercontent.google.com/download?id=abcdefghij12&export=download&confirm=t", "https://drive.usercontent.google.com/download?id=abcdefghij&export=download&confirm=t", None, None]


@pytest.mark.parametrize(("given", "left", "purchase", "description", "want"), [
    (True, True, None, "", ("native", "u")), (True, False, "https://x.bandcamp.com/a", "https://dropbox.com/b", ("cloud", "https://dropbox.com/b")),
    (False, True, "https://we.tl/a", "https://mega.nz/b https://toneden.io/c", ("toneden", "https://toneden.io/c")), (False, True, "https://mega.nz/a", "(https://we.tl/b)", ("wetransfer", "https://we.tl/b")),
    (None, None, None, None, ("none", None)), (False, False, "", "https://beatport.com/1 https://bandcamp.com/2", ("store", "https://beatport.com/1")),
])
def test_download_kinds(spark, given, left, purchase, description, want):
    got = one(spark, urls.classify_download(F.lit("u"), F.lit(given).cast("boolean"), F.lit(left).cast("boolean"), F.lit(purchase).cast("string"), F.lit(description).cast("string")))
    assert (got.kind, got.link) == want


def test_keys(spark):
    assert one(spark, music.compatible_keys(F.lit(" 12b "))) == ["12B", "11B", "1B", "12A"] and one(spark, music.compatible_keys(F.lit("13A"))) is None
    assert [one(spark, music.camelot_distance(F.lit(a), F.lit(b))) for a, b in (("8A", "8A"), ("1A", "12B"), ("2A", "8A"), ("Am", "8A"))] == [0, 2, 6, None]
    pairs = [("12A", "1A"), ("1A", "12A"), ("8A", "8B"), ("8A", "10A"), ("10A", "8A"), ("8A", "11A"), ("8A", "3B"), (None, "8A"), ("8a", "8A"), ("8A", "9B")]
    assert [one(spark, music.camelot_relation(F.lit(a).cast("string"), F.lit(b))) for a, b in pairs] == ["neighbour", "neighbour", "relative", "plus2", "far", "plus3", "far", "unknown", "same", "far"]
    cost = lambda a, b, x, y: one(spark, music.transition_cost(F.lit(a).cast("string"), F.lit(x).cast("double"), F.lit(b), F.lit(y).cast("double")))
    assert [cost("8A", "9A", 150, 153.5), cost("8A", "8A", 150, 155), cost("8A", "8A", None, 155), cost("zz", "8A", 150, 150), cost("8A", "8B", 150, 154)] == [1.5, float("inf"), 1.0, 6.0, 2.5]


def test_tempo(spark):
    bpm = lambda title, tags=(), desc="": one(spark, music.estimate_bpm(F.lit(title), F.array(*map(F.lit, tags)) if tags else F.lit(None).cast("array<string>"), F.lit(desc)))
    assert [bpm("Song 155 BPM"), bpm("2155bpm"), bpm("x", ["160bpm"]), bpm("x", (), "y" * 595 + " 150 bpm"), bpm("150 bpms"), bpm("99 bpm 140bpm")] == [155.0, None, 160.0, None, None, 140.0]
    assert col_of(spark, music.bpm_bucket(V), "double", [154.9, 155.0, None]) == ["150-155", "155-160", "unknown-bpm"]
    assert col_of(spark, music.bpm_range_label(V), "double", [79.0, 170.0, 120.0, 200.0, 0.0, None, 155.0]) == ["155-160", "165-170", "140-145", "165-170", None, None, "155-160"]
    resolve = lambda audio, given=None, sure=None: tuple(one(spark, music.resolve_bpm(F.lit(audio).cast("double"), F.lit(given).cast("double"), (150.0, 165.0), confidence=F.lit(sure).cast("double"))))
    assert resolve(None, 150) == (150.0, "text") and resolve(0) == (None, "none") and resolve(79, 158) == (158.0, "audio near text") and resolve(100, 155) == (155.0, "text")
    assert resolve(155, 150, 0.9) == (155.0, "audio in window") and resolve(79.5) == (159.0, "audio in window") and resolve(70) == (140.0, "audio plausible") and resolve(110) == (110.0, "audio")


def test_phrases(spark):
    q = lambda e, kick=0.0, bpm=120.0, beats=None: one(spark, music.quantize_to_phrase(F.lit(e), F.lit(kick), F.lit(bpm), downbeats=beats))
    # At 120 a beat is half a second: 32 beats are 16 s, 1.75 beats 0.875 s.
    assert [q(16.8), q(8.5), q(12.0), q(12.9), q(5.0, 6.0), q(5.0, 0.0, 0.0), q(12.9, 0.0, 120.0, F.array(F.lit(13.1), F.lit(12.5)))] == [16.0, 8.0, 12.0, 12.0, 5.0, 5.0, 13.1]
    assert [one(spark, music.is_off_phrase(F.lit(e), F.lit(0.0), F.lit(120.0))) for e in (16.8, 12.0, -1.0)] == [False, True, False]
    assert one(spark, music.phrase_grid(F.lit(1.0), F.lit(120.0), F.lit(40.0))) == [1.0, 17.0, 33.0] and one(spark, music.phrase_grid(F.lit(1.0), F.lit(0.0), F.lit(40.0))) == []
    loop = one(spark, music.active_loop(F.lit(0.0), F.lit(120.0), F.lit(61.0)))
    assert (loop.start, loop.stop) == (52.0, 60.0)


def test_loudness(spark):
    gain = lambda lufs, peak: one(spark, music.gain_plan(F.lit(lufs).cast("double"), F.lit(peak).cast("double")))
    assert [gain(-6.0, None), gain(-10.0, None), gain(-10.0, -1.0), gain(-10.0, -6.0), gain(-8.6, -6.0), gain(None, 0), gain(-10.0, 1.0), gain(-8.4, 2.0)] == [-2.5, 0.0, 0.5, 1.5, 0.0, 0.0, 0.0, 0.0]
    tags = one(spark, music.loudness_tags(F.lit(-7.25), F.lit(-1.0), F.lit(None).cast("double")))
    assert tags["REPLAYGAIN_TRACK_GAIN"] == "-10.75 dB" and tags["REPLAYGAIN_TRACK_PEAK"] == "0.891251" and "LRA" not in tags and set(tags) == {"REPLAYGAIN_TRACK_GAIN", "REPLAYGAIN_TRACK_PEAK", "LUFS"}
    assert col_of(spark, music.rating_stars(V), "int", [0, 51, 128, 255, None, 26, 25]) == [0, 1, 3, 5, None, 1, 0]


def test_style(spark):
    assert col_of(spark, style.version_type(V), "string", ["Re-Edit", "Edition", "Bootleg Remix", "x (VIP)", "Tool", "Remix", "", None, "rework tool"]) == ["edit", "original", "bootleg", "vip", "tool", "remix", "original", "original", "rework"]
    tags = F.array(F.lit("Hard-Groove"), F.lit("acid"))
    assert one(spark, style.subgenre_by_keyword(F.lit("Terror"), tags)) == "hardgroove" and one(spark, style.subgenre_by_keyword(F.lit("303 Trip"))) == "acid" and one(spark, style.subgenre_by_keyword(F.lit("x"))) is None
    null = F.lit(None).cast("double")
    got = one(spark, style.classify(F.lit("Track"), F.array().cast("array<string>"), F.lit(156.0), null, F.lit(0.1), F.lit(0.7), F.lit(4000.0)))
    assert (got.subgenre, got.flow, got.aesthetic, got.confidence, got.energy, got.cluster, got.version) == ("neo", "horizontal", "melodic", 0.7, 5, "emotion", "original")
    got = one(spark, style.classify(F.lit("Donk Edit"), F.array().cast("array<string>"), null, F.lit(7.0), null, null, F.lit(1000.0)))
    assert (got.subgenre, got.flow, got.confidence, got.energy) == ("bounce", "vertical", 0.85, 1)
    made = lambda title, bpm: style.classify(F.lit(title), F.array().cast("array<string>"), bpm, null, null, null, null)
    assert one(spark, style.comment(made("Bounce It", F.lit(154.0)), F.lit(154.0), F.lit("5A"))) == "[Bounce] 154 BPM · 5A | Vertikal · ⚠️ Subbass-Phasengefahr!"
    assert one(spark, style.comment(made("Tribal Tool", F.lit(150.5)), F.lit(150.5), F.lit(None).cast("string"), False)) == "[TOOL] 150.5 BPM | 3-Deck Loop Tool"
    assert one(spark, style.compact_comment(made("Hardgroove", F.lit(155.0)), F.lit(155.0), F.lit("9A"), F.lit(45.0), F.lit(135.9), F.lit(-7.5))) == "[155|9A|Hardgroove|D1:0:45|D2:2:15|L-7.5]"
    assert one(spark, style.colour(made("Tool", null))) == "Blue" and one(spark, style.colour(made("Psy", null), True)) == "Purple" and one(spark, style.colour(made("x", null))) == "None"
    assert [one(spark, style.energy(F.lit(b).cast("double"), F.lit(-5.0), F.lit(2.0), F.lit("terror"), F.lit(3600.0))) for b in (None, 130.0, 165.0)] == [5, 5, 5]


def test_scoring(spark):
    now, t = F.lit(dt.datetime(2024, 1, 15)), lambda *a: F.lit(dt.datetime(*a))
    speed = lambda likes, at: one(spark, scoring.velocity(F.lit(likes).cast("long"), at, now))
    assert [speed(48, t(2024, 1, 14)), speed(5, t(2024, 1, 14, 23, 30)), speed(5, t(2024, 1, 16)), speed(0, t(2024, 1, 1)), speed(None, t(2024, 1, 1)), speed(3, F.lit(None).cast("timestamp_ntz"))] == [2.0, 5.0, 5.0, 0.0, 0.0, 0.0]
    fresh = lambda at: round(one(spark, scoring.recency(at, now)), 6)
    assert [fresh(t(2024, 1, 8)), fresh(t(2024, 1, 7, 12)), fresh(t(2023, 1, 1)), fresh(t(2024, 1, 16)), fresh(F.lit(None).cast("timestamp_ntz"))] == [0.5, 0.5, 0.0, round(1 + 1 / 14, 6), 0.0]
    spam = lambda r, li, c, *texts: one(spark, scoring.spam_reasons(F.lit(r).cast("long"), F.lit(li).cast("long"), F.lit(c).cast("long"), F.array(*[F.lit(x) for x in texts]) if texts else F.array().cast("array<string>"), ["Repost Exchange", "promo"]))
    assert spam(10, 3, 5) == ["reposts over 3x likes"] and spam(9, 0, 5) == [] and spam(50, 50, 1) == ["reposts without comments"] and spam(49, 49, 0) == [] and spam(None, None, None, "PROMO repost exchange") == ["promo: repost exchange"]
    delta = lambda *a: one(spark, scoring.reputation_delta(*[F.lit(x).cast("long") for x in a]))
    assert [delta(0, 0, 3, 0), delta(0, 0, 3, 1), delta(1, 1, 9, 0), delta(9, 0, 0, 0), delta(0, 0, 2, 0), delta(None, None, 3, None)] == [-15.0, 2.0, 7.0, 20.0, 0.0, -15.0]
    assert [one(spark, scoring.percent_change(F.lit(a), F.lit(b))) for a, b in ((205, 200), (3, 2), (1, 0), (1, 2))] == [2, 50, None, -50]
    notes = F.array(F.lit("Download failed: a"), F.lit("ok"), F.lit("Download failed: b"))
    why = lambda ok, reason, error, own: one(spark, scoring.rejection_reason(F.lit(ok).cast("boolean"), F.lit(reason).cast("string"), F.lit(error).cast("string"), own))
    assert [why(False, "bad", "e", notes), why(False, None, None, notes), why(True, None, "e", notes), why(None, None, None, notes), why(None, None, None, F.array().cast("array<string>"))] == ["bad", "quality check not passed", "e", "Download failed: b", None]


SEGMENTS = "array<struct<start: double, stop: double, label: string>>"


def test_segments(spark):
    rows = spark.createDataFrame([
        (1, [(60.0, 90.0, "Breakdown"), (0.0, 10.0, "silence"), (10.0, 60.0, "verse"), (90.0, 120.0, "drop"), (130.0, None, "Drop")], [0.5, 10.2, 11.0], 200.0), (2, [], [], 0.0), (3, None, None, None), (4, [(5.0, 9.0, "chorus")], [1.0], 100.0),
    ], f"id int, s {SEGMENTS}, b array<double>, d double")
    got = {r.id: r.c for r in rows.select("id", segments.cues(F.col("s"), F.col("b"), F.col("d")).alias("c")).collect()}
    c = got[1]
    assert (c.first_kick, c.drop, c.second_drop, c.breakdown, c.breakdown_kind, c.breakdown_ratio) == (10.2, 90.0, 130.0, 60.0, "silence", 0.15)
    assert [(m.name, m.time) for m in c.marks] == [("First Kick", 10.2), ("Drop", 90.0), ("Drop 2", 130.0), ("Breakdown", 60.0)]
    assert (got[2].first_kick, got[2].marks, got[3].marks, got[3].breakdown_ratio) == (0.0, [], [], 0.0) and (got[4].first_kick, got[4].drop) == (5.0, 5.0)
    plain = spark.createDataFrame([([(0.0, 10.0, "intro"), (10.0, 60.0, "main"), (60.0, 80.0, "breakdown"), (80.0, 110.0, "main"), (110.0, 120.0, "outro")],), ([],), ([(0.0, 5.0, "main")],)], f"s {SEGMENTS}")
    assert [(r.a, r.b) for r in plain.select(segments.drop_start(F.col("s")).alias("a"), segments.breakdown_ratio(F.col("s")).alias("b")).collect()] == [(80.0, 0.2), (None, 0.0), (None, 0.0)]
    n = F.lit(None).cast("double")
    pads = one(spark, segments.hot_cues(F.lit(120.0), F.lit(300.0), F.lit(1.0), F.lit(80.0), F.lit(160.0), F.lit(120.0), n, n, n))
    assert [(p.pad, p.name, p.time) for p in pads] == [(0, "Main Entry", 16.0), (1, "Late Entry", 48.0), (2, "Drop 1", 80.0), (3, "Breakdown", 120.0), (5, "Drop 2", 160.0), (6, "Snare Fill", 79.5), (7, "Outro", 268.0)]
    assert one(spark, segments.hot_cues(n, n, n, n, n, n, n, n, n)) == []
    assert [p.pad for p in one(spark, segments.plain_hot_cues(F.lit(1.0), n, F.lit(3.0), n))] == [0, 1]


def test_tracklists(spark):
    lines = ["[048] Artist - Title [Label - 001]", "# '''A''' - [[B|C]]", "* ?", "...", "== Tracklist ==", "[12:30] Only title", "Artist - ", "", "# [02] X - Y [Kube]", "id - id", "[[Category:Sets]]", "<!-- c -->A - B", "A - B [?]"]
    got = col_of(spark, tracklist.entry(V), "string", lines)
    plain = [None if r is None else (r.position, r.artist, r.title, r.label, r.catalogue, r.unknown) for r in got]
    assert plain == [(2880, "Artist", "Title", "Label", "001", False), (None, "A", "C", None, None, False), (None, "", "", None, None, True), None, None, (750, "", "Only title", None, None, False), (None, "", "Artist -", None, None, False), None, (120, "X", "Y", "Kube", None, False), (None, "", "", None, None, True), None, (None, "A", "B", None, None, False), (None, "A", "B", "?", None, False)]
    page = "intro\n== File ==\n| 2:05:00\n== Tracklist ==\n# A - B\n# C - D\n[[Category:X]]\n== More ==\n# E - F\n"
    assert one(spark, tracklist.section(F.lit(page))).split("\n") == ["# A - B", "# C - D", ""] and one(spark, tracklist.duration(F.lit(page))) == 7500
    assert one(spark, tracklist.section(F.lit("none"))) == "" and one(spark, tracklist.duration(F.lit("none"))) is None
