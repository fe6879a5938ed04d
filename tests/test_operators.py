"""Operators on small tables with results worked out by hand or by plain loops."""

import datetime as dt
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crateflow.functions import music, text
from crateflow.operators import components, digest, fuzzy, library, merges, ranking, recordings, rules, scores, sets, taste, trends


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


# --- ranks and scores ---------------------------------------------------------------------
def test_percent_ranks_are_shares_of_values_not_above(spark):
    rng = random.Random(1)
    values = [rng.choice([None, 0.0, 0.5, 1.0, rng.random(), float(rng.randint(0, 5))]) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    known = [v for v in values if v is not None]
    got = {r.id: r.v_rank for r in ranking.percent_ranks(df, ["v"], ranges=7).collect()}
    for k, v in enumerate(values):
        assert got[k] is None if v is None else got[k] == pytest.approx(100 * sum(w <= v for w in known) / len(known))
    assert ranking.percent_ranks(df.limit(0), ["v"]).count() == 0
    clashing = df.selectExpr("id", "v AS value_", "-v AS rank_", "1 AS column_", "2 AS v")  # names that the work itself uses
    both = {r.id: (r.value__rank, r.rank__rank, r.v_rank) for r in ranking.percent_ranks(clashing, ["value_", "rank_", "v"], ranges=3).collect()}
    for k, v in enumerate(values):
        up, down = (None, None) if v is None else (pytest.approx(100 * sum(w <= v for w in known) / len(known)), pytest.approx(100 * sum(w >= v for w in known) / len(known)))
        assert both[k] == (up, down, 100.0)


def test_running_sum_of_missing_orders(spark):
    df = spark.createDataFrame([(None, 10), (None, 1), (3, 2), (1, 5)], "k int, n long")
    up = {(r.k, r.n): r.s for r in ranking.running_sum(df, "n", "k", "s", ranges=3).collect()}
    down = {(r.k, r.n): r.s for r in ranking.running_sum(df, "n", "k", "s", descending=True, ranges=3).collect()}
    assert (up[1, 5], up[3, 2]) == (11, 16) and {up[None, 10], up[None, 1]} in ({0, 10}, {0, 1}, {0, 10, 1})  # missing ones come first
    assert (down[3, 2], down[1, 5]) == (0, 2) and min(down[None, 10], down[None, 1]) == 7


def test_running_sum_and_eviction(spark):
    files = spark.createDataFrame([(k, 10 * k + 1) for k in range(100)], "id long, size long")
    got = {r.id: r.before for r in ranking.running_sum(files, "size", "id", "before", ranges=9).collect()}
    assert got == {k: sum(10 * j + 1 for j in range(k)) for k in range(100)}
    total, kept, gone = sum(10 * k + 1 for k in range(100)), 20_000, []
    for k in range(100):
        if total > kept:
            gone.append(k)
            total -= 10 * k + 1
    assert sorted(r.id for r in library.evict(files, kept).collect()) == gone


def test_scores_add_up(spark):
    now = dt.datetime(2024, 1, 15)
    items = spark.createDataFrame([
        (1, "A", "https://x/good", "t", 1000, 100, 50, 10, now - dt.timedelta(days=1), False), (2, "B ", "https://x/bad", "t", 1000, 50, 20, 5, now - dt.timedelta(days=2), True),
        (3, None, "https://x/c", "Promo Network", 1000, 10, 40, 0, now - dt.timedelta(days=20), False), (4, "A", "https://x/d", "t", 100, 99, 99, 99, now, False), (5, "c", "https://x/e", "t", 2000, 30, 10, 3, None, False),
    ], "id long, artist string, artist_url string, title string, plays long, likes long, reposts long, comments long, created_at timestamp_ntz, reference_hit boolean")
    reps = spark.createDataFrame([("a", 1, 0, 0, 0), ("b", 0, 0, 3, 0)], "artist_key string, likes long, downloads long, dislikes long, stars long")
    got = {r.id: r for r in scores.score(items, F.lit(now), reps, min_like_ratio=0.0, min_percentile=0.0).collect()}
    pool = {1: (0.1, 0.05, 100 / 24, 0.01, 13 / 14), 2: (0.05, 0.02, 50 / 48, 0.005, 12 / 14), 3: (0.01, 0.04, 10 / 480, 0.0, 0.0), 5: (0.015, 0.005, 0.0, 0.0015, 0.0)}
    extra = {1: 5.0, 2: 15.0 - 15.0, 3: -20.0, 5: 0.0}
    want = {}
    for k, f in pool.items():
        rank = [100 * sum(g[j] <= f[j] for g in pool.values()) / 4 for j in range(4)]
        want[k] = 0.35 * rank[0] + 0.25 * rank[1] + 0.2 * rank[2] + 0.1 * rank[3] + 10 * f[4] + extra[k]
    assert {k: r.score for k, r in got.items()} == pytest.approx(want)
    assert {k: r.percentile for k, r in got.items()} == {k: 100 * sum(v <= want[k] for v in want.values()) / 4 for k in want}
    assert 2 not in {r.id for r in scores.score(items, F.lit(now), blocked=("https://x/BAD/",), min_like_ratio=0.0, min_percentile=0.0).collect()}
    assert len(scores.score(items, F.lit(now), apply_filter=False).collect()) == 5
    for tags in ("array('x', 'The PROMO network', null)", "'[\"promo network\"]'"):  # phrases are searched in each tag by itself
        tagged = items.withColumn("tags", F.when(F.col("id") == 5, F.expr(tags)))
        assert {r.id for r in scores.score(tagged, F.lit(now), apply_filter=False).where("size(reasons) > 0").collect()} == {3, 5}
    apart = items.withColumn("tags", F.expr("array('promo', 'network')"))
    assert {r.id for r in scores.score(apart, F.lit(now), apply_filter=False).where("size(reasons) > 0").collect()} == {3}


def test_reputations_count_each_track_once(spark):
    tracks = spark.createDataFrame([("A", 5, "like", "archive"), ("a ", None, "like", "archive"), ("A", 0, None, "inbox"), ("A", None, None, "rejected"), ("A", None, "later", "archive"), ("", 3, None, None), (None, None, "like", None), ("B", None, "dislike", None)], "artist string, rb_rating int, feedback string, status string")
    votes = spark.createDataFrame([("b", "dislike"), ("B", "like"), ("C", "later"), (None, "like")], "artist string, value string")
    assert rows(scores.reputations(tracks, votes)) == [("a", 1, 1, 0, 5), ("b", 0, 1, 2, 0), ("c", 0, 0, 0, 0)]


# --- names ---------------------------------------------------------------------------------
TITLES = ["Dark Matter", "Dark Matter (VRTGO Edit)", "Dark Matter (Free DL)", "Solo", "Night Drive Part Two", "Night Drive", "Original Mix", "", None, "Acid Rain Storm", "Acid Storm", "Rain"]


def names_of(spark):
    return spark.createDataFrame([(k, ["Artist", "The Artist", None, "Other One"][k % 4], TITLES[k % len(TITLES)], 1000 * (200 + k)) for k in range(48)], "id long, artist string, title string, duration_ms long")


def test_name_join_of_common_words_is_that_of_all_pairs(spark):
    """Words that most names hold, names of one word and of many, copies; few pairs are compared."""
    rng = random.Random(6)
    hot = ["night", "club", "session", "live"]
    titles = [" ".join(["dj", *rng.sample(hot, rng.randint(1, 4)), *[f"u{rng.randrange(400)}" for _ in range(rng.randint(1, 6))]]) for _ in range(150)]
    titles += [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randint(13, 40))) for _ in range(25)] + [f"w{k}" for k in range(10)] + ["night", "dj", "night club", "dj night"] + titles[:10]
    titles += [t + " (Alpha Edit)" for t in titles[:8]] + ["w1 w2 w3 " + " ".join(f"z{k}" for k in range(30)), "w1 w2 w3"]
    names = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    keys = fuzzy.keyed(names, "id", None, "title")
    x, y = keys.select(F.col("id").alias("left_id"), F.col("key").alias("x")), keys.select(F.col("id").alias("right_id"), F.col("key").alias("y"))
    every = rows(x.crossJoin(y).where(text.names_match(F.col("x"), F.col("y"))), "left_id", "right_id")
    assert rows(fuzzy.matches(keys, keys), "left_id", "right_id") == every
    assert fuzzy.candidates(keys, keys).count() < 2.5 * len(every) < len(titles) ** 2 / 3


def test_fuzzy_join_finds_what_comparing_all_finds(spark):
    from crateflow.functions import text

    names = names_of(spark)
    keys = fuzzy.keyed(names, "id", "artist", "title")
    x, y = keys.select(F.col("id").alias("a"), F.col("key").alias("x")), keys.select(F.col("id").alias("b"), F.col("key").alias("y"))
    every = rows(x.crossJoin(y).where(text.names_match(F.col("x"), F.col("y"))), "a", "b")
    assert rows(fuzzy.matches(keys, keys), "left_id", "right_id") == every and len(every) > 48
    owned = dict(rows(fuzzy.owned(names.select("id", text.name_key(F.col("artist"), F.col("title")).alias("key")), keys.where("id < 5"))))
    assert owned[0] is True and len(owned) == 48 and False in owned.values()
    nameless = spark.createDataFrame([(99, None, "?")], "id long, artist string, title string")
    assert rows(fuzzy.owned(nameless.select("id", text.name_key(F.col("artist"), F.col("title")).alias("key")), keys)) == [(99, None)]


def test_duplicates_by_name_length_and_override(spark):
    tracks = spark.createDataFrame([(1, "Artist", "Dark Matter", 200_000), (2, "Artist", "Dark Matter", 0), (3, "Artist", "Dark Matter", 300_000), (4, "Nobody", "Nothing here", 1), (5, "Artist", "Dark Matter", 200_000)], "id long, artist string, title string, duration_ms long")
    collection = spark.createDataFrame([(10, "Artist", "Dark Matter", 206.0), (11, "Artist", "Dark Matter [Out Now]", 204.0), (12, "Artist", "Dark Matter", None)], "id long, artist string, title string, seconds double")
    overrides = spark.createDataFrame([(4, "already_in_collection"), (5, "not_duplicate")], "id long, override_type string")
    assert rows(fuzzy.duplicates(tracks, collection, overrides)) == [(1, 11, False), (2, 10, False), (3, 12, False), (4, None, True)]


def test_link_proposals(spark):
    records = spark.createDataFrame([(1, None, None, "/m/[9] Artist - Dark Matter.mp3", None), (2, "Artist", "Night Drive", "/m/x.mp3", " "), (3, "Artist", "Solo", "/m/y.mp3", "https://s"), (4, "X", "Unknown thing", "/m/z.mp3", "")], "id long, artist string, title string, path string, source_url string")
    candidates = spark.createDataFrame([(100, "Label", "Artist - Dark Matter", "u100"), (101, "Artist", "Night Drive", "u101"), (102, "Artist", "Night Drive", "u102"), (103, "Artist", "Dark Matter", "u103")], "id long, artist string, title string, url string")
    overrides = spark.createDataFrame([(103, "not_duplicate")], "id long, override_type string")
    found = fuzzy.proposals(records, candidates, overrides)
    assert rows(found, "record_id", "candidate_id", "overlap", "ambiguous") == [(1, 100, 3, False), (2, 101, 3, True)]
    assert dict(rows(fuzzy.apply_proposals(records, found, candidates), "id", "source_url")) == {1: "u100", 2: None, 3: "https://s", 4: None}


def test_digest(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    seen = spark.createDataFrame([(1, "https://www.sc.com/a/one/", "Artist - One Song", None, t(1)), (2, "https://sc.com/a/two", "(FREE DL) Artist - Two Song", None, t(2)), (3, "https://sc.com/three", "Three Song", "Own", t(3)), (4, "https://sc.com/four", "Four", "", t(4)), (5, "https://sc.com/five", "Artist - Five Song (VRTGO Edit)", None, t(5)), (6, "https://sc.com/six", "Artist - Two Song", None, t(6))], "id long, url string, title string, artist string, reported_at timestamp_ntz")
    tracks = spark.createDataFrame([(1, "/m/[4] x.mp3", "inbox", None, None, None, None), (2, "/m/b.mp3", "archive", None, "http://sc.com/A/One?x", "q", "q"), (3, "/m/Artist - Two Song.mp3", "adopted", None, None, "", ""), (4, "/m/c.mp3", "archive", 3, None, "zz", "yy"), (5, "/m/d.mp3", "archive", None, None, "Artist", "Five Song"), (6, "/m/e.mp3", "rejected", 5, None, "a", "b")], "id long, path string, status string, sc_id long, source_url string, artist string, title string")
    votes = spark.createDataFrame([(1, "like")], "sc_id long, value string")
    stores = spark.createDataFrame([(3, "https://store"), (4, "")], "sc_id long, purchase_url string")
    gates = spark.createDataFrame([(3, "https://gate", None), (5, "https://gate", t(9))], "sc_id long, gate_url string, done_at timestamp_ntz")
    snaps = spark.createDataFrame([(1, 1, 5, 6, 7, 8, t(1)), (2, 1, 9, 9, 9, 9, t(2)), (3, 1, 1, None, 1, 1, t(2))], "id long, sc_id long, plays long, likes long, reposts long, comments long, recorded_at timestamp_ntz")
    overrides = spark.createDataFrame([(6, "not_duplicate")], "sc_id long, override_type string")
    d = digest.rows(seen, tracks, votes, stores, gates, snaps, overrides)
    got = {r.sc_id: r for r in d.collect()}
    assert {k: (r.in_inbox, r.in_collection, r.download_kind) for k, r in got.items()} == {1: (False, True, "native"), 2: (False, True, "native"), 3: (False, True, "store"), 4: (True, False, "native"), 5: (False, False, "gate"), 6: (False, False, "stream")}
    assert (got[1].plays, got[1].likes, got[1].feedback, got[2].artist, got[3].artist, got[3].title, got[5].gate_url, got[3].gate_url) == (1, 0, "like", "Artist", "Own", "Three Song", "https://gate", None)
    ids = lambda df: [r.sc_id for r in df.collect()]
    assert sorted(ids(digest.search(d, status="open"))) == [5, 6] and ids(digest.search(d, kind="gate")) == [5] and sorted(ids(digest.search(d, feedback="none"))) == [2, 3, 4, 5, 6] and sorted(ids(digest.search(d, query="FREE"))) == [2]
    assert ids(digest.ordered(d)) == [6, 5, 4, 3, 2, 1] and ids(digest.ordered(d, "feedback")) == [1, 6, 5, 4, 3, 2] and ids(digest.ordered(d, "feedback", True)) == [1, 6, 5, 4, 3, 2]
    dated = spark.createDataFrame([(1, "2024-01-02"), (2, None), (3, "2024-01-01")], "sc_id int, reported_at string").selectExpr("sc_id", "reported_at", "false AS in_inbox", "false AS in_collection")
    assert ids(digest.ordered(dated, "date")) == [3, 1, 2] and ids(digest.ordered(dated, "date", True)) == [1, 3, 2]  # a row without a date comes last
    assert ids(digest.page(digest.ordered(d), 2, 1)) == [5, 4] and ids(digest.page(digest.ordered(d), -1)) == [] and len(ids(digest.page(d, 10**6))) == 6


# --- recordings ------------------------------------------------------------------------------
def plain_error(a, b):
    best = 1.0
    for off in range(-80, 81):
        x, y = a[max(off, 0) :], b[max(-off, 0) :]
        m = min(len(x), len(y))
        if m >= 50:
            best = min(best, sum(bin(p ^ q).count("1") for p, q in zip(x[:m], y[:m])) / (32 * m))
    return best


def test_recordings(spark):
    rng = np.random.default_rng(1)
    base = [rng.integers(0, 1 << 32, 130).tolist() for _ in range(4)]
    noisy = [v ^ (1 << int(rng.integers(0, 32))) for v in base[0]]
    prints = [(1, base[0], 200.0), (2, noisy, 203.0), (3, noisy[7:], 206.0), (4, base[1], 200.5), (5, base[0], 210.0), (6, [], 200.0), (7, base[2], None), (8, base[1][:40], 200.0), (9, base[0], 200.0)]
    table = spark.createDataFrame(prints, "id long, fingerprint array<long>, seconds double")
    want = {(a[0], b[0]): plain_error(a[1], b[1]) for a, b in itertools.permutations([p for p in prints if p[1] and p[2] is not None], 2) if abs(a[2] - b[2]) <= 3.0}
    want = {k: v for k, v in want.items() if v <= 0.15}
    got = {(r.a, r.b): r.errors for r in recordings.same(table, table).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert rows(recordings.groups(table)) == [(1, 1), (2, 1), (3, 1), (9, 1)]
    near = recordings.similar(table.where("id = 1"), table, top=2).collect()
    assert [(r.id, r.rank) for r in sorted(near, key=lambda r: r.rank)][0][1] == 1 and all(r.errors > 0.15 for r in near) and len(near) == 2
    coded = table.select("id", recordings.decode(recordings.encode("fingerprint")).alias("f"), "fingerprint").collect()
    assert all(list(r.f) == list(r.fingerprint) for r in coded)


def test_recordings_by_index_are_those_of_all_pairs(spark):
    """Copies shifted and spoilt up to the bound, silence of a third of the rows, and rows of silence alone."""
    rng = np.random.default_rng(3)
    prints = []
    for k in range(30):
        base = rng.integers(0, 1 << 32, int(rng.integers(60, 200)))
        prints.append((10 * k, base, 200.0 + k % 4))
        for j, share in enumerate((0.02, 0.1, 0.14)):
            spoilt = base.copy()
            for bit in range(32):
                spoilt ^= (rng.random(len(base)) < share).astype(np.int64) << bit
            prints.append((10 * k + j + 1, spoilt[int(rng.integers(0, 9)) :], 200.0 + k % 4 + 1))
        if k % 3 == 0:
            prints.append((10 * k + 5, np.concatenate([np.zeros(40, dtype=np.int64), rng.integers(0, 1 << 32, 60)]), 201.0))
    prints += [(1000 + k, np.zeros(60 + k, dtype=np.int64), 201.0) for k in range(5)] + [(2000, np.zeros(20, dtype=np.int64), 201.0)]
    table = spark.createDataFrame([(i, v.tolist(), s) for i, v, s in prints], "id long, fingerprint array<long>, seconds double")
    want = {(a[0], b[0]): e for a, b in itertools.permutations(prints, 2) if abs(a[2] - b[2]) <= 3 and (e := recordings._errors(a[1], b[1])) <= 0.15}
    assert all(recordings._errors(a[1], b[1]) == pytest.approx(plain_error(a[1].tolist(), b[1].tolist())) for a, b in zip(prints[::7], prints[1::7]))
    pairs = recordings.candidates(recordings.usable(table), recordings.usable(table), longest=8)
    assert pairs.count() < len(prints) ** 2 / 4
    got = {(r.a, r.b): r.errors for r in recordings.same(table, table).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    crowded = {(r.a, r.b) for r in pairs.collect()}
    assert want.keys() <= crowded  # lists that make no pairs lose none here: silence alone is compared by length


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 102), (200, 200)]
    found = dict(rows(components.components(spark.createDataFrame(links, "a long, b long"))))
    assert found == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100, 102: 100}


def test_cascade(spark):
    vectors = spark.createDataFrame([(1, 5, 0.123456)], "query_id long, id long, score double")
    prints = spark.createDataFrame([(1, 9, 0.2), (2, 8, 0.25)], "query_id long, id long, errors double")
    assert rows(recordings.similar_cascade(vectors, prints, spark.createDataFrame([(1,), (2,), (3,)], "query_id long"))) == [(1, 5, 0.1235, "embedding"), (2, 8, 0.75, "fingerprint"), (3, None, None, "none")]


# --- sets ---------------------------------------------------------------------------------------
def test_order_of_a_set(spark):
    from crateflow.functions import music

    pool = spark.createDataFrame([(1, k, k, key, bpm) for k, (key, bpm) in enumerate([("8A", 150.0), ("9A", 151.0), ("3B", 150.0), ("8A", 160.0), (None, 150.0), ("10A", 151.5), ("8B", None), ("9A", 161.0)])], "pool int, pos int, id int, key_camelot string, bpm double")
    ordered = sets.order(pool)
    got = [(r.segment, r.id) for r in sorted(ordered.collect(), key=lambda r: r.place)]
    assert sorted(i for _, i in got) == list(range(8)) and [s for s, _ in got] == sorted(s for s, _ in got)
    steps = rows(sets.transitions(ordered, pool), "kind", "cost", "warning", "place")
    assert len(steps) == 7 and all(c is not None and c <= 3.0 for k, c, _, _ in steps if k == "step") and all(c is None and w == "cut" for k, c, w, _ in steps if k == "cut")
    # The matrix of the grouped task is the column's.
    by_column = {(r.a, r.b): r.cost for r in sets.costs(pool).collect()}
    data = sorted(pool.collect(), key=lambda r: r.pos)
    import pandas as pd

    matrix = sets._matrix(pd.Series([r.key_camelot for r in data]), np.array([np.nan if r.bpm is None else r.bpm for r in data]))
    assert all(matrix[a, b] == by_column[a, b] for a, b in by_column) and music.RELATION_COST["far"] == 8.0
    fastest = {s: np.mean([data[i].bpm for t, i in got if t == s and data[i].bpm]) for s in {s for s, _ in got} if any(data[i].bpm for t, i in got if t == s)}
    assert list(fastest.values()) == sorted(fastest.values(), reverse=True)
    with pytest.raises(Exception, match="at most"):
        sets.order(spark.range(300).selectExpr("1 AS pool", "id AS pos", "id", "'8A' AS key_camelot", "150.0 AS bpm")).collect()


# --- rules ----------------------------------------------------------------------------------------
@pytest.mark.parametrize(("data", "word"), [({"x": 1}, "x"), ({"bpm_min": True}, "bpm_min"), ({"bpm_min": float("nan")}, "bpm_min"), ({"bpm_min": 150, "bpm_max": 140}, "bpm_min"), ({"taste_min": 2}, "taste_min"), ({"energy_min": 1.5}, "energy_min"), ({"keys": "8A"}, "keys"), ({"keys": ["13A"]}, "keys"), ({"tags_any": ["bad!"]}, "tags_any"), ({"duration_min": 0}, "duration_min"), ([], "rules"), ({"bpm_max": "150"}, "bpm_max")])
def test_rules_that_are_refused_name_their_key(data, word):
    with pytest.raises(rules.RuleError, match=word):
        rules.parse(data)


def test_rules_select_and_order(spark):
    tracks = spark.createDataFrame([(1, 150.0, " 8a ", 3, 0.9, 4, 200.0, None, "p0"), (2, None, "8A", 3, 0.9, 4, 200.0, "archive", "p0"), (3, 150.0, "10A", 5, None, None, 300.0, "archive", "p1"), (4, 150.0, "2A", None, 0.1, 1, None, "rejected", "p0"), (5, 150.0, "odd", 3, 0.5, 2, 100.0, "inbox", "p0"), (6, float("nan"), None, 1, 0.0, 0, 1.0, "inbox", "p0")], "id long, bpm double, key_camelot string, energy int, taste_score double, rb_rating int, duration double, status string, profile_id string")
    tags = spark.createDataFrame([(1, ["a", "b"]), (5, ["a"])], "id long, tags array<string>")
    ids = lambda data, **kw: [r.id for r in rules.select(tracks, rules.parse(data), tags=tags, **kw).collect()]
    assert ids({}) == [1, 3, 5, 6, 2] and ids({"bpm_min": 100}) == [1, 3, 5] and ids({"keys": ["8A"]}) == [1, 2] and ids({"tags_all": ["a", "b"]}) == [1] and ids({"tags_any": ["b", "a"]}) == [1, 5] and ids({"tags_any": ["a"], "rating_min": 3}) == [1]
    assert ids({"taste_min": 0.5, "energy_max": 3}, profile="p0") == [1, 5, 2] and ids({"bpm_max": None, "keys": []}, profile="p1") == [3]
    assert rules.parse({"keys": ["9b", "8A"], "bpm_min": 140}).to_json() == json.dumps({"bpm_min": 140.0, "keys": ["8A", "9B"]})
    assert rows(rules.overview(tracks, {"all": rules.parse({}), "fast": rules.parse({"bpm_min": 100, "energy_min": 3})})) == [("all", 0, 5), ("fast", 2, 3)]


# --- trends, retention, alarms -----------------------------------------------------------------
def snaps(spark, data):
    return spark.createDataFrame(data, "id long, sc_id long, artist string, title string, likes long, reposts long, comments long, tags string, recorded_at timestamp_ntz")


def test_growth_orders_by_time_then_id(spark):
    t = lambda d, s=0, us=0: dt.datetime(2024, 1, d, 0, 0, s, us)
    data = [
        (1, 1, "a", "x", 10, 1, 1, '["Techno", "acid"]', t(10, 11)), (2, 1, "a", "x", 15, 1, 1, "broken", t(10, 11, 500000)), (3, 1, None, "y", 5, 9, 9, None, t(1)), (4, 2, "b", "z", 100, 0, 0, '["techno"]', t(4)), (5, 2, "b", "z", 110, 0, 0, None, t(4)),
        (6, 3, "b", "w", 9, 0, 0, '["techno "]', t(4)), (7, 3, "b", "w", 90, 0, 0, '["acid", 5, "acid"]', t(5)), (8, 4, "c", "v", 50, 0, 0, "[]", t(5)), (9, 4, "c", "v", 40, 0, 0, None, t(6)),
    ]
    s = snaps(spark, data)
    assert rows(trends.track_growth(s, days=7), "sc_id", "delta", "rate") == [(1, 5, 0.5), (2, 10, 0.1)]
    assert [tuple(r) for r in trends.artist_growth(s, days=7).collect()] == [("b", 2, 109, 200, 91, 91 / 109)]
    # Track 1: 12 to 17 (techno, acid); track 2: 100 to 110 (techno); track 3: 9 to 90 (acid).
    assert [tuple(r) for r in trends.tag_trends(s, days=7).collect()] == [("acid", 2, 53.5, 86, 86 / 21), ("techno", 2, 63.5, 15, 15 / 112)]
    assert trends.track_growth(s.limit(0)).count() == 0


def test_retention_keeps_days_then_weeks(spark):
    days = [dt.date(2024, 3, 1) - dt.timedelta(days=k) for k in range(60)]
    kept = {r.day: r.keep for r in trends.retention(spark.createDataFrame([(d,) for d in days], "day date"), daily=3, weekly=2).collect()}
    old = days[3:]
    weeks = sorted({d.isocalendar()[:2] for d in old}, reverse=True)[:2]
    weekly = {max(d for d in old if d.isocalendar()[:2] == w) for w in weeks}
    assert kept == {d: "daily" if d in days[:3] else "weekly" if d in weekly else "drop" for d in days}


def test_alarms_once_and_recovery_once(spark):
    outcomes = [0, 0, 1, 0, 0, 0, 0, 1, 1, 0, 0, 0]
    runs = spark.createDataFrame([(k, "m", bool(k % 2) or o > 0, o) for k, o in enumerate(outcomes)], "id long, mode string, ok boolean, found long")
    active, want = False, []
    for k in range(len(outcomes)):
        last = outcomes[max(0, k - 2) : k + 1]
        if not active and len(last) == 3 and not any(last):
            active = True
            want.append((k, "m", "alarm"))
        elif active and outcomes[k]:
            active = False
            want.append((k, "m", "recovery"))
    assert rows(trends.alarms(runs, 3)) == sorted(want, key=str)


def test_kick_segments(spark):
    times = [10 + 0.4 * k for k in range(50)] + [60 + 0.4 * k for k in range(50)] + [200.0, 200.4]
    peaks = spark.createDataFrame([(1, round(t, 3)) for t in times] + [(2, 0.1 + 0.5 * k) for k in range(10)] + [(3, 1.0)], "track_id long, t double")
    durations = spark.createDataFrame([(1, 120.0), (2, 7.0), (3, 5.0)], "track_id long, duration double")
    got = {r.track_id: [(s.label, s.start, s.stop) for s in r.segments] for r in trends.kick_segments(peaks, durations).collect()}
    assert got == {1: [("intro", 0.0, 10.0), ("main", 10.0, 30.0), ("breakdown", 30.0, 60.0), ("main", 60.0, 80.0), ("outro", 80.0, 120.0)], 2: [("main", 0.0, 7.0)]}


# --- the library --------------------------------------------------------------------------------
def test_explorer(spark):
    tracks = spark.createDataFrame([(1, "b", "One", "/m/[7] a.mp3", 150.0, "8A", 0.1, 0.9, "archive", "ok", "x", None), (2, "A", "Two", "/m/b.mp3", None, "9A", None, None, "archive", None, None, 8), (3, None, "One b", "/m/c.mp3", 140.0, "8A", 0.5, 0.2, "inbox", "ok", None, None)], "id long, artist string, title string, path string, bpm double, key_camelot string, breakdown_ratio double, taste_score double, status string, quality_status string, adopted string, sc_id long")
    votes, counts = spark.createDataFrame([(7, "like"), (8, "later")], "sc_id long, value string"), spark.createDataFrame([(1, 7, 5, 6, 7, dt.datetime(2024, 1, 1))], "id long, sc_id long, likes long, reposts long, comments long, recorded_at timestamp_ntz")
    page, total = library.explore(tracks, votes, counts, sort="artist", limit=2)
    assert [(r.id, r.vote, r.counts and r.counts.likes) for r in page.collect()] == [(2, "later", None), (1, "like", 5)] and total.first().total == 3
    ids = lambda **kw: [r.id for r in library.ordered(library.track_filter(tracks, **kw)).collect()]
    assert ids(bpm_min=100) == [1, 3] and ids(most_breakdown=0.4) == [1] and ids(adopted=True) == [1] and ids(adopted=False) == [2, 3] and ids(query="ONE b") == [1, 3] and ids(status="inbox", key="8A") == [3]
    assert [r.id for r in library.ordered(tracks, "artist", True).collect()] == [1, 2, 3] and [r.id for r in library.ordered(tracks, "no such").collect()] == [1, 2, 3]


def test_neighbours_paths_and_duplicates(spark):
    rng = random.Random(8)
    some = lambda *v: rng.choice(v)
    data = [(k, 120.0 + rng.choice([0, 0.5, 1, 2.25, k % 9]), f"{k % 4 + 1}{'AB'[k % 2]}", some("a", "b", None), some("x", "y"), some("/m/p", "/m/q"), "archive" if k % 5 else "rejected", "ok" if k % 7 else "clipped") for k in range(150)]
    data += [(200, None, "8A", None, None, None, None, None), (201, 120.0, None, None, None, None, None, None), (202, 120.0, "none", None, None, None, None, None)]
    tracks = spark.createDataFrame(data, "id long, bpm double, key_camelot string, artist string, title string, path string, status string, quality_status string")

    def keys(k):
        if not k or k == "none":
            return []
        n, letter = int(k[:-1]), k[-1]
        return [k, f"{(n + 10) % 12 + 1}{letter}", f"{n % 12 + 1}{letter}", f"{n}{'B' if letter == 'A' else 'A'}"]

    def best(a, tolerance, limit):
        fits = [(keys(a[2]).index(b[2]), abs(a[1] - b[1]), b[3] or "", b[4] or "", b[5] or "", b[0]) for b in data if a[0] != b[0] and a[1] and b[1] and b[2] in keys(a[2]) and abs(a[1] - b[1]) <= tolerance and b[6] != "rejected" and b[7] not in library.POOR]
        return [(a[0], f[5], k + 1, f[0], f[1]) for k, f in enumerate(sorted(fits)[:limit])]

    for tolerance, limit in ((3.0, 30), (3.0, 2), (0.0, 5), (0.5, 1)):
        got = rows(library.harmonic_neighbours(tracks, tracks, tolerance, limit))
        assert got == sorted([r for a in data for r in best(a, tolerance, limit)], key=str)
    files = spark.createDataFrame([(1, "/m/[5] a.mp3", None, None), (2, "/m/x/[5] a_2.mp3", "8A", None), (3, "/m/x/[5] b.mp3", "8A", 150.0), (4, "/m/[6] c.mp3", None, None), (5, "/m/d.mp3", None, None)], "id long, path string, key_camelot string, bpm double")
    assert rows(library.duplicates_by_id(files)) == [(5, 1, False), (5, 2, False), (5, 3, True)]
    mapped = files.select("id", library.map_paths(files, {"/m": "C:/music", "/m/x": "D:\\x"}).alias("p")).collect()
    assert {r.id: r.p for r in mapped}[1] == "C:/music/[5] a.mp3" and {r.id: r.p for r in mapped}[2] == "D:/x/[5] a_2.mp3"
    assert files.where("id = 1").select(library.file_location(F.lit("C:/ä b+c~/d.mp3")).alias("x")).first().x == "file://localhost/C:/%C3%A4%20b%2Bc~/d.mp3"
    assert rows(library.path_or_name(spark.createDataFrame([(1, "/m/[6] c.mp3"), (2, "/z/d.mp3"), (3, "/z/e")], "id long, path string"), files)) == [(1, 4, "path"), (2, 5, "name"), (3, None, "none")]


# --- merges ---------------------------------------------------------------------------------------
def test_merges(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    now = spark.createDataFrame([("a", 1, "x", "like"), ("b", 2, "y", None)], "path string, bpm int, title string, feedback string")
    new = spark.createDataFrame([("a", None, "z"), ("c", 3, None)], "path string, bpm int, title string")
    assert rows(merges.upsert(now, new, ["path"])) == [("a", 1, "z", "like"), ("b", 2, "y", None), ("c", 3, None, None)]
    log = spark.createDataFrame([("a", 5, "p", 1), ("a", None, "q", 2)], "path string, bpm int, title string, at int")
    assert rows(merges.upsert(now, log, ["path"], kept=("title",), latest="at"))[0] == ("a", 5, "x", "like")
    assert rows(merges.fold_last(spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, "clear", 1), (2, "z", 1), (2, "w", 2), (3, "n", 1)], "k int, v string, at int"), "k", "at", "v")) == [(2, "w"), (3, "n")]
    used = merges.count_uses(spark.createDataFrame([("a", 2, 1, t(1))], "tag string, uses long, successes long, last_success timestamp_ntz"), spark.createDataFrame([("a", False, t(5)), ("b", True, t(3))], "tag string, success boolean, at timestamp_ntz"))
    assert rows(used) == [("a", 3, 1, t(1)), ("b", 1, 1, t(3))]
    jobs = spark.createDataFrame([(1, "cues", "running", None, "e", t(1)), (2, "embedding", "running", "r", None, t(1)), (3, "cues", "running", None, None, t(1) + dt.timedelta(minutes=31))], "id long, job_type string, status string, result string, error string, updated_at timestamp_ntz")
    assert [r[2] for r in rows(merges.requeue_stale(jobs, F.lit(t(1) + dt.timedelta(hours=1)), {"embedding": 120}))] == ["pending", "running", "running"]
    assert rows(merges.finish_jobs(jobs, spark.createDataFrame([(1, "done", None, None, t(2))], "id long, status string, result string, error string, at timestamp_ntz")))[0] == (1, "cues", "done", None, "e", t(2))
    tries = spark.createDataFrame([(1, t(1), False, "a"), (1, t(2), True, None), (1, t(3), False, "b" * 400), (2, t(1), False, "x"), (2, t(2), True, None), *[(3, t(k), False, str(k)) for k in range(1, 6)]], "sc_id long, at timestamp_ntz, ok boolean, error string")
    assert rows(merges.retries(tries)) == [(1, 1, "b" * 300, "pending"), (3, 5, "5", "failed")]
    daily = merges.daily_snapshots(spark.createDataFrame([(1, t(1), 5)], "sc_id long, recorded_at timestamp_ntz, likes int"), spark.createDataFrame([(1, t(1) + dt.timedelta(hours=3), 6), (1, t(2), 7), (1, t(2) + dt.timedelta(hours=1), 8), (2, t(1), 1)], "sc_id long, recorded_at timestamp_ntz, likes int"))
    assert [(r[0], r[2]) for r in rows(daily)] == [(1, 5), (1, 7), (2, 1)]
    with pytest.raises(ValueError, match="do not exist"):
        merges.add_tags(spark.createDataFrame([(1, "a")], "track_id long, tag string"), spark.createDataFrame([(9, "b")], "track_id long, tag string"), spark.createDataFrame([(1,)], "id long"))


def test_adoption_and_availability(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    tracks = spark.createDataFrame([(1, 7, "u", None, None), (2, 8, None, "dislike", None), (3, None, None, None, None)], "id long, sc_id long, source_url string, feedback string, adopted_at timestamp_ntz")
    adopted = spark.createDataFrame([(1, 3, t(5)), (2, 3, t(6))], "id long, archive_id long, adopted_at timestamp_ntz")
    assert rows(merges.adopt(tracks, adopted)) == [(1, 7, "u", "like", t(5)), (2, 8, None, "dislike", t(6)), (3, 7, "u", None, None)]
    watch = spark.createDataFrame([(1, t(1), t(1), "none", None), (2, t(1), t(1), "cloud", t(1)), (3, t(1), t(1), "none", None)], "sc_id long, first_checked timestamp_ntz, last_checked timestamp_ntz, last_kind string, available_at timestamp_ntz")
    asked, found = spark.createDataFrame([(1,), (3,), (4,), (5,)], "sc_id long"), spark.createDataFrame([(1, "store"), (4, "cloud")], "sc_id long, kind string")
    new, opened = merges.check_availability(watch, asked, found, F.lit(t(9)))
    assert rows(opened) == [(1, "store")]
    assert rows(new) == [(1, t(1), t(9), "store", t(9)), (2, t(1), t(1), "cloud", t(1)), (3, t(1), t(9), "none", None), (4, t(9), t(9), "cloud", t(9)), (5, t(9), t(9), "none", None)]
    votes = spark.createDataFrame([(1, "like"), (2, "like"), (7, "like"), (9, "later"), (10, "like")], "sc_id long, value string")
    assert sorted(r.sc_id for r in merges.watch_candidates(votes, tracks, watch, F.lit(t(9))).collect()) == [1, 10]
    assert sorted(r.sc_id for r in merges.watch_candidates(votes, tracks, watch, F.lit(t(9)), days=3).collect()) == [10]


# --- taste -----------------------------------------------------------------------------------------
def test_taste(spark):
    rng = np.random.default_rng(3)
    data = [(k, "m", (rng.normal(1.5 if k % 2 else -1.5, 1, 4)).tolist(), k % 2) for k in range(40)]
    labelled = spark.createDataFrame(data, "id long, model string, vector array<double>, label int")
    x, y = np.array([d[2] for d in data]), np.array([d[3] for d in data])
    own = taste.fit_arrays(x, y)
    z = (x - x.mean(axis=0)) / x.std(axis=0) @ np.array(own["weights"]) + own["bias"]
    model = taste.fit(labelled)
    got = {r.id: r.taste_score for r in taste.score(labelled.union(spark.createDataFrame([(90, "m", [1.0], 0), (91, "q", [1.0] * 4, 0), (92, "m", [float("nan")] * 4, 0)], labelled.schema)), model).collect()}
    assert [got[k] for k in range(40)] == pytest.approx((1 / (1 + np.exp(-z))).tolist()) and got[90] is None and got[91] is None and got[92] is None
    assert np.mean([(got[k] > 0.5) == bool(k % 2) for k in range(40)]) > 0.9
    assert taste.fit(labelled.where("label = 1")).count() == 0
    with pytest.raises(ValueError, match="at least"):
        taste.fit_arrays(x[:6], y[:6])


def test_taste_examples(spark):
    embedded = spark.createDataFrame([(k, "m" if k < 9 else "n", [1.0]) for k in range(1, 11)], "id long, model string, vector array<double>")
    tracks = spark.createDataFrame([(1, 11, "x", None, None), (2, 11, None, "dislike", None), (3, 13, None, "like", None), (4, 14, None, None, 4), (5, 15, None, None, 3), (6, 16, None, "later", None), (7, 17, None, "dislike", None), (8, 18, None, None, None), (9, 19, "x", None, None), (10, 20, None, None, None)], "id long, sc_id long, adopted string, feedback string, rb_rating int")
    votes = spark.createDataFrame([(18, "dislike"), (15, "later"), (16, "like")], "sc_id long, value string")
    assert rows(taste.examples(embedded, tracks, votes), "id", "label") == [(1, 1), (2, 1), (3, 1), (4, 1), (6, 1), (7, 0), (8, 0)]


def test_vectors_alike(spark):
    from crateflow.operators import vectors

    rng = np.random.default_rng(8)
    data = [(k, k % 2, rng.normal(0, 1, 4).round(1).tolist()) for k in range(60)] + [(60, 0, [0.0] * 4), (61, 0, [1.0]), (62, 0, None)]
    data[4] = (4, 0, data[2][2])
    rows_ = spark.createDataFrame(data, "id long, model int, vector array<double>")
    got = [(r.query_id, r.rank, r.id, r.score) for r in vectors.similar(rows_.where("id % 20 = 0"), rows_, top=3, cell_rows=30).collect()]
    want = []
    for q, m, v in data:
        if q % 20 == 0:
            scored = []
            for k, n, w in data:
                if k != q and n == m and w is not None and len(w) == len(v):
                    norm = np.linalg.norm(v) * np.linalg.norm(w)
                    c = round(float(np.dot(v, w) / norm), 6) if norm > 0 else 0.0
                    if c >= 0:
                        scored.append((-c, k))
            want += [(q, r + 1, k, -c) for r, (c, k) in enumerate(sorted(scored)[:3])]
    assert [(a, b, c, pytest.approx(d, abs=2e-6)) for a, b, c, d in sorted(want)] == sorted(got)


def test_names_meet_once_and_only_over_as_many_words_as_they_must_share(spark):
    """Names of five words that match share three; two that all of them share make no candidates."""
    names = spark.createDataFrame([(k, "red ring", f"a{k} b{k} c{k}") for k in range(60)] + [(100 + k, "red ring", f"z d{k} e{k}") for k in range(8)], "id long, artist string, title string")
    keys = fuzzy.keyed(names, "id", "artist", "title")
    found = rows(fuzzy.candidates(keys, keys))
    assert len(found) == len(set(found)) == 60 + 8 * 8
    own = keys.withColumn("side", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    got = rows(fuzzy.related(keys, own, "side"), "left_id", "side")
    assert set(got) == {(k, "odd" if k % 2 else "even") for k in range(60)} | {(100 + k, s) for k in range(8) for s in ("even", "odd")} and len(got) == 76


def test_phrase_places_half_way_between_bars_are_those_of_the_definition(spark):
    """Beats are seconds times tempo by 60, here a bar and a half exactly; seconds by the length of a beat lie beside it."""
    got = spark.range(1).select(music.quantize_to_phrase(F.lit(197.3), F.lit(0.5), F.lit(125.0)).alias("t")).first().t
    assert got == 196.34


def test_every_neighbour_without_a_limit(spark):
    tracks = spark.createDataFrame([(i, "8A", 140.0 + i % 2, "a", "t", "/p", "inbox", "ok") for i in range(40)] + [(90, "8A", 150.0, "a", "t", "/p", "inbox", "ok")], "id long, key_camelot string, bpm double, artist string, title string, path string, status string, quality_status string")
    got = rows(library.harmonic_neighbours(tracks, tracks, limit=None), "id", "next_id", "key_place", "bpm_gap")
    assert set(got) == {(a, b, 0, float((a + b) % 2)) for a in range(40) for b in range(40) if a != b} and len(got) == 40 * 39


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_upsert_holds_no_pairs_of_a_key(spark):
    """A full join gives the pairs of one key on only once it has them all."""
    old = spark.createDataFrame([("x", 1, "a"), ("x", 2, None), ("y", 3, "b")], "path string, bpm int, feedback string")
    new = spark.createDataFrame([("x", 7), ("x", None), ("z", 9), (None, 4)], "path string, bpm int")
    out = merges.upsert(old, new, ["path"])
    assert "FullOuter" not in _plan(out)
    assert set(rows(out)) == {("x", 7, "a"), ("x", 1, "a"), ("x", 7, None), ("x", 2, None), ("y", 3, "b"), ("z", 9, None), (None, 4, None)}


def test_paths_that_many_tracks_share_are_joined_last(spark):
    tracks = spark.createDataFrame([(1, "/a/x"), (2, "/a/x"), (3, "/b/x")], "id long, path string")
    out = library.path_or_name(spark.createDataFrame([(1, "/a/x"), (2, "/c/x"), (3, "/c/y")], "id long, path string"), tracks)
    assert set(rows(out)) == {(1, 1, "path"), (1, 2, "path"), (2, 1, "name"), (3, None, "none")}
    first = next(line for line in _plan(out).splitlines() if "Join LeftOuter" in line)
    assert "regexp_extract" not in first and " b#" not in first


def test_alarms_over_ranges_are_those_of_one_walk(spark):
    rng = random.Random(3)
    runs = [(i, f"m{i % 2}", rng.random() < (0.0 if 200 < i < 420 else 0.5), 1) for i in range(900)]
    df = spark.createDataFrame(runs, "id long, mode string, ok boolean, found int")
    want, streak = set(), {}
    for i, mode, ok, _ in runs:
        if ok and streak.get(mode, 0) >= 3:
            want.add((i, mode, "recovery"))
        streak[mode] = 0 if ok else streak.get(mode, 0) + 1
        if streak[mode] == 3:
            want.add((i, mode, "alarm"))
    out = trends.alarms(df, 3)
    assert set(rows(out, "id", "mode", "message")) == want
    assert all("range_" in line for line in _plan(out).splitlines() if "Window [" in line and "bad" in line)


def test_jobs_of_a_query_are_dealt_to_all_cores(spark):
    from crateflow.plans import registry

    plan = _plan(registry.queries()["job_outcomes"](spark, "/root/testdata/sf0.001"))
    assert "RepartitionByExpression [id#" in plan and f", {2 * spark.sparkContext.defaultParallelism}" in plan


def _tasks_that_make(df, least):
    """Partitions of ``df`` that hold ``least`` of its rows or more."""
    return df.groupBy(F.spark_partition_id().alias("p")).count().where(F.col("count") >= least).count()


def test_every_neighbour_is_made_on_all_cores(spark):
    """Tracks of one key and tempo: their pairs come from lists that are dealt out, not from one task's join."""
    tracks = spark.range(6000).select("id", F.lit("8A").alias("key_camelot"), F.lit(140.0).alias("bpm"), F.lit(None).cast("string").alias("status"), F.lit("ok").alias("quality_status"))
    odd = spark.createDataFrame([(None, "8A", 140.0, None, "ok"), (7000, "8A", None, None, "ok"), (7001, None, 140.0, None, "ok")], "id long, key_camelot string, bpm double, status string, quality_status string")
    out = library.harmonic_neighbours(tracks.union(odd), tracks.union(odd), limit=None)
    got = out.agg(F.count("*"), F.count_distinct("id"), F.sum("next_id"), F.min(F.col("id") != F.col("next_id")), F.max("bpm_gap")).first()
    assert tuple(got) == (6000 * 5999, 6000, 5999 * (5999 * 6000 // 2), True, 0.0)
    assert _tasks_that_make(out, 1_000_000) >= 8


def test_rows_of_a_shared_path_are_made_on_all_cores(spark):
    """Also with ids and paths that are missing: a track without an id is no match, an asked row without one stays."""
    tracks = spark.range(5000).select("id", F.lit("/a/x").alias("path")).union(spark.createDataFrame([(None, "/a/y"), (9, "/b/y"), (8, "/b/y"), (None, "/c/z"), (7, None)], "id long, path string"))
    asked = [(None, "/a/x"), (-1, "/a/y"), (-2, "/b/y"), (-3, "/d/y"), (-4, "/c/z"), (-5, None), (-6, "/c/no"), (None, "/d/y"), (None, "/d/y")]
    out = library.path_or_name(spark.range(4000).select((F.col("id") + 100).alias("id"), F.lit("/a/x").alias("path")).union(spark.createDataFrame(asked, "id long, path string")), tracks)
    few = rows(out.where("id < 0 or (id is null and match_id between 8 and 9 and how = 'name') or match_id is null"))
    assert few == sorted([(-1, 8, "name"), (-2, 8, "path"), (-2, 9, "path"), (-3, 8, "name"), (-4, None, "none"), (-5, None, "none"), (-6, None, "none"), (None, 8, "name"), (None, 8, "name")], key=str)
    many = out.where("how = 'path' and (id >= 0 or id is null)").agg(F.count("*"), F.count_if(F.col("id").isNull()), F.sum("id"), F.sum("match_id")).first()
    assert tuple(many) == (4001 * 5000, 5000, 5000 * sum(range(100, 4100)), 4001 * sum(range(5000)))
    assert _tasks_that_make(out, 1_000_000) >= 4


def test_changes_to_a_key_of_many_rows_are_made_on_all_cores(spark):
    """Every row of a key meets every change to it, equal ones as often as they stand; also where columns are maps."""
    old = spark.range(5000).select(F.lit("x").alias("path"), (F.col("id") % 3).cast("int").alias("bpm"), F.lit("t").alias("title"), F.when(F.col("id") % 2 == 0, "a").alias("feedback"))
    new = spark.range(6000).select(F.lit("x").alias("path"), F.when(F.col("id") % 6 == 0, 9).alias("bpm"), F.lit("u").alias("title"))
    more = spark.createDataFrame([("y", 5, "v"), ("y", 5, "v"), (None, None, "w")], "path string, bpm int, title string")
    out = merges.upsert(old, new.union(more), ["path"], kept=("title",))
    got = {tuple(r) for r in out.groupBy("path", "bpm", "title", "feedback").count().collect()}
    want = {("y", 5, "v", None, 2), (None, None, "w", None, 1), ("x", 9, "t", "a", 2500 * 1000), ("x", 9, "t", None, 2500 * 1000)}
    assert got == want | {("x", b, "t", f, sum(1 for i in range(5000) if i % 3 == b and (i % 2 == 0) == (f == "a")) * 5000) for b in range(3) for f in ("a", None)}
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are too large to be sent to all
    try:
        assert _tasks_that_make(merges.upsert(old, new.union(more), ["path"], kept=("title",)), 500_000) >= 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    maps = spark.createDataFrame([("x", {"k": 1}, 1), ("x", {"k": 1}, 1), ("z", None, 3)], "path string, m map<string, int>, n int")
    given = spark.createDataFrame([("x", {"k": 2}), ("x", None), ("w", {"k": 7})], "path string, m map<string, int>")
    assert rows(merges.upsert(maps, given, ["path"])) == sorted(2 * [("x", {"k": 2}, 1), ("x", {"k": 1}, 1)] + [("z", None, 3), ("w", {"k": 7}, None)], key=str)
