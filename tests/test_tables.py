"""Merges into stored tables: the same table whatever is played again or stopped half-way."""

import json

import pytest
from pyspark.sql import functions as F

from crateflow.operators import rules
from crateflow.sinks import tables

TRACKS = "id long, title string, sc_id long, seen string"
ROUNDS = [
    [(1, "one", None, "a"), (2, "two", 7, "a")],
    [(2, None, 8, "b"), (3, "three", None, "b"), (40, "forty", None, "b")],
    [(1, "uno", 5, "c"), (3, None, None, "c")],
]


def table(spark, path, schema=TRACKS):
    return sorted(map(tuple, tables.read(spark, path, schema).collect()), key=str)


def expected(rounds):
    out = {}
    for rows in rounds:
        for i, title, sc, seen in rows:
            old = out.get(i, (None, None, None))
            out[i] = (title or old[0], old[1] if old[1] is not None else sc, seen or old[2])
    return sorted([(i, *v) for i, v in out.items()], key=str)


FOLD = tables.upserts(["id"], kept=("sc_id",))


def test_batches_played_again_change_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    assert table(spark, path) == []
    for k, rows in enumerate(ROUNDS):
        for _ in range(2):
            tables.merge(spark.createDataFrame(rows, TRACKS), k, path, TRACKS, ["id"], FOLD, buckets=4)
        assert table(spark, path) == expected(ROUNDS[: k + 1])
    assert not [p for p in tmp_path.iterdir() if "_next" in p.name]
    tables.merge(spark.createDataFrame([], TRACKS), 9, path, TRACKS, ["id"], FOLD, buckets=4)
    assert table(spark, path) == expected(ROUNDS)


def test_a_batch_stopped_half_way_is_finished(spark, tmp_path):
    """Counters, which a second reading of the same change would spoil."""
    schema, path = "tag string, uses long, successes long, last_success string", str(tmp_path / "c")
    events = spark.createDataFrame([(f"t{k % 9}", k % 2 == 0, f"2024-01-{1 + k % 20:02d}") for k in range(60)], "tag string, success boolean, at string")
    want = sorted(map(tuple, tables.uses(spark.createDataFrame([], schema), events).collect()))
    some = events.where(F.pmod(F.xxhash64("tag"), F.lit(4)) < 2)  # the buckets that were reached
    tables.merge(some, 0, path, schema, ["tag"], tables.uses, buckets=4)
    half = table(spark, path, schema)
    assert 0 < len(half) < 9
    tables.merge(events, 0, path, schema, ["tag"], tables.uses, buckets=4)
    assert table(spark, path, schema) == want


def test_a_stream_of_changes(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "t", "ck"))

    def run():
        changes = spark.readStream.schema(TRACKS).option("maxFilesPerTrigger", 1).json(source)
        changes.writeStream.foreachBatch(tables.merging(path, TRACKS, ["id"], FOLD, 4)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    for k, rows in enumerate(ROUNDS):
        spark.createDataFrame(rows, TRACKS).coalesce(1).write.mode("append").json(source)
        if k != 1:  # once two batches wait
            run()
    assert table(spark, path) == expected(ROUNDS)


def test_sightings_keep_the_first_time(spark, tmp_path):
    schema, path = "sc_id long, profile string, first_seen string, last_seen string, link string", str(tmp_path / "s")
    fold = tables.sightings(["sc_id", "profile"], "first_seen", "last_seen")
    for k, rows in enumerate([[(1, "p", "01", "01", "x")], [(1, "p", "05", "05", None), (1, "q", "05", "05", "y")], [(1, "p", "03", "03", "z")]]):
        tables.merge(spark.createDataFrame(rows, schema), k, path, schema, ["sc_id", "profile"], fold, buckets=3)
    assert table(spark, path, schema) == [(1, "p", "01", "05", "z"), (1, "q", "05", "05", "y")]


def test_smartlists_are_checked_and_replaced(spark, tmp_path):
    path = str(tmp_path / "l")
    tables.save_smartlist(spark, path, "p", "b", {"bpm_min": 150, "keys": ["8a"]}, "2024-01-01", 0)
    tables.save_smartlist(spark, path, "p", "A", {"tags_all": ["Peak  Time"]}, "2024-01-02", 1)
    tables.save_smartlist(spark, path, "q", "b", {}, "2024-01-02", 2)
    tables.save_smartlist(spark, path, "p", "b", {"energy_min": 3}, "2024-01-03", 3)
    assert [(r.name, json.loads(r.rules)) for r in tables.smartlists(spark, path, "p").collect()] == [("A", {"tags_all": ["peak time"]}), ("b", {"energy_min": 3})]
    with pytest.raises(rules.RuleError, match="keys"):
        tables.save_smartlist(spark, path, "p", "c", {"keys": ["99Z"]}, "2024-01-03", 4)
    with pytest.raises(ValueError, match="name"):
        tables.save_smartlist(spark, path, "p", " ", {}, "2024-01-03", 4)
