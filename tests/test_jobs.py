"""Jobs run in tasks, models over runs, sources that fail alone, the library file with its playlists."""

import json
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from crateflow.operators import jobs, merges, models, taste
from crateflow.sinks import files, tables
from crateflow.sources import collect


def handler():
    def run(payload):  # made here, so that tasks get it by value
        if payload["job_id"] == 4:
            raise RuntimeError("cannot decode")
        return {"twice": 2 * payload.get("x", 0), "job": payload["job_id"]}

    return run


work = handler()


def queue(spark, n=10):
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [(k, "cues", "pending", json.dumps({"x": k}), None, None, at) for k in range(n)]
    rows += [(100, "other", "pending", None, None, None, at), (101, "cues", "completed", "{}", "1", None, at), (102, "cues", "running", "[]", None, None, at), (103, "cues", "running", "{", None, None, datetime.now(timezone.utc))]
    return spark.createDataFrame(rows, jobs.JOBS)


def test_one_failing_job_of_ten(spark):
    table = queue(spark)
    chosen = jobs.next_pending(table, 10, "cues")
    running = jobs.claimed(table, chosen, F.current_timestamp())
    assert running.where("status = 'running'").count() == 12
    reports = jobs.run(running.join(chosen.select("id"), "id", "left_semi"), {"cues": work})
    rows = {r.id: r for r in reports.collect()}
    assert sorted(rows) == list(range(10)) and rows[4].status == "failed" and rows[4].error == "cannot decode" and rows[4].result is None
    assert all(rows[k].status == "completed" and json.loads(rows[k].result) == {"twice": 2 * k, "job": k} for k in rows if k != 4)
    assert all(r.started_at <= r.at for r in rows.values())
    done = {r.id: r.status for r in merges.finish_jobs(running, spark.createDataFrame(list(rows.values()), jobs.REPORT)).collect()}
    assert sum(s == "completed" for s in done.values()) == 10 and done[4] == "failed" and done[100] == "pending"


def test_outcomes_of_odd_jobs():
    assert jobs.outcome({"id": 1, "job_type": "x", "payload": None}, {}) == ("failed", None, "no handler for 'x'")
    assert jobs.outcome({"id": 1, "job_type": "x", "payload": "[1]"}, {"x": lambda p: p}) == ("completed", '{"job_id": 1}', None)
    assert jobs.outcome({"id": 1, "job_type": "x", "payload": '{"job_id": 7}'}, {"x": lambda p: p["job_id"]}) == ("completed", "7", None)
    assert jobs.outcome({"id": 1, "job_type": "x", "payload": "{}"}, {"x": lambda p: [][0]})[0] == "failed"


def test_rounds_over_a_stored_queue(spark, tmp_path):
    path = str(tmp_path / "jobs")
    tables.merge(queue(spark), 0, path, jobs.JOBS, ["id"], tables.upserts(["id"]))
    assert jobs.work_round(spark, path, 1, {"cues": work, "other": work}, most=6, parts=2) == 6
    state = lambda: {r.id: r.status for r in tables.read(spark, path, jobs.JOBS).collect()}
    first = state()
    assert [first[k] for k in range(6)] == ["completed"] * 4 + ["failed", "completed"] and first[6] == "pending"
    assert first[102] == "pending" and first[103] == "running"  # not heard of for long, and just now
    jobs.work_round(spark, path, 3, {"cues": work, "other": work}, parts=2)
    assert set(state().values()) == {"completed", "failed", "running"} and state()[102] == "completed"


def test_newest_model_of_a_profile(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3))
    y = (x[:, 0] > 0).astype(int)
    labelled = spark.createDataFrame([(k, "m", v.tolist(), int(t)) for k, (v, t) in enumerate(zip(x, y))], "id long, model string, vector array<double>, label int")
    fitted = taste.fit(labelled)
    rows = models.entries(fitted, "p", "2024-01-02").unionByName(models.entries(fitted, "q", "2024-01-02")).union(spark.createDataFrame([("p", "m", "2024-01-01", 1, "{"), ("q", "m", "2024-02-01", 9, '{"weights": [1], "bias": 0, "mean": [0], "std"'), ("r", "m", "2024-01-01", 3, '{"weights": [1, null], "bias": 0, "mean": [0, 0], "std": [1, 1]}')], models.ROWS))
    state = {r.profile_id: (r.trained_at, r.parameters is not None) for r in models.current(rows).collect()}
    assert state == {"p": ("2024-01-02", True), "q": ("2024-02-01", False), "r": ("2024-01-01", False)}
    embedded = labelled.select(F.explode(F.array(*map(F.lit, "pqrs"))).alias("profile_id"), "id", F.when(F.col("id") == 7, "other").otherwise(F.col("model")).alias("model"), "vector")
    got = {(r.profile_id, r.id): r.taste_score for r in models.scores(embedded, rows).collect()}
    plain = {r.id: r.taste_score for r in taste.score(labelled, fitted).collect()}
    assert all(got["p", k] == pytest.approx(plain[k]) for k in plain if k != 7) and got["p", 7] is None
    assert all(v is None for (p, _), v in got.items() if p != "p")
    tracks = embedded.select("profile_id", "id", F.lit(0.25).alias("taste_score"))
    after = {(r.profile_id, r.id): r.taste_score for r in models.rescored(tracks, embedded, rows).collect()}
    assert after["p", 7] is None and after["p", 3] == got["p", 3] and after["q", 3] == 0.25 and after["s", 3] == 0.25


@pytest.fixture
def pages(tmp_path):
    folder = tmp_path / "answers"
    folder.mkdir()
    put = lambda name, page: (folder / name).write_text(page if isinstance(page, str) else json.dumps(page), encoding="utf-8")
    for k in range(5):
        put(f"s{k} a.json", {"collection": [{"id": 10 * k + i, "title": "ä"} for i in range(3)], "next_href": f"s{k} b.json"})
        put(f"s{k} b.json", {"collection": [{"id": 10 * k + 5}], "next_href": None})
    put("s2 b.json", "{broken")
    put("limited.json", {"error": {"class": "rate_limit", "message": "429"}})
    put("round.json", {"collection": [{"id": 99}], "next_href": "round.json"})
    return str(folder)


def starts(spark, *paths):
    return spark.createDataFrame([(k, p.split(".")[0], p) for k, p in enumerate(paths)], "place int, source string, path string")


def test_one_broken_start_among_five(spark, pages):
    items, outcomes = collect.collect(collect.read_pages(spark, pages), starts(spark, *[f"s{k} a.json" for k in range(5)]))
    assert [(r.place, r.pos, json.loads(r.item)["id"]) for r in items.orderBy("place", "pos").collect()] == [(k, i, 10 * k + v) for k in (0, 1, 3, 4) for i, v in enumerate((0, 1, 2, 5))]
    rows = outcomes.orderBy("place").collect()
    assert [(r.status, r.items) for r in rows] == [("ok", 4), ("ok", 4), ("failed", 0), ("ok", 4), ("ok", 4)] and rows[2].error == "broken page: s2 b.json"


def test_an_aborting_error_ends_the_collection(spark, pages):
    items, outcomes = collect.collect(collect.read_pages(spark, pages), starts(spark, "s0 a.json", "nowhere.json", "round.json", "limited.json", "s1 a.json"), most_pages=3, limit=2)
    rows = outcomes.orderBy("place").collect()
    assert [r.status for r in rows] == ["ok", "failed", "ok", "failed", "not asked"] and rows[1].error == "missing page: nowhere.json" and rows[3].error == "rate_limit: 429"
    assert [(r.place, r.pos) for r in items.orderBy("place", "pos").collect()] == [(0, 0), (0, 1), (2, 0)]  # the third names itself as its next page


def test_pages_as_a_stream(spark, pages, tmp_path):
    def run():
        collect.stream_pages(spark, pages).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    run()
    run()  # nothing comes twice
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.path for r in rows if r.error) == ["limited.json", "s2 b.json"] and sum(r.item is not None for r in rows) == 5 * 3 + 4 + 1


def test_library_file_with_its_playlists(spark, tmp_path):
    at = datetime(2024, 1, 1)
    tracks = spark.createDataFrame([(k, f"/m/{k}.mp3", f"A & <{k}>", f"T{k}", 140.0 + k if k else None, f"{k + 1}A", 100.0, k, "archive", "ok", [("Drop", 1.5, 0)], at + timedelta(days=5 * k), "hard" if k % 2 else None) for k in range(6)],
        "id long, path string, artist string, title string, bpm double, key_camelot string, duration double, rb_rating int, status string, quality_status string, cues array<struct<name: string, time: double, pad: int>>, created_at timestamp_ntz, genre string")
    path = str(tmp_path / "library")
    files.write_library(tracks, {"/m": "C:/m"}, path)
    (part,) = [p for p in (tmp_path / "library").iterdir() if p.name.startswith("part")]
    import xml.etree.ElementTree as ET

    root = ET.fromstring(part.read_text(encoding="utf-8"))
    assert root.tag == "DJ_PLAYLISTS" and root.find("COLLECTION").get("Entries") == "6"
    assert [t.get("TrackID") for t in root.find("COLLECTION")] == [str(k) for k in range(6)] and root.find("COLLECTION")[2].get("Artist") == "A & <2>"
    assert root.find("COLLECTION")[3].find("POSITION_MARK").get("Start") == "1.500" and root.find("COLLECTION")[3].find("TEMPO").get("Bpm") == "143.00"
    assert [t.get("AverageBpm") for t in root.find("COLLECTION")][:2] == ["", "141.00"]
    tree = root.find("PLAYLISTS")[0]
    folders = {n.get("Name"): n for n in tree}
    assert tree.get("Name") == "ROOT" and tree.get("Count") == str(len(folders)) and list(folders) == ["week", "bpm", "key", "style"]
    want = {}
    for r in sorted(files.playlists(tracks).collect(), key=lambda r: (r.kind, r.sort, r.name, r.id)):
        want.setdefault(r.kind, {}).setdefault(r.name, []).append(str(r.id))
    for kind, node in folders.items():
        assert {n.get("Name"): [t.get("Key") for t in n] for n in node} == want[kind] and [n.get("Name") for n in node] == list(want[kind])
        assert node.get("Count") == str(len(node)) and all(n.get("Entries") == str(len(n)) for n in node)
    back = spark.read.format("xml").option("rowTag", "COLLECTION").option("inferSchema", "false").load(path).selectExpr("explode(TRACK) AS t").select("t._TrackID", "t._Name").collect()
    assert [(int(r._TrackID), r._Name) for r in back] == [(k, f"T{k}") for k in range(6)]
