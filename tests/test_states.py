"""Streams with state give what their batch twins give, in any split and over a restart."""

import datetime as dt
import random

import pytest

from crateflow.operators import trends
from crateflow.streaming import states

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def play(spark, tmp_path, rows, schema, cuts, build, restart=False):
    """Rows written as one file a split, read as a stream of one file a batch; with ``restart`` by a new
    query for every split, from the checkpoint."""
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "ck"))
    edges = [0, *cuts, len(rows)]
    found = []

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
        query = build(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()

    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        if a < b:
            spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").json(source)
            if restart:
                run()
    if not restart:
        run()
    found = spark.read.parquet(out)
    return sorted(map(tuple, found.collect()), key=str)


RUNS = "id long, mode string, ok boolean, found long"


@pytest.mark.parametrize("restart", [False, True])
def test_alarms(spark, tmp_path, restart):
    rng = random.Random(1)
    rows = [(k, rng.choice("ab"), rng.random() < 0.5, rng.choice([0, 3])) for k in range(60)]
    want = sorted(map(tuple, trends.alarms(spark.createDataFrame(rows, RUNS), 2).collect()), key=str)
    assert want and play(spark, tmp_path, rows, RUNS, [7, 8, 31], lambda s: states.alarms(s, 2), restart) == want


def test_availability(spark, tmp_path):
    rng = random.Random(2)
    schema = "sc_id long, at timestamp, kind string"
    rows = [(rng.randrange(5), T0 + dt.timedelta(minutes=k), rng.choice(["none", "none", "gate", "store", None])) for k in range(60)]
    want = sorted(map(tuple, states.availability_of(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert want and play(spark, tmp_path, rows, schema, [20, 41], states.availability) == want


def test_retries_with_timers(spark, tmp_path):
    rng = random.Random(3)
    schema = "sc_id long, at timestamp, ok boolean, error string"
    rows = [(rng.randrange(6), T0 + dt.timedelta(minutes=7 * k), rng.random() < 0.3, rng.choice(["e" * 400, "timeout", None])) for k in range(50)]
    rows += [(99, T0 + dt.timedelta(days=2), True, None), (99, T0 + dt.timedelta(days=2, minutes=1), True, None)]  # time goes on
    wait = dt.timedelta(minutes=30)
    twin = sorted(map(tuple, states.retries_of(spark.createDataFrame(rows, schema), 3, wait).collect()), key=str)
    got = play(spark, tmp_path, rows, schema, [9, 10, 33, 50], lambda s: states.retries(s, 3, wait), restart=True)
    assert got == twin and {r[2] for r in got} == {"pending", "failed", "done", "due"}
