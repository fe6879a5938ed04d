"""Recordings at sizes that the plain way, all pairs by loops, still reaches."""

import itertools

import numpy as np

from crateflow.operators import components, recordings


def printed(spark, prints):
    return spark.createDataFrame([(i, v.tolist(), s) for i, v, s in prints], "id long, fingerprint array<long>, seconds double")


def all_pairs(prints):
    pairs = ((a, b, recordings._errors(a[1], b[1])) for a, b in itertools.permutations(prints, 2) if a[0] != b[0] and abs(a[2] - b[2]) <= 3)
    return {(a[0], b[0]): round(e, 9) for a, b, e in pairs if e <= 0.15}


def found(df):
    got = [((r.a, r.b), round(r.errors, 9)) for r in df.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


def written(spark):
    """Records written to shuffles so far."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_only_fingerprints_are_shuffled(spark):
    """No sampled values, 512 a row here, and no candidates."""
    rng = np.random.default_rng(5)
    table = printed(spark, [(k, rng.integers(0, 1 << 32, 64), 200.0 + k % 9) for k in range(300)])
    for run in (lambda: recordings.same(table, table), lambda: recordings.first_same(table.where("id >= 100"), table.where("id < 100")), lambda: recordings.groups(table)):
        before = written(spark)
        assert run().count() == 0
        assert written(spark) - before < 20 * 300


def test_silence_in_long_lists_links_rows_with_sound_of_their_own(spark):
    rng = np.random.default_rng(6)
    prints = [(k, np.concatenate([np.zeros(44, dtype=np.int64), rng.integers(0, 1 << 32, 8 + k)]), 200.0 + k % 5) for k in range(14)]
    want = all_pairs(prints)
    assert len(want) > 50
    table = recordings.usable(printed(spark, prints))
    assert want.keys() == {(r.a, r.b) for r in recordings.candidates(table, table, longest=8).collect()}


def test_cells_dealt_to_several_tasks_give_the_same_pairs(spark, monkeypatch):
    """Copies, shifted and spoilt ones, negative lengths, too short and missing ones, values beyond 32 bits."""
    rng = np.random.default_rng(7)
    prints = []
    for k in range(24):
        base = rng.integers(0, 1 << 32, int(rng.integers(60, 120)))
        prints += [(4 * k, base, -2.0 + 0.75 * k), (4 * k + 1, base, 0.75 * k), (4 * k + 2, base[int(rng.integers(0, 9)) :] ^ np.int64(1 << k), 0.75 * k + 1), (4 * k + 3, base + (np.int64(1) << 40), 0.75 * k - 1)]
    prints += [(200, prints[0][1][:49], -2.0), (201, prints[0][1][:50], -2.0)]
    table = printed(spark, prints).union(spark.createDataFrame([(202, prints[0][1].tolist(), None), (203, None, 0.0), (None, prints[0][1].tolist(), 0.0), (204, prints[0][1].tolist(), float("nan"))], "id long, fingerprint array<long>, seconds double"))
    want = all_pairs(prints)
    assert len(want) > 150
    for values in (1 << 21, 500):
        monkeypatch.setattr(recordings, "VALUES", values)
        assert found(recordings.same(table, table)) == want
        assert found(recordings.same_within(table)) == {k: e for k, e in want.items() if k[0] < k[1]}
        assert found(recordings.same(table.where("id < 40"), table.where("id % 4 = 1"))) == {k: e for k, e in want.items() if k[0] < 40 and k[1] % 4 == 1}
    assert recordings.same_within(table.limit(0)).count() == 0


def test_slices_of_a_cell_give_the_same_pairs(monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 32, (6, 64), dtype=np.uint32)
    values = np.concatenate([base, base ^ np.uint32(9), base[:, ::-1]]).ravel()
    n, got = 18, []
    for size in (1 << 20, 100):
        monkeypatch.setattr(recordings, "SLICE", size)
        side = recordings._Prints(values, np.arange(n + 1) * 64, np.zeros(n), np.arange(n), np.ones(n, dtype=bool), np.arange(n))
        for longest in (2000, 1):
            cell = recordings._Cell(side, side, True, 3.0, 0.15, longest, 80)
            got.append(sorted((int(p), int(q), float(e)) for part in cell.pairs() for p, q, e in zip(*part)))
    assert len(got[0]) == 6 and all(g == got[0] for g in got)


def test_links_to_themselves_and_both_ways(spark):
    links = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (5, 2)], "a long, b long")
    assert dict(components.components(links).collect()) == {1: 1, 2: 1, 5: 1}


def test_samples_leave_out_any_two_bits(spark):
    """Two recordings that differ in the same bits of every value, whichever they are."""
    assert all(m.bit_count() == 24 for m in recordings.MASKS)
    assert all(any(not m >> a & 1 and not m >> b & 1 for m in recordings.MASKS) for a, b in itertools.combinations(range(32), 2))
    base = np.random.default_rng(9).integers(0, 1 << 32, 64)
    prints = [(0, base, 200.0)] + [(1 + bit, base ^ np.int64(1 << bit), 200.0) for bit in range(32)]
    table = printed(spark, prints)
    assert found(recordings.same_within(table)) == {k: e for k, e in all_pairs(prints).items() if k[0] < k[1]}
