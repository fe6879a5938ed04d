"""Measures of sample series by plain loops over whole arrays, whatever blocks they are cut into."""

import random

import numpy as np
import pytest

from crateflow.operators import samples

RATE, FRAME, HOP = 100.0, 40, 20
SECONDS = HOP / RATE


def tracks(seed=1):
    rng = np.random.default_rng(seed)
    out = {}
    for k in range(6):
        n = int(rng.integers(300, 2500))
        x = rng.integers(-9, 10, n).astype(float)
        for _ in range(3):
            a = int(rng.integers(0, n))
            x[a : a + int(rng.integers(50, 700))] *= 0.0 if k % 2 else 0.25
        out[k] = x
    return out | {10: np.zeros(500), 11: np.ones(30), 12: np.zeros(0), 13: np.full(700, 3.0)}


@pytest.fixture(scope="module")
def series():
    return tracks()


def cut(spark, series, size):
    rows = [(k, x.tolist()) for k, x in series.items()] + [(None, [1.0] * 90), (14, None)]
    return samples.blocks(spark.createDataFrame(rows, "track_id long, samples array<double>"), size)


def envelope(x):
    return [round(float((x[a : a + FRAME] ** 2).sum()), 9) for a in range(0, len(x) - FRAME + 1, HOP)]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", [7, 64, 10**6])
def test_loudest_window_and_envelope(spark, series, size):
    parts = cut(spark, series, size)
    want = []
    for k, x in series.items():
        best = (0, None)
        if len(x) >= 170:
            starts = sorted({*range(0, len(x) - 169, 50), len(x) - 170})
            sums = [round(float((x[a : a + 170] ** 2).sum()), 9) for a in starts]
            best = (starts[int(np.argmax(sums))], max(sums))
        if len(x):
            want.append((k, *best))
    key = lambda r: r[:2]
    assert sorted(rows(samples.loudest(parts, 170, 50)), key=key) == [pytest.approx(w, abs=1e-8) for w in sorted(want, key=key)]
    frames = [(k, i, e) for k, x in series.items() for i, e in enumerate(envelope(x))]
    assert sorted(rows(samples.envelope(parts, FRAME, HOP)), key=key) == [pytest.approx(w, abs=1e-8) for w in sorted(frames, key=key)]
    assert samples.loudest(parts.limit(0), 170, 50).count() == 0
    with pytest.raises(ValueError, match="a sample at least"):
        samples.loudest(parts, 0, 5)


def quiet_stretches(energy, share, least):
    peak, out, i = max(energy, default=0.0), [], 0
    while i < len(energy):
        j = i
        while j < len(energy) and energy[j] < share * peak:
            j += 1
        if j > i and i > 0 and j < len(energy) and (j - 1 - i) * SECONDS >= least:
            out.append((i, j - 1))
        i = max(j, i + 1)
    return out


@pytest.mark.parametrize("frames", [3, 4096])
def test_pauses_drops_and_first_kicks(spark, series, frames, monkeypatch):
    monkeypatch.setattr(samples, "FRAMES", frames)  # stretches over many pieces, or inside one
    parts = cut(spark, series, 128)
    env = samples.envelope(parts, FRAME, HOP)
    energies = {k: envelope(x) for k, x in series.items()}
    pauses = [(k, *p) for k, e in energies.items() for p in quiet_stretches(e, 0.3, 0.6)]
    assert pauses and rows(samples.pauses(env, SECONDS, share=0.3, least=0.6)) == sorted(pauses, key=str)
    kicks = [(k, round(next(i for i, v in enumerate(e) if v >= 0.5 * max(e)) * SECONDS, 3)) for k, e in energies.items() if e and max(e) > 0]
    assert rows(samples.first_kicks(env, SECONDS)) == sorted(kicks, key=str)
    if frames == 3:
        return
    rng = random.Random(4)
    asked = [(k, round(rng.random() * len(x) / RATE, 2)) for k, x in series.items() for _ in range(3)] + [(0, 0.0), (None, 1.0), (1, None)]
    beats = [(k, round(rng.random() * len(x) / RATE, 2)) for k, x in series.items() for _ in range(8)] + [(2, None)]

    def drop(k, s, own):
        e, peak = energies[k], max(energies[k], default=0.0)
        if not peak:
            return None
        t = [i * SECONDS for i in range(len(e))]
        hit = None
        for b in sorted(own):
            near = [v for at, v in zip(t, e) if abs(at - b) <= 0.15]
            if s <= b <= s + 2.0 and near and max(near) >= 0.75 * peak:
                hit = (b, max(near))
                break
        if hit is None:
            hit = next(((at, v) for at, v in zip(t, e) if s <= at <= s + 2.0 and v >= 0.75 * peak), None)
        if hit is None:
            return None
        late = hit[0] - s > 0.1
        return (k, s, round(hit[0], 3), round(hit[1] / peak, 4), late, round(hit[0] - s, 3) if late else 0.0)

    searches, downs = spark.createDataFrame(asked, "track_id long, searched double"), spark.createDataFrame(beats, "track_id long, beat double")
    valid = sorted({(k, s) for k, s in asked if k is not None and s is not None})
    for own in (None, downs):
        by = {k: [b for i, b in beats if i == k and b is not None] if own is not None else [] for k in series}
        want = [d for k, s in valid if (d := drop(k, s, by[k]))]
        assert rows(samples.drops(env, searches, own, SECONDS, within=2.0)) == [pytest.approx(w) for w in sorted(want, key=str)] and want


def test_breakdown_kinds(spark, series):
    rng = random.Random(5)
    spans = sorted({(k, *sorted((round(rng.random() * len(x) / RATE, 2), round(rng.random() * len(x) / RATE, 2)))) for k, x in series.items() for _ in range(6)}) + [(0, -1.0, 2.0), (0, 3.0, 2.0), (1, 1000.0, 1001.0), (99, 0.0, 1.0), (2, 0.5, 1e4)]

    def kind(k, a, b):
        x = series.get(k, np.zeros(0))
        own = x[int(a * RATE) : min(len(x), int(b * RATE))] if a >= 0 and b > a else x[:0]
        whole = float(np.sqrt((x**2).mean())) if len(x) else 0.0
        r = float(np.sqrt((own**2).mean())) / whole if len(own) and whole else 0.0
        return (k, a, b, "groove" if r >= 0.15 else "silence", round(r, 4))

    df = spark.createDataFrame(spans, "track_id long, start double, stop double")
    want = sorted([kind(*s) for s in spans], key=str)
    for size in (50, 10**6):
        got = rows(samples.breakdown_kinds(cut(spark, series, size), df, RATE, size))
        assert [g[:4] for g in got] == [w[:4] for w in want] and [g[4] for g in got] == pytest.approx([w[4] for w in want], abs=1e-4)


def test_report_puts_them_together(spark):
    x = np.concatenate([np.ones(1000), np.zeros(1000), np.full(200, 0.5), np.ones(800)])
    parts = cut(spark, {1: x}, 256)
    quiet, drops, kicks = samples.stem_report(parts, parts, None, RATE, FRAME, HOP, 256)
    (q,), (d,), (k,) = quiet.collect(), drops.collect(), kicks.collect()
    assert (q.kind, q.start, q.ratio) == ("silence", 10.0, 0.0) and 19 < q.stop < 20
    assert d.searched == q.stop and d.corrected and d.start == pytest.approx(21.9, abs=0.3) and k.first_kick == 0.0


@pytest.mark.parametrize("wait", [0, 4, 30])
def test_kicks_by_a_plain_walk(spark, series, wait):
    env = samples.envelope(cut(spark, series, 97), FRAME, HOP)
    want = []
    for track, x in series.items():
        e = envelope(x)
        rise = [0.0] + [max(0.0, b - a) for a, b in zip(e, e[1:])]
        last = None
        for k, r in enumerate(rise):
            part = rise[max(0, k - 3) : k + 3]
            if r > 0 and r == max(part) and r >= sum(part) / len(part) + 0.15 * max(rise) and (last is None or k - last > wait):
                want.append((track, k * SECONDS))
                last = k
    got = sorted(rows(samples.kicks(env, SECONDS, wait=wait)))
    assert len(want) > 5 and [g[0] for g in got] == [w[0] for w in sorted(want)] and [g[1] for g in got] == pytest.approx([w[1] for w in sorted(want)])
