"""Periodic runs against their definition, and the query's figures against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from crateflow.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=6, exponent=4):
    """(start, length, period) of all runs, by the definition: every period, every maximal stretch."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, exponent * q):
                part = words[i : i + length]
                if not any(part[r:] == part[: length - r] for r in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("exponent", [2, 3, 4])
def test_runs_of_random_and_planted_words(exponent):
    rng = random.Random(exponent)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(0, 6)):
            n, kinds = rng.randint(0, 70), rng.choice([1, 2, 2, 3, 5, 30])
            w = [rng.randrange(kinds) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 10)
                w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
            docs.append(w)
        flat, offsets = np.array([x for d in docs for x in d], dtype=np.int64), np.concatenate([[0], np.cumsum([len(d) for d in docs], dtype=np.int64)]).astype(np.int64)
        got = [tuple(r) for r in runs.runs_of(flat, offsets, exponent=exponent).tolist()]
        assert got == [(k, *r) for k, d in enumerate(docs) for r in brute(d, exponent=exponent)]


def test_strings_rich_in_runs():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a  # Fibonacci words have runs of exponent below 4 only
    assert len(runs.runs_of(np.array(b), [0, len(b)])) == 0
    got = [tuple(r[1:]) for r in runs.runs_of(np.array(b), [0, len(b)], exponent=2).tolist()]
    assert got == brute(b, exponent=2) and len(got) > 50
    ones = np.zeros(5000, dtype=np.int64)
    assert runs.runs_of(ones, [0, 5000]).tolist() == [[0, 0, 5000, 1]]
    with pytest.raises(ValueError, match="two periods"):
        runs.runs_of(ones, [0, 5000], exponent=1)


def test_smaller_half_moves_each_position_seldom(monkeypatch):
    moves, linked = [], runs.Partition._link
    monkeypatch.setattr(runs.Partition, "_link", lambda self, members, group: (moves.append(len(members)), linked(self, members, group)))
    rng, n = np.random.default_rng(2), 1 << 13
    block = rng.integers(0, 4, n // 8)
    runs.runs_of(np.tile(block, 8), [0, n])
    assert sum(moves) <= n * 14  # a constant number of rounds over all positions would need n // 4 of them


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute(words)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    figures = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(found), *figures, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def odd_rows(texts):
    rng = random.Random(11)
    rows = [(k, t) for k, t in enumerate(texts)]
    for k in range(len(rows), len(rows) + 250):
        rows.append((k, " ".join(rng.choice(["a", "b", "Ä日", "c\u00a0d"]) + rng.choice(["", "\t", "\n "]) for _ in range(rng.randint(0, 90)))))
    return rows + [(None, "x y " * 30), (None, None), rows[3], rows[3], (10**12, "only"), (-5, " \t\n")]


def test_query_rows_by_brute_force(spark, texts, nothing):
    rows = odd_rows(texts)
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, runs int, collapsed string")
    got = runs.report(runs.collapsed(docs, plant=True, slice_bytes=3000)).collect()
    want = sorted([(i, *expected(i, t)) for i, t in rows], key=str)
    assert sorted([tuple(r) for r in got], key=str) == want
    assert any(r[1] for r in want) and any(not r[1] for r in want)
    assert got[0].__fields__ == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert runs.report(runs.collapsed(nothing)).count() == 0


def test_collapsed_text_keeps_one_period(spark):
    docs = spark.createDataFrame([(1, "a  b\tc " * 5 + "end"), (2, "plain words  here")], "doc_id long, text string")
    got = {r.doc_id: (r.collapsed, [tuple(x) for x in r.runs]) for r in runs.collapsed(docs).collect()}
    assert got == {1: ("a b c end", [(0, 15, 3)]), 2: ("plain words here", [])}
