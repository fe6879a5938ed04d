"""Fill-in-middle by its definition over code points, whole and by chunks; units and sentinels of other kinds."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from crateflow.llm import infill

PIECES = ["a", "é", "日", "🙂", "<", "<P", "<S", "<M", "<P>", "<M>", "P>", "S>", " ", "\n", "word ", "e\u0301", "\x00"]


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def draw(doc_id):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]


def expected(doc_id, text, units=list):
    text = text or ""
    own, (h1, h2, h3, h4) = units(text), draw(doc_id)
    n = len(own)
    a, b = sorted([h1 % (n + 1), h2 % (n + 1)])
    if not text or any(s in text for s in infill.SENTINELS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    x, y, z = ("".join(p) for p in (own[:a], own[a:b], own[b:]))
    return (n, "spm", a, b - a, f"<S>{z}<P>{x}<M>{y}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{x}<S>{z}<M>{y}")


def odd_rows(texts, seed=1):
    rng = random.Random(seed)
    rows = list(enumerate(texts)) + [(1000 + k, "".join(rng.choice(PIECES[:8] + PIECES[10:]) for _ in range(rng.randint(0, 90)))) for k in range(200)]
    rows += [(2000 + k, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60)))) for k in range(100)]
    return rows + [(None, "null id, " * 20), (None, None), rows[0], rows[0], rows[40], (10**12, "x"), (-7, "<" * 50)]


@pytest.mark.parametrize("chunk", [7, 40, 1 << 20])
def test_rows_by_the_definition(spark, texts, nothing, chunk):
    rows = odd_rows(texts)
    docs = spark.createDataFrame([(*r, 1, "k", "f") for r in rows], "doc_id long, text string, n int, key string, form string")
    got = infill.fill_in_middle(docs, chunk=chunk, slice_bytes=500)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(i, *expected(i, t)) for i, t in rows], key=str)
    assert infill.fill_in_middle(nothing, chunk=chunk).count() == 0
    if chunk == 40:
        want = [(i, n, form, a, m, sha(out), sha(t or "")) for i, t in rows for n, form, a, m, out in [expected(i, t)]]
        assert sorted(map(tuple, infill.digest(got).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("unit,pattern", [("word", r"\A\s+|\S+\s*"), ("line", r"[^\n]*\n|[^\n]+\Z")])
def test_words_and_lines(spark, unit, pattern):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice(["a", "bc", " ", "  ", "\n", "\n\n", "日本", "\t"]) for _ in range(rng.randint(0, 40)))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = lambda t: re.findall(pattern, t, re.ASCII)
    want = sorted((i, *expected(i, t, cut)) for i, t in rows)
    for chunk in (16, 1 << 20):
        assert sorted(map(tuple, infill.fill_in_middle(docs, unit=unit, chunk=chunk).collect())) == want


def test_other_sentinels_and_shares(spark):
    marks = ("[prefix]", "[suffix]", "[middle]")
    rows = [(k, "[pre" * (k % 3) + "some text [" + "x" * k) for k in range(60)] + [(99, "a [middle] b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = infill.fill_in_middle(docs, sentinels=marks, rearranged=100, suffix_first=50).withColumn("again", infill.restored(F.col("output"), F.col("form"), marks))
    found = {r.doc_id: r for r in got.collect()}
    assert all(found[i].again == t for i, t in rows) and {r.form for r in found.values()} == {"plain", "psm", "spm"} and found[99].form == "plain"
    assert infill.fill_in_middle(docs, rearranged=0).where("form <> 'plain'").count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("ab", "bc", "x"), ("aba", "c", "d"), ("abc", "b", "x")):
        with pytest.raises(ValueError, match="sentinels"):
            infill.fill_in_middle(docs, sentinels=bad)
    with pytest.raises(ValueError, match="units are"):
        infill.fill_in_middle(docs, unit="page")


def test_chunk_maps_compose_associatively():
    own, text = infill.Automaton("word", infill.SENTINELS), "  one <S> two\n<M three é 日 <P> end".encode()
    whole = own.map_of(text)
    for k in (1, 2, 5, 9):
        parts = [text[i : i + k] for i in range(0, len(text), k)]
        entry, units, marked = own.compose([own.map_of(p) for p in parts])
        assert int(units[-1]) == whole["units"][0] and marked and own.map_of(parts[-1])["exits"][entry[-1]] == whole["exits"][0]
