"""Operators whose results are exact, against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from crateflow.llm import bpe, components, fingerprints, licenses, mixing, ngram_join, repair, shingles, topk


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def alike(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def least_reachable(sets):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if alike(sets[a], sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


def test_join_finds_all_links(spark, docs, texts):
    sets = {k: shingle_set(t) for k, t in enumerate(texts)}
    want = least_reachable(sets)
    got = ngram_join.link_classes(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id == want[4]
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])


def test_join_of_chains_and_of_sets_at_the_limit(spark):
    words = [f"w{k}" for k in range(400)]
    rows = [(10 * g + j, " ".join(words[20 * g + j : 20 * g + j + 30])) for g in range(8) for j in range(10)]
    sets = {i: shingle_set(t) for i, t in rows}
    want = least_reachable(sets)
    got = ngram_join.link_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_keep_one_keeps_every_column_and_one_of_each_group(docs, texts):
    want = set(least_reachable({k: shingle_set(t) for k, t in enumerate(texts)}).values())
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(90, 80), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {k: 0 for k in range(41)} | {80: 80, 90: 80}
    assert components.components(links.limit(0)).count() == 0


def test_shingle_hashes_tell_sets_apart(texts):
    for text, own in zip(texts, shingles.distinct_sets(texts), strict=True):
        assert len(own) == len(shingle_set(text))


@pytest.fixture(scope="session")
def tiktoken_encoding():
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def test_bpe_gives_the_librarys_ids_and_texts_back(docs, texts, tiktoken_encoding):
    encoding, _ = tiktoken_encoding
    for r in bpe.encode_documents(docs).collect():
        text = texts[4 if r.doc_id is None else r.doc_id] or ""
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == encoding.encode_ordinary(text)
        assert bytes(r.decoded).decode() == text and r.n_tokens == len(r.ids) // 4


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 64])
def test_bpe_does_not_depend_on_the_tree(texts, tiktoken_encoding, leaf):
    import public_tokenizers

    encoding, ranks = tiktoken_encoding
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN, leaf_chars=leaf, leaf_bytes=leaf)
    for text in [t for t in texts if t and len(t) < 2000] + ["  \n\n  x", "I'll 's ''s", "1234567 \r\n", "  "]:
        assert codec.encode(text).tolist() == encoding.encode_ordinary(text)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 16)).round(2)
    x[10], x[11] = x[12], x[12]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (1000, [1.0, None]), (1100, [float("nan")] * 16), (None, [1.0] * 16), (200, x[5].tolist())]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell_rows=128, query_rows=3).collect()
    whole = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    want = []
    for q, (i, v) in enumerate(whole):
        if i % 100 == 0 and (i, min((w.tolist() for j, w in whole if j == i))) == (i, v.tolist()):
            scores = sorted((-int(v @ w), j) for j, w in whole if j != i)
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scores[:10])]
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got)
    assert sorted(want) == found


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_files_give_the_librarys_ids_back(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 2] for k, t in enumerate(texts)}
    start = 0
    got = repair.read(repair.write(docs, shard_ids=500)).collect()
    assert len(got) == docs.count()
    for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.start)):
        own = ids[4 if r.doc_id is None else r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)


@pytest.mark.parametrize(("weights", "block"), [({"a": 1009, "b": 661, "c": 331}, 1), ({"a": 1000, "b": 1}, 1), ({"a": 3, "b": 7, "c": 11}, 1), ({"a": 6, "b": 2, "c": 2}, 4)])
def test_mix_differs_from_its_weights_by_less_than_a_block(spark, weights, block):
    total = sum(weights.values())
    rows = [(k, "t", s) for s, w in weights.items() for k in range(12_000 * w * block // total + block)]
    docs = spark.createDataFrame([(k, t, s) for k, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string")
    found = mixing.schedule(docs, weights, block_docs=block).select("source", "slot", "block", "release", "deadline", "position", "doc_id").collect()
    assert len({r.position for r in found}) == len(rows) and sorted(r.doc_id for r in found) == list(range(len(rows)))
    assert all(r.release <= r.slot < r.deadline for r in found)
    by_slot = {r.slot: r.source for r in found}
    assert len({(r.slot, r.source, r.block) for r in found}) == len(by_slot)
    # Until the first source has run out.
    end, seen = min(max(r.slot for r in found if r.source == s) for s in weights), dict.fromkeys(weights, 0)
    assert end > 10_000
    for t in range(end):
        seen[by_slot[t]] += 1
        assert all(abs(seen[s] * total - w * (t + 1)) < total for s, w in weights.items())


def test_weights_whose_period_is_too_long_are_refused(spark, docs):
    many = docs.sparkSession.range(3000).selectExpr("id AS doc_id", "'t' AS text", "concat('s', id % 2) AS source")
    with pytest.raises(ValueError, match="at most"):
        mixing.schedule(many, {"s0": 10**9 + 7, "s1": 1}, block_docs=1)


def test_default_weights_are_exact_square_roots():
    small = mixing._weighed([("=a", 10), ("=b", 16), ("", 1)], None)
    assert [w for _, _, w in small] == [4, 4, 1]
    large = mixing._weighed([("=big", 10**13), ("=light", 1)], None)
    assert [w for _, _, w in large] == [3162278, 1]  # a light source is not raised by coarser units
    assert [w for _, _, w in mixing._weighed([("=a", 5), ("", 5)], {"a": 3, None: 2})] == [3, 2]


def test_repeated_documents_are_joined_once(spark):
    """A doc_id that comes thousands of times, with one text and with another that links."""
    words = [f"w{k}" for k in range(60)]
    text, near = " ".join(words), " ".join([*words[:-1], "other"])
    docs = spark.range(3000).selectExpr("7 AS doc_id", f"'{text}' AS text").union(spark.range(40).selectExpr("7 AS doc_id", f"'{near}' AS text")).union(spark.createDataFrame([(3, near), (9, text), (11, "one two")], "doc_id long, text string"))
    found = ngram_join.link_classes(docs).groupBy("doc_id", "component_id").count().collect()
    assert sorted(map(tuple, found)) == [(3, 3, 1), (7, 3, 3040), (9, 3, 1), (11, 11, 1)]


def test_mix_of_one_heavy_and_many_light_sources(spark):
    rows = [(k, "t", "heavy" if k < 2000 else f"s{k % 600}") for k in range(3800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.schedule(docs, {"heavy": 300}, block_docs=1).collect()
    # A third of the slots, not 171 of 512 + 600.
    assert abs(sum(r.slot < 1800 for r in found if r.source == "heavy") - 600) < 1


def test_mix_keeps_rows_and_columns(docs):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))


def test_base_phrases(docs, texts):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for r in licenses.scan_documents(docs).collect():
        text = texts[4 if r.doc_id is None else r.doc_id] or ""
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        at = [(k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in at}))
        assert {x for x in r.base_labels.split(",") if x} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_empty_tables(nothing):
    assert ngram_join.link_classes(nothing).count() == 0
    assert bpe.encode_documents(nothing).count() == 0
    assert repair.read(repair.write(nothing)).count() == 0
    assert mixing.schedule(nothing).count() == 0 and mixing.mixed(nothing).count() == 0
    assert licenses.scan_documents(nothing).count() == 0
    assert fingerprints.fingerprints(nothing).count() == 0
