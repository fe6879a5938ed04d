"""Fingerprints, edited texts and classes against plain readings of their definition."""

import hashlib
import itertools
import random

import duckdb
import numpy as np

from crateflow.llm import fingerprints

from .test_exact import alike, shingle_set

SF = "/root/testdata/sf0.01"


def as_values(fingerprint):
    return np.frombuffer(bytes.fromhex(fingerprint), "<u2")


def test_fingerprints_of_odd_rows(docs, texts):
    out = {r.doc_id: r for r in fingerprints.fingerprints(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    n = len(texts)
    assert len(out) == n
    for k in range(n):
        own, following = texts[k] or "", texts[k - 1 if k else n - 1] or ""
        cut = len(own) // 3
        edited = own[: len(own) - cut] + following[:cut]
        assert (out[k].n_chars, out[k].edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = shingle_set(own), shingle_set(edited), shingle_set(following)
        assert abs(out[k].near_edited - (len(a & b) / len(a | b) if a | b else 1)) < 0.25
        assert abs(out[k].near_next - (len(a & c) / len(a | c) if a | c else 1)) < 0.25
        # Both likenesses are what the fingerprints say.
        mine, theirs = as_values(out[k].fingerprint), as_values(out[k - 1 if k else n - 1].fingerprint)
        empty = [not a, not c]
        assert out[k].near_next == (0.0 if empty[0] != empty[1] else (mine == theirs).mean())
        assert (as_values(out[k].edited_fingerprint) == fingerprints.signatures([edited])[0]).all()
        assert out[k].fingerprint == next(out[j].fingerprint for j in range(n) if shingle_set(texts[j]) == a)
    again = fingerprints.fingerprints(docs).collect()
    assert len(again) == docs.count() and [r.class_id for r in again if r.doc_id is None] == [None]


def by_hand(texts, linked):
    least = list(range(len(texts)))
    for _ in texts:
        for a, b in linked:
            least[a] = least[b] = min(least[a], least[b])
    return least


def families(rng, n):
    """Families of near copies of several passages, each changed at its own places, and copies."""
    out = []
    for k in range(n):
        near = [f"w{k % 7}-{j}" for j in range(200)]
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            near[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(near))
    return [*out, out[3], out[3].upper(), "", "a b", "a b"]


def test_classes_hold_nearly_every_alike_pair_and_no_other(spark):
    texts = families(random.Random(3), 240)
    sets = [shingle_set(t) for t in texts]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if alike(sets[a], sets[b])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in fingerprints.fingerprints(docs).collect()}
    recall = np.mean([got[a] == got[b] for a, b in pairs])
    assert len(pairs) > 2000 and recall >= 0.9
    # Classes are never coarser than the true ones.
    true = by_hand(texts, pairs)
    assert all(true[k] == true[c] for k, c in got.items()) and all(c <= k for k, c in got.items())
    # Every verified pair that shares a band is inside a class.
    signs = fingerprints.signatures(texts).reshape(len(texts), fingerprints.BANDS, -1)
    assert all(got[a] == got[b] for a, b in pairs if (signs[a] == signs[b]).all(axis=1).any())


def test_texts_that_share_a_passage_make_no_pairs_and_lose_none(spark):
    rng = random.Random(6)
    passage = [f"p{j}" for j in range(150)]
    texts = [" ".join(passage + [f"own{k}-{j}" for j in range(60)]) for k in range(120)]  # likeness about 0.55
    texts += [" ".join(passage + [f"own{k}-{j}" for j in range(58)] + ["x", f"y{rng.randrange(9)}"]) for k in range(0, 120, 4)]
    sets = [shingle_set(t) for t in texts]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if alike(sets[a], sets[b])]
    assert len(pairs) == 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in fingerprints.fingerprints(docs).collect()}
    assert [got[k] for k in range(len(texts))] == by_hand(texts, pairs)


def test_edited_texts_are_those_of_the_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(tuple(r) for r in fingerprints.edited_texts(docs).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    assert got == sorted(con.execute(fingerprints.EDITED_SQL).fetchall())


def test_bands_are_hashes_of_their_values():
    signs = fingerprints.signatures(["a b c d e f g", "a b c d e f g", "other words stand here now then", ""])
    bands = fingerprints._bands(signs)
    assert (bands[0] == bands[1]).all() and not (bands[0] == bands[2]).any() and len(set(bands[0].tolist())) == fingerprints.BANDS
