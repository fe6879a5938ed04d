"""Token counts against the library, whole and by chunks; the transducers against their definitions."""

import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from crateflow.llm import automata, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    "a", "The", "naïve", "é", "e\u0301", "'s", "'", "’", ".", ",\n", "\n\n", "\t", " ", "  ", "12", "½", "٣", "日本", "🙂", "\u00a0", "\u3000", "\u0085", "\x1c", "\x0b", "<|endoftext|>", "<|", "|>", "endoftext", "ǅ", "ß", "_", "-", "\r\n",
    "'re", "'ll", "'ve", "'t", "'l", "'r", "'S", "v", "e", "l", "the", "ing", "ers", "aaaa", "\u200b", "\ufeff",
]


@pytest.fixture(scope="module")
def own():
    return token_counts.Tokenizer(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def samples(seed, n):
    rng = random.Random(seed)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    out += ["".join(chr(rng.choice([rng.randrange(97, 123), 32, rng.randrange(33, 0x250), rng.randrange(0x250, 0xD7FF)])) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return out + ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 300))) for _ in range(n // 4)] + ["a" * 3000, " " * 1000 + "x", "\n" * 77, "=-" * 500, "lolol" * 300, ""]


def library_counts(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_are_the_library_s(own, library):
    texts = samples(1, 2000)
    assert own.texts([t.encode() for t in texts]).tolist() == library_counts(library, texts)


def test_chunks_of_any_size_compose(own, library):
    rng, texts = random.Random(2), samples(3, 250)
    for text, want in zip(texts, library_counts(library, texts), strict=True):
        raw, k, h = text.encode(), rng.choice([1, 2, 3, 7, 16, 50]), own.halo
        chunks = [own.chunk(raw[max(0, a - h) : a], raw[a : a + k], raw[a + k : a + k + h]) for a in range(0, len(raw), k)]
        assert not chunks or own.compose(chunks) == want


def test_counter_by_the_definition_of_merges():
    """A small tokenizer: pairs of lowest rank first, from the left; every count of every prefix."""
    byte_of = token_counts._byte_of()
    names = {b: c for c, b in byte_of.items()}
    vocabulary = {names[b]: b for b in range(256)}
    rng, merges = random.Random(4), []
    tokens = ["a", "b", "c"]
    while len(merges) < 40:
        x, y = rng.choice(tokens), rng.choice(tokens)
        if x + y not in vocabulary:
            vocabulary[x + y] = len(vocabulary)
            merges.append((x, y))
            tokens.append(x + y)

    def define(text):
        parts = list(text)
        while pairs := [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]:
            i = min(pairs)[1]
            parts[i : i + 2] = ["".join(parts[i : i + 2])]
        return len(parts)

    counter = token_counts.Counter(vocabulary, merges, most_states=50)  # states are given up and compiled again
    unreachable = [t for t in counter.parts if not counter.whole(t)]
    assert unreachable  # random merges make tokens that their own bytes never give
    reachable = {t for t in vocabulary if len(t) > 1 and define(t) == 1}
    assert {vocabulary[t] for t in reachable} == set(counter.parts) - set(unreachable)
    for _ in range(400):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
        assert counter.count(text.encode()) == define(text)


def test_refusals(tmp_path):
    with open(PATH, "rb") as f:
        settings = json.load(f)

    def changed(**parts):
        with open(tmp_path / "t.json", "w") as f:
            json.dump(settings | parts, f)
        return str(tmp_path / "t.json")

    with pytest.raises(ValueError, match="byte-level"):
        token_counts.Tokenizer(changed(pre_tokenizer=None))
    with pytest.raises(ValueError, match="plain BPE"):
        token_counts.Tokenizer(changed(model=settings["model"] | {"ignore_merges": True}))
    with pytest.raises(ValueError, match="as they are"):
        token_counts.Tokenizer(changed(added_tokens=[settings["added_tokens"][0] | {"lstrip": True}]))
    with pytest.raises(ValueError, match="overlap"):
        token_counts.Tokenizer(changed(added_tokens=[settings["added_tokens"][0] | {"content": c} for c in ("<a>", ">b")]))
    with pytest.raises(ValueError, match="bytes at least"):
        token_counts.count_tokens(None, chunk=5)


def test_lanes_give_the_states_of_a_plain_run():
    rng = np.random.default_rng(6)
    table, symbols = rng.integers(0, 5, (4, 5)).astype(np.int8), rng.integers(0, 4, 1000)
    for n in (0, 1, 6, 7, 8, 1000):
        scan = automata.Scan(table, symbols[:n], lane=7)
        for state in range(5):
            before, now = [], state
            for s in symbols[:n]:
                before.append(now)
                now = int(table[s, now])
            assert scan.states_before(state).tolist() == before and scan.exit(state) == now


@pytest.mark.parametrize("chunk", [64, 1 << 20])
def test_query_rows_are_the_library_s(spark, texts, nothing, library, chunk):
    rows = [(k, t) for k, t in enumerate([*texts, *samples(5, 40)])] + [(None, "don't " * 50), (None, None), (7, "x" * 500), (7, "x" * 500), (7, "x" * 500)]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n_tokens int, k string")
    got = sorted(map(tuple, token_counts.count_tokens(docs, chunk=chunk, slice_bytes=2000).collect()), key=str)
    counts = library_counts(library, [t or "" for _, t in rows])
    assert got == sorted([(i, len((t or "").encode()), n, n > 512) for (i, t), n in zip(rows, counts, strict=True)], key=str)
    assert token_counts.count_tokens(nothing, chunk=chunk).count() == 0
