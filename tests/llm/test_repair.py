"""Re-Pair token files: grammars, random access, and the encoder's parts."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from crateflow.llm import repair


def shard_of(ids, terminals):
    rules, lengths, seq = repair.compress(ids, terminals)
    marks = repair.marks_of(lengths, seq, terminals)
    return rules, seq, repair.Shard(repair.width_for(terminals), rules.tobytes(), lengths.tobytes(), seq.tobytes(), marks.tobytes(), terminals)


@pytest.mark.parametrize("terminals", [50, 70_000, 100_000])  # the latter two need 32-bit symbols
def test_grammar_is_a_round_trip_with_random_access(terminals):
    rng = np.random.default_rng(5)
    top = terminals - 50
    ids = np.concatenate([np.tile(rng.integers(0, 50, 30), 400), np.zeros(101, int), rng.integers(0, 50, 5000)]).astype("<u4") + top
    rules, seq, shard = shard_of(ids.astype("<u4"), terminals)
    assert len(rules) and len(seq) < len(ids)
    for a, n in ((0, 1), (17, 300), (4000, 9000), (len(ids) - 5, 5), (0, len(ids)), (40, 0)):
        assert shard.ids(a, n) == ids[a : a + n].astype("<u4").tobytes()
    sizes = [1, 29, 7000, 0, 3]
    sizes.append(len(ids) - sum(sizes))
    assert list(shard.documents(sizes)) == [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_random_access_expands_only_what_covers_the_range():
    ids = np.tile(np.arange(1000, dtype="<u4"), 100)
    _, _, shard = shard_of(ids, 1000)
    shard.ids(50_000, 3)
    few = len(shard.known)
    list(map(shard.expand, shard.sequence.tolist()))
    assert few < len(shard.known)


def test_passes_go_on_until_no_pair_is_frequent():
    # Doublings: every pass halves the run, so many passes are needed.
    rules, seq, _ = shard_of(np.zeros(1 << 14, dtype="<u4"), 5)
    pairs = list(zip(seq[:-1].tolist(), seq[1:].tolist()))
    assert len(rules) > 9 and max((pairs.count(p) for p in set(pairs)), default=0) < 2 * repair.LEAST


def test_an_id_outside_the_vocabulary_is_refused():
    with pytest.raises(ValueError, match="outside the vocabulary"):
        repair.compress(np.array([50_257], dtype="<u4"), 50_257)


def test_encoder_gives_what_the_library_gives():
    rng, own = random.Random(3), repair.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    alphabet = ["a", "The", "naïve", "é", "'s", "'", "’", ".", ",\n", "\n\n", "\t", " ", "  ", "12", "日本", "🙂", "\u00a0", "\u3000", "\u0085", "<|endoftext|>", "ǅ", "ß", "_", "-", "\r\n", "е"]
    texts = ["".join(rng.choice(alphabet) + (" " if rng.random() < 0.5 else "") for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [None, ""]
    for _ in range(2):  # once more from memory
        got = own.batch(pa.array(texts, pa.string()))
        assert [np.frombuffer(r, "<u4").tolist() for r in got] == [own.library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_chosen_documents_are_read_from_their_shards_alone(spark, docs, texts):
    own = repair.Encoder(public_tokenizers.path("byte_bpe_50k.json")).library
    files = repair.write(docs, shard_ids=300)
    assert files.count() > 5
    wanted = spark.createDataFrame([(3,), (7,), (7,), (len(texts) - 1,), (99_999,), (None,)], "doc_id long")
    got = sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in repair.read_documents(files, wanted).collect())
    ids = lambda k: own.encode(texts[k] or "", add_special_tokens=False).ids + [2]
    assert got == sorted([(3, ids(3))] * 3 + [(7, ids(7)), (len(texts) - 1, ids(len(texts) - 1))])  # the row of doc 3 comes three times
    opened = repair.read_documents(files, wanted.limit(1))
    assert opened.count() == 3 and repair.read_documents(files, wanted.limit(0)).count() == 0
