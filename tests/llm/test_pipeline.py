"""The pipeline's stages, each on what the one before kept."""

import hashlib
import math
import os
from fractions import Fraction

import pyarrow as pa

import corpus_pipeline
from crateflow.llm import bpe, mixing

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0
    assert seen[2] == seen[3] == seen[4]


def test_stages_of_odd_and_empty_tables(spark, docs, nothing, tmp_path):
    for given in (docs, nothing):
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, given, SF).count() <= given.count(), name


def by_hand(rows):
    """(doc_id, source) in the order of the mix, by exact fractions slot by slot."""
    queues = {}
    for i, source in rows:
        queues.setdefault(source, []).append(i)
    for ids in queues.values():
        ids.sort(key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    weight = {s: math.isqrt(len(ids) - 1) + 1 for s, ids in queues.items()}
    done, out, t = dict.fromkeys(queues, 0), [], 0
    share = {s: Fraction(w, sum(weight.values())) for s, w in weight.items()}
    while any(done[s] * mixing.BLOCK_DOCS < len(queues[s]) for s in queues):
        ready = [(math.ceil((done[s] + 1) / share[s]), f"={s}", s) for s in queues if math.floor(done[s] / share[s]) <= t]
        s = min(ready)[2]
        out += [(i, s) for i in queues[s][done[s] * mixing.BLOCK_DOCS : (done[s] + 1) * mixing.BLOCK_DOCS]]
        done[s] += 1
        t += 1
    return out


def test_last_stage_returns_the_order_of_the_mix(spark, tmp_path):
    rows = [(k, f"text {k}", "en", f"s{k % 7 % 3}", 6) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # Several files, of which Spark reads the largest first.
    corpus_pipeline.source_mixing(spark, docs, SF).repartition(5).write.parquet(str(tmp_path / "mixed"))
    out = corpus_pipeline.byte_bpe(spark, spark.read.parquet(str(tmp_path / "mixed")), SF).collect()
    assert len({r.position for r in out}) == len(rows)
    assert [r.doc_id for r in sorted(out, key=lambda r: r.position)] == [i for i, _ in by_hand([(r[0], r[3]) for r in rows])]


def test_last_stage_decodes_the_texts(spark, docs):
    out = corpus_pipeline.byte_bpe(spark, docs, SF).collect()
    given = sorted((-1 if r.doc_id is None else r.doc_id, (r.text or "").encode()) for r in docs.collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.decoded)) for r in out) == given
    assert all(len(r.ids) == 4 * r.n_tokens for r in out)


def test_the_last_stage_keeps_the_positions_it_is_given(spark):
    docs = spark.createDataFrame([(k, f"text {k}", "en", "s", 6, 1000 - k) for k in range(5)], "doc_id long, text string, lang string, source string, n_chars int, position long")
    assert {(r.doc_id, r.position) for r in corpus_pipeline.byte_bpe(spark, docs, SF).collect()} == {(k, 1000 - k) for k in range(5)}


def test_batches_to_workers_are_small_and_a_lower_number_stays(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    name, docs = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.range(5000, numPartitions=1)
    given = spark.conf.get(name)
    try:
        for own, most in (("10000", 1000), ("0", 1000), ("300", 300)):
            for step, stage in corpus_pipeline.STAGES:
                if step == "source_mixing":  # runs no Python
                    continue
                spark.conf.set(name, own)
                stage(spark, spark.createDataFrame([(1, "a text", "en", "s", 6)], "doc_id long, text string, lang string, source string, n_chars int"), SF)
                got = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
                assert sum(got) == 5000 and max(got) == most, (step, own)
    finally:
        spark.conf.set(name, given)


def test_workers_keep_no_vocabulary_of_the_last_stage(spark, docs):
    def held(batches):
        list(batches)
        yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([bpe.codec.cache_info().currsize])], names=["pid", "n"])

    def by_worker():
        return {r.pid: r.n for r in spark.range(64, numPartitions=64).mapInArrow(held, "pid long, n long").collect()}

    before = by_worker()
    corpus_pipeline.byte_bpe(spark, docs.repartition(16), SF).collect()
    assert all(n <= before.get(pid, 0) for pid, n in by_worker().items())
