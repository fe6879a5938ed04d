"""Operator 7: document fingerprints by MinHash.

The distinct shingles of a text (five words; see ``shingles``) are hashed by ``PERMUTATIONS``
universal permutations h -> a * h + b, a odd, modulo 2**32, and the least value under each is
kept, in numpy over whole batches. A fingerprint is these values in hexadecimal, 16 bits each.
The likeness of two fingerprints is the share of equal values, an estimate of the Jaccard
likeness of the shingle sets.

Bands of ``ROWS`` values are joined in Spark, and pairs that share one are verified by the exact
Jaccard likeness of their shingle sets: they and equal sets make up the classes (``classes``). A
pair of likeness 0.8 shares a band with a chance of 0.99, and every pair that does is verified or
inside a class already.

Null texts are empty; a text without words has the fingerprint of the empty set, which is like
itself (1) and no other (0). Texts of any length are hashed whole. Repeated rows give repeated
results, an empty table an empty one. Other columns are left out. A row without doc_id has
fingerprints and no class.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bitmap, common, components, ngram_join, shingles

PERMUTATIONS, BANDS = 96, 16
ROWS = PERMUTATIONS // BANDS
#: Rounds in which the members of a band are compared with one of them; members of a band that are
#: compared with each other after that.
PIVOTS, FEW = 3, 16
#: Likeness of two texts of one class; the prefix join has the same.
LEAST = 0.8
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_EMPTY = np.full(PERMUTATIONS, 0xFFFF, dtype="<u2")


def signatures(texts: list[str | None]) -> np.ndarray:
    """texts x PERMUTATIONS values of 16 bits. Repeated shingles do not change a least value."""
    hashes, at = shingles.shingle_hashes(texts)
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.tile(_EMPTY, (len(texts), 1))
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        starts = at[:-1][full]
        for k in range(PERMUTATIONS):
            least = np.minimum.reduceat(h * _A[k] + _B[k], starts)
            # The low bits of a least value are the evenly spread ones.
            out[full, k] = (least & np.uint32(0x7FFF)).astype("<u2")
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row share of equal values."""
    same = (a == b).mean(axis=1)
    return np.where((a == _EMPTY).all(axis=1) != (b == _EMPTY).all(axis=1), 0.0, same)


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many of the next text's first ones."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_PLACED = "bucket int, doc_id long, tie long, carried boolean, packed binary"


def _neighbours(docs: DataFrame) -> DataFrame:
    """bucket, doc_id, carried, packed (the text, deflated) in descending order over buckets of doc_id; the
    last row of each bucket (``carried``) is a copy of the next bucket's first one, so that every row's
    next row is in its own task. Boundaries come from an approximate quantile of doc_id; they and the
    first rows are one a bucket. Null ids come last, in a bucket of their own."""
    spark = docs.sparkSession
    texts = common.texts_of(docs).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("tie", F.xxhash64("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = np.array(sorted(set(texts.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n)).first()[0] or [])), dtype=np.int64)

    def buckets(ids: pa.Array) -> np.ndarray:
        """Bucket 0 holds the largest ids."""
        known = ids.fill_null(0).to_numpy(zero_copy_only=False)
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), len(cuts) + 1, len(cuts) - np.searchsorted(cuts, known, side="left"))

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for batch in batches:
            for b, i, t in zip(buckets(batch.column(0)).tolist(), batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b not in best or (i is not None and (-i, t) < (-best[b][0], best[b][1])) or (i is None and t < best[b][1]):
                    best[b] = (i, t)
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array([i for i, _ in best.values()], pa.int64()), pa.array([t for _, t in best.values()], pa.int64())], names=["bucket", "doc_id", "tie"])

    each = texts.select("doc_id", "tie").mapInArrow(firsts, "bucket int, doc_id long, tie long")
    order = F.struct((-F.coalesce("doc_id", F.lit(0)).cast("decimal(20,0)")).alias("i"), "tie")
    first = {r.bucket: (r.doc_id, r.tie) for r in each.groupBy("bucket").agg(F.min_by(F.struct("doc_id", "tie"), order).alias("f")).select("bucket", "f.*").collect()}
    full = sorted(first)
    heads = {first[b]: full[k - 1] for k, b in enumerate(full)}  # to the bucket before; before the first the last

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                rows = []
                for b, i, t, x in zip(buckets(part.column(0)).tolist(), part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(1).to_pylist(), strict=True):
                    packed = zlib.compress(x.encode("utf-8", "surrogatepass"), 1)
                    rows.append((b, i, t, False, packed))
                    if (to := heads.get((i, t))) is not None:
                        rows.append((to, i, t, True, packed))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=y) for c, y in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["bucket", "doc_id", "tie", "carried", "packed"])

    placed = texts.select("doc_id", "text", "tie").mapInArrow(work, _PLACED)
    return placed.repartition(n, "bucket").sortWithinPartitions("bucket", "carried", F.col("doc_id").desc_nulls_last(), "tie").select("bucket", "doc_id", "carried", "packed")


_SIGNED = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "sign": pa.binary(), "edited_sign": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64(), "n": pa.int64(), "hi": pa.int64(), "lo": pa.int64()}
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, sign binary, edited_sign binary, near_edited double, near_next double, n long, hi long, lo long"


def _digest(s: np.ndarray) -> tuple[int, int]:
    raw = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def signed(docs: DataFrame) -> DataFrame:
    """Every row's fingerprint and its edited text's, as bytes, their likeness to each other and to the
    next document's (descending doc_id, equal ids by a hash of their texts; after the last the first),
    the size of its shingle set and a digest (hi, lo) of it."""

    def slices(batches: Iterator[pa.RecordBatch]):
        """Lists of (doc_id, text, next text)."""
        out, size, last = [], 0, None
        for batch in batches:
            for bucket, i, carried, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = zlib.decompress(packed).decode("utf-8", "surrogatepass")
                if last is not None and last[0] == bucket and not last[3]:
                    out.append((last[1], last[2], text))
                    size += 2 * len(last[2])
                    if size > common.SLICE_CHARS // 2 or len(out) >= 512:
                        yield out
                        out, size = [], 0
                last = (bucket, i, text, carried)
        if out:
            yield out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            changed = [edited(t, f) for _, t, f in part]
            # A text's next one is, but for bucket ends, the next row's own text.
            texts = [t for _, t, _ in part]
            extra = [k for k in range(len(part)) if k + 1 == len(part) or part[k][2] is not texts[k + 1]]
            all_ = signatures(texts + changed + [part[k][2] for k in extra])
            n = len(part)
            own, other = all_[:n], all_[n : 2 * n]
            following = np.roll(own, -1, axis=0)
            following[extra] = all_[2 * n :]
            sets = shingles.distinct_sets(texts)
            keys = [_digest(s) for s in sets]
            columns = [[i for i, _, _ in part], [len(t) for t in texts], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], [r.tobytes() for r in own], [r.tobytes() for r in other], likeness(own, other), likeness(own, following), [len(s) for s in sets], [k[0] for k in keys], [k[1] for k in keys]]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, _SIGNED.values(), strict=True)], names=list(_SIGNED))

    return _neighbours(docs).mapInArrow(work, SCHEMA)


def _bands(signs: np.ndarray) -> np.ndarray:
    """texts x BANDS hashes of the bands' values."""
    h = np.zeros((len(signs), BANDS), dtype=np.uint64)
    for k in range(ROWS):
        h = (h ^ signs[:, k::ROWS].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return ((h + np.arange(BANDS, dtype=np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _banded(reps: DataFrame, filter_=None) -> DataFrame:
    """rep, n, band of every set (rep, n, sign); those alone that ``filter_``, a shared bitmap, holds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = _bands(np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype="<u2").reshape(batch.num_rows, PERMUTATIONS)).ravel()
                at = np.repeat(np.arange(batch.num_rows), BANDS)
                if filter_ is not None:
                    keep = filter_.value.holds(flat)
                    flat, at = flat[keep], at[keep]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(flat)], names=["rep", "n", "band"])

    return reps.select("rep", "n", "sign").mapInArrow(work, "rep long, n long, band long")


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, s: the shingle sets of the documents ``wanted`` (id, lo); repeated rows come again."""
    filter_ = docs.sparkSession.sparkContext.broadcast(bitmap.bitmap(wanted, "id"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = filter_.value.holds(batch.column(0).to_numpy(zero_copy_only=False))
            for ids, texts in common.slices(iter([batch.filter(pa.array(keep))])):
                sets = shingles.distinct_sets(texts)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([_digest(s)[1] for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "lo", "s"])

    found = common.texts_of(docs).where("doc_id is not null").mapInArrow(work, "id long, lo long, s array<long>")
    return found.join(wanted, ["id", "lo"]).select("id", "s")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v of the pairs (a, b) whose exact likeness reaches ``LEAST``."""
    left, right = sets.select(F.col("id").alias("a"), F.col("s").alias("x")), sets.select(F.col("id").alias("b"), F.col("s").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").where(both >= F.lit(LEAST) * (F.size("x") + F.size("y") - both)).select(F.col("a").alias("u"), F.col("b").alias("v"))


def classes(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, class_id of the documents that share a class with another set or text: the least id that
    equal shingle sets and pairs of a likeness of ``LEAST`` that share a band lead to. ``rows``: ``signed(docs)``.

    In ``PIVOTS`` rounds the members of a band are compared with one of them only, first the
    smallest id, then one of any component. Where members of different components still share a
    band, those of small bands (``FEW``) are compared with each other, but for those whose sizes
    rule it out; those of larger bands, which share common passages, go through the exact prefix
    join of ``ngram_join``, whose likeness is the same, which makes no pairs of a group."""
    shared = docs.sparkSession.sparkContext.broadcast

    def alike(n: str, m: str) -> Column:
        return F.least(n, m) / F.greatest(n, m) >= LEAST

    known = rows.where("n > 0 AND doc_id IS NOT NULL")
    reps = common.stored(known.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("sign").alias("sign"), F.count("*").alias("copies")), "reps")
    parts = common.parts_for(reps.count())
    held = common.stored(_banded(reps).groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band"), "bands", parts)
    own = common.stored(_banded(reps, shared(bitmap.bitmap(held, "band"))).join(held, "band").coalesce(parts), "own", parts)
    wanted = common.stored(own.select("rep").distinct().join(reps.select("rep", "lo"), "rep").select(F.col("rep").alias("id"), "lo"), "wanted", parts)
    sets = common.stored(_sets_of(docs, wanted), "band-sets")
    tree = None
    for k in range(PIVOTS + 1):
        rooted = own.withColumn("root", F.col("rep")) if tree is None else own.join(tree, own["rep"] == tree["node"], "left").select("rep", "n", "band", F.coalesce("root", "rep").alias("root"))
        least_root = F.min(F.struct((F.xxhash64("root", F.lit(k)) if k else F.lit(0)).alias("h"), "rep", "n", "root"))
        pivot = rooted.groupBy("band").agg(least_root.alias("p"), F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).where("low <> high").select("band", "p", "size")
        mixed = rooted.join(pivot, "band")
        if k < PIVOTS:
            pairs = mixed.where((F.col("root") != F.col("p.root")) & alike("n", "p.n")).select(F.least("rep", "p.rep").alias("a"), F.greatest("rep", "p.rep").alias("b"))
        else:
            mixed = common.stored(mixed.drop("p"), "mixed", parts)
            a, b = mixed.where(F.col("size") <= FEW).alias("a"), mixed.alias("b")
            meets = (F.col("a.band") == F.col("b.band")) & (F.col("a.root") != F.col("b.root")) & (F.col("a.rep") < F.col("b.rep")) & alike("a.n", "b.n")
            pairs = a.join(b, meets).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))
        found = common.stored(_verified(pairs.coalesce(parts).distinct(), sets), "found", parts)
        if tree is None:
            tree = components.components(found)
        elif not found.isEmpty():
            tree = components.components(tree.select(F.col("node").alias("u"), F.col("root").alias("v")).union(found))
    crowded = mixed.where(F.col("size") > FEW).select(F.col("rep").alias("id")).distinct()
    full = common.stored(sets.dropDuplicates(["id"]).join(crowded, "id").select(F.col("id").alias("set"), F.col("id").alias("rep"), F.col("s").alias("tokens")), "crowded", parts)
    if not full.isEmpty():
        more = ngram_join.component_stars(full, parts).union(tree)
        tree = components.components(more.select(F.col("node").alias("u"), F.col("root").alias("v")))
    common.remove(held, own, wanted, sets, mixed, full)
    grouped = reps.join(tree, reps["rep"] == tree["node"], "left").where("copies > 1 OR node IS NOT NULL").select("hi", "lo", F.coalesce("root", "rep").alias("class_id"))
    return common.stored(known.select("doc_id", "hi", "lo").join(grouped, ["hi", "lo"]).groupBy("doc_id").agg(F.min("class_id").alias("class_id")), "classes")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (see
    ``signed``) and class_id (see ``classes``; a document alone is its own class)."""
    rows = common.stored(signed(docs), "signatures")
    found = classes(docs, rows).withColumnRenamed("doc_id", "member")
    return rows.join(found, rows["doc_id"] == found["member"], "left").select(
        "doc_id", "n_chars", "edited_sha256", F.lower(F.hex("sign")).alias("fingerprint"), F.lower(F.hex("edited_sign")).alias("edited_fingerprint"), "near_edited", "near_next", F.coalesce("class_id", "doc_id").alias("class_id")
    )


#: doc_id, n_chars and edited_sha256 of the same table in DuckDB's SQL.
EDITED_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS f FROM t)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(left(t, CAST(n - n // 3 AS INTEGER)) || left(f, CAST(n // 3 AS INTEGER))) AS edited_sha256 FROM n"""


def edited_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256 of every text."""
    return signed(docs).select("doc_id", "n_chars", "edited_sha256")
