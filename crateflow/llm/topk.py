"""Operator 6: exact top-k by inner product over an impact-ordered score-at-a-time index.

Vectors become whole numbers floor(1024 * x) and are cut, where they lie, into cells of up to
``CELL_ROWS`` rows. A cell's index is stored once: its vectors and its postings (row, dimension)
in the order of descending impact. A component's impact is its absolute value, quantised to
levels by shares of the cell's components (each stands for its mean); the postings of one level form a segment, by dimension.

Queries come in blocks of ``QUERY_ROWS``, which bound what is sent to the workers; for each block
the index is read once and no candidate moves. Segments are processed by descending impact;
each posting adds level x sign x query component to its row's score. After each segment the
part of a vector that is not yet scored has a known length, so by Cauchy-Schwarz a score lies
within |q| * |rest| of its final value. Processing stops only on proof: when few rows can still
reach the k-th best score known (of this cell, or of those the worker had before), or when
segments are used up. The possible members are then scored exactly. Ties go to the smaller id.

Vectors that are null or hold null or non-finite components take no part, nor do null ids.
Vectors shorter than the longest count as padded by zeros; empty ones score 0. Repeated ids
are candidates each of their own; as a query such an id asks once, by its least vector, and
never meets rows of its own id. Components and scores beyond a long count as the nearest long.
An empty table gives an empty one. Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SCALE, K = 1024, 10
#: Rows of a cell, queries of a block, and queries scored at a time; shares of a
#: cell's components below the lower edges of its impact levels.
CELL_ROWS, QUERY_ROWS, AT_ONCE = 4096, 16_384, 256
LEVELS = (0.99, 0.96, 0.91, 0.83, 0.72, 0.58, 0.40, 0.20, 0.0)
#: A segment that holds this share of a cell's components is added as a matrix, others posting by posting.
DENSE = 1 / 16
_MOST, _LIMIT = (1 << 63) - 1, 2.0**63


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """id, v array<long> of the vectors that take part."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine).select("id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))


class Index:
    """One cell: ids, whole-number vectors, and their flat places by descending level, then dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, order: np.ndarray | None = None, levels: tuple[float, ...] = LEVELS):
        self.ids, self.vectors = ids, vectors
        self.rows, self.width = vectors.shape
        impact = np.abs(vectors.astype(float)).ravel()
        self.levels = np.unique(np.quantile(impact, levels, method="lower"))[::-1] if impact.size else np.zeros(1)
        #: Number of the level of each component: 0 is the highest.
        self.level_of = np.searchsorted(-self.levels, -impact, side="left").clip(0, len(self.levels) - 1)
        if order is None:
            order = np.lexsort((np.arange(vectors.size) % max(1, self.width), self.level_of))
        self.order = order

    def segments(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, dimensions, level x sign) of each segment's postings."""
        ends = np.cumsum(np.bincount(self.level_of, minlength=len(self.levels)))
        flat = self.vectors.ravel()
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            own = self.order[a:b]
            level = float(np.abs(flat[own].astype(float)).mean()) if len(own) else 0.0
            yield own // max(1, self.width), own % max(1, self.width), np.sign(flat[own]) * level

    def possible(self, queries: np.ndarray, k: int, known: np.ndarray, most: int) -> np.ndarray:
        """A mask queries x rows that surely covers the rows of the ``k`` best of each query that
        reach ``known``, the score that its k-th best so far has."""
        score = np.zeros((len(queries), self.rows))
        mask = np.ones(score.shape, dtype=bool)
        if self.rows <= most:
            return mask
        rest = (self.vectors.astype(float) ** 2).sum(axis=1)
        length = np.sqrt((queries**2).sum(axis=1))[:, None]
        for rows, dims, value in self.segments():
            if not len(rows):
                continue
            real = self.vectors[rows, dims].astype(float)
            rest += np.bincount(rows, weights=(real - value) ** 2 - real**2, minlength=self.rows)
            if len(rows) > DENSE * self.vectors.size:
                posting = np.zeros(self.vectors.shape)
                posting[rows, dims] = value
                score += queries @ posting.T
            else:
                cuts = np.flatnonzero(np.diff(dims)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(dims)], strict=True):
                    score[:, rows[a:b]] += queries[:, dims[a]][:, None] * value[a:b]
            slack = length * np.sqrt(np.maximum(rest, 0))[None, :] * (1 + 1e-9) + 1e-6 * np.maximum(1.0, np.abs(score))
            low = np.partition(score - slack, self.rows - k, axis=1)[:, -k] if self.rows >= k else np.full(len(queries), -np.inf)
            mask = np.clip(score + slack, -_LIMIT, _LIMIT) >= np.clip(np.maximum(low, known), -_LIMIT, _LIMIT)[:, None]
            if mask.sum(axis=1).max(initial=0) <= most:
                break
        return mask

    def exact(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products, cut to the range of a long."""
        own = self.vectors[rows]
        # Whole numbers below 2**53 are exact as doubles, sums of products included.
        if len(own) and float(np.abs(own.astype(float)).max(initial=0)) * float(np.abs(query.astype(float)).max(initial=0)) * max(1, self.width) < 2**53:
            return (own.astype(float) @ query.astype(float)).astype(np.int64)
        return np.array([max(-_MOST - 1, min(_MOST, sum(int(a) * int(b) for a, b in zip(v, query, strict=True)))) for v in own], dtype=np.int64)


class Best:
    """The k best of every query of a block, over all cells that a worker sees."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id), in order
        self.known = np.full(len(ids), -np.inf)

    def search(self, cell: Index) -> None:
        if not cell.rows:
            return
        # A query's own rows take no part, so as many more are looked for as rows share its id.
        own = int(np.unique(cell.ids, return_counts=True)[1].max())
        for a in range(0, len(self.ids), AT_ONCE):
            part = slice(a, a + AT_ONCE)
            mask = cell.possible(self.queries[part].astype(float), self.k + own, self.known[part], most=max(4 * self.k, cell.rows // 64))
            for j in range(len(mask)):
                q = a + j
                at = np.flatnonzero(mask[j])
                at = at[cell.ids[at] != self.ids[q]]
                if not len(at):
                    continue
                score, names = cell.exact(at, self.queries[q]), cell.ids[at]
                first = np.lexsort((names, -score.astype(float)))[: self.k] if np.abs(score).max() < 2**53 else sorted(range(len(at)), key=lambda i: (-int(score[i]), int(names[i])))[: self.k]
                merged = sorted(self.found[q] + [(-int(score[i]), int(names[i])) for i in first])[: self.k]
                self.found[q] = merged
                if len(merged) == self.k:
                    self.known[q] = float(-merged[-1][0])


_CELL = "n int, width int, ids binary, vectors binary, postings binary"


def index(rows: DataFrame, width: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The cells of ``rows`` (id, v), stored."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], []

        def cell() -> pa.RecordBatch:
            vectors = np.zeros((len(held), width), dtype=np.int64)
            for i, v in enumerate(held):
                vectors[i, : len(v)] = v
            own = Index(np.array(ids, dtype=np.int64), vectors)
            row = [len(ids), width, own.ids.tobytes(), vectors.tobytes(), own.order.astype("<u4").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["n", "width", "ids", "vectors", "postings"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                held.append(v)
                if len(ids) == cell_rows:
                    yield cell()
                    ids, held = [], []
        if ids:
            yield cell()

    return common.stored(rows.mapInArrow(work, _CELL), "impact-index")


def top_k(vectors: DataFrame, every: int = 100, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", cell_rows: int = CELL_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best for each id divisible by ``every``, against all rows."""
    rows = whole_numbers(vectors, id_col, vector_col)
    size = rows.agg(F.sum((F.col("id") % every == 0).cast("long")).alias("q"), F.max(F.size("v")).alias("w")).first()
    width, blocks = size.w or 0, max(1, math.ceil((size.q or 0) / query_rows))
    cells = index(rows, width, cell_rows)
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    asked = common.stored(rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")).select("id", "v", block.alias("block")), "queries")
    found = None
    for b in range(blocks):
        own = sorted(asked.where(F.col("block") == b).select("id", "v").collect(), key=lambda r: r.id)  # about ``query_rows`` of them
        matrix = np.zeros((len(own), width), dtype=np.int64)
        for i, r in enumerate(own):
            matrix[i, : len(r.v)] = r.v
        shared = vectors.sparkSession.sparkContext.broadcast((np.array([r.id for r in own], dtype=np.int64), matrix))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = Best(*shared.value, k)
            for batch in batches:
                for n, w, ids, flat, order in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    best.search(Index(np.frombuffer(ids, dtype=np.int64), np.frombuffer(flat, dtype=np.int64).reshape(n, w), np.frombuffer(order, dtype="<u4").astype(np.int64)))
            out = [(int(q), i, -s) for q, own in zip(best.ids, best.found, strict=True) for s, i in own]
            for a in range(0, len(out), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[a : a + 100_000], strict=True)], names=["query_id", "vec_id", "score"])

        part = cells.mapInArrow(work, "query_id long, vec_id long, score long")
        found = part if found is None else found.union(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""
