"""The impact-ordered index against every product worked out."""

import numpy as np
import pytest

from crateflow.llm import topk


def every_product(ids, vectors, queries, k):
    out = []
    for q in queries:
        scored = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(int(a) * int(b) for a, b in zip(vectors[ids.index(q)], v)))), i) for i, v in zip(ids, vectors) if i != q)
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [0.01, 0.3, 40.0, 1e7, 1e14])
def test_searches_of_any_size_of_components(spark, scale):
    rng = np.random.default_rng(int(scale * 100) % 1000)
    centres = rng.normal(0, 1, (6, 12))
    vectors = (centres[rng.integers(0, 6, 700)] + 0.2 * rng.normal(0, 1, (700, 12))) * scale
    vectors[10:20] = vectors[5]  # ties
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50, k=4, cell_rows=96, query_rows=5).collect()
    whole = [[int(np.floor(x * topk.SCALE)) for x in v] for v in vectors.tolist()]
    whole = [[max(-(1 << 63), min((1 << 63) - 1, x)) for x in v] for v in whole]
    want = every_product(list(range(700)), whole, range(0, 700, 50), 4)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want


def test_few_rows_are_scored_exactly():
    """On clustered vectors the proof comes before all rows are candidates."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 300, (40, 32))
    vectors = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(0, 20, (4000, 32))).astype(np.int64)
    cell = topk.Index(np.arange(4000), vectors)
    queries = vectors[:50].astype(float)
    mask = cell.possible(queries, 5, np.full(50, -np.inf), most=200)
    best = np.argsort(-(queries @ vectors.T.astype(float)), axis=1)[:, :5]
    assert all(mask[q, best[q]].all() for q in range(50)) and mask.sum(axis=1).max() < 2000
    # A score known from elsewhere leaves fewer.
    known = np.sort(queries @ vectors.T.astype(float), axis=1)[:, -5]
    assert cell.possible(queries, 5, known, most=10).sum() <= mask.sum()


def test_postings_are_in_impact_order():
    vectors = np.array([[500, -3, 0], [-100, 320, 64], [7, 0, 0]], dtype=np.int64)
    cell = topk.Index(np.arange(3), vectors)
    levels = [[abs(int(vectors[r, d])) for r, d in zip(rows.tolist(), dims.tolist())] for rows, dims, _ in cell.segments()]
    assert sorted(sum(levels, [])) == sorted(map(abs, vectors.ravel().tolist())) and len(levels) > 3
    assert all(min(a) > max(b) for a, b in zip(levels, levels[1:]))
    for _, dims, value in cell.segments():
        assert (np.diff(dims) >= 0).all() and len(set(np.abs(value).tolist()) - {0.0}) <= 1
