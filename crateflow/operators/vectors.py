"""Tracks with vectors alike."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that are compared with the queries in one task.
CELL_ROWS = 20_000


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where one is zero, null for different lengths."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    value = F.when(norm > 0, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b) / norm))).otherwise(0.0)
    return F.when(F.size(a) == F.size(b), value)


def similar(query: DataFrame, rows: DataFrame, top: int = 5, least: float = 0.0, cell_rows: int = CELL_ROWS) -> DataFrame:
    """query_id, id, score, rank: the ``top`` rows of a query's model most like it, but for itself, of a score
    of ``least`` or more. ``query`` and ``rows``: id, model, vector; vectors of another length than the
    query's, and those with missing or not finite values, take no part, zero vectors score 0.

    Rows are dealt to cells of about ``cell_rows`` by a hash of the id, as many as the rows fill, and every
    query, of which there are few, goes to all cells; norms are worked out once a vector, scores by one
    matrix product a cell, and the best of each cell meet in the end."""
    cells = max(1, math.ceil(rows.count() / cell_rows))
    kinds = dict(rows.dtypes)
    plain = lambda df, name: df.select(F.col("id").alias(name), "model", F.col("vector").cast("array<double>").alias("vector")).where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    own = plain(rows, "id").withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(cells)).cast("int"))
    asked = plain(query, "query_id").withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))

    def best(cell: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": [], "id": [], "score": []}, dtype=object)]
        for size, part in queries.groupby(queries["vector"].map(len)):
            near = cell[cell["vector"].map(len) == size]
            ids, x = near["id"].to_numpy(), _unit(near["vector"])
            for k in range(0, len(part) if len(near) else 0, 256):
                some = part.iloc[k : k + 256]
                scores = np.clip(_unit(some["vector"]) @ x.T, -1, 1).round(6)
                for q, own_scores in zip(some["query_id"], scores, strict=True):
                    at = np.flatnonzero((own_scores >= least) & (ids != q))
                    if len(at) > top:  # all that reach the last place, then by id
                        at = at[own_scores[at] >= np.partition(own_scores[at], len(at) - top)[len(at) - top]]
                    at = at[np.lexsort((ids[at], -own_scores[at]))][:top]
                    found.append(pd.DataFrame({"query_id": q, "id": ids[at], "score": own_scores[at]}))
        return pd.concat([f for f in found if len(f)] or found)

    some = asked.groupBy("model", "cell").cogroup(own.groupBy("model", "cell")).applyInPandas(lambda q, cell: best(cell, q), f"query_id {kinds['id']}, id {kinds['id']}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _unit(vectors: pd.Series) -> np.ndarray:
    """Rows of length one; zero vectors stay zero."""
    x = np.array(vectors.tolist(), dtype=float).reshape(len(vectors), -1)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1.0)
