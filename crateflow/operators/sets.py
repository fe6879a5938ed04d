"""Orders of a set of tracks in which each goes well into the next.

A chain is sequential by nature; it is built over one bounded pool, at most ``MOST`` tracks, in one
grouped task. Pools are groups of a table, so many sets are ordered side by side.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateflow.functions import music

#: Most tracks of a pool; price at which a chain is cut; weight of the best step after the next.
MOST, MOST_COST, AHEAD = 200, 3.0, 0.3


def costs(pool: DataFrame) -> DataFrame:
    """pool, a, b, cost of every two tracks (pool, id, key_camelot, bpm) of a pool that may follow each other."""
    a = pool.select("pool", F.col("id").alias("a"), F.col("key_camelot").alias("ka"), F.col("bpm").alias("ba"))
    b = pool.select("pool", F.col("id").alias("b"), F.col("key_camelot").alias("kb"), F.col("bpm").alias("bb"))
    return a.join(b, "pool").where("a <> b").select("pool", "a", "b", music.transition_cost(F.col("ka"), F.col("ba"), F.col("kb"), F.col("bb")).alias("cost"))


def _walk(cost: np.ndarray, bpm: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(segment, turn) of each track of a pool: one walk over the cost matrix that starts anew wherever
    no open track is within ``most``.

    Columns of tracks that are taken are raised to infinity, so a row's least entry is the best way
    on from there; a step is priced by its own cost and, at ``AHEAD``, by the best way on behind it
    (``most`` at most, nothing where no track would be left). A start is the open track nearest to the
    median tempo of the open ones, or the first where no tempo is known."""
    n = len(bpm)
    open_ = cost.copy()
    np.fill_diagonal(open_, np.inf)
    segment, turn, taken, at, now = np.zeros(n, dtype=int), np.zeros(n, dtype=int), np.zeros(n, dtype=bool), -1, 0
    for t in range(n):
        step = open_[at] if at >= 0 else np.full(n, np.inf)
        if (step <= most).any():
            ahead = np.minimum(open_.min(axis=1), most) if t < n - 1 else 0.0
            at = int(np.argmin(np.where(step <= most, step + AHEAD * ahead, np.inf)))
        else:
            known = ~taken & ~np.isnan(bpm)
            away = np.where(known, np.abs(bpm - np.median(bpm[known])), np.inf) if known.any() else np.where(taken, np.inf, 0.0)
            at, now = int(np.argmin(away)), now + 1
        segment[at], turn[at], taken[at] = now, t, True
        open_[:, at] = np.inf
    return segment, turn


def _placed(cost: np.ndarray, bpm: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(tracks in order, their segments): segments by falling mean tempo, the earlier first of equals."""
    segment, turn = _walk(cost, bpm, most)
    means = np.zeros(int(segment.max(initial=0)) + 1)
    for k in np.unique(segment):
        own = bpm[(segment == k) & ~np.isnan(bpm)]
        means[k] = math.fsum(own) / len(own) if len(own) else 0.0
    ranks = np.empty(len(means), dtype=int)
    ranks[1 + np.argsort(-means[1:], kind="stable")] = np.arange(1, len(means))
    order = np.lexsort((turn, ranks[segment]))
    return order, ranks[segment][order]


_RELATIONS = np.array(list(music.RELATION_COST.values()))


def _matrix(keys: pd.Series, bpm: np.ndarray) -> np.ndarray:
    """What each transition costs, as ``music.transition_cost`` says."""
    parsed = keys.fillna("").str.extract(r"^0*([1-9]|1[0-2])([ABab])$")
    n, letter = pd.to_numeric(parsed[0]).to_numpy(dtype=float), parsed[1].str.upper().to_numpy(dtype=object)
    step, same = (n[None, :] - n[:, None]) % 12, letter[:, None] == letter[None, :]
    kind = np.full(step.shape, 5)
    for k, fits in ((4, same & np.isin(step, (3, 9))), (3, same & (step == 2)), (2, ~same & (step == 0)), (1, same & np.isin(step, (1, 11))), (0, same & (step == 0))):
        kind[fits] = k
    kind[np.isnan(step)] = 6
    gap = np.abs(bpm[:, None] - bpm[None, :])
    return _RELATIONS[kind] + np.where(np.isnan(gap), 1.0, np.where(gap > music.MOST_BPM, np.inf, np.maximum(0.0, gap - music.EASY_BPM)))


def order(tracks: DataFrame, most_cost: float = MOST_COST) -> DataFrame:
    """pool, place, segment, id for tracks (pool, pos, id, key_camelot, bpm) of each pool: segments of
    transitions that cost ``most_cost`` at most, the fastest segment first. A pool of more than
    ``MOST`` tracks is refused."""

    def work(pool: pd.DataFrame) -> pd.DataFrame:
        if len(pool) > MOST:
            raise ValueError(f"a pool of {len(pool)} tracks; at most {MOST} can be ordered")
        pool = pool.sort_values(["pos", "id"]).reset_index(drop=True)
        bpm = pool["bpm"].to_numpy(dtype=float)
        order, segment = _placed(_matrix(pool["key_camelot"], bpm), bpm, most_cost)
        return pd.DataFrame({"pool": pool["pool"].iloc[0], "place": range(1, len(order) + 1), "segment": segment, "id": pool["id"].to_numpy()[order]})

    kinds = dict(tracks.dtypes)
    return tracks.select("pool", "pos", "id", "key_camelot", F.col("bpm").cast("double").alias("bpm")).groupBy("pool").applyInPandas(work, f"pool {kinds['pool']}, place int, segment int, id {kinds['id']}")


def transitions(ordered: DataFrame, tracks: DataFrame) -> DataFrame:
    """pool, place, segment, kind (step or cut), id, next_id, relation, cost, bpm_step, warning between
    neighbours of an order; nothing costs at a cut."""
    one = ordered.join(tracks.select("pool", "id", "key_camelot", "bpm"), ["pool", "id"])
    nxt = one.select("pool", (F.col("place") - 1).alias("place"), *[F.col(c).alias(f"next_{c}") for c in ("id", "segment", "key_camelot", "bpm")])
    cut = F.col("segment") != F.col("next_segment")
    relation = music.camelot_relation(F.col("key_camelot"), F.col("next_key_camelot"))
    cost = music.transition_cost(F.col("key_camelot"), F.col("bpm"), F.col("next_key_camelot"), F.col("next_bpm"))
    step = F.bround(F.col("next_bpm") - F.col("bpm"), 1)
    warning = (
        F.when(cut, "cut").when(step.isNull(), "tempo unknown").when(F.abs(step) > music.MOST_BPM, "tempo out of range").when(F.abs(step) > music.EASY_BPM, "match tempo")
        .when(relation.isin("plus2", "plus3", "far", "unknown"), F.concat(F.lit("key "), relation)).otherwise("")
    )
    return one.join(nxt, ["pool", "place"]).select("pool", "place", F.col("next_segment").alias("segment"), F.when(cut, "cut").otherwise("step").alias("kind"), "id", "next_id", relation.alias("relation"), F.when(~cut, F.bround(cost, 2)).alias("cost"), step.alias("bpm_step"), warning.alias("warning"))
