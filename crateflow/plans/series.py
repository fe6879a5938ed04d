"""Queries over sample series, each track forty vectors end to end in blocks of one vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from crateflow.operators import samples

from .operations import query

WIDTH, HOP, FRAME, STEP, RATE = 300, 50, 64, 32, 64.0
QUIET, LEAST = 0.8, 0.5

SAMPLES = """
WITH s AS (SELECT floor(vec_id / 40)::BIGINT AS track_id, (vec_id % 40) * 64 + i - 1 AS p, floor(1000 * embedding[i]::DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings) x),
n AS (SELECT track_id, count(*) AS n, sum(v * v) AS whole FROM s GROUP BY 1),
"""
FRAMES = SAMPLES + """
w AS (SELECT track_id, p, sum(v * v) OVER (PARTITION BY track_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 63 FOLLOWING) AS energy FROM s),
f AS (SELECT track_id, p // 32 AS k, energy FROM w JOIN n USING (track_id) WHERE p % 32 = 0 AND p <= n - 64),
t AS (SELECT track_id, max(energy) AS peak, max(k) AS last FROM f GROUP BY 1),
q AS (SELECT track_id, k, last, k - row_number() OVER (PARTITION BY track_id ORDER BY k) AS run FROM f JOIN t USING (track_id) WHERE energy < 0.8 * peak),
z AS (SELECT track_id, min(k) AS first_k, max(k) AS last_k FROM q GROUP BY track_id, run, last HAVING min(k) > 0 AND max(k) < last AND (max(k) - min(k)) * 0.5 >= 0.5),
"""


def _blocks(table):
    v = table("embeddings").select(F.floor(F.col("vec_id") / 40).cast("long").alias("track_id"), (F.col("vec_id") % 40 * 64).alias("first"), F.transform("embedding", lambda x: F.floor(1000 * x.cast("double"))).alias("samples"))
    # Lengths are few and are looked up: a window would sort all samples.
    totals = v.groupBy("track_id").agg(F.sum(F.size("samples")).alias("total")).hint("shuffle_hash")
    return v.join(totals, "track_id")


def _frames(table):
    return samples.envelope(_blocks(table), FRAME, STEP)


def _pauses(table):
    return samples.pauses(_frames(table), STEP / RATE, share=QUIET, least=LEAST)


@query(SAMPLES + """
c AS (SELECT track_id, p, sum(v * v) OVER (PARTITION BY track_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 299 FOLLOWING) AS energy FROM s)
SELECT track_id, p::BIGINT AS start, energy::DOUBLE AS energy FROM c JOIN n USING (track_id) WHERE p <= n - 300 AND (p % 50 = 0 OR p = n - 300)
QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY energy DESC, p) = 1""")
def loudest_window(table):
    return samples.loudest(_blocks(table), WIDTH, HOP)


@query(FRAMES[: FRAMES.rindex(",")] + " SELECT track_id, first_k::BIGINT AS first_k, last_k::BIGINT AS last_k FROM z")
def quiet_islands(table):
    return _pauses(table)


@query(FRAMES + """
r AS (SELECT z.track_id, first_k * 0.5::DOUBLE AS start, last_k * 0.5::DOUBLE AS stop, sqrt(sum(v * v) / ((last_k - first_k) * 32)) / sqrt(any_value(whole) / any_value(n)) AS ratio
  FROM z JOIN s ON s.track_id = z.track_id AND p >= first_k * 32 AND p < last_k * 32 JOIN n ON n.track_id = z.track_id GROUP BY z.track_id, first_k, last_k)
SELECT track_id, start, stop, CASE WHEN ratio >= 0.95 THEN 'groove' ELSE 'silence' END AS kind, round(ratio, 4) AS ratio FROM r""")
def breakdown_types(table):
    spans = _pauses(table).select("track_id", (F.col("first_k") * STEP / RATE).alias("start"), (F.col("last_k") * STEP / RATE).alias("stop"))
    return samples.breakdown_kinds(_blocks(table), spans, RATE, 64, threshold=0.95)


@query(FRAMES + """
l AS (SELECT f.track_id, k * 0.5::DOUBLE AS t, energy, peak FROM f JOIN t USING (track_id) WHERE energy >= 0.75 * peak),
b AS (SELECT d.track_id, d.t, max(l.energy) AS energy, any_value(l.peak) AS peak FROM (SELECT DISTINCT track_id, k * 0.5::DOUBLE AS t FROM f WHERE k % 9 = 0) d JOIN l ON l.track_id = d.track_id AND abs(l.t - d.t) <= 0.5 GROUP BY 1, 2),
c AS (SELECT z.track_id, last_k * 0.5::DOUBLE AS searched, x.t, x.energy, x.peak, x.rank FROM z JOIN (SELECT *, 1 AS rank FROM l UNION ALL SELECT *, 0 FROM b) x ON x.track_id = z.track_id AND x.t >= last_k * 0.5 AND x.t <= last_k * 0.5 + 4),
o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY track_id, searched ORDER BY rank, t) = 1)
SELECT track_id, searched, t AS start, round(energy / peak, 4) AS energy_ratio, t - searched > 0.1 AS corrected, CASE WHEN t - searched > 0.1 THEN t - searched ELSE 0 END AS "offset" FROM o""")
def bass_drops(table):
    frames = _frames(table)
    beats = frames.where("k % 9 = 0").select("track_id", (F.col("k") * STEP / RATE).alias("beat"))
    searches = _pauses(table).select("track_id", (F.col("last_k") * STEP / RATE).alias("searched"))
    return samples.drops(frames, searches, beats, STEP / RATE, within=4.0, around=0.5)


@query(FRAMES + "k AS (SELECT track_id, min(k) * 0.5::DOUBLE AS first_kick FROM f JOIN t USING (track_id) WHERE energy >= 0.9 * peak GROUP BY 1) SELECT * FROM k")
def first_kicks(table):
    return samples.first_kicks(_frames(table), STEP / RATE, share=0.9)


@query(FRAMES + """
d AS (SELECT track_id, k, greatest(0, energy - coalesce(lag(energy) OVER (PARTITION BY track_id ORDER BY k), energy)) AS rise FROM f),
g AS (SELECT *, max(rise) OVER (PARTITION BY track_id ORDER BY k ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS most, avg(rise) OVER (PARTITION BY track_id ORDER BY k ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS mean, max(rise) OVER (PARTITION BY track_id) AS top FROM d)
SELECT track_id, k * 0.5::DOUBLE AS t FROM g WHERE rise > 0 AND rise = most AND rise >= mean + 0.15 * top""")
def kick_times(table):
    return samples.kicks(_frames(table), STEP / RATE, wait=0)
