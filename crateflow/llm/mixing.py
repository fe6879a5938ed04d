"""Operator 10: mixing sources to target weights by Pfair scheduling, DataFrame functions only.

Every source's documents are put in a fixed pseudo-random order (md5 of the doc_id) and cut
into blocks of ``block_docs``. A source of weight w gives its k-th block (k from 0) the
release time floor(k / w) and the deadline ceil((k + 1) / w). One block a slot, the released
block of earliest deadline runs first (ties: smaller source). On one processor with weights
that sum to 1 this meets every deadline, so until a source runs out its number of blocks in
the first t slots differs from w * t by less than one block; its later slots stay empty, and
the others keep their proportions.

Weights are whole numbers. Divided by their greatest common divisor they are the quotas of a
period as long as their sum, so releases, deadlines and the bound above hold for the weights as
given, over any number of periods. That one period is scheduled on the driver from one row a
source, in time in proportion to its slots, and is broadcast. It has at most ``SLOTS`` slots and
sources; weights whose period is longer are refused, not rounded. By default a source weighs
the square root of its number of documents, rounded up. These, too, are refused where their
period is longer, which begins at some 10**13 documents: give weights of a smaller sum then.

Ranks inside a source come from counts of hash buckets and row numbers inside a bucket, so that
no task holds a source.

A null source is a source of its own. Null doc_ids rank as an empty text does. Repeated rows
keep their places next to each other. An empty table gives an empty one. Texts are not read.
Columns of the input that share a name with a result column are kept in ``mixed`` (the input's
columns alone come back, in schedule order) and left out of ``schedule``.
"""

from __future__ import annotations

import heapq
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Documents of a block, and most rows aimed at in a hash bucket.
BLOCK_DOCS, BUCKET_ROWS = 8, 1_000_000
#: Most slots of a period.
SLOTS = 1 << 22


def _whole(a: Column, b: Column) -> Column:
    """floor(a / b) of whole numbers, exact at any size."""
    return ((a - a % b) / b).cast("long")


def _release(k: Column, quota: Column, period: Column) -> Column:
    return _whole(k * period, quota)


def _deadline(k: Column, quota: Column, period: Column) -> Column:
    return _whole((k + F.lit(1)) * period + quota - 1, quota)


def _weighed(counts: list[tuple[str, int]], weights: dict[str, int] | None) -> list[tuple[str, int, int]]:
    """(skey, n, weight) of every source. ``weights`` are whole numbers by source (None: the null one; missing: 1)."""
    if weights is not None:
        return [(k, n, max(1, int(weights.get(k[1:] if k else None, 1)))) for k, n in counts]
    return [(k, n, math.isqrt(n - 1) + 1) for k, n in counts]


def earliest_deadline_first(quota: list[int], slots: int) -> list[list[int]]:
    """The places of each source among the first ``slots`` of a period of sum(quota)."""
    period = sum(quota)
    ready, waiting, places = [(-(-period // q), i) for i, q in enumerate(quota)], [], [[] for _ in quota]
    heapq.heapify(ready)
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            heapq.heappush(ready, heapq.heappop(waiting)[1:])
        i = heapq.heappop(ready)[1]
        places[i].append(t)
        k, q = len(places[i]), quota[i]
        if k < q:
            heapq.heappush(waiting, (k * period // q, -(-(k + 1) * period // q), i))
    return places


def period_plan(counts: DataFrame, weights: dict[str, int] | None, block_docs: int) -> DataFrame:
    """skey, quota, period, slots: the slots of each source in one period, by earliest deadline first."""
    found = sorted((r.skey, r.n) for r in counts.limit(SLOTS + 1).collect())  # one row a source
    rows = _weighed(found, weights)
    shared = math.gcd(*(w for _, _, w in rows))
    quota = [w // shared for _, _, w in rows]
    period = sum(quota)
    # The deadline of the last block that any source has.
    needed = min(period, max((-(-(-(-n // block_docs) * period) // q) for (_, n, _), q in zip(rows, quota, strict=True)), default=0))
    if needed > SLOTS:
        raise ValueError(f"the weights' period has {period} slots; at most {SLOTS} can be scheduled: give weights of a smaller sum")
    places = earliest_deadline_first(quota, needed)
    plan = json.dumps([{"skey": k, "quota": q, "period": period, "slots": p} for (k, _, _), q, p in zip(rows, quota, places, strict=True)])
    parsed = F.from_json(F.lit(plan), "array<struct<skey string, quota long, period long, slots array<long>>>")
    return counts.sparkSession.range(1).select(F.explode(parsed).alias("s")).select("s.*")


def _placed(docs: DataFrame, weights: dict[str, int] | None, block_docs: int, columns: list[Column]) -> DataFrame:
    """``columns`` with rank, block, release, deadline, slot and position."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    n = docs.count()
    digits = max(2, math.ceil(math.log(max(n / BUCKET_ROWS, 1), 16)))
    keyed = docs.select(
        *columns,
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("skey"),
        key.alias("key"),
        F.substring(key, 1, digits).alias("bucket"),
    )
    counts = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("skey"), F.substring(key, 1, digits).alias("bucket")
    ).groupBy("skey", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("skey", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("skey", "bucket").orderBy("key")
    sources = counts.groupBy("skey").agg(F.sum("n").alias("n"))
    plan = period_plan(sources, weights, block_docs)
    ranked = keyed.withColumn("rank", F.row_number().over(own) - 1).join(offsets, ["skey", "bucket"])
    rank = (F.col("rank") + F.col("before")).cast("long")
    block = _whole(rank, F.lit(block_docs))
    placed = ranked.select("*", rank.alias("rank_"), block.alias("block_")).join(F.broadcast(plan), "skey")
    slot = _whole(F.col("block_"), F.col("quota")) * F.col("period") + F.expr("slots[cast(block_ % quota as int)]")
    return placed.select(
        *[F.col(f"in_{k}") for k in range(len(columns))],
        F.col("rank_").alias("rank"),
        F.col("block_").alias("block"),
        _release(F.col("block_"), F.col("quota"), F.col("period")).alias("release"),
        _deadline(F.col("block_"), F.col("quota"), F.col("period")).alias("deadline"),
        slot.cast("long").alias("slot"),
        (slot * block_docs + F.col("rank_") % block_docs).cast("long").alias("position"),
    )


def schedule(docs: DataFrame, weights: dict[str, int] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """doc_id, source, rank (in its source), block, release, deadline, slot, position (the
    order of the mix: ascending, with gaps where a source has run out)."""
    out = _placed(docs, weights, block_docs, [F.col("doc_id").alias("in_0"), F.col("source").alias("in_1")])
    return out.withColumnsRenamed({"in_0": "doc_id", "in_1": "source"})


def mixed(docs: DataFrame, weights: dict[str, int] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """All rows and columns of ``docs`` in the order of the mix, over range partitions of it."""
    out = _placed(docs, weights, block_docs, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("in_0")])
    return out.select("in_0", "position").orderBy("position").select("in_0.*")


def positioned(docs: DataFrame, weights: dict[str, int] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """As ``mixed``, with each row's position as a last column, in place of one of that name."""
    columns = [c for c in docs.columns if c.lower() != "position"]
    out = _placed(docs, weights, block_docs, [F.struct(*[F.col(f"`{c}`") for c in columns]).alias("in_0")])
    return out.select("in_0", "position").orderBy("position").select("in_0.*", "position")


def numbered(docs: DataFrame, weights: dict[str, int] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """doc_id, text, position in the mix of every row of ``docs``, in no order: the position is
    a value of its own, which survives any file or partition order."""
    out = _placed(docs, weights, block_docs, [F.col("doc_id").alias("in_0"), F.col("text").alias("in_1")])
    return out.select(F.col("in_0").alias("doc_id"), F.col("in_1").alias("text"), "position")


SQL = f"""
WITH RECURSIVE counts AS (
  SELECT CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS skey, count(*) AS n FROM documents GROUP BY 1),
roots AS (SELECT skey, CAST(ceil(sqrt(n)) AS BIGINT) AS r FROM counts),
weighed AS (SELECT skey, r AS w FROM roots),
shared AS (SELECT list_reduce(list(w), lambda a, b: gcd(a, b)) AS g FROM weighed),
quota AS (SELECT skey, CAST(w // g AS BIGINT) AS quota FROM weighed, shared),
named AS (
  SELECT skey, quota, CAST(row_number() OVER (ORDER BY skey) AS BIGINT) AS i,
         CAST(sum(quota) OVER () AS BIGINT) AS period FROM quota),
lists AS (SELECT list(quota ORDER BY i) AS q, any_value(period) AS period FROM named),
edf AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(q, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick, q, period FROM lists
  UNION ALL
  SELECT t, list_transform(done, lambda d, i: CASE WHEN i = pick THEN d + 1 ELSE d END), pick, q, period
  FROM (
    SELECT t + 1 AS t, done, q, period,
      list_min(list_transform(list_filter(list_transform(q, lambda x, i: [
        CASE WHEN done[i] < x AND (done[i] * period) // x <= t + 1 THEN 0 ELSE 1 END,
        ((done[i] + 1) * period + x - 1) // x, i]), lambda y: y[1] = 0), lambda y: y[2] * 1000000 + y[3])) % 1000000 AS pick
    FROM edf WHERE t + 1 < period)),
slots AS (
  SELECT pick AS i, t AS place, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j FROM edf WHERE t >= 0),
ranked AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS skey,
    row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), ''))) - 1 AS rank
  FROM documents),
blocks AS (SELECT *, rank // {BLOCK_DOCS} AS block FROM ranked JOIN named USING (skey))
SELECT doc_id, source, CAST(rank AS BIGINT) AS rank, CAST(block AS BIGINT) AS block,
  CAST((block * period) // quota AS BIGINT) AS release,
  CAST(((block + 1) * period + quota - 1) // quota AS BIGINT) AS deadline,
  CAST((block // quota) * period + place AS BIGINT) AS slot,
  CAST(((block // quota) * period + place) * {BLOCK_DOCS} + rank % {BLOCK_DOCS} AS BIGINT) AS position
FROM blocks b JOIN slots s ON s.i = b.i AND s.j = b.block % b.quota
"""
