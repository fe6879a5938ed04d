"""Measures of sample series that are stored as rows of blocks.

A block has track_id, first (its first sample's number), total (samples of the whole track, as a file's
header gives them) and samples. Every measure adds up what blocks hold of a window, so windows may
reach over any number of blocks, blocks never meet in one task, and the result does not depend on how
a track was cut (sums are rounded to ``DIGITS``, which hides the order of additions).

Missing samples count as 0, blocks without samples and rows without a track give nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIGITS = 9
#: Shares of a track's peak: what counts as quiet, as a kick, as a drop; of the whole level: as a groove.
QUIET, KICK, DROP, GROOVE = 0.01, 0.5, 0.75, 0.15
#: Seconds: a drop is looked for so long, a downbeat's energy is taken so far around it, a later drop
#: than so much is a corrected one, and a pause lasts so long at least.
SEARCH, AROUND, LATER, PAUSE = 12.0, 0.15, 0.1, 6.0
#: Frames that are looked at together for pauses.
FRAMES = 4096


def blocks(tracks: DataFrame, size: int) -> DataFrame:
    """Tracks (track_id, samples) cut into blocks of ``size`` samples."""
    n = F.size("samples")
    cut = tracks.where(n > 0).select("track_id", "samples", n.alias("total"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).alias("k"))
    return cut.select("track_id", (F.col("k").cast("long") * size).alias("first"), F.col("total").cast("long").alias("total"), F.slice("samples", F.col("k") * size + 1, F.lit(size)).alias("samples"))


def _window_sums(parts: DataFrame, width: int, hop: int, last: bool) -> DataFrame:
    """track_id, start, energy (sum of squares) of the windows of ``width`` samples at every ``hop``-th
    sample that lie inside the track, with ``last`` also of the one that ends with it."""
    if width < 1 or hop < 1:
        raise ValueError("a window and its step have a sample at least")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for track, first, total, samples in zip(*[batch.column(k) for k in range(4)], strict=True):
                x = np.nan_to_num(samples.values.cast(pa.float64()).to_numpy(zero_copy_only=False))
                first, total, n = first.as_py(), total.as_py(), len(x)
                if total < width or not n:
                    continue
                sums = np.concatenate([[0.0], np.cumsum(x * x)])
                low, high = max(0, -(-(first - width + 1) // hop)), min((total - width) // hop, (first + n - 1) // hop)
                starts = np.arange(low, high + 1, dtype=np.int64) * hop
                if last and (total - width) % hop and first + n > total - width:
                    starts = np.append(starts, total - width)
                if len(starts):
                    part = sums[np.clip(starts + width - first, 0, n)] - sums[np.clip(starts - first, 0, n)]
                    yield pa.RecordBatch.from_arrays([pa.repeat(track, len(starts)), pa.array(starts), pa.array(part)], names=["track_id", "start", "part"])

    own = parts.where("track_id is not null and size(samples) > 0").select("track_id", F.col("first").cast("long").alias("first"), F.col("total").cast("long").alias("total"), F.col("samples").cast("array<double>").alias("samples"))
    return own.mapInArrow(work, f"track_id {dict(own.dtypes)['track_id']}, start long, part double").groupBy("track_id", "start").agg(F.round(F.sum("part"), DIGITS).alias("energy"))


def loudest(parts: DataFrame, width: int, hop: int) -> DataFrame:
    """track_id, start, energy of each track's window of most energy, the earliest of equals; start 0
    without an energy for tracks shorter than a window."""
    best = _window_sums(parts, width, hop, last=True).groupBy("track_id").agg(F.max_by(F.struct("start", "energy"), F.struct(F.col("energy"), -F.col("start"))).alias("w")).select("track_id", "w.*")
    short = parts.where("track_id is not null and size(samples) > 0").where(F.col("total") < width).select("track_id").distinct()
    return best.unionByName(short.select("track_id", F.lit(0).cast("long").alias("start"), F.lit(None).cast("double").alias("energy")))


def envelope(parts: DataFrame, frame: int, hop: int) -> DataFrame:
    """track_id, k, energy of frame k: the sum of squares of ``frame`` samples from sample k * ``hop`` on."""
    sums = _window_sums(parts, frame, hop, last=False)
    return sums.select("track_id", F.floor(F.col("start") / hop).cast("long").alias("k"), "energy")


def peaks(frames: DataFrame) -> DataFrame:
    """track_id, peak, last_k of tracks that are not silent."""
    return frames.groupBy("track_id").agg(F.max("energy").alias("peak"), F.max("k").alias("last_k")).where("peak > 0")


def pauses(frames: DataFrame, seconds: float, share: float = QUIET, least: float = PAUSE) -> DataFrame:
    """track_id, first_k, last_k of stretches of frames below ``share`` of the track's peak, neither at its
    start nor at its end, that last ``least`` seconds. ``seconds``: from one frame to the next.

    Stretches are found in pieces of ``FRAMES`` frames; only those that touch a piece's edge, two a
    piece at most, meet their neighbours."""
    top = peaks(frames)
    quiet = frames.join(top, "track_id").where(F.col("energy") < share * F.col("peak")).select("track_id", "k", "last_k", F.floor(F.col("k") / FRAMES).alias("piece"))
    run = F.col("k") - F.row_number().over(Window.partitionBy("track_id", "piece").orderBy("k"))
    local = quiet.withColumn("run", run).groupBy("track_id", "piece", "run").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.first("last_k").alias("last_k"))
    edge = (F.col("a") % FRAMES == 0) | ((F.col("b") + 1) % FRAMES == 0)
    by = Window.partitionBy("track_id").orderBy("a")
    met = local.where(edge).withColumn("fresh", F.coalesce(F.col("a") != F.lag("b").over(by) + 1, F.lit(True)).cast("int")).withColumn("run", F.sum("fresh").over(by))
    joined = met.groupBy("track_id", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.first("last_k").alias("last_k"))
    columns = ["track_id", F.col("a").alias("first_k"), F.col("b").alias("last_k")]
    inside = (F.col("a") > 0) & (F.col("b") < F.col("last_k")) & ((F.col("b") - F.col("a")) * F.lit(seconds) >= least)
    return local.where(~edge).where(inside).select(*columns).union(joined.where(inside).select(*columns))


def first_kicks(frames: DataFrame, seconds: float, share: float = KICK) -> DataFrame:
    """track_id, first_kick: the time of the first frame that reaches ``share`` of the peak."""
    loud = frames.join(peaks(frames), "track_id").where(F.col("energy") >= share * F.col("peak"))
    return loud.groupBy("track_id").agg(F.bround(F.min("k") * F.lit(seconds), 3).alias("first_kick"))


def kicks(frames: DataFrame, seconds: float, share: float = 0.15, near: int = 3, wait: int = 8) -> DataFrame:
    """track_id, t of frames whose energy rises by more than around them: the rise from the frame before is the
    largest among ``near`` frames before and ``near`` - 1 behind, and ``share`` of the track's largest rise above
    their mean; after one, none counts within ``wait`` frames. What ``trends.kick_segments`` takes.

    Candidates that follow each other within ``wait`` frames are few; each row of them is gone through in order."""
    by = Window.partitionBy("track_id").orderBy("k")
    around = by.rowsBetween(-near, near - 1)
    rises = frames.withColumn("rise", F.greatest(F.lit(0.0), F.coalesce(F.col("energy") - F.lag("energy").over(by), F.lit(0.0))))
    top = rises.groupBy("track_id").agg(F.max("rise").alias("top")).where("top > 0")
    marked = rises.withColumns({"most": F.max("rise").over(around), "mean": F.avg("rise").over(around)}).join(top, "track_id")
    found = marked.where((F.col("rise") > 0) & (F.col("rise") == F.col("most")) & (F.col("rise") >= F.col("mean") + share * F.col("top"))).select("track_id", "k")
    rows = found.withColumn("fresh", F.coalesce(F.col("k") - F.lag("k").over(by) > wait, F.lit(True)).cast("int")).withColumn("row", F.sum("fresh").over(by))
    own = rows.groupBy("track_id", "row").agg(F.array_sort(F.collect_list("k")).alias("ks"))
    kept = F.aggregate("ks", F.array().cast("array<bigint>"), lambda done, k: F.when((F.size(done) == 0) | (k - F.try_element_at(done, F.lit(-1)) > wait), F.array_append(done, k)).otherwise(done))
    return own.select("track_id", F.explode(kept).alias("k")).select("track_id", (F.col("k") * F.lit(seconds)).alias("t"))


def drops(frames: DataFrame, searches: DataFrame, beats: DataFrame | None, seconds: float, share: float = DROP, within: float = SEARCH, around: float = AROUND) -> DataFrame:
    """track_id, searched, start, energy_ratio, corrected, offset: where the energy comes back after
    ``searched`` (searches: track_id, searched), ``within`` seconds at most.

    That is the first downbeat (beats: track_id, beat) around which a frame reaches ``share`` of the
    track's peak, else the first frame that does; searches without one have no row. A band join on
    pieces of time as wide as the search."""
    piece = lambda c, width: F.floor(c / F.lit(width)).cast("long")
    loud = frames.join(peaks(frames), "track_id").where(F.col("energy") >= share * F.col("peak")).select("track_id", (F.col("k") * F.lit(seconds)).alias("t"), "energy", "peak")
    asked = searches.select("track_id", F.col("searched").cast("double").alias("searched")).where("searched is not null").distinct()
    spread = asked.withColumn("piece", F.explode(F.sequence(piece(F.col("searched"), within), piece(F.col("searched") + within, within))))
    hit = F.col("t").between(F.col("searched"), F.col("searched") + within)
    plain = spread.join(loud.withColumn("piece", piece(F.col("t"), within)), ["track_id", "piece"]).where(hit)
    found = plain.select("track_id", "searched", F.lit(1).alias("rank"), "t", "energy", "peak")
    if beats is not None:
        own = beats.select("track_id", F.col("beat").cast("double").alias("t")).where("t is not null").distinct()
        near = own.withColumn("piece", F.explode(F.sequence(piece(F.col("t") - around, 1.0), piece(F.col("t") + around, 1.0))))
        frames_near = loud.select("track_id", F.col("t").alias("at"), "energy", "peak").withColumn("piece", piece(F.col("at"), 1.0))
        strong = near.join(frames_near, ["track_id", "piece"]).where(F.abs(F.col("at") - F.col("t")) <= around).groupBy("track_id", "t").agg(F.max("energy").alias("energy"), F.max("peak").alias("peak"))
        on_beat = spread.join(strong.withColumn("piece", piece(F.col("t"), within)), ["track_id", "piece"]).where(hit)
        found = found.union(on_beat.select("track_id", "searched", F.lit(0).alias("rank"), "t", "energy", "peak"))
    best = found.groupBy("track_id", "searched").agg(F.min(F.struct("rank", "t", "energy", "peak")).alias("d"))
    offset = F.col("d.t") - F.col("searched")
    return best.select(
        "track_id", "searched", F.bround("d.t", 3).alias("start"), F.bround(F.col("d.energy") / F.col("d.peak"), 4).alias("energy_ratio"),
        (offset > LATER).alias("corrected"), F.when(offset > LATER, F.bround(offset, 3)).otherwise(0.0).alias("offset"),
    )


def breakdown_kinds(parts: DataFrame, spans: DataFrame, rate: float, size: int, threshold: float = GROOVE) -> DataFrame:
    """track_id, start, stop, kind, ratio for spans (track_id, start, stop in seconds): groove where the
    level of the span is ``threshold`` of the track's, else silence, with their ratio; silence and 0 for
    spans that begin before 0, end before they begin or lie behind the track, and for silent tracks.

    ``size``: most samples of a block, whose multiples deal the spans out to the blocks they touch."""

    @F.arrow_udf("double")
    def squares(samples: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
        out = []
        for x, a, b in zip(samples, low.to_pylist(), high.to_pylist(), strict=True):
            own = np.nan_to_num(x.values.cast(pa.float64()).to_numpy(zero_copy_only=False))[a:b]
            out.append(float((own * own).sum()))
        return pa.array(out, pa.float64())

    own = parts.where("track_id is not null and size(samples) > 0").select("track_id", "first", "total", F.col("samples").cast("array<double>").alias("samples"))
    n = F.size("samples")
    level = own.select("track_id", "total", squares("samples", F.lit(0), n).alias("part")).groupBy("track_id").agg(F.sum("part").alias("all"), F.max("total").alias("total"))
    asked = spans.select("track_id", F.col("start").cast("double").alias("start"), F.col("stop").cast("double").alias("stop")).distinct()
    valid = asked.where("start >= 0 and stop > start").select("*", F.floor(F.col("start") * rate).cast("long").alias("i"), F.floor(F.col("stop") * rate).cast("long").alias("j")).where("j > i")
    dealt = valid.withColumn("piece", F.explode(F.sequence(F.floor(F.col("i") / size), F.floor((F.col("j") - 1) / size))))
    spread = own.withColumn("piece", F.explode(F.array_distinct(F.array(F.floor(F.col("first") / size), F.floor((F.col("first") + n - 1) / size)))))
    clip = lambda c: F.least(F.greatest(c - F.col("first"), F.lit(0)), n).cast("int")
    # A block and a span may share two pieces; they are counted in the first of them.
    first_shared = F.greatest(F.floor(F.col("i") / size), F.floor(F.col("first") / size)) == F.col("piece")
    touched = dealt.join(spread, ["track_id", "piece"]).where(first_shared & (clip(F.col("j")) > clip(F.col("i"))))
    sums = touched.select("track_id", "start", "stop", squares("samples", clip(F.col("i")), clip(F.col("j"))).alias("part")).groupBy("track_id", "start", "stop").agg(F.sum("part").alias("own"))
    sums = sums.select(F.col("track_id").alias("track_"), F.col("start").alias("start_"), F.col("stop").alias("stop_"), "own")
    level = level.withColumnRenamed("track_id", "of_")
    met = (F.col("track_id") == F.col("track_")) & (F.col("start") == F.col("start_")) & (F.col("stop") == F.col("stop_"))
    rows = asked.join(sums, met, "left").join(level, F.col("track_id") == F.col("of_"), "left")
    count = F.least(F.floor(F.col("stop") * rate), F.col("total")) - F.floor(F.col("start") * rate)
    ratio = F.when((F.col("all") > 0) & (count > 0) & F.col("own").isNotNull(), F.sqrt(F.col("own") / count) / F.sqrt(F.col("all") / F.col("total")))
    return rows.withColumn("r", F.coalesce(ratio, F.lit(0.0))).select("track_id", "start", "stop", F.when(F.col("r") >= threshold, "groove").otherwise("silence").alias("kind"), F.bround("r", 4).alias("ratio"))


def stem_report(bass: DataFrame, drums: DataFrame, beats: DataFrame | None, rate: float, frame: int, hop: int, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pauses of the bass with their kind by the drums, drops after them, first kicks)."""
    seconds = hop / rate
    frames = envelope(bass, frame, hop)
    quiet = pauses(frames, seconds).select("track_id", (F.col("first_k") * F.lit(seconds)).alias("start"), (F.col("last_k") * F.lit(seconds)).alias("stop"))
    return breakdown_kinds(drums, quiet, rate, size), drops(frames, quiet.select("track_id", F.col("stop").alias("searched")), beats, seconds), first_kicks(frames, seconds)


def time_of(k: Column, seconds: float) -> Column:
    """The time of frame k."""
    return F.bround(k * F.lit(seconds), 3)
