"""Cue points and shares from the segments of a track: arrays of struct(start, stop, label)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DROPS, BREAKS = ("drop", "chorus"), ("breakdown", "bridge")


def ordered(segments: Column) -> Column:
    """Segments with a start, by start; a missing or earlier stop is the start, labels in lower case."""
    known = F.filter(segments, lambda s: s["start"].isNotNull() & ~F.isnan(s["start"]))
    plain = F.transform(known, lambda s, i: F.struct(
        s["start"].alias("start"), i.alias("i"), F.greatest(F.coalesce(s["stop"], s["start"]), s["start"]).alias("stop"), F.lower(F.trim(F.coalesce(s["label"], F.lit("")))).alias("label")
    ))
    return F.array_sort(plain)


def _start(segments: Column, labels: tuple[str, ...], nth: int = 1) -> Column:
    return F.bround(F.try_element_at(F.filter(segments, lambda s: s["label"].isin(*labels)), F.lit(nth))["start"], 3)


def cues(segments: Column, beats: Column, duration: Column) -> Column:
    """struct(first_kick, drop, second_drop, breakdown, breakdown_kind, breakdown_ratio, marks): the first
    beat from the first sound on, the first drop or chorus, the second drop, the first breakdown or bridge."""
    own = ordered(F.coalesce(segments, F.expr("cast(array() as array<struct<start:double,stop:double,label:string>>)")))
    times = F.array_sort(F.filter(F.coalesce(beats, F.expr("cast(array() as array<double>)")), lambda b: b.isNotNull() & (b >= 0)))
    sound = F.coalesce(F.try_element_at(F.filter(own, lambda s: s["label"] != "silence"), F.lit(1))["start"], F.lit(0.0))
    kick = F.when(F.size(times) == 0, 0.0).otherwise(F.bround(F.coalesce(F.try_element_at(F.filter(times, lambda b: b >= sound - 1e-9), F.lit(1)), sound), 3))
    drop, second, breakdown = _start(own, DROPS), _start(own, ("drop",), 2), _start(own, BREAKS)
    quiet = F.aggregate(F.filter(own, lambda s: s["label"].isin(*BREAKS)), F.lit(0.0), lambda a, s: a + s["stop"] - s["start"])
    kind = F.when(F.exists(own, lambda s: s["label"] == "silence"), "silence").otherwise("groove")
    mark = lambda name, at: F.when(at.isNotNull(), F.struct(F.lit(name).alias("name"), at.alias("time")))
    marks = F.array_compact(F.array(mark("First Kick", kick), mark("Drop", drop), mark("Drop 2", second), mark("Breakdown", breakdown)))
    given = (F.size(own) > 0) | (F.size(times) > 0)
    return F.struct(
        kick.alias("first_kick"), drop.alias("drop"), second.alias("second_drop"), breakdown.alias("breakdown"), kind.alias("breakdown_kind"),
        F.bround(quiet / F.greatest(F.coalesce(duration, F.lit(0.0)), F.lit(1.0)), 3).alias("breakdown_ratio"), F.when(given, marks).otherwise(F.slice(marks, 1, 0)).alias("marks"),
    )


def drop_start(segments: Column) -> Column:
    """Where the first breakdown ends; null where there is none."""
    return F.bround(F.try_element_at(F.filter(segments, lambda s: s["label"] == "breakdown"), F.lit(1))["stop"], 3)


def breakdown_ratio(segments: Column) -> Column:
    """Breakdowns' share of the time between intro and outro, to four digits; 0 without such time."""
    first, last = F.try_element_at(segments, F.lit(1)), F.try_element_at(segments, F.lit(-1))
    begin = F.when(first["label"] == "intro", first["stop"]).otherwise(first["start"])
    end = F.when(last["label"] == "outro", last["start"]).otherwise(last["stop"])
    inside = F.filter(segments, lambda s: (s["label"] == "breakdown") & (s["start"] >= begin) & (s["stop"] <= end))
    quiet = F.aggregate(inside, F.lit(0.0), lambda a, s: a + s["stop"] - s["start"])
    return F.when(end > begin, F.bround(quiet / (end - begin), 4)).otherwise(0.0)


def hot_cues(bpm: Column, duration: Column, kick: Column, drop: Column, second_drop: Column, breakdown: Column, loop: Column, fill: Column, outro: Column) -> Column:
    """Up to eight pads, array of struct(pad, name, time): entries 128 and 64 beats before the drop, drops,
    loop or breakdown, fill, outro. Pads without a place are left out."""
    beat = F.when(bpm > 0, 60.0 / bpm)
    floor = F.coalesce(kick, F.lit(0.0))
    early = drop - 128.0 * beat
    entry = F.when(early.isNull() | (early < kick), kick).otherwise(early)
    late, own_fill = drop - 64.0 * beat, F.coalesce(fill, drop - beat)
    tail = duration - 64.0 * beat
    own_outro = F.coalesce(outro, F.when(tail > F.greatest(F.coalesce(drop, F.lit(0.0)), F.coalesce(breakdown, F.lit(0.0)), floor), tail))
    pad = lambda k, name, at, ok=F.lit(True): F.when(at.isNotNull() & F.coalesce(ok, F.lit(False)), F.struct(F.lit(k).alias("pad"), F.lit(name).alias("name"), at.alias("time")))
    return F.array_compact(F.array(
        pad(0, "Main Entry", F.greatest(entry, F.lit(0.0)), entry.isNotNull()), pad(1, "Late Entry", late, late >= floor), pad(2, "Drop 1", drop),
        F.coalesce(pad(3, "Percussion Loop", loop), pad(3, "Breakdown", breakdown)), pad(4, "Breakdown", breakdown, loop.isNotNull()),
        pad(5, "Drop 2", second_drop), pad(6, "Snare Fill", own_fill, drop.isNotNull() & beat.isNotNull() & (own_fill >= floor)),
        pad(7, "Outro", own_outro, (duration > 0) & beat.isNotNull()),
    ))


def plain_hot_cues(kick: Column, drop: Column, second_drop: Column, breakdown: Column) -> Column:
    """The four sections as pads in order, those without a place left out."""
    mark = lambda name, at: F.when(at.isNotNull(), F.struct(F.lit(name).alias("name"), at.alias("time")))
    return F.transform(F.array_compact(F.array(mark("First Kick", kick), mark("Drop", drop), mark("Drop 2", second_drop), mark("Breakdown", breakdown))),
                       lambda m, i: F.struct(i.alias("pad"), m["name"].alias("name"), m["time"].alias("time")))
