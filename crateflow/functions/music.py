"""Keys, tempo, phrases, loudness and ratings, as expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The price of a transition by how two keys relate.
RELATION_COST = {"same": 0.0, "neighbour": 1.0, "relative": 1.5, "plus2": 3.0, "plus3": 5.0, "far": 8.0, "unknown": 6.0}
#: Steps of tempo that are easy, and beyond which tracks are not mixed.
EASY_BPM, MOST_BPM = 3.0, 4.0
INF = float("inf")


def key_number(key: Column, strict: bool = True) -> Column:
    """1..12 of a key such as 8A, else null; without ``strict`` blanks around and lower case are fine."""
    own = key if strict else F.upper(F.trim(key))
    return F.regexp_extract(own, r"^0*([1-9]|1[0-2])[ABab]$", 1).try_cast("int") if strict else F.regexp_extract(own, r"^([1-9]|1[0-2])[AB]$", 1).try_cast("int")


def key_letter(key: Column) -> Column:
    return F.upper(F.right(F.trim(key), F.lit(1)))


def normal_key(key: Column) -> Column:
    """A key in upper case without blanks, null where it is none."""
    own = F.upper(F.trim(key))
    return F.when(own.rlike("^(?:[1-9]|1[0-2])[AB]$"), own)


def compatible_keys(key: Column) -> Column:
    """[the key, one down, one up, the other letter] on the wheel of twelve; null for no key."""
    n, letter = key_number(key, strict=False), key_letter(key)
    other = F.when(letter == "A", "B").otherwise("A")
    name = lambda number, own: F.concat(number.cast("string"), own)
    return F.when(n.isNotNull(), F.array(name(n, letter), name((n + 10) % 12 + 1, letter), name(n % 12 + 1, letter), name(n, other)))


def camelot_distance(a: Column, b: Column) -> Column:
    """Steps around the wheel, one more for another letter: 0 to 7; null where a key is none."""
    gap = F.abs(key_number(a, strict=False) - key_number(b, strict=False))
    return F.least(gap, 12 - gap) + F.when(key_letter(a) == key_letter(b), 0).otherwise(1)


def camelot_relation(a: Column, b: Column) -> Column:
    """How key ``b`` follows key ``a``: a name of ``RELATION_COST``. Two up is directed."""
    n, m, same = key_number(a), key_number(b), key_letter(a) == key_letter(b)
    step = F.pmod(m - n, F.lit(12))
    return (
        F.when(n.isNull() | m.isNull(), "unknown").when((step == 0) & same, "same").when(same & step.isin(1, 11), "neighbour").when(same & (step == 2), "plus2")
        .when(same & step.isin(3, 9), "plus3").when((step == 0) & ~same, "relative").otherwise("far")
    )


def relation_cost(relation: Column) -> Column:
    out = F.when(F.lit(False), 0.0)
    for name, cost in RELATION_COST.items():
        out = out.when(relation == name, cost)
    return out


def transition_cost(key_a: Column, bpm_a: Column, key_b: Column, bpm_b: Column, easy: float = EASY_BPM, most: float = MOST_BPM) -> Column:
    """What a transition costs: infinite beyond ``most`` beats a minute, else the keys' price and what
    the tempo differs beyond ``easy``; an unknown tempo costs one."""
    gap = F.abs(bpm_a - bpm_b)
    tempo = F.when(gap.isNull(), 1.0).when(gap > most, INF).otherwise(F.greatest(F.lit(0.0), gap - easy))
    return relation_cost(camelot_relation(key_a, key_b)) + tempo


def estimate_bpm(title: Column, tags: Column, description: Column) -> Column:
    """The first number 100 to 199 before "bpm" in title, tags or the description's first 600 characters."""
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.array_join(F.coalesce(tags, F.array()), " "), F.substring(F.coalesce(description, F.lit("")), 1, 600))
    return F.regexp_extract(text, r"(?i)(?<!\d)(1[0-9]{2})\s*bpm\b", 1).try_cast("double")


def bpm_bucket(bpm: Column, size: int = 5) -> Column:
    """Label of the tempo's range of ``size``, unknown-bpm for null."""
    low = (F.floor(bpm / size) * size).cast("long")
    return F.when(bpm.isNull(), "unknown-bpm").otherwise(F.concat(low.cast("string"), F.lit("-"), (low + size).cast("string")))


def bpm_range_label(bpm: Column, low: int = 140, high: int = 170, size: int = 5) -> Column:
    """The range a tempo is tagged with: below 100 it is doubled, beyond the ranges the nearest one."""
    real = F.when(bpm < 100, bpm * 2).otherwise(bpm)
    start = F.least(F.greatest(F.floor(real / size) * size, F.lit(low)), F.lit(high - size)).cast("long")
    return F.when(bpm > 0, F.concat(start.cast("string"), F.lit("-"), (start + size).cast("string")))


def resolve_bpm(audio: Column, text: Column, window: tuple[float, float], plausible: tuple[float, float] = (120.0, 200.0), tolerance: float = 3.0, confidence: Column | None = None, sure: float = 0.6) -> Column:
    """struct(bpm, source): a measured tempo freed of octave errors. Of half, whole and double it is
    the one near the text's tempo, else the text's unless the measurement is sure, else the first one in
    ``window``, else the plausible one nearest the window's middle, else the measured one."""
    audio, text = audio.cast("double"), text.cast("double")
    options = F.array(audio / 2, audio, audio * 2)
    confident = F.lit(False) if confidence is None else F.coalesce(confidence >= sure, F.lit(False))

    def nearest(values: Column, to: Column) -> Column:
        """Of equally near ones the first."""
        return F.array_min(F.transform(values, lambda v, i: F.struct(F.abs(v - to).alias("gap"), i.alias("i"), v.alias("v"))))["v"]

    by_text = nearest(options, text)
    inside = F.try_element_at(F.filter(options, lambda v: v.between(*window)), F.lit(1))
    possible = nearest(F.filter(options, lambda v: v.between(*plausible)), F.lit(sum(window) / 2))
    has_text = F.coalesce(text != 0, F.lit(False))
    none = audio.isNull() | (audio <= 0)
    bpm = (
        F.when(none, F.when(has_text, text)).when(has_text & (F.abs(by_text - text) <= tolerance), F.bround(by_text, 1)).when(has_text & ~confident, text)
        .otherwise(F.bround(F.coalesce(inside, possible, audio), 1))
    )
    source = (
        F.when(none, F.when(has_text, "text").otherwise("none")).when(has_text & (F.abs(by_text - text) <= tolerance), "audio near text").when(has_text & ~confident, "text")
        .when(inside.isNotNull(), "audio in window").when(possible.isNotNull(), "audio plausible").otherwise("audio")
    )
    return F.struct(bpm.alias("bpm"), source.alias("source"))


def _snap(beats: Column, grid: float, tolerance: float) -> Column:
    place = F.bround(beats / grid) * grid
    return F.when(F.abs(beats - place) <= tolerance, place)


def quantize_to_phrase(event: Column, kick: Column, bpm: Column, phrase: float = 32, second: float = 16, tolerance: float = 1.75, downbeats: Column | None = None) -> Column:
    """Seconds moved to the phrase grid that begins at ``kick``: to 32 beats, else 16, where these are
    within ``tolerance`` beats, else to the nearest downbeat given, else to the bar. What lies before
    the kick, or has no tempo, is only rounded to milliseconds."""
    beat = 60.0 / F.nullif(bpm, F.lit(0.0))
    beats = (event - kick) * F.nullif(bpm, F.lit(0.0)) / 60.0
    bar = kick + F.bround(beats / 4.0) * 4.0 * beat
    if downbeats is not None:
        near = F.array_min(F.transform(downbeats, lambda d, i: F.struct(F.abs(d - event).alias("gap"), i.alias("i"), d.alias("d"))))["d"]
        bar = F.coalesce(near, bar)
    snapped = F.coalesce(kick + F.coalesce(_snap(beats, phrase, tolerance), _snap(beats, second, tolerance)) * beat, bar)
    usable = F.coalesce((bpm > 0) & (kick >= 0) & (event >= kick), F.lit(False))
    return F.bround(F.when(usable, snapped).otherwise(event), 3)


def is_off_phrase(event: Column, kick: Column, bpm: Column, phrase: float = 32, second: float = 16, tolerance: float = 1.75) -> Column:
    """Whether an event lies outside the tolerance of both grids; false where there is no grid."""
    beats = (event - kick) * F.nullif(bpm, F.lit(0.0)) / 60.0
    usable = F.coalesce((bpm > 0) & (kick >= 0) & (event >= kick), F.lit(False))
    return usable & F.coalesce(_snap(beats, phrase, tolerance), _snap(beats, second, tolerance)).isNull()


def phrase_grid(kick: Column, bpm: Column, duration: Column, phrase: int = 32) -> Column:
    """Starts of phrases in seconds up to ``duration``; an empty array where there is no grid."""
    step = phrase * 60.0 / bpm
    usable = (bpm > 0) & (duration > 0) & (kick >= 0) & (kick <= duration)
    places = F.transform(F.sequence(F.lit(0), F.floor((duration - kick) / step).cast("int")), lambda k: F.bround(kick + k * step, 3))
    return F.when(usable, places).otherwise(F.expr("cast(array() as array<double>)"))


def gain_plan(lufs: Column, true_peak: Column, target: float = -8.5, ceiling: float = -0.5, tolerance: float = 0.2) -> Column:
    """Decibels that bring a track to ``target``: cuts in full, boosts up to the headroom below
    ``ceiling`` and never without a known peak; 0 within ``tolerance``."""
    gain = F.lit(target) - lufs
    boost = F.when(true_peak.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(gain, F.lit(ceiling) - true_peak)))
    planned = F.when(gain < 0, gain).otherwise(boost)
    return F.when(lufs.isNull() | (F.abs(planned) <= tolerance), 0.0).otherwise(F.bround(planned, 2))


def loudness_tags(lufs: Column, true_peak: Column, loudness_range: Column) -> Column:
    """map of the tags that loudness gives; only those whose measurement is known."""
    entries = F.array(
        F.when(lufs.isNotNull(), F.struct(F.lit("REPLAYGAIN_TRACK_GAIN").alias("key"), F.format_string("%.2f dB", F.lit(-18.0) - lufs).alias("value"))),
        F.when(lufs.isNotNull(), F.struct(F.lit("LUFS").alias("key"), F.format_string("%.1f", lufs).alias("value"))),
        F.when(true_peak.isNotNull(), F.struct(F.lit("REPLAYGAIN_TRACK_PEAK").alias("key"), F.format_string("%.6f", F.pow(F.lit(10.0), true_peak / 20)).alias("value"))),
        F.when(loudness_range.isNotNull(), F.struct(F.lit("LRA").alias("key"), F.format_string("%.1f", loudness_range).alias("value"))),
    )
    return F.map_from_entries(F.array_compact(entries))


def rating_stars(raw: Column) -> Column:
    """0..5 stars of a rating 0..255 in steps of 51, rounded; null stays."""
    return F.when(raw.isNotNull(), F.least(F.lit(5), F.greatest(F.lit(0), F.floor((raw + 25) / 51)))).cast("int")


def active_loop(kick: Column, bpm: Column, duration: Column, beats: int = 16) -> Column:
    """struct(start, stop) of a loop over the last ``beats`` beats, from a bar's begin; null without a tempo."""
    beat = 60.0 / bpm
    start = kick + F.floor((duration - kick - beats * beat) / (4 * beat)) * 4 * beat
    return F.when((bpm > 0) & (start >= kick), F.struct(F.bround(start, 3).alias("start"), F.bround(start + beats * beat, 3).alias("stop")))
