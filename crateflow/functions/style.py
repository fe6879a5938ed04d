"""Styles of tracks: version, subgenre, energy, colours and comments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of version by a word of the title or a tag, the first that is found.
VERSIONS = {
    "edit": r"re-?edit|edit", "bootleg": "bootleg", "mashup": "mashup", "flip": "flip", "vip": "vip",
    "rework": "rework", "tool": "tool", "remix": "remix", "original": "original",
}
#: Subgenres by a part of a tag or title, the first that is found.
KEYWORDS = [
    ("reverse bass", "reverse_bass"), ("reversebass", "reverse_bass"), ("crossbreed", "crossbreed"), ("breakcore", "crossbreed"), ("amen", "crossbreed"),
    ("hardgroove", "hardgroove"), ("hard groove", "hardgroove"), ("industrial", "industrial"), ("tribal", "tribal"), ("classic", "classic"), ("acid", "acid"),
    ("303", "acid"), ("terror", "terror"), ("melodic", "melodic"), ("neo", "neo"), ("bounce", "bounce"), ("donk", "bounce"), ("psy", "psy"), ("triplet", "psy"), ("ebm", "ebm"),
]
#: Cluster, flow, raster, aesthetic, colour, display name and note of each subgenre.
PROFILES = {
    "tribal": ("fundament", "horizontal", "syncopated", "percussive", "Green", "Tribal", "3-Deck Loop Tool"),
    "hardgroove": ("fundament", "horizontal", "syncopated", "percussive", "Green", "Hardgroove", "Ext. Intro/Outro"),
    "classic": ("fundament", "horizontal", "straight", "percussive", "Blue", "Classic", "Klassischer Schranz · 4/4"),
    "industrial": ("noise", "vertical", "straight", "percussive", "Red", "Industrial", "⚠️ Noise-Layer / Hall"),
    "acid": ("noise", "horizontal", "straight", "melodic", "Purple", "Acid", "303-Line · Filter fahren"),
    "terror": ("noise", "vertical", "straight", "percussive", "Red", "Terror", "⚠️ Extremtempo!"),
    "neo": ("emotion", "vertical", "straight", "percussive", "Orange", "Neo", "⚠️ Stopp & Drop"),
    "melodic": ("emotion", "vertical", "straight", "melodic", "Yellow", "Melodic", "Melodische Hook / Peak"),
    "bounce": ("crossover", "vertical", "offbeat", "percussive", "Pink", "Bounce", "⚠️ Subbass-Phasengefahr!"),
    "psy": ("crossover", "vertical", "triplet", "percussive", "Purple", "Psy", "Triolen-Groove · Hypnose"),
    "reverse_bass": ("crossover", "vertical", "offbeat", "percussive", "Purple", "Reverse Bass", "Reverse-Bass · Offbeat"),
    "ebm": ("crossover", "horizontal", "straight", "melodic", "Purple", "EBM", "EBM-Bassline · düster"),
    "crossbreed": ("crossover", "vertical", "breakbeat", "percussive", "Red", "Crossbreed", "Breakbeat · DnB-Kante"),
}
#: Colours by kind of version.
VERSION_COLOURS = {"tool": "Blue", "edit": "Green", "bootleg": "Red", "mashup": "Red", "flip": "Red", "vip": "Yellow", "rework": "Yellow"}


def _chosen(key: Column, values: dict[str, str], default: str | None = None) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for k, v in values.items():
        out = out.when(key == k, v)
    return out.otherwise(default) if default is not None else out


def version_type(title: Column, tags: Column | None = None) -> Column:
    """Kind of version by title and tags; original where nothing is said."""
    text = F.concat_ws(" ", title, *([F.array_join(tags, " ")] if tags is not None else []))
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in VERSIONS.items():
        out = out.when(text.rlike(rf"(?i)\b(?:{pattern})\b"), name)
    return out.otherwise("original")


def version_tag(title: Column, file_name: Column) -> Column:
    """Kind of version by the title, else by the file's name."""
    own = version_type(title)
    return F.when(own == "original", version_type(file_name)).otherwise(own)


def subgenre_by_keyword(title: Column, tags: Column | None = None) -> Column:
    """The subgenre that the first tag with a keyword names, else the title; null for none."""
    def named(text: Column) -> Column:
        plain = F.translate(F.lower(F.trim(text)), "-_", "  ")
        out = F.when(F.lit(False), F.lit(""))
        for word, name in KEYWORDS:
            out = out.when(F.contains(plain, F.lit(word)), name)
        return out

    by_title = named(title)
    if tags is None:
        return by_title
    return F.coalesce(F.try_element_at(F.filter(F.transform(tags, named), lambda n: n.isNotNull()), F.lit(1)), by_title)


def subgenre_by_sound(bpm: Column, loudness_range: Column, breakdown_ratio: Column, chroma: Column) -> Column:
    """The subgenre that measurements suggest; null for none."""
    return (
        F.when((breakdown_ratio >= 0.30) & (chroma >= 0.60), "melodic").when((bpm >= 165) & (loudness_range <= 3), "terror")
        .when(F.coalesce(breakdown_ratio >= 0.20, F.lit(False)) | F.coalesce(bpm >= 155, F.lit(False)), "neo")
    )


def energy(bpm: Column, lufs: Column | None = None, loudness_range: Column | None = None, subgenre: Column | None = None, centroid: Column | None = None) -> Column:
    """Energy 1..5: a level by tempo, one more or less for loudness, its range, brightness and style."""
    level = F.when(bpm.isNull(), 3).when(bpm < 138, 1).when(bpm < 145, 2).when(bpm < 152, 3).when(bpm < 160, 4).otherwise(5)
    if lufs is not None:
        level += F.when(lufs > -6, 1).otherwise(0)
    if loudness_range is not None:
        level += F.when(loudness_range < 3, 1).when(loudness_range > 6.5, -1).otherwise(0)
    if centroid is not None:
        level += F.when(centroid > 3500, 1).when(centroid < 1800, -1).otherwise(0)
    if subgenre is not None:
        level += F.when(subgenre.isin("terror", "crossbreed"), 1).when(subgenre.isin("melodic", "ebm"), -1).otherwise(0)
    return F.greatest(F.lit(1), F.least(F.lit(5), level))


def classify(title: Column, tags: Column, bpm: Column, loudness_range: Column, breakdown_ratio: Column, chroma: Column, centroid: Column) -> Column:
    """struct(subgenre, cluster, flow, raster, aesthetic, confidence, energy, version, note)."""
    named = subgenre_by_keyword(title, tags)
    heard = subgenre_by_sound(bpm, loudness_range, breakdown_ratio, chroma)
    own = F.coalesce(named, heard, F.lit("classic"))
    of = lambda k: _chosen(own, {name: p[k] for name, p in PROFILES.items()})
    flow = F.when(breakdown_ratio.isNull(), of(1)).when(breakdown_ratio >= 0.20, "vertical").otherwise("horizontal")
    look = F.when(chroma.isNull(), of(3)).when(chroma >= 0.60, "melodic").otherwise("percussive")
    sure = F.when(named.isNotNull(), 0.85).when(heard.isNotNull(), 0.7).otherwise(0.4)
    return F.struct(
        own.alias("subgenre"), of(0).alias("cluster"), flow.alias("flow"), of(2).alias("raster"), look.alias("aesthetic"), sure.alias("confidence"),
        energy(bpm, None, loudness_range, own, centroid).alias("energy"), version_type(title, tags).alias("version"), of(6).alias("note"),
    )


def colour(style: Column, by_subgenre: bool = False) -> Column:
    """A colour for a style of ``classify``, by version or by subgenre; "None" for no colour."""
    if by_subgenre:
        return _chosen(style["subgenre"], {k: p[4] for k, p in PROFILES.items()}, "None")
    return _chosen(style["version"], VERSION_COLOURS, "None")


def _label(style: Column) -> Column:
    name = _chosen(style["subgenre"], {k: p[5] for k, p in PROFILES.items()})
    return F.when(style["version"].isin("original", "remix"), name).otherwise(F.upper(style["version"]))


def _number(value: Column) -> Column:
    """A number without an ending .0, six digits at most."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value), "0+$", ""), r"\.$", "")


def comment(style: Column, bpm: Column, key: Column, with_flow: bool = True) -> Column:
    """``[Label] bpm BPM · key | flow · note``; unknown parts are left out."""
    meta = F.concat_ws(" · ", F.when(bpm.isNotNull(), F.concat(_number(bpm), F.lit(" BPM"))), F.when(key != "", key))
    flow = F.when(style["flow"] == "vertical", "Vertikal").otherwise("Horizontal") if with_flow else F.lit(None).cast("string")
    head = F.concat(F.lit("["), _label(style), F.lit("]"), F.when(meta != "", F.concat(F.lit(" "), meta)).otherwise(""))
    return F.concat(head, F.lit(" | "), F.concat_ws(" · ", flow, F.when(style["note"] != "", style["note"])))


def compact_comment(style: Column, bpm: Column, key: Column, drop: Column, second_drop: Column, lufs: Column) -> Column:
    """``[bpm|key|label|D1:m:ss|D2:m:ss|Llufs]``; unknown parts are left out."""
    def clock(s: Column) -> Column:
        whole = F.floor(s).cast("long")
        return F.format_string("%d:%02d", F.floor(whole / 60), whole % 60)

    parts = F.concat_ws(
        "|", F.when(bpm > 0, _number(bpm)), F.when(F.trim(key) != "", F.trim(key)), _label(style),
        F.when(drop >= 0, F.concat(F.lit("D1:"), clock(drop))), F.when(second_drop >= 0, F.concat(F.lit("D2:"), clock(second_drop))),
        F.when(lufs.isNotNull(), F.format_string("L%.1f", lufs)),
    )
    return F.concat(F.lit("["), parts, F.lit("]"))
