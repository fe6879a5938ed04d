"""Saved rules for lists of tracks.

Every rule is declared once: the column it looks at, what its value must be and how the two are
compared. Checking what a user gave and compiling it to a predicate both follow from that table.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crateflow.functions import music


class RuleError(ValueError):
    """A rule that cannot be used; the message names its key."""


def _known(value: Column) -> Column:
    number = value.cast("double")
    return F.when(~F.isnan(number), number)


@dataclass(frozen=True)
class Number:
    """A bound of a numeric column. ``inside``: the closed interval of values, or None for all above 0."""

    column: str
    least: bool
    inside: tuple[float, float] | None = None
    whole: bool = False

    def read(self, value: Any) -> float | int:
        if type(value) not in (int, float) or not math.isfinite(value):
            raise ValueError(f"a number is expected, not {value!r}")
        if self.whole and value != round(value):
            raise ValueError(f"a whole number is expected, not {value!r}")
        if self.inside is None and value <= 0:
            raise ValueError(f"{value!r} is not above 0")
        if self.inside is not None and not self.inside[0] <= value <= self.inside[1]:
            raise ValueError(f"{value!r} is not within {self.inside[0]} to {self.inside[1]}")
        return int(value) if self.whole else float(value)

    def holds(self, value: float, tags: Column) -> Column:
        own = _known(F.col(self.column))
        return own >= value if self.least else own <= value


@dataclass(frozen=True)
class Words:
    """A list of texts of one form. ``holds`` compares them with a track."""

    form: str
    what: str
    plain: Callable[[str], str]
    compare: Callable[[list[str], Column], Column]
    sort: bool = False

    def read(self, value: Any) -> tuple[str, ...]:
        if not isinstance(value, list | tuple | set | frozenset) or any(not isinstance(v, str) for v in value):
            raise ValueError(f"a list of texts is expected, not {value!r}")
        own = list(dict.fromkeys(map(self.plain, value)))
        if wrong := [v for v in own if not re.fullmatch(self.form, v)]:
            raise ValueError(f"{wrong[0]!r} is no {self.what}")
        return tuple(sorted(own) if self.sort else own)

    def holds(self, value: tuple[str, ...], tags: Column) -> Column:
        return self.compare(list(value), tags)


def _tags(compare: Callable[[list[str], Column], Column]) -> Words:
    return Words("[a-z0-9äöüß _-]{1,40}", "tag", lambda v: " ".join(v.lower().split()), compare)


#: All rules by name; their order is that of the checks.
RULES: dict[str, Number | Words] = {
    "bpm_min": Number("bpm", True), "bpm_max": Number("bpm", False),
    "energy_min": Number("energy", True, (1, 5), whole=True), "energy_max": Number("energy", False, (1, 5), whole=True),
    "taste_min": Number("taste_score", True, (0, 1)), "rating_min": Number("rb_rating", True, (0, 5), whole=True),
    "duration_min": Number("duration", True), "duration_max": Number("duration", False),
    "keys": Words("(?:[1-9]|1[0-2])[AB]", "key (1 to 12 with A or B)", lambda v: v.strip().upper(), lambda own, _: F.upper(F.trim("key_camelot")).isin(*own), sort=True),
    "tags_all": _tags(lambda own, tags: F.size(F.array_except(F.array(*map(F.lit, own)), tags)) == 0),
    "tags_any": _tags(lambda own, tags: F.arrays_overlap(tags, F.array(*map(F.lit, own)))),
}


@dataclass(frozen=True)
class Rules:
    """Rules that were checked: name to value, only those that are set."""

    given: Mapping[str, Any] = field(default_factory=lambda: MappingProxyType({}))

    @property
    def tagged(self) -> bool:
        """Whether a rule looks at tags."""
        return bool({"tags_all", "tags_any"} & set(self.given))

    def to_json(self) -> str:
        """As JSON with sorted keys."""
        return json.dumps(dict(self.given), sort_keys=True, ensure_ascii=False)


def parse(data: Any) -> Rules:
    """``data`` as Rules. Missing, null and empty values set no rule; an unknown name, a value that its
    rule does not read and a least above its most are refused."""
    if not isinstance(data, dict):
        raise RuleError(f"rules: a dict is expected, not {type(data).__name__}")
    if strange := [k for k in data if k not in RULES]:
        raise RuleError(f"{strange[0]}: unknown rule")
    given: dict[str, Any] = {}
    for name, rule in RULES.items():
        try:
            value = None if data.get(name) is None else rule.read(data[name])
        except ValueError as e:
            raise RuleError(f"{name}: {e}") from None
        if value not in (None, ()):
            given[name] = value
    sides = {(r.column, r.least): n for n, r in RULES.items() if isinstance(r, Number) and n in given}
    for (column, least), low in sides.items():
        high = sides.get((column, False))
        if least and high and given[low] > given[high]:
            raise RuleError(f"{low}: {given[low]:g} is above {high} {given[high]:g}")
    return Rules(MappingProxyType(given))


def predicate(rules: Rules, tags: Column | None = None) -> Column:
    """Whether a track meets all rules; a missing value meets none that asks for it."""
    none = F.array().cast("array<string>")
    own = none if tags is None else F.coalesce(tags, none)
    out = F.lit(True)
    for name, value in rules.given.items():
        out &= F.coalesce(RULES[name].holds(value, own), F.lit(False))
    return out


def key_order(key: Column) -> Column:
    """A value to sort by: keys around the wheel, other texts by alphabet, missing ones last."""
    own = F.upper(F.trim(F.coalesce(key, F.lit(""))))
    number = music.key_number(own, strict=False)
    kind = F.when(number.isNotNull(), 0).when(own != "", 1).otherwise(2)
    return F.struct(kind.alias("kind"), F.coalesce(number, F.lit(0)).alias("number"), F.when(number.isNotNull(), F.right(own, F.lit(1))).otherwise(own).alias("text"))


def select(tracks: DataFrame, rules: Rules, profile: str | None = None, tags: DataFrame | None = None) -> DataFrame:
    """The tracks (of a profile) that meet the rules and are not rejected, by tempo (unknown last), key and
    id. ``tags``: id, tags (array)."""
    rows = tracks if profile is None else tracks.where(F.col("profile_id") == profile)
    rows = rows.where(F.coalesce(F.col("status"), F.lit("")) != "rejected")
    if rules.tagged and tags is not None:
        rows = rows.join(tags.select("id", F.col("tags").alias("tags_")), "id", "left").where(predicate(rules, F.col("tags_"))).drop("tags_")
    else:
        rows = rows.where(predicate(rules))
    return rows.orderBy(F.col("bpm").asc_nulls_last(), key_order(F.col("key_camelot")), "id")


def overview(tracks: DataFrame, saved: dict[str, Rules]) -> DataFrame:
    """name, rules, tracks: how many tracks meet each saved list, in one pass over the tracks."""
    live = F.coalesce(F.col("status"), F.lit("")) != "rejected"
    counts = tracks.agg(*[F.count_if(live & predicate(r)).alias(f"c{k}") for k, r in enumerate(saved.values())])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(len(r.given)).alias("rules"), F.col(f"c{k}").alias("tracks")) for k, (n, r) in enumerate(saved.items())])).alias("s")).select("s.*")
