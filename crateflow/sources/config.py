"""Settings: merged with their defaults, checked, compared."""

from __future__ import annotations

import copy
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a track of a source's answer must have.
TRACK_FIELDS = (
    "id", "kind", "title", "permalink_url", "created_at", "duration", "playback_count", "likes_count", "reposts_count", "comment_count", "downloadable",
    "tag_list", "description", "user.username", "user.permalink_url", "media.transcodings",
)


def deep_merge(base: dict, own: dict) -> dict:
    """``own`` over ``base``: dicts are merged, everything else is replaced."""
    out = copy.deepcopy(base)
    for k, v in own.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def profiles(config: dict) -> dict[str, dict]:
    """Each profile's settings over the common ones; one profile ``default`` where none is named."""
    common = {k: v for k, v in config.items() if k != "profiles"}
    own = config.get("profiles") or {"default": {}}
    if not isinstance(own, dict):
        raise ValueError("profiles: a dict is expected")
    return {name: deep_merge(common, settings or {}) for name, settings in own.items()}


def flatten(config: dict, front: str = "") -> dict[str, Any]:
    """Leaves by dotted path."""
    out: dict[str, Any] = {}
    for k, v in config.items():
        path = f"{front}.{k}" if front else str(k)
        if isinstance(v, dict) and v:
            out |= flatten(v, path)
        else:
            out[path] = v
    return out


def diff(old: dict, new: dict) -> list[tuple[str, Any, Any]]:
    """(path, old, new) of all leaves that differ, by path."""
    a, b = flatten(old), flatten(new)
    return [(p, a.get(p), b.get(p)) for p in sorted(a.keys() | b.keys()) if p not in a or p not in b or a[p] != b[p]]


def minimal_override(base: dict, wanted: dict) -> dict:
    """The least settings that, merged over ``base``, give ``wanted`` (what ``base`` alone holds stays)."""
    out: dict = {}
    for k, v in wanted.items():
        if isinstance(v, dict) and isinstance(base.get(k), dict):
            if inner := minimal_override(base[k], v):
                out[k] = inner
        elif k not in base or base[k] != v:
            out[k] = copy.deepcopy(v)
    return out


def check(config: dict, schema: dict[str, dict]) -> tuple[list[str], list[str]]:
    """(problems, warnings). ``schema``: by dotted path the type, and where wanted least, most, choices,
    pattern; ``weights`` must sum to 1 within 0.01; paths of no schema are warned of."""
    import re

    leaves, problems = flatten(config), []
    for path, rule in schema.items():
        if path not in leaves:
            continue
        v, kind = leaves[path], rule["type"]
        if isinstance(v, bool) and kind is not bool or not isinstance(v, (int, float) if kind is float else kind):
            problems.append(f"{path}: {kind.__name__} expected, not {v!r}")
        elif "least" in rule and v < rule["least"] or "most" in rule and v > rule["most"]:
            problems.append(f"{path}: {v!r} is out of range")
        elif "choices" in rule and v not in rule["choices"]:
            problems.append(f"{path}: {v!r} is none of {sorted(rule['choices'])}")
        elif "pattern" in rule and not re.fullmatch(rule["pattern"], v):
            problems.append(f"{path}: {v!r} does not fit")
    for low in [p for p in leaves if p.endswith("_min")]:
        high = low[:-4] + "_max"
        if high in leaves and isinstance(leaves[low], int | float) and isinstance(leaves[high], int | float) and leaves[low] > leaves[high]:
            problems.append(f"{low}: above {high}")
    weights = [v for p, v in leaves.items() if ".weights." in f".{p}" and isinstance(v, int | float)]
    if weights and abs(sum(weights) - 1) > 0.01:
        problems.append(f"weights: sum to {sum(weights):g}, not 1")
    return problems, [f"{p}: unknown" for p in sorted(leaves.keys() - schema.keys())]


def missing_fields(payload: dict, required: list[str]) -> list[str]:
    """The dotted paths of ``required`` that a payload lacks; a null at the end of a path is there."""
    def has(path: str) -> bool:
        at: Any = payload
        for part in path.split("."):
            if not isinstance(at, dict) or part not in at:
                return False
            at = at[part]
        return True

    return [p for p in required if not has(p)]


def payload_gaps(payload: Column, required: list[str] | tuple[str, ...] = TRACK_FIELDS) -> Column:
    """array of what a search answer (JSON text) lacks: ``search.collection`` where there is no list, or an empty
    one; ``search.collection[kind=track]`` where none of its items is a track; else the ``required`` dotted
    paths that its first track lacks, in their order. A null at the end of a path is there."""
    items = F.try_variant_get(F.try_parse_json(payload), "$.collection", "array<variant>")
    track = F.try_element_at(F.filter(items, lambda v: F.try_variant_get(v, "$.kind", "string") == "track"), F.lit(1))
    lacks = [F.when(F.try_variant_get(track, "$." + path, "variant").isNull(), f"search[0].{path}") for path in required]
    return (
        F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, F.array(F.lit("search.collection")))
        .when(track.isNull(), F.array(F.lit("search.collection[kind=track]"))).otherwise(F.array_compact(F.array(*lacks)))
    )
