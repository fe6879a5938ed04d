"""Operator 4: licence scans by ordered signature rules.

A text's lower-case words are joined by blanks. Each rule of ``license_rules`` is gated by a
keyword: one pass of an Aho-Corasick automaton finds the keywords a text holds, and only their
rules run. A detection is suppressed where its interval of words lies inside that of another of
higher priority, or of the same priority and greater length (equal intervals: smaller label).

Beside the detections the base phrases are counted at all places, and their labels always stay.
The score is the noisy-or of the kept detections' priorities.

Null texts are empty: no words, no places, empty labels, score 0. Texts of any length are
scanned whole. Repeated rows give repeated results, an empty table an empty one, and other
columns never reach the workers.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, license_rules

#: The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_PHRASES = [(re.compile(rf"(?<![^ ]){p}(?![^ ])"), label) for p, label in BASE]
_IS_WORD = np.zeros(256, dtype=bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _IS_WORD[_a:_b] = True


def count_words(text: str) -> int:
    inside = _IS_WORD[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    return int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(inside[:1].sum())


@functools.cache
def _gate() -> tuple[ahocorasick.Automaton, dict[str, list[int]]]:
    by: dict[str, list[int]] = {}
    for k, rule in enumerate(license_rules.rules()):
        by.setdefault(rule.keyword, []).append(k)
    automaton = ahocorasick.Automaton()
    for word in {*by, "cc", "general", "reserved"}:
        automaton.add_word(word, word)
    automaton.make_automaton()
    return automaton, by


def suppressed(found: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """``found`` (label, start, end, priority) without what lies inside another, by sweeps over
    the starts: one of each priority's own, one of those kept before."""
    kept: list[tuple[str, int, int, int]] = []
    starts, reach = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for _, group in itertools.groupby(sorted(found, key=lambda d: (-d[3], d[1], -d[2], d[0])), key=lambda d: d[3]):
        own, far = [], -1
        for d in group:
            if d[2] > far:
                far = d[2]
                own.append(d)
        # The farthest end among the kept that start no later.
        before = np.searchsorted(starts, [d[1] for d in own], side="right")
        own = [d for d, k in zip(own, before.tolist(), strict=True) if not k or reach[k - 1] < d[2]]
        kept += own
        order = sorted((d[1], d[2]) for d in kept)
        starts, reach = np.array([a for a, _ in order]), np.maximum.accumulate([b for _, b in order])
    return sorted(kept, key=lambda d: (-d[3], d[1] - d[2], d[1], d[0]))


def detections(words: str, keywords: set[str]) -> list[tuple[str, int, int, int]]:
    """(label, start, end, priority) over characters of joined words, after suppression."""
    _, by = _gate()
    rules, padded, found = license_rules.rules(), f" {words} ", []
    likely = [k for w in keywords for k in by.get(w, ())]
    held = {g for g in {rules[k].gate for k in likely} if g in padded}
    for k in sorted(k for k in likely if rules[k].gate in held):
        rule = rules[k]
        found += [(rule.label, m.start(), m.end(), rule.priority) for m in rule.pattern.finditer(words)]
    return suppressed(found)


def scan(text: str | None) -> dict:
    """One text's result."""
    text = text or ""
    out = {"n_words": count_words(text), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "detections": []}
    lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes: A-Z alone
    automaton, _ = _gate()
    keywords = {w for _, w in automaton.iter(lower)}
    if not keywords:
        return out
    own = _WORD.findall(lower)
    words = " ".join(own)
    starts = np.cumsum([0] + [len(w) + 1 for w in own])
    places, base = [], set()
    for pattern, label in _PHRASES:
        at = [m.start() for m in pattern.finditer(words)]
        places += at
        if at:
            base.add(label)
    kept = detections(words, keywords)
    if places:
        index = np.searchsorted(starts, sorted(places))
        out |= {"n_base": len(places), "first_word": int(index[0]), "last_word": int(index[-1])}
    miss = 1.0
    for label, _, _, priority in kept:
        miss *= 1 - priority / 100
    out["base_labels"] = ",".join(sorted(base))
    out["labels"] = ",".join(sorted(base | {d[0] for d in kept}))
    out["score"] = round(1 - miss * (0.5 if base else 1.0), 6)
    out["detections"] = [{"label": d[0], "first_word": int(np.searchsorted(starts, d[1])), "last_word": int(np.searchsorted(starts, d[2])) - 1, "priority": d[3]} for d in kept]
    return out


_SPAN = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("priority", pa.int32())]))
_FIELDS = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "detections": _SPAN}
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,first_word:long,last_word:long,priority:int>>"


def scan_documents(docs: DataFrame) -> DataFrame:
    """Scan every text of ``docs`` (doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.slices(batches):
            rows = [{"doc_id": i} | scan(t) for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], type=k) for n, k in _FIELDS.items()], names=list(_FIELDS))

    return common.texts_of(docs).mapInArrow(work, SCHEMA)


def base_places(docs: DataFrame) -> DataFrame:
    """What the scan says of the base phrases alone: doc_id, n_words, n_base, first_word, last_word, base_labels."""
    return scan_documents(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


#: ``base_places`` in DuckDB's SQL: words as a list, and the places where the phrases' words follow each other.
BASE_SQL = """
WITH w AS (
  SELECT doc_id, string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), ' ') AS w FROM documents),
l AS (SELECT doc_id, CASE WHEN w = [''] THEN [] ELSE w END AS w FROM w),
p AS (
  SELECT doc_id, len(w) AS n, list_filter(range(len(w)), lambda i: w[i + 1] = 'cc' AND w[i + 2] = 'by') AS a,
    list_filter(range(len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS b,
    list_filter(range(len(w)), lambda i: w[i + 1] = 'all' AND w[i + 2] = 'rights' AND w[i + 3] = 'reserved') AS c FROM l)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(a) + len(b) + len(c) AS BIGINT) AS n_base,
  CAST(list_min(a || b || c) AS BIGINT) AS first_word, CAST(list_max(a || b || c) AS BIGINT) AS last_word,
  array_to_string(list_filter([CASE WHEN len(a) > 0 THEN 'cc-by' END, CASE WHEN len(b) > 0 THEN 'gpl' END, CASE WHEN len(c) > 0 THEN 'reserved' END], lambda x: x IS NOT NULL), ',') AS base_labels
FROM p"""
