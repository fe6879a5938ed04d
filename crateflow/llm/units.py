"""Cutting texts into units that byte-level BPE never crosses, and memory for their ids.

A unit starts at a blank that a visible character follows. No rule of the pattern reaches
across such a place: runs of letters, digits and marks hold no blank, and white space gives
its last blank to the word behind it. So every text is encoded unit by unit, and where two
texts meet only the units at the seam can change.
"""

from __future__ import annotations

import functools
import re

import regex

_ODD = re.compile(r" (?!\S)")
_CUT = re.compile(r"(?= \S)")


@functools.cache
def compiled(pattern: str):
    return regex.compile(pattern)


def cut(text: str) -> list[str]:
    """The units of ``text``; joined they give it back."""
    if _ODD.search(text):
        return [u for u in _CUT.split(text) if u]
    first, *rest = text.split(" ")
    units = [" " + w for w in rest]
    return [first, *units] if first else units


class Memory:
    """A dictionary of bounded size: two generations, of which the older is dropped."""

    def __init__(self, size: int):
        self.size, self.young, self.old = max(1, size // 2), {}, {}

    def get(self, key):
        out = self.young.get(key)
        if out is None and (out := self.old.get(key)) is not None:
            self.put(key, out)
        return out

    def put(self, key, value) -> None:
        self.turn()
        self.young[key] = value

    def turn(self) -> None:
        """Start a new generation once the young one is full."""
        if len(self.young) >= self.size:
            self.young, self.old = {}, self.young
