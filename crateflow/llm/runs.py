"""Operator 13: periodic runs of words by Crochemore's partition refinement.

Positions of a text are kept in classes of equal factors. Classes of length 1 are the equal words;
those of length l + 1 come from those of length l by splitting, for every class that is not the
largest piece of its parent (the smaller half), the classes of the positions one to the left. So
each position is moved a logarithmic number of times. Members of a class are linked in order of
position: two neighbours at distance l in a class of length l are a square of period l, and a
stretch of neighbouring squares of one period is a run. A square whose half is itself periodic is
never one of neighbours, so every run comes with its smallest period, and once.

A run of period q and exponent e holds (e - 2) * q + 1 squares in a row. Hence

* at length q every 2**k-th position is looked at, 2**k being at most that number, and what is found
  there is followed to both sides;
* a document is finished once no stretch of that many positions has near enough neighbours left,
  which is checked whenever the length has doubled.

Many documents are refined together in numpy; their classes never mix. Memory is in proportion to
the longest document, some hundred bytes a word, beyond a slice's size.

Null and empty texts, and those without words, have no runs and an empty collapsed text. Repeated
rows give repeated results, an empty table an empty one; a null doc_id stays null and counts as the
empty text in the planted edit. Other columns never reach the workers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run's least length in words, and least exponent.
LEAST, EXPONENT = 6, 4
#: Bytes of text that a worker refines together.
SLICE_BYTES = 6_000_000
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start[k] .. start[k] + size[k] - 1, end to end."""
    ends = np.cumsum(size)
    out = np.repeat(start - (ends - size), size)
    out += np.arange(len(out))
    return out


class Partition:
    """Classes of positions that begin equal factors of one length, over several documents."""

    def __init__(self, words: np.ndarray, offsets: np.ndarray):
        docs, counts = len(offsets) - 1, np.diff(offsets)
        # One position more for each document: its end, which equals nothing.
        self.starts = offsets[:-1] + np.arange(docs)
        self.total = total = len(words) + docs
        self.none = 2 * total  # farther than any distance looked for
        self.doc = np.repeat(np.arange(docs), counts + 1)
        kinds = int(words.max(initial=-1)) + 2
        key = self.doc * kinds
        inner = np.ones(total, dtype=bool)
        inner[self.starts + counts] = False
        key[inner] += words + 1
        self.perm = np.argsort(key, kind="stable")
        ranked = key[self.perm]
        fresh = np.ones(total, dtype=bool)
        fresh[1:] = ranked[1:] != ranked[:-1]
        first = np.flatnonzero(fresh)
        self.classes = len(first)
        self.start, self.size = np.zeros(total, np.int64), np.zeros(total, np.int64)
        self.start[: len(first)] = first
        self.size[: len(first)] = np.diff(first, append=total)
        number = np.cumsum(fresh) - 1
        self.cls, self.loc = np.empty(total, np.int64), np.empty(total, np.int64)
        self.cls[self.perm], self.loc[self.perm] = number, np.arange(total)
        self.next, self.prev = np.full(total, self.none, np.int64), np.full(total, -1, np.int64)
        self._link(self.perm, number)
        self.is_first = np.zeros(total, dtype=bool)
        self.is_first[self.starts] = True
        self.flag = np.zeros(total, dtype=bool)
        # All classes but the largest of each document.
        owner = self.doc[self.perm[first]]
        order = np.lexsort((self.size[: len(first)], owner))
        last = np.ones(len(order), dtype=bool)
        last[:-1] = owner[order][1:] != owner[order][:-1]
        largest = np.zeros(len(first), dtype=bool)
        largest[order[last]] = True
        self.small = np.flatnonzero(~largest[self.cls])

    def _link(self, members: np.ndarray, group: np.ndarray) -> None:
        """Chain ``members``, ordered by group and position, inside each group."""
        same = group[1:] == group[:-1]
        self.next[members] = self.none
        self.prev[members] = -1
        self.next[members[:-1][same]] = members[1:][same]
        self.prev[members[1:][same]] = members[:-1][same]

    def refine(self) -> None:
        """From factors of one length to those one longer."""
        left = self.small[~self.is_first[self.small]] - 1
        left = left[self.size[self.cls[left]] > 1]
        self.small = left[:0]
        if not len(left):
            return
        parent, child = self.cls[left], self.cls[left + 1]
        order = np.lexsort((left, child, parent))
        left, parent, child = left[order], parent[order], child[order]
        new_parent = np.ones(len(left), dtype=bool)
        new_parent[1:] = parent[1:] != parent[:-1]
        new_group = new_parent.copy()
        new_group[1:] |= child[1:] != child[:-1]
        group_at = np.flatnonzero(new_group)
        group_size = np.diff(group_at, append=len(left))
        parent_of = np.cumsum(new_parent[group_at]) - 1  # by group
        parent_at = np.flatnonzero(new_parent[group_at])  # first group of each parent
        parents = parent[group_at[parent_at]]
        rest = self.size[parents] - np.add.reduceat(group_size, parent_at)
        most = np.maximum.reduceat(group_size, parent_at)
        # The first of a parent's largest groups.
        tops = np.flatnonzero(group_size == most[parent_of])
        top = np.zeros(len(group_at), dtype=bool)
        top[tops[np.diff(parent_of[tops], prepend=-1) > 0]] = True
        moved = ~(top & (rest[parent_of] == 0))  # where nothing else is left, the largest keeps the name
        if not moved.any():
            return
        members = np.repeat(moved, group_size)
        out, out_parent = left[members], parent[members]
        sizes = group_size[moved]
        k = len(sizes)
        names = np.arange(self.classes, self.classes + k)
        named = np.repeat(names, sizes)
        # Out of the parents' lists: stretches of moved neighbours are bridged.
        by_place = np.lexsort((out, out_parent))
        u, owner = out[by_place], out_parent[by_place]
        opens = np.ones(len(u), dtype=bool)
        opens[1:] = (owner[1:] != owner[:-1]) | (self.prev[u[1:]] != u[:-1])
        closes = np.append(opens[1:], True)
        before, after = self.prev[u[opens]], self.next[u[closes]]
        self.next[before[before >= 0]] = after[before >= 0]
        self.prev[after[after < self.none]] = before[after < self.none]
        self._link(out, named)
        # Into slots of their own at the end of the parents' segments.
        touched = np.flatnonzero(np.diff(out_parent, prepend=-1) != 0)
        owners = out_parent[touched]
        taken = np.diff(touched, append=len(out))
        tail = self.start[owners] + self.size[owners] - taken
        slots = _ranges(tail, taken)
        self.flag[out] = True
        there = self.perm[slots]
        stay = there[~self.flag[there]]
        self.flag[out] = False
        at = self.loc[out]
        holes = at[at < np.repeat(tail, taken)]
        self.perm[holes], self.loc[stay] = stay, holes
        self.perm[slots], self.loc[out] = out, slots
        self.cls[out] = named
        ends = np.cumsum(sizes)
        self.start[names], self.size[names] = slots[ends - sizes], sizes
        self.size[owners] -= taken
        self.classes += k
        # All pieces but the largest are looked at next.
        by_rest = (rest > 0) & (rest < most)
        skipped = (top & by_rest[parent_of])[moved]
        chosen = out[np.repeat(~skipped, sizes)]
        kept = parents[by_rest]
        self.small = np.concatenate([chosen, self.perm[_ranges(self.start[kept], self.size[kept])]]) if len(kept) else chosen


def runs_of(words: np.ndarray, offsets: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (document, start, length, period) of all runs of ``least`` words and ``exponent`` periods,
    by document, start and period. ``words``: numbers of the words, documents end to end."""
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    offsets = np.asarray(offsets, dtype=np.int64)
    counts = np.diff(offsets)
    own = np.flatnonzero(counts >= max(least, exponent))
    if not len(own):
        return np.zeros((0, 4), np.int64)
    p = Partition(words[_ranges(offsets[own], counts[own])], np.concatenate([[0], np.cumsum(counts[own])]))
    most = counts[own] // exponent  # periods beyond leave no room for the exponent
    most_at, alive = most[p.doc], np.ones(len(own), dtype=bool)
    found: list[tuple[int, int, int]] = []
    q, step, samples = 1, 1, np.zeros(0, np.int64)
    while True:
        row = (exponent - 2) * q + 1  # least squares in a row
        if q & (q - 1) == 0:
            near = p.next - np.arange(p.total) <= most_at
            edge = np.flatnonzero(np.diff(near.view(np.int8), prepend=0, append=0))
            a, b = edge[0::2], edge[1::2]
            longest = np.zeros(len(own), np.int64)
            np.maximum.at(longest, p.doc[a], b - a)
            alive &= longest >= row
            step = 1 << (row.bit_length() - 1)
            samples = np.arange(0, p.total, step)
            samples = samples[alive[p.doc[samples]]]
            p.small = p.small[alive[p.doc[p.small]]]
        alive &= most >= q
        if not alive.any():
            break
        hits = samples[p.next[samples] - samples == q]
        if len(hits):
            reach = (exponent - 2) * q // 2  # one of the two is in the row as well, wherever the hit is
            up, down = np.minimum(hits + reach, p.total - 1), np.maximum(hits - reach, 0)
            hits = hits[(p.next[up] - up == q) | (p.next[down] - down == q)]
            end = -1
            for i in hits.tolist():
                if i < end:
                    continue
                begin, end = _stretch(p, i, q)
                if end - begin >= row and (length := end - begin - 1 + 2 * q) >= least:
                    found.append((begin, length, q))
        p.refine()
        q += 1
    if not found:
        return np.zeros((0, 4), np.int64)
    rows = np.array(found, dtype=np.int64)
    doc = p.doc[rows[:, 0]]
    out = np.column_stack([own[doc], rows[:, 0] - p.starts[doc], rows[:, 1], rows[:, 2]])
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _stretch(p: Partition, i: int, q: int) -> tuple[int, int]:
    """The positions around ``i`` whose next member is ``q`` away, as a half-open range."""
    size, end = 2 * q + 2, i + 1
    while True:
        part = np.arange(end, min(end + size, p.total))
        other = np.flatnonzero(p.next[part] - part != q)
        end += int(other[0]) if len(other) else len(part)
        if len(other) or not len(part):
            break
        size *= 2
    size, begin = 2 * q + 2, i
    while True:
        part = np.arange(max(begin - size, 0), begin)
        other = np.flatnonzero(p.next[part] - part != q)
        begin -= len(part) - 1 - int(other[-1]) if len(other) else len(part)
        if len(other) or not len(part):
            return begin, end
        size *= 2


def planted(n: int, doc_id: int | None) -> tuple[int, int] | None:
    """(a, p): from word a on, a text of ``n`` words repeats its p words from there. None: left alone."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words, and the offsets of each text's."""
    raw = b" ".join(texts) + b" "
    edge = np.flatnonzero(np.diff(_IS_WORD[np.frombuffer(raw, dtype=np.uint8)].view(np.int8), prepend=0)).astype(np.int64)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), max(len(edge) - 1, 0), [None, pa.py_buffer(edge if len(edge) else np.zeros(1, np.int64)), pa.py_buffer(raw)])
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return pieces.take(pa.array(np.arange(0, max(len(edge) - 1, 0), 2))), np.searchsorted(edge[0::2], bounds)


def collapse_texts(ids: list[int | None], texts: list[bytes], plant: bool, least: int, exponent: int) -> pa.RecordBatch:
    """Runs and collapsed texts of one slice."""
    words, offsets = _words(texts)
    counts = np.diff(offsets)
    pick = np.arange(len(words))
    if plant:
        for k, (i, n) in enumerate(zip(ids, counts.tolist(), strict=True)):
            if (how := planted(n, i)) is not None:
                a, p = how
                pick[offsets[k] + a : offsets[k + 1]] = offsets[k] + a + np.arange(n - a) % p
    numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[pick] if len(words) else np.zeros(0, np.int64)
    runs = runs_of(numbers, offsets, least, exponent)
    begin = offsets[runs[:, 0]] + runs[:, 1]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, begin + runs[:, 3], 1)
    np.add.at(cover, begin + runs[:, 2], -1)
    keep = np.cumsum(cover[:-1]) == 0
    kept = words.take(pa.array(pick[keep]))
    ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
    collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), kept), pa.scalar(b" ", pa.large_binary()))
    places = np.searchsorted(runs[:, 0], np.arange(len(ids) + 1)).astype(np.int32)
    struct = pa.StructArray.from_arrays([pa.array(runs[:, k], pa.int64()) for k in (1, 2, 3)], ["start", "length", "period"])
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(places), struct), collapsed.cast(pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"]
    )


def collapsed(docs: DataFrame, plant: bool = False, least: int = LEAST, exponent: int = EXPONENT, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start and period) and collapsed: the words that
    no run contains after its first period, joined by one space. ``plant`` gives a tenth of the
    documents a repeated tail first (see ``planted``), which measures how well runs are found."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                t = t.as_py() or b""
                if ids and size + len(t) > slice_bytes:
                    yield collapse_texts(ids, texts, plant, least, exponent)
                    ids, texts, size = [], [], 0
                ids.append(i.as_py())
                texts.append(t)
                size += len(t)
            if ids:
                yield collapse_texts(ids, texts, plant, least, exponent)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(work, SCHEMA).withColumn("collapsed", F.col("collapsed").cast("string"))


def report(found: DataFrame) -> DataFrame:
    """A row of figures for each document of ``collapsed``: the longest run and hashes of all."""
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    one = F.when(F.size("runs") > 0, longest)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("one_", one).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("one_.start").alias("start"), (-F.col("one_.less")).alias("length"), F.col("one_.period").alias("period"),
        F.floor(-1000 * F.col("one_.less") / F.col("one_.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
