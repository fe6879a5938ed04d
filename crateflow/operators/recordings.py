"""Recordings compared by their acoustic fingerprints: arrays of 32-bit values, one about every 0.12 s."""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import components

#: Most bits in a hundred that differ, and seconds of length, between two of one recording.
MOST_ERRORS, MOST_SECONDS = 0.15, 3.0
#: Fewest values of two recordings that stand beside each other.
LEAST_OVERLAP = 50
#: Longest list that is paired place by place.
LONGEST = 2000
#: Each deal parts the 32 bits in four by the low bits of their numbers: numbers go together if they differ by one of the
#: two here or by their sum. Any two numbers go together in one of the deals.
DEALS = ((1, 6), (2, 12), (4, 11), (8, 5), (3, 10))


def _masks() -> list[int]:
    """Samples of 24 of a value's 32 bits: all but one part of a deal. Any two bits are left out by one of them."""
    parts = [[min((bit ^ w) & 15 for w in (0, u, v, u ^ v)) for bit in range(32)] for u, v in DEALS]
    return [sum(1 << bit for bit in range(32) if part[bit] != k) for part in parts for k in sorted(set(part))]


MASKS = _masks()
#: Values on either side of a cell that one task holds; values or pairs that it compares in one go.
VALUES, SLICE = 1 << 21, 1 << 20


def _errors(a: np.ndarray, b: np.ndarray, most_offset: int = 80, least_overlap: int = LEAST_OVERLAP) -> float:
    """All shifts at once: row i of a table holds value i of ``a`` against the values of ``b`` that the
    shifts bring beside it; a column is a shift."""
    if not len(a) or not len(b):
        return 1.0
    reach = np.arange(len(a))[:, None] + np.arange(-most_offset, most_offset + 1)
    there = (reach >= 0) & (reach < len(b))
    beside = b.astype(np.uint32)[np.clip(reach, 0, len(b) - 1)]
    wrong = np.where(there, np.bitwise_count(a.astype(np.uint32)[:, None] ^ beside), 0).sum(axis=0, dtype=np.int64)
    overlap = there.sum(axis=0)
    valid = overlap >= least_overlap
    return float((wrong[valid] / (32 * overlap[valid])).min()) if valid.any() else 1.0


def _error_rates(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([1.0 if x is None or y is None else _errors(np.asarray(x, dtype=np.int64), np.asarray(y, dtype=np.int64)) for x, y in zip(a, b, strict=True)])


def _encoded(values: pd.Series) -> pd.Series:
    return pd.Series([base64.b64encode((np.asarray(v if v is not None else [], dtype=np.int64) & 0xFFFFFFFF).astype("<u4").tobytes()).decode() for v in values])


def _decoded(texts: pd.Series) -> pd.Series:
    return pd.Series([np.frombuffer(raw[: len(raw) // 4 * 4], dtype="<u4").astype(np.int64).tolist() for raw in (base64.b64decode(t or "") for t in texts)])


def bit_error_rate(a: Column | str, b: Column | str) -> Column:
    """Least share of differing bits over shifts of up to 80 values that overlap in 50 or more; 1 for none."""
    return F.pandas_udf(_error_rates, "double")(a, b)


def encode(values: Column | str) -> Column:
    """Fingerprints as base64 of little-endian unsigned 32-bit values; "" for none."""
    return F.pandas_udf(_encoded, "string")(values)


def decode(texts: Column | str) -> Column:
    """The values of an encoded fingerprint; bytes that fill no value are left out."""
    return F.pandas_udf(_decoded, "array<long>")(texts)


def usable(rows: DataFrame) -> DataFrame:
    """Rows (id, fingerprint, seconds, ...) with a fingerprint and a length; missing values are 0."""
    own = rows.where((F.size("fingerprint") > 0) & F.col("seconds").isNotNull())
    return own.withColumn("fingerprint", F.transform("fingerprint", lambda v: F.coalesce(v, F.lit(0))))


def _places(once: bool, left: bool, seconds: float) -> Column:
    """cell, asks, own of each cell that a row is sent to. A cell holds the rows of one piece of length, and beside
    them the rows that ask for their like: those of that piece and its neighbours or, where a pair is to be
    found ``once``, of that piece and the next."""
    piece = F.floor(F.col("seconds") / F.lit(seconds)).cast("long")
    held, asks = [F.struct(piece.alias("cell"), F.lit(False).alias("asks"), F.lit(True).alias("own"))], [F.struct((piece + k).alias("cell"), F.lit(True).alias("asks"), F.lit(k == 0).alias("own")) for k in ((-1, 0) if once else (-1, 0, 1))]
    return F.array(*(held + asks if once else asks if left else held))


def _wrong(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Bits that differ between ``m`` values of ``x`` from place ``i`` on and of ``y`` from place ``j`` on."""
    out = np.empty(len(m), dtype=np.int64)
    ends = np.cumsum(m)
    cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(SLICE, ends[-1], SLICE)), len(m)]) if len(m) else [0]
    for lo, hi in itertools.pairwise(cuts):
        n = m[lo:hi]
        first = np.cumsum(n) - n
        at = np.arange(n.sum()) - np.repeat(first, n)
        out[lo:hi] = np.add.reduceat(np.bitwise_count(x[np.repeat(i[lo:hi], n) + at] ^ y[np.repeat(j[lo:hi], n) + at]), first, dtype=np.int64)
    return out


class _Prints:
    """The different fingerprints of some rows, one after another, and their rows: copies are compared once."""

    def __init__(self, values: np.ndarray, bounds: np.ndarray, s: np.ndarray, rank: np.ndarray, own: np.ndarray, rows: np.ndarray):
        seen: dict[tuple, int] = {}
        of = np.array([seen.setdefault((own[r], values[bounds[r] : bounds[r + 1]].tobytes()), len(seen)) for r in rows], dtype=np.int64)
        order = np.argsort(of, kind="stable")
        self.rows, self.count = rows[order], np.bincount(of)
        self.first = np.cumsum(self.count) - self.count
        head = self.rows[self.first]
        self.own, self.size = own[head], (bounds[1:] - bounds[:-1])[head]
        self.start = np.cumsum(self.size) - self.size
        self.of = np.repeat(np.arange(len(head)), self.size)
        self.values = values[np.arange(len(self.of)) - np.repeat(self.start - bounds[head], self.size)]
        self.least_s, self.most_s = np.minimum.reduceat(s[self.rows], self.first), np.maximum.reduceat(s[self.rows], self.first)
        self.least, self.most = np.minimum.reduceat(rank[self.rows], self.first), np.maximum.reduceat(rank[self.rows], self.first)


class _Cell:
    """Pairs within one cell: fingerprints ``x`` that ask, ``y`` that are held."""

    def __init__(self, x: _Prints, y: _Prints, once: bool, seconds: float, most_errors: float, longest: int, most_offset: int):
        self.x, self.y, self.once, self.seconds, self.most_errors, self.longest, self.most_offset = x, y, once, seconds, most_errors, longest, most_offset

    def may(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether two fingerprints have rows of similar length that are not one row, in order where pairs are found once."""
        x, y = self.x, self.y
        near = (x.least_s[p] - y.most_s[q] <= self.seconds) & (y.least_s[q] - x.most_s[p] <= self.seconds)
        return near & (~x.own[p] | (x.least[p] < y.most[q]) if self.once else (x.least[p] != y.most[q]) | (x.most[p] != y.least[q]))

    def keys(self, mask: int):
        """Places of x and y with equal sampled bits: in slices, less the lists that are too long; and which
        fingerprints stand in such."""
        x, y = self.x.values & np.uint32(mask), self.y.values & np.uint32(mask)
        by_x, by_y = np.argsort(x), np.argsort(y)
        x, y = x[by_x], y[by_y]
        lo = np.searchsorted(y, x)
        n = np.searchsorted(y, x, "right") - lo
        runs = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        alike = np.diff(np.r_[runs, len(x)])
        crowded = (n > 0) & (np.maximum(n, np.repeat(alike, alike)) > self.longest)
        self.crowded_x[self.x.of[by_x[crowded]]] = True
        for k in runs[crowded[runs]]:
            self.crowded_y[self.y.of[by_y[lo[k] : lo[k] + n[k]]]] = True
        kept = np.flatnonzero((n > 0) & ~crowded)
        ends = np.cumsum(n[kept])
        cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(SLICE, ends[-1], SLICE)), len(kept)]) if len(kept) else [0]
        for a, b in itertools.pairwise(cuts):
            some = kept[a:b]
            first = np.cumsum(n[some]) - n[some]
            yield np.repeat(by_x[some], n[some]), by_y[np.arange(n[some].sum()) + np.repeat(lo[some] - first, n[some])]

    def meet(self, px: np.ndarray, py: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Pairs, as p * len(y) + q, not yet ``found``, whose errors are few at the shift that brings place px upon py."""
        x, y = self.x, self.y
        p, q = x.of[px], y.of[py]
        at, at_ = px - x.start[p], py - y.start[q]
        back = np.minimum(at, at_)
        m = np.minimum(x.size[p] - at, y.size[q] - at_) + back
        pair = p * len(y.count) + q
        good = (np.abs(at - at_) <= self.most_offset) & (m >= LEAST_OVERLAP) & self.may(p, q) & ~np.isin(pair, found)
        shifts = pair * (2 * self.most_offset + 1) + at - at_ + self.most_offset
        one = np.flatnonzero(good)[np.unique(shifts[good], return_index=True)[1]]
        pair, m, i, j = pair[one], m[one], (px - back)[one], (py - back)[one]
        # Most that share a key by chance have too many errors in the first part already.
        few = np.flatnonzero(_wrong(x.values, y.values, i, j, m * 2 // 5) / (32 * m) <= self.most_errors)
        few = few[_wrong(x.values, y.values, i[few], j[few], m[few]) / (32 * m[few]) <= self.most_errors]
        return np.unique(pair[few])

    def errors(self, pair: np.ndarray) -> np.ndarray:
        """Least share of differing bits over all shifts."""
        x, y = self.x, self.y
        out, shift = np.ones(len(pair)), np.arange(-self.most_offset, self.most_offset + 1)
        step = max(1, SLICE // len(shift))
        for a in range(0, len(pair), step):
            p, q = np.divmod(pair[a : a + step, None], len(y.count))
            i, j = np.maximum(shift, 0), np.maximum(-shift, 0)
            m = np.minimum(x.size[p] - i, y.size[q] - j)
            r, c = np.nonzero(m >= LEAST_OVERLAP)
            m = m[r, c]
            np.minimum.at(out, a + r, _wrong(x.values, y.values, x.start[p[r, 0]] + i[c], y.start[q[r, 0]] + j[c], m) / (32 * m))
        return out

    def pairs(self):
        """p, q, errors in slices. Fingerprints in lists that are too long are all compared with each other."""
        self.crowded_x, self.crowded_y = np.zeros(len(self.x.count), dtype=bool), np.zeros(len(self.y.count), dtype=bool)
        found = np.empty(0, dtype=np.int64)
        for mask in MASKS:
            for px, py in self.keys(mask):
                if len(new := self.meet(px, py, found)):
                    found = np.union1d(found, new)
        yield *np.divmod(found, len(self.y.count)), self.errors(found)
        silent, other = np.flatnonzero(self.crowded_x), np.flatnonzero(self.crowded_y)
        step = max(1, SLICE // max(1, len(other)))
        for a in range(0, len(silent), step):
            p, q = (v.ravel() for v in np.meshgrid(silent[a : a + step], other, indexing="ij"))
            pair = p * len(self.y.count) + q
            pair = pair[self.may(p, q) & ~np.isin(pair, found)]
            errors = self.errors(pair)
            few = errors <= self.most_errors
            yield *np.divmod(pair[few], len(self.y.count)), errors[few]


def _in_cell(once: bool, seconds: float, most_errors: float, longest: int, most_offset: int):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        ids, prints = table["id"].combine_chunks(), table["f"].combine_chunks()
        asks, own, s = (table[name].to_numpy() for name in ("asks", "own", "s"))
        rank = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        values, bounds = prints.values.to_numpy().view(np.uint32), prints.offsets.to_numpy().astype(np.int64)
        if asks.all() or not asks.any():
            return
        x, y = (_Prints(values, bounds, s, rank, own, np.flatnonzero(side)) for side in (asks, ~asks))
        for p, q, errors in _Cell(x, y, once, seconds, most_errors, longest, most_offset).pairs():
            n = x.count[p] * y.count[q]
            ends = np.cumsum(n)
            cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(SLICE, ends[-1], SLICE)), len(n)]) if len(n) else [0]
            for lo, hi in itertools.pairwise(cuts):
                k = np.repeat(np.arange(lo, hi), n[lo:hi])
                at = np.arange(len(k)) - np.repeat(np.cumsum(n[lo:hi]) - n[lo:hi], n[lo:hi])
                a, b = x.rows[x.first[p[k]] + at // y.count[q[k]]], y.rows[y.first[q[k]] + at % y.count[q[k]]]
                good = (np.abs(s[a] - s[b]) <= seconds) & (~own[a] | (rank[a] < rank[b]) if once else rank[a] != rank[b])
                if once:
                    a, b, good = np.where(rank[a] < rank[b], a, b), np.where(rank[a] < rank[b], b, a), good & (rank[a] != rank[b])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a[good])), ids.take(pa.array(b[good])), pa.array(errors[k][good])], names=["a", "b", "errors"])

    return pairs


def _compared(left: DataFrame, right: DataFrame, once: bool, most_errors: float, seconds: float, longest: int, most_offset: int) -> DataFrame:
    """a, b, errors. Fingerprints are sent to cells of similar length, where tasks look up the sampled bits; only
    they are shuffled, no sampled values and no candidates. A cell of more than ``VALUES`` values is dealt
    to several by parts of either side."""

    def sent(rows: DataFrame, asking: bool) -> DataFrame:
        whole = F.transform("fingerprint", lambda v: F.shiftright(F.shiftleft(v.cast("long"), 32), 32).cast("int"))
        fit = rows.where((F.size("fingerprint") >= LEAST_OVERLAP) & F.col("id").isNotNull() & ~F.isnan(F.col("seconds").cast("double")))
        return fit.select("id", F.col("seconds").cast("double").alias("s"), whole.alias("f"), F.inline(_places(once, asking, seconds)))

    rows = sent(left, True) if once else sent(left, True).union(sent(right, False))
    parts = [F.ceil(F.sum(F.when(F.col("asks") == asks, F.size("f")).otherwise(0)) / VALUES).cast("int").alias(name) for asks, name in ((True, "m"), (False, "n"))]
    counts = rows.groupBy("cell").agg(*parts).where("m > 0 AND n > 0")
    own_m, own_n = (F.pmod(F.xxhash64("id"), F.col(c)).cast("int") for c in ("m", "n"))
    each_m, each_n = (F.sequence(F.lit(0), F.col(c) - 1) for c in ("m", "n"))
    to = F.when(F.col("asks"), F.transform(each_n, lambda k: F.struct(own_m.alias("i"), k.alias("j")))).otherwise(F.transform(each_m, lambda k: F.struct(k.alias("i"), own_n.alias("j"))))
    dealt = rows.join(F.broadcast(counts), "cell").select("cell", "asks", "own", "id", "s", "f", F.inline(to))
    kind = left.schema["id"].dataType.simpleString()
    return dealt.groupBy("cell", "i", "j").applyInArrow(_in_cell(once, seconds, most_errors, longest, most_offset), f"a {kind}, b {kind}, errors double")


def candidates(left: DataFrame, right: DataFrame, seconds: float = MOST_SECONDS, longest: int = LONGEST, most_offset: int = 80) -> DataFrame:
    """a, b: pairs of similar length with values that agree in sampled bits, at a shift where few bits differ.

    A value of two recordings that differ in 15 of a hundred bits, evenly spread, agrees in all bits of one of
    ``MASKS`` with a chance of 16 %; fifty values miss a pair with one of 0.013 %, a whole minute never in
    practice, nor one that differs in the same two bits of every value. Lists of more than ``longest`` places in a cell (silence) are not
    paired place by place; all fingerprints that stand in such lists are compared with each other."""
    return _compared(left, right, False, MOST_ERRORS, seconds, longest, most_offset).select("a", "b").distinct()


def same(left: DataFrame, right: DataFrame, most_errors: float = MOST_ERRORS, seconds: float = MOST_SECONDS) -> DataFrame:
    """a, b, errors: rows of two tables (id, fingerprint, seconds) that are one recording. Rows of one id
    are not compared. Pairs are found as in ``candidates`` and measured over all shifts."""
    return _compared(usable(left), usable(right), False, most_errors, seconds, LONGEST, 80)


def same_within(rows: DataFrame, most_errors: float = MOST_ERRORS, seconds: float = MOST_SECONDS) -> DataFrame:
    """a, b, errors: the pairs of ``same`` within one table, each once, the lesser id first."""
    own = usable(rows)
    return _compared(own, own, True, most_errors, seconds, LONGEST, 80)


def first_same(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b: for each row of ``left`` the first row of ``right`` that is the same recording."""
    return same(left, right).groupBy("a").agg(F.min("b").alias("b"))


def groups(rows: DataFrame) -> DataFrame:
    """id, group of rows that share their recording with another: the group is its least id. Of equal
    fingerprints and lengths one stands for all, so copies are not compared with each other."""
    own = usable(rows).withColumn("copy", F.xxhash64("fingerprint", "seconds"))
    reps = own.groupBy("copy", "fingerprint", "seconds").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    one = reps.select(F.col("rep").alias("id"), "fingerprint", "seconds")
    tree = components.components(same_within(one).select("a", "b"))
    member = own.select("id", "copy", "seconds").join(reps.select("copy", "seconds", "rep", "copies"), ["copy", "seconds"])
    return member.join(tree, F.col("rep") == F.col("node"), "left").where(F.col("node").isNotNull() | (F.col("copies") > 1)).select("id", F.coalesce("root", "rep").alias("group"))


def similar(query: DataFrame, rows: DataFrame, top: int = 5, most_errors: float = MOST_ERRORS, cells: int = 64) -> DataFrame:
    """query_id, id, errors, rank: the ``top`` rows nearest each query (id, fingerprint) that are not the
    same recording. Rows are dealt to cells, and every query, of which there are few, to all of them."""
    q = query.where(F.size("fingerprint") > 0).select(F.col("id").alias("query_id"), F.col("fingerprint").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
    own = rows.where(F.size("fingerprint") > 0).select("id", F.col("fingerprint").alias("y"), F.pmod(F.xxhash64("id"), F.lit(cells)).cast("int").alias("cell"))
    scored = own.join(q, "cell").where("id <> query_id").select("query_id", "id", "cell", bit_error_rate("x", "y").alias("errors")).where(F.col("errors") > most_errors)
    some = scored.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "cell").orderBy("errors", "id"))).where(F.col("k") <= top).drop("k", "cell")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("errors", "id"))).where(F.col("rank") <= top)


def similar_cascade(embedded: DataFrame, printed: DataFrame, ids: DataFrame) -> DataFrame:
    """query_id, id, score, method: hits by embedding (query_id, id, score) where a query has any, else by
    fingerprint (query_id, id, errors), else one row with the method none."""
    by_vector = embedded.select("query_id", "id", F.round("score", 4).alias("score"), F.lit("embedding").alias("method"))
    without = ids.join(embedded.select("query_id").distinct(), "query_id", "left_anti")
    by_print = printed.join(without, "query_id").select("query_id", "id", F.round(1 - F.col("errors"), 4).alias("score"), F.lit("fingerprint").alias("method"))
    rest = without.join(printed.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("score"), F.lit("none").alias("method"))
    return by_vector.union(by_print).union(rest)
