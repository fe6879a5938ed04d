"""Operator 9: token-id files compressed by Re-Pair grammars, one grammar a shard.

Documents are put in ascending doc_id order over range partitions, their ids are laid end to
end (each document closed by an end id) and cut into shards at document boundaries. In each
shard frequent pairs of neighbouring symbols are replaced by new symbols, again and again,
until no pair stands ``LEAST`` times or the symbol space is used up. One pass replaces up to
``AT_ONCE`` of the most frequent pairs, by counts taken at its start; the next pass counts anew.

File format: Parquet, one row a shard.

* ``part``, ``block``: the shard's place (ascending doc_id); ``part_start``: ids before it in its part
* ``docs``, ``sizes``: ids of its documents in order, and how many token ids each has
* ``width``: bytes of a symbol, 2, or 4 where the vocabulary leaves too few 16-bit symbols
* ``rules``: pairs of unsigned symbols; rule k expands symbol ``terminals + k``
* ``lengths``: unsigned 32-bit, how many ids each rule expands to
* ``sequence``: the shard's symbols
* ``marks``: unsigned 32-bit, how many ids stand before every ``MARK``-th symbol

Any document is decoded alone (``Shard.ids``): its start is looked up among the marks, the
lengths of a few symbols from there lead to those that cover it, and these alone are expanded.

Null and empty texts give only the end id. A null doc_id comes first. Repeated doc_ids stay
repeated, in the order of a hash of their texts. A document longer than a shard gets a shard
of its own. An empty table gives empty files; other columns never reach the workers.
"""

from __future__ import annotations

import functools
import json
import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, units

#: Ids a shard closes at; least count of a pair worth a rule; pairs replaced in a pass; symbols between marks.
SHARD_IDS, LEAST, AT_ONCE, MARK = 400_000, 8, 2048, 1024
#: Parts of units whose ids a worker keeps; bytes of text encoded together.
MEMORY, SLICE_BYTES = 1_200_000, 8_000_000
#: Characters of text that are worth a range partition of their own.
PART_CHARS = 128_000_000
_HASH_BITS = 18


def width_for(terminals: int) -> int:
    """Bytes of a symbol: two where they leave a thousand symbols for rules, else four."""
    return 2 if terminals + 1000 <= 1 << 16 else 4


def _slot(pair: np.ndarray) -> np.ndarray:
    """A hash of ``_HASH_BITS`` bits of pairs."""
    if pair.dtype == np.uint32:
        return ((pair * np.uint32(0x9E3779B1)) >> np.uint32(32 - _HASH_BITS)).astype(np.intp)
    return ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _HASH_BITS)).astype(np.intp)


def _marked(slots: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _HASH_BITS, dtype=bool)
    out[slots] = True
    return out


def compress(ids: np.ndarray, terminals: int, least: int = LEAST, at_once: int = AT_ONCE):
    """(rules, lengths, sequence) of a Re-Pair grammar for ``ids`` < ``terminals``."""
    width = width_for(terminals)
    if len(ids) and int(ids.max()) >= terminals:
        raise ValueError(f"id {int(ids.max())} is outside the vocabulary of {terminals}")
    kind, half = (np.uint32, 16) if width == 2 else (np.uint64, 32)
    shift, low = kind(half), kind((1 << half) - 1)
    seq = ids.astype(kind)
    rules, length = np.zeros((0, 2), dtype=kind), np.ones(terminals, np.uint32)
    while True:
        room = min(at_once, (1 << half) - terminals - len(rules))
        if room <= 0 or len(seq) < 2:
            break
        pair = (seq[:-1] << shift) | seq[1:]
        slot = _slot(pair)
        count = np.bincount(slot, minlength=1 << _HASH_BITS)
        many = np.flatnonzero(count >= least)
        if len(many) > 2 * room:
            many = many[np.argpartition(count[many], -2 * room)[-2 * room :]]
        found, times = np.unique(pair[_marked(many)[slot]], return_counts=True)
        order = np.argsort(-times, kind="stable")[:room]
        chosen = np.sort(found[order[times[order] >= least]])
        if not len(chosen):
            break
        near = np.flatnonzero(_marked(_slot(chosen))[slot])  # the only places where a chosen pair can stand
        place = np.minimum(np.searchsorted(chosen, pair[near]), len(chosen) - 1)
        fits = chosen[place] == pair[near]
        at, place = near[fits], place[fits]
        # Of places that follow each other, every other one is taken, so that no two overlap.
        run = np.diff(at, prepend=-2) != 1
        first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        other = (np.arange(len(at)) - first) % 2 == 0
        at, place = at[other], place[other]
        base = terminals + len(rules)
        new = np.stack([chosen >> shift, chosen & low], axis=1)
        seq[at] = (base + place).astype(kind)
        keep = np.ones(len(seq), dtype=bool)
        keep[at + 1] = False
        seq = seq[keep]
        length = np.concatenate([length, length[new[:, 0]] + length[new[:, 1]]])
        rules = np.concatenate([rules, new])
    return rules.astype(f"<u{width}"), length[terminals:].astype("<u4"), seq.astype(f"<u{width}")


def marks_of(lengths: np.ndarray, sequence: np.ndarray, terminals: int) -> np.ndarray:
    """How many ids stand before every ``MARK``-th symbol."""
    own = np.concatenate([np.ones(terminals, np.uint32), lengths])[sequence]
    sums = np.add.reduceat(own, np.arange(0, len(own), MARK), dtype=np.int64) if len(own) else np.zeros(0, np.int64)
    return np.concatenate([[0], np.cumsum(sums)])[:-1].astype("<u4") if len(own) else np.zeros(0, "<u4")


class Shard:
    """One row of the files, read at any place."""

    def __init__(self, width: int, rules: bytes, lengths: bytes, sequence: bytes, marks: bytes, terminals: int):
        kind, self.terminals = f"<u{width}", terminals
        self.rules = np.frombuffer(rules, dtype=kind).reshape(-1, 2).tolist()
        self.sequence, self.marks = np.frombuffer(sequence, dtype=kind), np.frombuffer(marks, dtype="<u4")
        self.lengths = np.frombuffer(lengths, dtype="<u4")
        self.known: dict[int, bytes] = {}

    def expand(self, symbol: int) -> bytes:
        """The ids a symbol stands for, as little-endian unsigned 32-bit integers."""
        known, stack = self.known, [symbol]
        while stack:
            s = stack[-1]
            if s in known:
                stack.pop()
            elif s < self.terminals:
                known[s] = s.to_bytes(4, "little")
                stack.pop()
            else:
                a, b = self.rules[s - self.terminals]
                if a in known and b in known:
                    known[s] = known[a] + known[b]
                    stack.pop()
                else:
                    stack += [x for x in (a, b) if x not in known]
        return known[symbol]

    def ids(self, start: int, n: int) -> bytes:
        """Ids ``start`` to ``start + n``, as little-endian unsigned 32-bit integers."""
        if n <= 0:
            return b""
        block = int(np.searchsorted(self.marks, start, side="right")) - 1
        at, place, parts, got = block * MARK, int(self.marks[block]), [], 0
        first = None
        known, expand = self.known, self.expand
        while first is None or place + got // 4 < start + n:
            for s in self.sequence[at : at + MARK].tolist():
                if first is None:
                    size = 1 if s < self.terminals else int(self.lengths[s - self.terminals])
                    if place + size <= start:
                        place += size
                        continue
                    first = start - place
                if place + got // 4 >= start + n:
                    break
                raw = known.get(s) or expand(s)
                parts.append(raw)
                got += len(raw)
            at += MARK
        return b"".join(parts)[4 * first : 4 * (first + n)]

    def documents(self, sizes: list[int]) -> Iterator[bytes]:
        """The ids of each document of the shard in order, all symbols expanded in one go, which is
        cheaper than ``ids`` where all are wanted."""
        table = _terminal_bytes(self.terminals).copy()
        for x, y in self.rules:
            table.append(table[x] + table[y])
        flat = np.concatenate([np.arange(self.terminals, dtype="<u4"), np.frombuffer(b"".join(table[self.terminals :]), dtype="<u4")])
        size = np.concatenate([np.ones(self.terminals, np.int64), self.lengths])
        raw, at = gathered(flat, np.cumsum(size) - size, size, self.sequence)[0].tobytes(), 0
        for n in sizes:
            yield raw[4 * at : 4 * (at + n)]
            at += n


@functools.lru_cache(maxsize=1)
def _terminal_bytes(terminals: int) -> list[bytes]:
    return [i.to_bytes(4, "little") for i in range(terminals)]


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the pieces ``code`` end to end, their sizes); piece k is ``flat[start[k] : start[k] + size[k]]``."""
    own = size[code]
    ends = np.cumsum(own)
    where = np.repeat(start[code] - (ends - own), own)
    where += np.arange(len(where))
    return flat[where], own


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Ids by the tokenizers library; what it gave for a part of a text is kept and used again.

    Texts are cut into units (see ``units``), and a unit into the Latin letters it begins with
    and the rest: where the pattern meets a letter it takes all that follow, and it never looks
    back, so both have ids of their own. The letters are one piece of the pattern, which lets a
    copy of the library without the pattern encode them."""

    #: A blank that white space or the end follows; more than ``units`` asks for does no harm.
    ODD = r" (?:[\s\x0b\x1c-\x1f\x{85}\p{Z}]|$)"
    #: Latin letters before an ASCII character that is none, or the end.
    LETTERS = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)(?=[\\x00-@\\[-`{-\\x7f]|\\Z)")

    #: The same for a word: its letters and the rest, or no match.
    WORD = "(?s)^(?P<letters>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)(?P<rest>(?:[\\x00-@\\[-`{-\\x7f].*)?)$"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.lettered = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.library.encode_special_tokens = False
        self.terminals = self.library.get_vocab_size()
        with open(path, "rb") as f:
            settings = json.load(f)
        kind = settings.get("pre_tokenizer") or {}
        #: Whether the file's pattern is the one that units and letters rest on.
        self.known_pattern = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space", True) and settings.get("normalizer") is None
        self.lettered.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.parts = units.Memory(MEMORY)

    def _ids_of(self, own: list[str], letters: bool) -> list[bytes]:
        """The ids of parts: runs of ``letters``, or others."""
        self.parts.turn()
        young, old = self.parts.young, self.parts.old
        out = list(map(young.get, own))
        lacking = dict.fromkeys([u for u, raw in zip(own, out, strict=True) if raw is None])
        if not lacking:
            return out
        again = [u for u in lacking if u in old]
        young.update((u, old[u]) for u in again)
        fresh = [u for u in lacking if u not in old] if again else list(lacking)
        young.update(zip(fresh, self._encoded(fresh, letters), strict=True))
        out = [young[u] if raw is None else raw for u, raw in zip(own, out, strict=True)]
        for u in fresh:
            if len(u) > 64:
                del young[u]
        return out

    def _encoded(self, own: list[str], letters: bool = False) -> list[bytes]:
        library = self.lettered if letters else self.library
        return [array("I", e.ids).tobytes() for k in range(0, len(own), 10_000) for e in library.encode_batch_fast(own[k : k + 10_000], add_special_tokens=False)]

    def _units(self, own: list[str]) -> list[bytes]:
        """The ids of units by letters and rest."""
        match = self.LETTERS.match
        ends = [m.end() if (m := match(u)) else 0 for u in own]
        letters = iter(self._ids_of([u[:n] for u, n in zip(own, ends, strict=True) if n], True))
        rest = iter(self._ids_of([u[n:] for u, n in zip(own, ends, strict=True) if n < len(u)], False))
        return [(next(letters) if n else b"") + (next(rest) if n < len(u) else b"") for u, n in zip(own, ends, strict=True)]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, their number in each) of different words, each with a blank before it."""
        cut = pc.extract_regex(words, self.WORD)
        whole = pc.is_null(cut)
        letters = pc.struct_field(cut, "letters").dictionary_encode()  # null where the word stays whole
        rest = pc.if_else(whole, pc.binary_join_element_wise("", words, " "), pc.struct_field(cut, "rest")).dictionary_encode()
        pool = [*self._ids_of([" " + w for w in _strings(letters.dictionary)], True), *self._ids_of(_strings(rest.dictionary), False), b""]
        size = np.fromiter(map(len, pool), dtype=np.int64, count=len(pool)) // 4
        code = np.empty((len(words), 2), dtype=np.int64)
        code[:, 0] = np.asarray(pc.fill_null(letters.indices, len(pool) - 1))
        code[:, 1] = np.asarray(rest.indices) + len(letters.dictionary)
        flat, own = gathered(np.frombuffer(b"".join(pool), dtype="<u4"), np.cumsum(size) - size, size, code.ravel())
        return flat, own[0::2] + own[1::2]

    def _regular(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, their number in each) of texts in which a visible character follows every blank."""
        parts = pc.split_pattern(texts, " ")
        bounds, words = np.asarray(parts.offsets, dtype=np.int64), parts.flatten()
        bounds = bounds - bounds[0]
        first = np.zeros(len(words), dtype=bool)
        first[bounds[:-1]] = True
        coded = pc.filter(words, pa.array(~first)).dictionary_encode()
        flat, size = self._words(coded.dictionary)
        heads = self._units(_strings(words.take(pa.array(bounds[:-1]))))
        flat = np.concatenate([flat, np.frombuffer(b"".join(heads), dtype="<u4")])
        size = np.concatenate([size, np.fromiter(map(len, heads), dtype=np.int64, count=len(heads)) // 4])
        code = np.empty(len(words), dtype=np.int64)
        code[~first] = np.asarray(coded.indices)
        code[first] = len(coded.dictionary) + np.arange(len(heads))
        ids, own = gathered(flat, np.cumsum(size) - size, size, code)
        return ids, np.diff(np.concatenate([[0], np.cumsum(own)])[bounds])

    def batch(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        texts = pc.fill_null(texts, "")
        if not self.known_pattern:
            return self._encoded(texts.to_pylist())
        odd = np.asarray(pc.match_substring_regex(texts, self.ODD))
        out: list[bytes] = [b""] * len(texts)
        plain = np.flatnonzero(~odd)
        if len(plain):
            ids, sizes = self._regular(texts.filter(pa.array(~odd)) if odd.any() else texts)
            raw, bounds = ids.tobytes(), (4 * np.cumsum(sizes)).tolist()
            for i, a, b in zip(plain.tolist(), [0, *bounds], bounds):
                out[i] = raw[a:b]
        if odd.any():
            strange = np.flatnonzero(odd).tolist()
            cut = [units.cut(texts[i].as_py()) for i in strange]
            found = iter(self._units([u for own in cut for u in own]))
            for i, own in zip(strange, cut, strict=True):
                out[i] = b"".join(next(found) for _ in own)
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


_KINDS = {"part": pa.int64(), "block": pa.int64(), "part_start": pa.int64(), "docs": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()), "width": pa.int32(), "rules": pa.binary(), "lengths": pa.binary(), "sequence": pa.binary(), "marks": pa.binary()}
SCHEMA = "part long, block long, part_start long, docs array<long>, sizes array<long>, width int, rules binary, lengths binary, sequence binary, marks binary"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array]]:
    """(ids, texts) of about ``SLICE_BYTES`` at most, without a copy."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), dtype=np.int64)
        group = (np.cumsum(sizes) - 1) // SLICE_BYTES
        for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(group)) + 1):
            if len(part):
                own = batch.slice(int(part[0]), len(part))
                yield own.column(0).to_pylist(), own.column(1)


def write(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write the files; returns them as read back."""
    import public_tokenizers

    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    end = np.array([end_id], dtype="<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cluster's cores are Spark's to share
        own, part = encoder(path), TaskContext.get().partitionId()
        terminals = max(own.terminals, end_id + 1)
        block, before, names, sizes, parts, held = 0, 0, [], [], [], 0

        def shard() -> pa.RecordBatch:
            rules, lengths, seq = compress(np.frombuffer(b"".join(parts), dtype="<u4"), terminals)
            row = [part, block, before, names, sizes, width_for(terminals), rules.tobytes(), lengths.tobytes(), seq.tobytes(), marks_of(lengths, seq, terminals).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip(row, _KINDS.values(), strict=True)], names=list(_KINDS))

        for ids, texts in _slices(batches):
            for i, raw in zip(ids, own.batch(texts), strict=True):
                parts.append(raw + end)
                names.append(i)
                sizes.append(len(raw) // 4 + 1)
                held += sizes[-1]
                if held >= shard_ids:
                    yield shard()
                    block, before, names, sizes, parts, held = block + 1, before + held, [], [], [], 0
        if parts:
            yield shard()

    size = docs.select(F.sum(F.length(F.col("text").cast("string"))).alias("n")).first().n or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PART_CHARS))
    ordered = (
        common.texts_of(docs)
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
        .select("doc_id", "text")
    )
    return common.stored(ordered.mapInArrow(work, SCHEMA), "token-ids")


def read(files: DataFrame, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """Decode the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    import public_tokenizers

    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    # One row a range partition: their number, not the data's size, bounds this table and its window.
    parts = files.groupBy("part").agg(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)")).alias("ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).cast("long").alias("before"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terminals = max(encoder(path).terminals, end_id + 1)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in _KINDS}
                shard = Shard(*(row[n] for n in ("width", "rules", "lengths", "sequence", "marks")), terminals)
                crc = [zlib.crc32(raw) for raw in shard.documents(row["sizes"])]
                starts = np.cumsum(row["sizes"]) - row["sizes"] + row["part_start"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(crc), pa.int64()), pa.array(row["docs"], pa.int64()), pa.array(starts, pa.int64()), pa.array(row["sizes"], pa.int64()), pa.array(crc, pa.int64())],
                    names=["part", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    found = files.mapInArrow(work, "part long, doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(totals), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(files: DataFrame, wanted: DataFrame, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit, the end id included) of the ``wanted`` documents (doc_id).

    Only the shards that hold one are opened, and in these only the symbols that cover it are expanded.
    The shards' lists of documents are looked through without their sequences. Repeated rows of a doc_id all
    come back; ids that no shard holds, and null, give nothing."""
    import public_tokenizers

    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    held = files.select("part", "block", F.explode("docs").alias("doc_id")).join(wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    # At most a shard's documents each.
    hits = held.groupBy(F.col("part").alias("of_part"), F.col("block").alias("of_block")).agg(F.collect_set("doc_id").alias("asked"))
    shards = files.join(hits, (F.col("part") == F.col("of_part")) & (F.col("block") == F.col("of_block"))).select(*_KINDS, "asked")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terminals = max(encoder(path).terminals, end_id + 1)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in (*_KINDS, "asked")}
                shard, asked = Shard(*(row[n] for n in ("width", "rules", "lengths", "sequence", "marks")), terminals), set(row["asked"])
                starts = np.cumsum(row["sizes"]) - row["sizes"]
                found = [(i, n, shard.ids(int(a), n)) for i, n, a in zip(row["docs"], row["sizes"], starts, strict=True) if i in asked]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "n_tokens", "ids"])

    return shards.mapInArrow(work, "doc_id long, n_tokens long, ids binary")
