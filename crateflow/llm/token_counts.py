"""Operator 12: token counts by a byte-level BPE tokenizer compiled to finite-state transducers.

Two deterministic transducers, both made from the tokenizer's file:

* ``Cutter`` reads classes of characters with what is seen of the next ones, and emits where pieces
  begin. It has eight states, so a chunk of text is a map from entry to exit states with the pieces
  emitted on the way; the maps of chunks compose by a parallel prefix scan (``automata``).
* ``Counter`` reads the bytes of a piece, and every transition is annotated with the tokens it adds
  to (or takes from) the count. Its states are compiled as texts need them: one holds, for each token
  that may still be going on, its place in the tree of tokens, the last token of the best encoding
  before it, and how many tokens fewer that one had. A token is the last one of a prefix exactly if
  it and the one before stay as they are when encoded together, which a walk over the merges at the
  seam decides. So one step a byte is enough, however long a piece is.

Texts up to ``CHUNK`` bytes are counted where they lie. Longer ones are dealt out as chunks with a few
bytes of their neighbours; a chunk gives its map and, for each entry state, the tokens of the pieces
that lie whole inside and the open ends. The maps of one document (2**31 / ``CHUNK`` at most, as a
string holds no more bytes) are composed, open ends are put together and counted.

Strings of the added tokens count as these tokens, as the library does by default. Null and empty
texts have no tokens. Repeated rows give repeated results, a null doc_id stays null, an empty table
gives an empty one, and other columns never reach the workers.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import automata

#: Bytes of a chunk; bytes of text counted together; states and pieces that a worker keeps.
CHUNK, SLICE_BYTES, STATES, PIECES = 1 << 16, 4_000_000, 400_000, 600_000
#: Tokens beyond which a document is over the limit.
LIMIT = 512

LETTER, NUMBER, OTHER, BLANK, SPACE, END, ADDED = range(7)
_END_BYTE = b"\xff"  # stands in no UTF-8 text


def _byte_of() -> dict[str, int]:
    """The bytes that the characters of byte-level vocabularies stand for: printable Latin ones
    for themselves, the others numbered from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class State:
    """A state of the counter: ``open`` has (place in the tree, last token before, tokens fewer)."""

    __slots__ = ("open", "go")

    def __init__(self, entries: tuple):
        self.open, self.go = entries, {}


class Counter:
    """The transducer over the bytes of one piece."""

    def __init__(self, vocabulary: dict[str, int], merges: list, most_states: int = STATES):
        byte_of = _byte_of()
        self.most_states = most_states
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocabulary.items() if all(c in byte_of for c in token)}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # of a merged token: left, right, rank
        for r, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list | tuple) else pair.split(" ")
            left, right, new = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if any(x in self.parts and self.parts[x][2] >= r for x in (left, right)) or new in self.parts:
                raise ValueError("a merge comes before those of its parts, or twice")
            self.rank[left, right] = r
            self.parts[new] = (left, right, r)
        single = {raw[0]: i for i, raw in self.bytes_of.items() if len(raw) == 1 and i not in self.parts}
        if len(single) != 256:
            raise ValueError("every byte needs a token of its own")
        # The tree: (place, byte) -> place; the token that ends at a place; whether it goes on.
        self.step: dict[int, int] = {}
        self.token: list[int] = [-1]
        self.inner: list[bool] = [True]
        for i in [*single.values(), *self.parts]:
            place = 0
            for b in self.bytes_of[i]:
                self.inner[place] = True
                if (deeper := self.step.get(place << 8 | b)) is None:
                    deeper = self.step[place << 8 | b] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                place = deeper
            self.token[place] = i
        self.whole = functools.lru_cache(maxsize=1 << 17)(self._whole)
        self.ending = functools.lru_cache(maxsize=1 << 17)(lambda t: self._spine(t, 1))
        self.beginning = functools.lru_cache(maxsize=1 << 17)(lambda t: self._spine(t, 0))
        self._renew()

    def _renew(self) -> None:
        first = ((0, -1, 0),)
        self.start = State(first)
        self.known = {first: self.start}

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts at one end of a token as its merges go on, each with the rank of the merge that
        takes it up (none for the token itself)."""
        out: list[tuple[int, float]] = [(token, float("inf"))]
        while token in self.parts:
            rank, token = self.parts[token][2], self.parts[token][side]
            out.append((token, rank))
        return out[::-1]

    def _crossed(self, a: int, b: int, before: float) -> bool:
        """Whether, with merges of rank below ``before``, one joins the end of ``a`` with the start of ``b``.
        Merges happen by rank, equal ones from the left: the left part must outlive the merge, the
        right one need not be taken up before it."""
        left, right = self.ending(a), self.beginning(b)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            r = self.rank.get((x, y))
            if r is not None and r < before and r < x_ends and r <= y_ends:
                return True
            if i + 1 == len(left) and j + 1 == len(right):
                return False
            if x_ends < y_ends:
                i += 1
            elif y_ends < x_ends:
                j += 1
            else:
                i, j = i + 1, j + 1

    def _whole(self, token: int) -> bool:
        """Whether the bytes of a token are encoded as that token."""
        if token not in self.parts:
            return True
        a, b, rank = self.parts[token]
        return self.whole(a) and self.whole(b) and not self._crossed(a, b, rank)

    def stay(self, a: int, b: int) -> bool:
        """Whether two tokens, encoded together, stay as they are."""
        return not self._crossed(a, b, float("inf"))

    def _compile(self, state: State, byte: int) -> tuple[State, int]:
        """The transition of ``state`` on ``byte``."""
        on, last, added = [], -1, 0
        for place, before, fewer in state.open:
            if (deeper := self.step.get(place << 8 | byte)) is None:
                continue
            token = self.token[deeper]
            if last < 0 and token >= 0 and self.whole(token) and (before < 0 or self.stay(before, token)):
                last, added = token, 1 - fewer
            if self.inner[deeper]:
                on.append((deeper, before, fewer))
        entries = tuple([(place, before, fewer + added) for place, before, fewer in on] + [(0, last, 0)])
        if (out := self.known.get(entries)) is None:
            if len(self.known) >= self.most_states:
                self._renew()
            out = self.known[entries] = State(entries)
        state.go[byte] = (out, added)
        return out, added

    def count(self, piece: bytes) -> int:
        """The tokens of one piece."""
        state, total = self.start, 0
        for byte in piece:
            state, added = state.go.get(byte) or self._compile(state, byte)
            total += added
        return total


#: States of the cutter: a piece begins next; in letters, numbers, others; behind a blank that the next
#: piece takes; in white space; one, two letters of a contraction to come.
_BEGIN, _LETTERS, _NUMBERS, _OTHERS, _TAKEN, _SPACES, _ONE, _TWO = range(8)
#: Its symbols: characters by class, an apostrophe that may begin a contraction of one, two letters, a
#: blank and another space before a visible character, white space before more of it, an end.
_L, _N, _O, _A1, _A2, _BV, _SV, _W, _E = range(9)


def _cutter() -> tuple[np.ndarray, np.ndarray]:
    """``go[symbol, state]`` and ``begins[symbol, state]``: whether a piece begins at the symbol."""
    go, begins = np.zeros((9, 8), np.int8), np.ones((9, 8), dtype=bool)
    for symbol, own in ((_L, _LETTERS), (_N, _NUMBERS), (_O, _OTHERS), (_A1, _OTHERS), (_A2, _OTHERS)):
        go[symbol] = own
        begins[symbol, [own, _TAKEN]] = False
    for symbol, own in ((_A1, _ONE), (_A2, _TWO)):  # a contraction where a piece begins, else one of the others
        go[symbol] = own
        go[symbol, [_OTHERS, _TAKEN]] = _OTHERS
    go[_L, _ONE], go[_L, _TWO] = _BEGIN, _ONE
    begins[_L, [_ONE, _TWO]] = False
    go[_BV], go[_SV], go[_W], go[_E] = _TAKEN, _BEGIN, _SPACES, _BEGIN
    begins[_W, _SPACES] = False
    return go, begins


GO, BEGINS = _cutter()


class Classes:
    """The classes of characters, asked of the library once a character."""

    def __init__(self):
        from tokenizers import pre_tokenizers

        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.table = np.full(0x110000, 255, dtype=np.uint8)
        self.table[ord(" ")] = BLANK

    def of(self, points: np.ndarray) -> np.ndarray:
        out = self.table[points]
        if len(out) and int(out.max()) == 255:
            for p in np.unique(points[out == 255]).tolist():
                self.table[p] = self._ask(chr(p))
            out = self.table[points]
        return out

    def _ask(self, c: str) -> int:
        for kind, around in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            if len(self.library.pre_tokenize_str(around + c + around)) == 1:
                return kind
        return SPACE


class Tokenizer:
    """Both transducers of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            settings = json.load(f)
        cut, model = settings.get("pre_tokenizer") or {}, settings["model"]
        if cut.get("type") != "ByteLevel" or not cut.get("use_regex", True) or cut.get("add_prefix_space", True) or settings.get("normalizer"):
            raise ValueError("a byte-level tokenizer with its usual pattern is needed")
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError("a plain BPE model is needed")
        added = settings.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens must stand for their strings as they are")
        self.added = [t["content"].encode() for t in added]
        if any(a[-k:] == b[:k] for a in self.added for b in self.added for k in range(1, min(len(a), len(b)) + (a != b))):
            raise ValueError("added tokens must not overlap")
        self.halo = max(map(len, self.added), default=1) + 8
        self.find = re.compile(b"|".join(map(re.escape, self.added))) if self.added else None
        self.counter, self.classes = Counter(model["vocab"], model["merges"]), Classes()
        self.fixed = dict.fromkeys(self.added, 1) | {_END_BYTE: 0, b"": 0}
        self.young, self.old = dict(self.fixed), {}

    def symbols(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The cutter's symbols, and where each begins."""
        data = np.frombuffer(raw + b"\0\0\0\0", dtype=np.uint8)
        lead = np.flatnonzero((data[:-4] & 0xC0) != 0x80)
        first = data[lead].astype(np.int32)
        tail = [(data[lead + k] & 0x3F).astype(np.int32) for k in (1, 2, 3)] if len(raw) and int(first.max(initial=0)) >= 0x80 else None
        points = first
        if tail is not None:
            two, three, four = (first >= 0xC0) & (first < 0xE0), (first >= 0xE0) & (first < 0xF0), (first >= 0xF0) & (first < 0xF8)
            points = np.where(two, (first & 0x1F) << 6 | tail[0], points)
            points = np.where(three, (first & 0x0F) << 12 | tail[0] << 6 | tail[1], points)
            points = np.where(four, np.minimum((first & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2], 0x10FFFF), points)
        ends = first == 0xFF
        kind = self.classes.of(np.where(ends, 0x20, points))
        kind[ends] = END
        if self.find and any(a in raw for a in self.added):
            gone = np.zeros(len(data), dtype=bool)
            starts = []
            for m in self.find.finditer(raw):
                starts.append(m.start())
                gone[m.start() + 1 : m.end()] = True
            kind[np.searchsorted(lead, starts)] = ADDED
            lead, kind = lead[~gone[lead]], kind[~gone[lead]]
        after = np.append(kind[1:], END)
        visible = after <= OTHER
        symbol = np.array([_L, _N, _O, _W, _W, _E, _E], dtype=np.int8)[kind]
        symbol[(kind == BLANK) & visible] = _BV
        symbol[(kind == SPACE) & visible] = _SV
        quote = np.flatnonzero((data[lead] == 0x27) & (after == LETTER))
        if len(quote):
            at = lead[quote]
            b, c = data[at + 1], data[at + 2]
            later = np.append(after[1:], END)[quote] == LETTER
            symbol[quote[np.isin(b, np.frombuffer(b"stmd", np.uint8))]] = _A1
            two = np.isin(b, np.frombuffer(b"rv", np.uint8)) & (c == ord("e")) | (b == ord("l")) & (c == ord("l"))
            symbol[quote[two & later]] = _A2
        return symbol, lead

    def counts_of(self, raw: bytes, starts: np.ndarray, end: int) -> np.ndarray:
        """The tokens of the pieces that begin at ``starts``, the last one ending at ``end``."""
        if not len(starts):
            return np.zeros(0, np.int64)
        bounds = np.append(starts, end).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
        known = np.fromiter(map(self.count, pieces.dictionary.to_pylist()), dtype=np.int64)
        return known[pieces.indices.to_numpy()]

    def count(self, piece: bytes) -> int:
        """The tokens of one piece or added token; short ones are kept."""
        out = self.young.get(piece)
        if out is None:
            out = self.old.get(piece)
            if out is None:
                out = self.counter.count(piece)
            if len(piece) <= 64:
                if len(self.young) >= PIECES // 2:
                    self.old, self.young = self.young, dict(self.fixed)
                self.young[piece] = out
        return out

    def texts(self, texts: list[bytes]) -> np.ndarray:
        """The tokens of whole texts, which an end between them keeps apart."""
        raw = b"".join(t + _END_BYTE for t in texts)
        symbol, lead = self.symbols(raw)
        before = automata.Scan(GO, symbol).states_before(_BEGIN)
        starts = lead[BEGINS[symbol, before]]
        sums = np.concatenate([[0], np.cumsum(self.counts_of(raw, starts, len(raw)))])
        ends = np.cumsum([len(t) + 1 for t in texts])
        return np.diff(sums[np.searchsorted(starts, ends)], prepend=0)

    def chunk(self, before: bytes, own: bytes, after: bytes) -> dict:
        """The map of a chunk between some bytes of its neighbours: for each entry state the exit state,
        the tokens of the pieces that lie whole inside, and where the first and the last piece begin (-1:
        none does), with the bytes up to the one and from the other."""
        symbol, lead = self.symbols(before + own + after)
        mine = (lead >= len(before)) & (lead < len(before) + len(own))
        symbol, lead = symbol[mine], lead[mine] - len(before)
        scan = automata.Scan(GO, symbol)
        exits, tokens, firsts, lasts = [], [], [], []
        base = base_sums = None
        for state in range(scan.states):
            starts = lead[BEGINS[symbol, scan.states_before(state)]] if len(symbol) else lead
            exits.append(scan.exit(state))
            firsts.append(int(starts[0]) if len(starts) else -1)
            lasts.append(int(starts[-1]) if len(starts) else -1)
            if not len(starts):
                tokens.append(0)
            elif base is None or not len(base):
                base, base_sums = starts, np.concatenate([[0], np.cumsum(self.counts_of(own, starts[:-1], int(starts[-1])))])
                tokens.append(int(base_sums[-1]))
            else:  # runs from different states soon agree: only what lies before is counted anew
                k = min(len(starts), len(base))
                differ = np.flatnonzero(starts[len(starts) - k :] != base[len(base) - k :])
                same = k - 1 - int(differ[-1]) if len(differ) else k
                if same:
                    own_part = starts[: len(starts) - same + 1]
                    tokens.append(int(self.counts_of(own, own_part[:-1], int(own_part[-1])).sum() + base_sums[-1] - base_sums[len(base) - same]))
                else:
                    tokens.append(int(self.counts_of(own, starts[:-1], int(starts[-1])).sum()))
        head, tail = (len(own), 0) if min(firsts) < 0 else (max(firsts), min(lasts))
        return {"exits": exits, "tokens": tokens, "firsts": firsts, "lasts": lasts, "head": own[:head], "tail": own[tail:], "size": len(own)}

    def compose(self, chunks: list[dict]) -> int:
        """The tokens of a document from the maps of its chunks in order."""
        maps = automata.prefix_maps(np.array([c["exits"] for c in chunks], dtype=np.int64).T)
        total, pending = 0, []
        for c, state in zip(chunks, [_BEGIN, *maps[_BEGIN, :-1].tolist()], strict=True):
            first, last = c["firsts"][state], c["lasts"][state]
            if first < 0:
                pending.append(c["head"])
                continue
            total += self.count(b"".join([*pending, c["head"][:first]])) + c["tokens"][state]
            pending = [c["tail"][len(c["tail"]) - (c["size"] - last) :]]
        return total + self.count(b"".join(pending))


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """A worker's own, made once."""
    return Tokenizer(path)


_MAP = "size int, exits array<int>, tokens array<long>, firsts array<int>, lasts array<int>, head binary, tail binary"


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document. ``path``: the tokenizer's file on every worker."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    halo = tokenizer(path).halo
    if chunk < 2 * halo:
        raise ValueError(f"a chunk needs {2 * halo} bytes at least")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            ids, sizes, texts = batch.column(0), batch.column(1), batch.column(2)
            out, part, held = [], [], 0
            for t in texts:
                t = t.as_py() or b""
                if part and held + len(t) > slice_bytes:
                    out.append(own.texts(part))
                    part, held = [], 0
                part.append(t)
                held += len(t)
            if part:
                out.append(own.texts(part))
            yield pa.RecordBatch.from_arrays([ids, sizes, pa.array(np.concatenate([np.zeros(0, np.int64), *out]), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1).to_pylist()[0]
                text, skip, size = one.pop("part"), one.pop("skip"), one.pop("size")
                yield pa.RecordBatch.from_pylist([one | {"map": own.chunk(text[:skip], text[skip : skip + size], text[skip + size :])}], schema=map_schema)

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            for r in batch.to_pylist():
                n = own.compose([c["map"] for c in sorted(r["chunks"], key=lambda c: c["k"])])
                yield pa.RecordBatch.from_pylist([{"doc_id": r["doc_id"], "n_bytes": r["n_bytes"], "n_tokens": n}] * r["copies"], schema=out_schema)

    ints = pa.list_(pa.int32())
    map_schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("text_key", pa.string()), ("k", pa.int32()), (
        "map", pa.struct([("size", pa.int32()), ("exits", ints), ("tokens", pa.list_(pa.int64())), ("firsts", ints), ("lasts", ints), ("head", pa.binary()), ("tail", pa.binary())]))])
    out_schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    text = F.col("text").cast("string").cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    few = rows.where(F.col("n_bytes") <= chunk).mapInArrow(whole, "doc_id long, n_bytes long, n_tokens long")
    # Chunks of long texts: bytes before, the chunk's own, bytes behind.
    begin = F.col("k") * F.lit(chunk).cast("long")
    skip = F.when(F.col("k") > 0, halo).otherwise(0)
    chunks = (
        rows.where(F.col("n_bytes") > chunk).withColumn("text_key", F.sha2("text", 256))
        .select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_bytes") - 1) / chunk).cast("int"))).alias("k"))
        .select("doc_id", "n_bytes", "text_key", "k", F.least(F.lit(chunk), F.col("n_bytes") - begin).cast("int").alias("size"), skip.alias("skip"), F.substring(F.col("text"), (begin - skip + 1).cast("int"), F.lit(chunk) + halo + skip).alias("part"))
        .repartition("text_key", "k")
    )
    maps = chunks.mapInArrow(mapped, f"doc_id long, n_bytes long, text_key string, k int, map struct<{_MAP.replace(' ', ': ').replace(',:', ',')}>")
    # Repeated rows have equal maps, which a set keeps once.
    by_doc = maps.groupBy("doc_id", "n_bytes", "text_key").agg(F.collect_set(F.struct("k", "map")).alias("chunks"), F.count_if(F.col("k") == 0).alias("copies"))
    many = by_doc.mapInArrow(composed, "doc_id long, n_bytes long, n_tokens long")
    return few.unionByName(many).withColumn("over_limit", F.col("n_tokens") > limit)
