"""Operator 5: byte-level BPE encoding and decoding by monoid tree reduction.

A text is cut into halves down to leaves; every leaf is encoded on its own and neighbours
are joined up the tree. A join re-encodes a window around the seam and lets it grow until
the tokens outside provably do not change:

* between units (see ``units``) only the two that meet at the seam are encoded anew;
* between the pieces of one long unit, a left piece is settled once it ends three characters
  before the seam (no rule of the pattern looks further), and a right piece is settled once
  a settled piece of the window ends where a right piece ends (the pattern never looks back);
* inside a long piece, halves of its bytes are joined in the same way: a sequence of tokens
  is the encoding of its bytes exactly if every two neighbours, encoded together, stay as
  they are, so the window grows until both of its outer seams pass that test.

The join is associative, hence any tree gives the same ids. Decoding concatenates up the tree.

Null and empty texts give no ids and no bytes. Texts of any length are handled: recursion
depth is the logarithm of the length. Repeated rows give repeated results, an empty table an
empty one, and other columns never reach the workers.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, units

#: Characters of a leaf of a text's tree, and bytes of a leaf inside one piece.
LEAF_CHARS, LEAF_BYTES = 4096, 32
#: Units, and pieces, whose ids a worker keeps.
UNITS, PIECES = 300_000, 600_000
_LONG = 64
_NONE = 1 << 40


class Codec:
    """Encoder and decoder over one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES, kept: float = 1.0):
        self.ranks, self.pattern = ranks, pattern
        self.leaf_chars, self.leaf_bytes = max(1, leaf_chars), max(1, leaf_bytes)
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for raw, i in ranks.items():
            self.bytes_of[i] = raw
        self.units, self.pieces, self._stays = (units.Memory(int(kept * n)) for n in (UNITS, PIECES, UNITS))

    # --- inside one piece -------------------------------------------------------------
    def _merge(self, raw: bytes) -> list[int]:
        """Lowest rank first, leftmost first: the definition, for a leaf."""
        get = self.ranks.get
        parts = [raw[i : i + 1] for i in range(len(raw))]
        rank = [get(raw[i : i + 2], _NONE) for i in range(len(raw) - 1)]
        while rank and (best := min(rank)) != _NONE:
            i = rank.index(best)
            parts[i : i + 2] = [new := parts[i] + parts[i + 1]]
            del rank[i]
            if i < len(rank):
                rank[i] = get(new + parts[i + 1], _NONE)
            if i:
                rank[i - 1] = get(parts[i - 1] + new, _NONE)
        return [self.ranks[p] for p in parts]

    def stays(self, a: int, b: int) -> bool:
        """Whether two neighbours, encoded together, stay as they are."""
        out = self._stays.get((a, b))
        if out is None:
            self._stays.put((a, b), out := self._merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b])
        return out

    def join_ids(self, left: list[int], right: list[int]) -> list[int]:
        """Join the encodings of two neighbouring byte strings of one piece."""
        if not left or not right or self.stays(left[-1], right[0]):
            return left + right
        i, j = 1, 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self._merge(b"".join(map(self.bytes_of.__getitem__, left[len(left) - i :] + right[:j])))
            good_left = i == len(left) or self.stays(left[-i - 1], window[0])
            good_right = j == len(right) or self.stays(window[-1], right[j])
            if good_left and good_right:
                return left[: len(left) - i] + window + right[j:]
            i, j = i if good_left else 2 * i, j if good_right else 2 * j

    def encode_bytes(self, raw: bytes) -> list[int]:
        """The ids of one piece, by halves."""
        if (whole := self.ranks.get(raw)) is not None:
            return [whole]
        if len(raw) <= self.leaf_bytes:
            return self._merge(raw)
        half = len(raw) // 2
        return self.join_ids(self.encode_bytes(raw[:half]), self.encode_bytes(raw[half:]))

    def piece(self, text: str) -> bytes:
        """The ids of a piece as little-endian 32-bit integers."""
        out = self.pieces.get(text)
        if out is None:
            out = np.array(self.encode_bytes(text.encode("utf-8", "surrogatepass")), dtype="<u4").tobytes()
            if len(text) <= _LONG:
                self.pieces.put(text, out)
        return out

    # --- over pieces ------------------------------------------------------------------
    def join_pieces(self, left: list[str], right: list[str]) -> list[str]:
        """Join the pieces of two neighbouring texts."""
        if not left or not right:
            return left + right
        keep, room = len(left), 0
        while keep and room < 3:  # a piece is settled if it ends three characters before the seam
            keep -= 1
            room += len(left[keep])
        take = 2
        while True:
            take = min(take, len(right))
            window = "".join(left[keep:]) + "".join(right[:take])
            new = units.compiled(self.pattern).findall(window)
            if take == len(right):
                return left[:keep] + new
            ends, place = {}, room
            for k, p in enumerate(right[:take]):
                place += len(p)
                ends[place] = k + 1
            place = 0
            for k, p in enumerate(new):
                place += len(p)
                if place > len(window) - 3:
                    break
                if place in ends:
                    return left[:keep] + new[: k + 1] + right[ends[place] :]
            take *= 2

    def split(self, text: str) -> list[str]:
        """The pieces of one unit, by halves."""
        if len(text) <= self.leaf_chars:
            return units.compiled(self.pattern).findall(text)
        half = len(text) // 2
        return self.join_pieces(self.split(text[:half]), self.split(text[half:]))

    # --- over units -------------------------------------------------------------------
    def unit(self, text: str) -> bytes:
        """The ids of a unit."""
        out = self.units.get(text)
        if out is None:
            out = b"".join(map(self.piece, self.split(text)))
            if len(text) <= _LONG:
                self.units.put(text, out)
        return out

    def tree(self, text: str) -> tuple[list[str], list[bytes]]:
        """The units of a text and the ids of each, by halves."""
        if len(text) <= self.leaf_chars:
            own = units.cut(text)
            young = self.units.young.get
            return own, [young(u) or self.unit(u) for u in own]
        half = len(text) // 2
        (left, left_ids), (right, right_ids) = self.tree(text[:half]), self.tree(text[half:])
        seam, seam_ids = self.tree_of_seam(left[-1] + right[0])
        return left[:-1] + seam + right[1:], left_ids[:-1] + seam_ids + right_ids[1:]

    def tree_of_seam(self, text: str) -> tuple[list[str], list[bytes]]:
        own = units.cut(text)
        return own, [self.unit(u) for u in own]

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text."""
        return np.frombuffer(b"".join(self.tree(text)[1]) if text else b"", dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids: concatenation, which is the tree's join here."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@functools.cache
def codec(path: str, pattern: str, kept: float = 1.0) -> Codec:
    """One codec a worker process; the vocabulary is read where the worker runs."""
    return read_codec(path, pattern, kept)


def read_codec(path: str, pattern: str, kept: float = 1.0) -> Codec:
    """A codec of the caller's own, which goes with it."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Codec(ranks, pattern, kept=kept)


_OUTPUTS = {
    "ids": ("binary", lambda ids, raw: ids.tobytes()),
    "decoded": ("binary", lambda ids, raw: raw),
    "ids_sha256": ("string", lambda ids, raw: hashlib.sha256(ids.tobytes()).hexdigest()),
    "decoded_sha256": ("string", lambda ids, raw: hashlib.sha256(raw).hexdigest()),
}


def encode_documents(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, outputs: tuple[str, ...] = ("ids", "decoded"), carried: tuple[str, ...] = (), kept: float = 1.0, lasting: bool = True) -> DataFrame:
    """Encode and decode every text of ``docs`` (doc_id, text).

    Returns doc_id, the whole-number columns ``carried``, n_tokens and ``outputs``: ``ids`` (little-endian unsigned 32-bit),
    ``decoded`` (the bytes the ids stand for) or the SHA-256 of either (``ids_sha256``,
    ``decoded_sha256``), so that the long columns need not leave the worker. ``kept``: the share of
    ``UNITS`` and ``PIECES`` that a worker keeps, where its memory is shared with other steps. ``lasting``: whether it
    keeps them, and the vocabulary, after a task, which then costs the steps that follow their memory.
    """
    import public_tokenizers

    path = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN
    names = ["doc_id", *carried, "n_tokens", *outputs]
    kinds = [pa.int64(), *[pa.int64()] * len(carried), pa.int64(), *(pa.binary() if _OUTPUTS[o][0] == "binary" else pa.string() for o in outputs)]
    decodes = any(o.startswith("decoded") for o in outputs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (codec if lasting else read_codec)(path, pattern, kept)
        for ids, texts in common.slices(batches):
            rows = []
            for i, t in zip(ids, texts, strict=True):
                tokens = own.encode(t)
                raw = own.decode(tokens) if decodes else b""
                rows.append((*i.values(), len(tokens), *(_OUTPUTS[o][1](tokens, raw) for o in outputs)))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    texts = docs.select(F.struct(*[F.col(f"`{c}`").cast("long").alias(c) for c in ("doc_id", *carried)]).alias("key"), F.col("`text`").cast("string").alias("text"))
    return texts.mapInArrow(work, ", ".join(["doc_id long", *(f"{c} long" for c in carried), "n_tokens long", *(f"{o} {_OUTPUTS[o][0]}" for o in outputs)]))
