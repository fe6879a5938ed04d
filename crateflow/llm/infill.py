"""Operator 11: fill-in-middle transformation, cuts found by a parallel automaton scan.

One automaton over bytes does all: it knows where units (code points, words or lines) begin and
whether a sentinel's string goes by. A chunk of a text gives, for every state it may be entered in,
the state it is left in, how many units begin and whether a sentinel is completed. These compose
associatively, so a prefix scan resolves the states chunks are entered in, and the counts before each
tell which chunk holds a cut; there the place is selected, the chunk run from its own entry state.

Texts up to ``CHUNK`` bytes are cut where they lie, many together, by lanes of the same automaton.
Longer ones are dealt out as chunks. The maps of one document are composed in one place (2**31 /
``CHUNK`` at most, as a string holds no more bytes); only the chunks that hold a cut are run again.
The parts are put together where the whole output is wanted as one string.

A text that is null or empty, or that contains a sentinel, stays plain: its output is the text (empty
for null). Repeated rows give repeated results; a null doc_id counts as the empty text in the draw and
stays null; an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import automata

#: Bytes of a chunk, and of text that is cut together.
CHUNK, SLICE_BYTES = 1 << 16, 1_000_000
#: Marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Of a hundred documents so many are rearranged, and of those so many with the suffix first.
REARRANGED, SUFFIX_FIRST = 90, 20
_SEPARATOR = 0xFF  # stands in no UTF-8 text


def _unit_steps(unit: str):
    """(state, byte) -> (state, whether a unit begins). State 0 is the start of a text."""
    if unit == "char":
        return lambda state, byte: (1, state == 0 or byte & 0xC0 != 0x80)
    if unit == "word":  # a word with the white space behind it; white space in front is one of its own
        blank = frozenset(b"\t\n\x0b\x0c\r ")
        return lambda state, byte: (1, state == 0) if byte in blank else (2, state != 2)
    if unit == "line":
        return lambda state, byte: (0 if byte == 10 else 1, state == 0)
    raise ValueError(f"units are char, word or line, not {unit}")


class Automaton:
    """The product of the units' automaton and the sentinels' search automaton."""

    def __init__(self, unit: str, sentinels: tuple[str, ...]):
        marks = [s.encode() for s in sentinels]
        if not all(marks) or len(set(marks)) < len(marks) or any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, min(len(a), len(b)) + (a != b))) or any(a != b and a in b for a in marks for b in marks):
            raise ValueError("sentinels must be different, not empty and must not overlap")
        seen = {m[:k] for m in marks for k in range(len(m))}  # what may have been read of a sentinel

        def search(read: bytes, byte: int) -> tuple[bytes, bool]:
            read += bytes([byte])
            if read in marks:
                return b"", True
            while read not in seen:
                read = read[1:]
            return read, False

        step, states, rows = _unit_steps(unit), {(0, b""): 0}, []
        for state in iter_growing(states):
            row = []
            for byte in range(256):
                if byte == _SEPARATOR:
                    row.append((0, False, False))
                    continue
                (own, begins), (read, hit) = step(state[0], byte), search(state[1], byte)
                row.append((states.setdefault((own, read), len(states)), begins, hit))
            rows.append(row)
        table = np.array(rows, dtype=np.int64).transpose(1, 0, 2)  # byte, state, (next, begins, hit)
        kinds, self.kind = np.unique(table.reshape(256, -1), axis=0, return_inverse=True)
        kinds = kinds.reshape(-1, len(rows), 3)
        self.kind = self.kind.ravel().astype(np.int8)
        self.go, self.begins, self.hit = kinds[:, :, 0].astype(np.int8), kinds[:, :, 1].astype(bool), kinds[:, :, 2].astype(bool)

    def scan(self, raw: bytes) -> tuple[np.ndarray, automata.Scan]:
        symbols = self.kind[np.frombuffer(raw, dtype=np.uint8)]
        return symbols, automata.Scan(self.go, symbols)

    def map_of(self, raw: bytes) -> dict[str, list]:
        """For each entry state: the exit state, the units that begin, whether a sentinel is completed."""
        symbols, scan = self.scan(raw)
        out = {"exits": [], "units": [], "hits": []}
        for state in range(scan.states):
            before = scan.states_before(state)
            out["exits"].append(scan.exit(state))
            out["units"].append(int(self.begins[symbols, before].sum()))
            out["hits"].append(bool(self.hit[symbols, before].any()))
        return out

    def select(self, raw: bytes, state: int, rank: int) -> int:
        """Where the unit of a rank begins in a chunk entered in ``state``."""
        symbols, scan = self.scan(raw)
        return int(np.flatnonzero(self.begins[symbols, scan.states_before(state)])[rank])

    def compose(self, maps: list[dict]) -> tuple[np.ndarray, np.ndarray, bool]:
        """The entry state of each chunk, the units before each and in all, and whether one has a sentinel."""
        upto = automata.prefix_maps(np.array([m["exits"] for m in maps], dtype=np.int64).T)
        entry = np.concatenate([[0], upto[0, :-1]])
        units = [m["units"][s] for m, s in zip(maps, entry.tolist(), strict=True)]
        return entry, np.concatenate([[0], np.cumsum(units)]), any(m["hits"][s] for m, s in zip(maps, entry.tolist(), strict=True))

    def cut(self, texts: list[bytes], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of whole texts: units, whether a sentinel is there, and where the units of ranks a % (units + 1)
        and b % (units + 1) begin, the smaller first (the end for the rank behind the last)."""
        raw = b"".join(t + b"\xff" for t in texts)
        symbols, scan = self.scan(raw)
        before = scan.states_before(0)
        begins, hits = np.flatnonzero(self.begins[symbols, before]), np.flatnonzero(self.hit[symbols, before])
        size = np.array([len(t) for t in texts], dtype=np.int64)
        stop = np.cumsum(size + 1) - 1
        start = stop - size
        first = np.searchsorted(begins, start)
        n = np.searchsorted(begins, stop) - first
        marked = np.searchsorted(hits, stop) > np.searchsorted(hits, start)
        ranks = np.sort([a % (n + 1), b % (n + 1)], axis=0)
        places = np.append(begins, 0)
        at = [np.where(r < n, places[np.minimum(first + r, len(begins))], stop) - start for r in ranks]
        return n, marked, ranks[0], ranks[1], at[0], at[1]


def iter_growing(states: dict):
    """The keys of a dictionary that grows meanwhile, in order."""
    k = 0
    while k < len(states):
        yield list(states)[k]
        k += 1


@lru_cache(maxsize=8)
def automaton(unit: str, sentinels: tuple[str, ...]) -> Automaton:
    """A worker's own, made once."""
    return Automaton(unit, sentinels)


def _draws(seed: int) -> list[Column]:
    """Four numbers of 32 bits drawn for a document."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(drawn, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(docs: DataFrame, unit: str = "char", sentinels: tuple[str, str, str] = SENTINELS, seed: int = 1, rearranged: int = REARRANGED, suffix_first: int = SUFFIX_FIRST, chunk: int = CHUNK, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_units, middle_units (null if plain) and output.

    A document's draw is the SHA-256 of seed and doc_id: two numbers give the cuts, one whether it is
    rearranged, one the order."""
    automaton(unit, sentinels)  # refuses bad sentinels here rather than in a task
    if chunk < 1:
        raise ValueError("a chunk holds a byte at least")
    map_type = "struct<exits: array<int>, units: array<long>, hits: array<boolean>>"

    @F.arrow_udf("struct<n: long, marked: boolean, first: long, second: long, from_: long, to_: long>")
    def cuts(text: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        own, raw = automaton(unit, sentinels), text.to_pylist()
        first, second = a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False)
        sizes = np.cumsum([len(t) for t in raw]) // slice_bytes
        edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(raw)]
        found = [own.cut(raw[i:j], first[i:j], second[i:j]) for i, j in zip(edges, edges[1:]) if i < j]
        columns = [pa.array(np.concatenate(c)) for c in zip(*found)] if found else [pa.array([], pa.int64()), pa.array([], pa.bool_()), *[pa.array([], pa.int64())] * 4]
        return pa.StructArray.from_arrays(columns, ["n", "marked", "first", "second", "from_", "to_"])

    @F.arrow_udf(map_type)
    def chunk_map(part: pa.Array) -> pa.Array:
        own = automaton(unit, sentinels)
        kinds = pa.struct([("exits", pa.list_(pa.int32())), ("units", pa.list_(pa.int64())), ("hits", pa.list_(pa.bool_()))])
        return pa.array([own.map_of(t.as_py()) for t in part], kinds)

    place = "struct<chunk: int, state: int, rank: long>"

    @F.arrow_udf(f"struct<n: long, marked: boolean, first: long, second: long, one: {place}, two: {place}>")
    def located(maps: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        own, out = automaton(unit, sentinels), []
        for chunks, x, y in zip(maps.to_pylist(), a.to_pylist(), b.to_pylist(), strict=True):
            entry, units, marked = own.compose([c["map"] for c in sorted(chunks, key=lambda c: c["k"])])
            n = int(units[-1])
            ranks = sorted([x % (n + 1), y % (n + 1)])
            row = {"n": n, "marked": marked, "first": ranks[0], "second": ranks[1]}
            for name, r in zip(("one", "two"), ranks):
                k = int(np.searchsorted(units, r, side="right")) - 1 if r < n else len(entry)
                row[name] = {"chunk": k, "state": int(entry[k]) if r < n else 0, "rank": int(r - units[k])}
            out.append(row)
        kind = pa.struct([("chunk", pa.int32()), ("state", pa.int32()), ("rank", pa.int64())])
        return pa.array(out, pa.struct([("n", pa.int64()), ("marked", pa.bool_()), ("first", pa.int64()), ("second", pa.int64()), ("one", kind), ("two", kind)]))

    @F.arrow_udf("int")
    def selected(part: pa.Array, state: pa.Array, rank: pa.Array) -> pa.Array:
        own = automaton(unit, sentinels)
        return pa.array([None if t is None else own.select(t, s, r) for t, s, r in zip(part.to_pylist(), state.to_pylist(), rank.to_pylist(), strict=True)], pa.int32())

    text = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("*", *_draws(seed))
    cut_at = lambda df, a, b: df.select("*", F.substring("text", F.lit(1), a).alias("prefix"), F.substring("text", a + 1, b - a).alias("middle"), F.substring("text", b + 1, F.octet_length("text")).alias("suffix"))
    few = rows.where(F.octet_length("text") <= chunk).withColumn("c", cuts("text", "h1", "h2"))
    few = cut_at(few, F.col("c.from_").cast("int"), F.col("c.to_").cast("int")).select("doc_id", "h3", "h4", "c.n", "c.marked", "c.first", "c.second", *[F.col(c).cast("string").alias(c) for c in ("prefix", "middle", "suffix")])

    # Chunks of long texts. Both uses read the same columns, so that the exchange is made once.
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2("text", 256))
    chunks = (
        rows.where(F.octet_length("text") > chunk).select("doc_id", "text", key.alias("key"), F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / chunk).cast("int"))).alias("k"))
        .select("doc_id", "key", "k", F.substring(F.col("text"), F.col("k") * chunk + 1, F.lit(chunk)).alias("part")).repartition("key", "k")
    )
    # Repeated rows have equal maps and parts, which sets keep once.
    by_doc = chunks.select("doc_id", "key", "k", chunk_map("part").alias("map")).groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.collect_set(F.struct("k", "map")).alias("maps"))
    found = by_doc.select("key", "doc_id", "maps", *_draws(seed)).select(F.col("key").alias("key_"), "h3", "h4", located("maps", "h1", "h2").alias("c"))
    side = chunks.join(found, F.col("key") == F.col("key_"))

    def within(name: str) -> Column:
        """Where a cut lies in a chunk; only chunks that hold one are run again."""
        at = F.col(f"c.{name}")
        own = selected(F.when(F.col("k") == at["chunk"], F.col("part")), at["state"], at["rank"])
        return F.when(F.col("k") < at["chunk"], F.octet_length("part")).when(F.col("k") > at["chunk"], 0).otherwise(own)

    placed = side.select("doc_id", "key", "k", "h3", "h4", "c", F.col("part").alias("text"), within("one").alias("a"), within("two").alias("b"))
    parts = cut_at(placed, F.col("a"), F.col("b"))
    whole = parts.groupBy("key").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "h3", "h4", "c")], F.count_if(F.col("k") == 0).alias("copies"),
        F.array_sort(F.collect_set(F.struct("k", *[F.col(c).cast("string").alias(c) for c in ("prefix", "middle", "suffix")]))).alias("parts"),
    ).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    many = whole.select("doc_id", "h3", "h4", "c.n", "c.marked", "c.first", "c.second", *[F.array_join(F.col("parts")[c], "").alias(c) for c in ("prefix", "middle", "suffix")])

    p, s, m = map(F.lit, sentinels)
    form = F.when((F.col("n") == 0) | F.col("marked") | (F.col("h3") % 100 >= rearranged), "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    output = (
        F.when(F.col("form") == "plain", F.concat("prefix", "middle", "suffix")).when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).otherwise(F.concat(s, "suffix", p, "prefix", m, "middle"))
    )
    counted = lambda c: F.when(F.col("form") != "plain", c)
    return few.unionByName(many).withColumn("form", form).select(
        "doc_id", "n", "form", counted(F.col("first")).alias("prefix_units"), counted(F.col("second") - F.col("first")).alias("middle_units"), output.alias("output")
    )


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text from its output and form alone. No sentinel stands in a rearranged text, nor can one
    arise where its parts meet a sentinel, as they do not overlap: so each is found where it was put."""
    p, s, m = sentinels
    behind = lambda c, mark: F.substring_index(c, mark, -1)
    before = lambda c, mark: F.substring_index(c, mark, 1)
    middle = behind(output, m)
    psm = F.concat(before(behind(output, p), s), middle, before(behind(output, s), m))
    spm = F.concat(before(behind(output, p), m), middle, before(behind(output, s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(cut: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """A row of figures for each document of ``fill_in_middle``."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return cut.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"), sentinels)).alias("restored_sha256"),
    )


#: The query in DuckDB's words: its characters are code points, so the cuts are plain arithmetic there.
SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
h AS (SELECT *, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2, ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS x, substring(t, a + 1, b - a) AS y, substring(t, b + 1) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
