"""Operator 2: n-gram Jaccard self-join with adaptive multi-match prefixes.

Documents are sets of hashed five-word shingles; two link when their Jaccard likeness is at
least ``least`` percent. Equal sets form a class, and one set of each class is joined.

1. Two sets of sizes n >= m that link share at least 0.8 n shingles. So, in any common order,
   the first n - ceil(0.8 n) + k of both share at least k ("k-prefix"). In hash order every
   set hands out its k-prefix with k a tenth of its size; sets of which fewer than k prefix
   shingles occur anywhere else cannot link and are done.
2. For the others, all shingles are put in ascending order of how many of these sets hold
   them. Each set then picks its own match count: from one up, the prefix is lengthened by a
   shingle and one more shared shingle is required, as long as the estimated cost falls. The
   cost of k is the number of occurrences its prefix meets, plus ``VERIFY`` times as many
   candidates as those occurrences can give (one for every k).
3. Each shingle's list is first compared with one of its sets only (``PIVOTS`` rounds, each
   with another one): the most central one, whose shingles are the most widely held, which
   for near copies is the text they were made from. That settles groups of near copies
   without listing their pairs. Only where sets of different components still meet in a list
   are pairs made, if the shared shingle and what follows it in both leave room for the overlap
   that their sizes ask for. They are compared if they share as many prefix shingles as the
   smaller of their match counts. Every pair of sets that link is in one component after that: it was
   compared, or its sets were in one component before.
4. All comparisons are exact, on whole sets.

Null texts are empty. Sets without shingles link with nothing, each document being its own
component. A null doc_id takes part and has no say in a component's id. Repeated rows are
members of one class. An empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bitmap, common, components, shingles

LEAST, WIDTH = 80, 5
#: Rounds of comparing lists with one of their sets; cost of a comparison in list entries; most matches asked for.
PIVOTS, VERIFY, MATCHES = 2, 8, 4


def _floor_size(n: Column) -> Column:
    """Least size of a set that can link with one of size n, which is also the least overlap."""
    return F.ceil(n * LEAST / 100).cast("long")


def _prefixes(docs: DataFrame) -> DataFrame:
    """doc_id, n, hi, lo (128-bit digest of the set) and tokens: the first prefix in hash order,
    once for each digest and task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for ids, texts in common.slices(batches):
            n, hi, lo, tokens = [], [], [], []
            for s in shingles.distinct_sets(texts, WIDTH):
                digest = _digest(s)
                n.append(len(s))
                hi.append(int.from_bytes(digest[:8], "little", signed=True))
                lo.append(int.from_bytes(digest[8:], "little", signed=True))
                if len(s) and digest not in seen:
                    seen.add(digest)
                    tokens.append(s[: len(s) - -(-len(s) * LEAST // 100) + max(1, len(s) // 10)].view(np.int64))
                else:
                    tokens.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], names=["doc_id", "n", "hi", "lo", "tokens"])

    return common.texts_of(docs).mapInArrow(work, "doc_id long, n long, hi long, lo long, tokens array<long>")


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _survivors(sets: DataFrame, parts: int) -> DataFrame:
    """set (lo) of the sets whose first prefix holds enough shingles that other prefixes hold."""
    prefix = sets.where("tokens is not null").select(F.col("lo").alias("set"), "n", "tokens")
    held = prefix.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token")
    held = common.stored(held, "held", parts)
    filter_ = sets.sparkSession.sparkContext.broadcast(bitmap.bitmap(held, "token"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = batch.column(2)
            flat = arrays.flatten().to_numpy(zero_copy_only=False)
            keep = filter_.value.holds(flat) if len(flat) else np.zeros(0, bool)
            own = np.repeat(np.arange(batch.num_rows), arrays.value_lengths().to_numpy(zero_copy_only=False))[keep]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)), pa.array(flat[keep])], names=["set", "n", "token"])

    few = prefix.mapInArrow(work, "set long, n long, token long")
    shared = few.join(held, "token").dropDuplicates(["token", "set"]).coalesce(parts)
    needed = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") / 10).cast("long"))
    return shared.groupBy("set").agg(F.count("*").alias("k"), F.min("n").alias("n")).where(F.col("k") >= needed).select("set")


def _whole(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """set, rep, tokens of the documents ``wanted`` (doc_id), and of few others: a set may come
    more than once, where an id is repeated or the filter takes another id of its class for it."""
    filter_ = docs.sparkSession.sparkContext.broadcast(bitmap.bitmap(wanted, "doc_id"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = filter_.value.holds(batch.column(0).to_numpy(zero_copy_only=False))
            for ids, texts in common.slices(iter([batch.filter(pa.array(keep))])):
                own = [(i, s) for i, s in zip(ids, shingles.distinct_sets(texts, WIDTH), strict=True) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(_digest(s)[8:], "little", signed=True) for _, s in own], pa.int64()), pa.array([i for i, _ in own], pa.int64()), pa.array([s.view(np.int64) for _, s in own], pa.list_(pa.int64()))], names=["set", "rep", "tokens"])

    return common.texts_of(docs).where("doc_id is not null").mapInArrow(work, "set long, rep long, tokens array<long>")


def _adaptive(full: DataFrame, parts: int) -> DataFrame:
    """set, n, need, centre, room, token: every set's adaptive prefix and match count, how widely
    its shingles are held, and how many of its shingles do not stand before the token."""
    every = full.select("set", F.size("tokens").cast("long").alias("n"), F.explode("tokens").alias("token"))
    df = every.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    known = every.join(df, "token").coalesce(parts).groupBy("set").agg(F.min("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "token"))).alias("own"))
    # Shingles that no other set holds stand in front.
    alone = F.col("n") - F.size("own")
    length = lambda k: F.greatest(F.lit(0).cast("long"), F.col("n") - _floor_size(F.col("n")) + k - alone).cast("int")

    def cost(k: Column) -> Column:
        met = F.aggregate(F.slice("own", 1, length(k)), F.lit(0).cast("long"), lambda a, t: a + t["df"] - 1)
        return F.struct((met * (1 + VERIFY / k)).alias("cost"), k.alias("k"))

    choices = F.transform(F.sequence(F.lit(1).cast("long"), F.least(_floor_size(F.col("n")), F.lit(MATCHES).cast("long"))), cost)
    centre = F.aggregate("own", F.lit(0).cast("long"), lambda a, t: a + t["df"]) / F.col("n")
    picked = known.select("set", "n", "own", centre.alias("centre"), alone.alias("alone"), F.array_min(choices)["k"].alias("need"))
    taken = picked.withColumn("len", F.greatest(F.lit(0).cast("long"), F.col("n") - _floor_size(F.col("n")) + F.col("need") - F.col("alone")).cast("int")).select(
        "set", "n", "need", "centre", "alone", F.posexplode(F.slice("own", 1, F.col("len"))).alias("k", "t")
    )
    return taken.select("set", "n", "need", "centre", (F.col("n") - F.col("alone") - F.col("k")).alias("room"), F.col("t.token").alias("token"))


def _linked(pairs: DataFrame, full: DataFrame, parts: int) -> DataFrame:
    """u, v (representatives' ids) of the pairs (a, b) of sets that link."""
    left = full.select(F.col("set").alias("a"), F.col("rep").alias("u"), F.col("tokens").alias("x"))
    right = full.select(F.col("set").alias("b"), F.col("rep").alias("v"), F.col("tokens").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.coalesce(parts).join(left, "a").coalesce(parts).join(right, "b").where(100 * both >= LEAST * (F.size("x") + F.size("y") - both)).select("u", "v")


def _grown(tree: DataFrame | None, found: DataFrame, parts: int) -> DataFrame:
    """The components' stars (node, root) after the links ``found`` have been added to them."""
    found = common.stored(found, "found", parts)
    if tree is None:
        return components.components(found)
    if found.isEmpty():
        return tree
    return components.components(tree.select(F.col("node").alias("u"), F.col("root").alias("v")).union(found))


def _overlap(n: Column, m: Column) -> Column:
    """Least overlap of linked sets of these sizes."""
    return F.ceil((n + m) * LEAST / (100 + LEAST)).cast("long")


def _alike(n: Column, m: Column) -> Column:
    return (n >= _floor_size(m)) & (m >= _floor_size(n))


def _mixed(own: DataFrame) -> DataFrame:
    """The entries of lists in which different components meet, with the component that most of
    the list's entries are of (major) and the size of its smallest set (small)."""
    held = own.groupBy("token", "root").agg(F.count("*").alias("c"), F.min("n").alias("small"))
    lists = held.groupBy("token").agg(F.count("*").alias("roots"), F.max(F.struct("c", "root"))["root"].alias("major"), F.min("small").alias("small")).where("roots > 1")
    return own.join(lists.drop("roots"), "token")


def _candidates(own: DataFrame, parts: int) -> DataFrame:
    """a, b: sets of different components for which a token of both prefixes may be the first
    that they share. All that they share then stands at it or behind it in both, so either has
    room for the overlap that their sizes ask for; an entry without room even for the smallest
    set of its list meets none. Entries of a list's major component are not compared with each
    other."""
    roomy = _mixed(own).where(F.col("room") >= _overlap(F.col("n"), F.greatest("small", _floor_size(F.col("n")))))
    mixed = common.stored(_mixed(roomy.drop("major", "small")), "mixed", parts)
    a, b = mixed.where("root <> major").alias("a"), mixed.alias("b")
    meets = (F.col("a.token") == F.col("b.token")) & (F.col("a.root") != F.col("b.root")) & _alike(F.col("a.n"), F.col("b.n"))
    meets &= F.least("a.room", "b.room") >= _overlap(F.col("a.n"), F.col("b.n"))
    meets &= (F.col("b.root") == F.col("b.major")) | (F.col("a.set") < F.col("b.set"))
    return a.join(b, meets).select(F.least("a.set", "b.set").alias("a"), F.greatest("a.set", "b.set").alias("b")).coalesce(parts).distinct()


def _matched(pairs: DataFrame, lists: DataFrame, parts: int) -> DataFrame:
    """The pairs (a, b) that share as many prefix tokens as the smaller of their match counts."""
    prefixes = lists.groupBy("set").agg(F.collect_set("token").alias("tokens"), F.min("need").alias("need"))
    left = prefixes.select(F.col("set").alias("a"), F.col("tokens").alias("x"), F.col("need").alias("k"))
    right = prefixes.select(F.col("set").alias("b"), F.col("tokens").alias("y"), F.col("need").alias("l"))
    both = pairs.join(left, "a").coalesce(parts).join(right, "b")
    return both.where(F.size(F.array_intersect("x", "y")) >= F.least("k", "l")).select("a", "b")


def component_stars(full: DataFrame, parts: int) -> DataFrame:
    """node, root of the representatives of sets (set, rep, tokens) that link, by steps 2 to 4."""
    lists = common.stored(_adaptive(full, parts), "lists", parts)
    names = full.select("set", "rep")

    tree = None
    roots = names.select("set", "rep", F.col("rep").alias("root"))
    for k in range(PIVOTS):
        own = lists.join(roots.groupBy("set").agg(F.min("root").alias("root")), "set")
        # First the most central set of a list, then that of any of its components.
        order = F.struct((F.xxhash64("root", F.lit(k)) if k else F.lit(0)).alias("h"), "centre", "set", "n", "root")
        own = common.stored(own, "own", parts)
        pivot = own.groupBy("token").agg(F.max(order).alias("p"), F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("token", "p")
        pairs = own.join(pivot, "token").where((F.col("root") != F.col("p.root")) & _alike(F.col("n"), F.col("p.n"))).select(F.col("set").alias("a"), F.col("p.set").alias("b")).coalesce(parts).distinct()
        grown = _grown(tree, _linked(pairs, full, parts), parts)
        common.remove(own)
        tree = grown
        roots = common.stored(names.join(tree, names["rep"] == tree["node"], "left").select("set", "rep", F.coalesce("root", "rep").alias("root")), "roots", parts)

    own = common.stored(lists.join(roots.groupBy("set").agg(F.min("root").alias("root")), "set"), "own", parts)
    pairs = common.stored(_candidates(own, parts), "candidates", parts)
    tree = _grown(tree, _linked(_matched(pairs, lists, parts), full, parts), parts)
    common.remove(lists, own, pairs, roots)
    return tree


def link_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    sets = common.stored(_prefixes(docs), "prefixes")
    parts = common.parts_for(sets.count())
    classes = common.stored(sets.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep")), "classes", parts)

    # The whole sets of the representatives that may link.
    wanted = common.stored(classes.join(_survivors(sets, parts).withColumnRenamed("set", "lo"), "lo").where("rep is not null").select(F.col("rep").alias("doc_id")).coalesce(parts).distinct(), "wanted", parts)
    full = common.stored(_whole(docs, wanted), "sets")
    times = full.groupBy("set").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if (times or 0) > 1:  # copies would be compared with copies: each set once, by its class's least id
        many, full = full, common.stored(full.groupBy("set").agg(F.min("rep").alias("rep"), F.min_by("tokens", "rep").alias("tokens")), "sets")
        common.remove(many)
    tree = component_stars(full, parts)
    common.remove(wanted, full)
    labels = classes.join(tree, classes["rep"] == tree["node"], "left").select("hi", "lo", F.coalesce("root", "rep").alias("component"))
    return sets.select("doc_id", "n", "hi", "lo").join(labels, ["hi", "lo"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their component: its least doc_id.
    Of rows that repeat that id, one stays; rows without id stay."""
    classes = link_classes(docs).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(classes, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))


SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, r, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  WITH RECURSIVE walk(node, place) AS (
    SELECT doc_id, doc_id FROM sets
    UNION
    SELECT walk.node, e.v FROM walk JOIN (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs) e ON e.u = walk.place)
  SELECT node, min(place) AS component_id FROM walk GROUP BY node)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN reach ON reach.node = sets.doc_id
"""
