"""Joins of names that are spelled differently, over shared words.

Names of several words only match when they share two, and 45 of a hundred words of the longer or 80
of the shorter one. So of sizes x and y an overlap t(x, y) is asked for, and two names that have it
share their k rarest common words inside the first x - t + k and y - t + k words by rarity. Sets of k
words are the keys of the join, three for names of up to ``NARROW`` words, two for those of up to
``WIDE``, whose sets would be many, and one for longer ones: words that half of all names hold make no
candidates unless other shared words stand beside them. Names of one word match names of that word
alone.

Two names may share several keys, and are only taken where the key is made of the rarest words
they share. So a pair is compared in full where it meets and is found once: nothing is shuffled but
the names under their keys.

Names of equal words are one class; classes are joined, with what is asked of their members beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crateflow.functions import text

from . import storage


#: Words of a name up to which three and two of them are a key; overlaps up to which each has keys of its own.
NARROW, WIDE, EXACT = 8, 12, 8
#: Members of a class that stand beside it at most, about; larger classes come in pieces.
MEMBERS = 512


def keyed(names: DataFrame, id_col: str, artist: str | None, title: str) -> DataFrame:
    """id, key (see ``text.name_key``) of rows that have a word to compare."""
    own = text.name_key(F.col(artist) if artist else F.lit(None).cast("string"), F.col(title))
    names = names.repartition(F.col(id_col))  # cutting words is much work for rows of a small file
    return names.select(F.col(id_col).alias("id"), own.alias("key")).where(F.size("key.tokens") > 0)


def _plain(keys: DataFrame) -> DataFrame:
    """rep, tokens, remix and what else the rows hold: the class of equal keys, by a hash of 256 bits. Stored,
    as words are cut by many expressions and read by several steps."""
    others = [c for c in keys.columns if c != "key"]
    rows = keys.select(*others, F.array_sort("key.tokens").alias("tokens"), F.array_sort("key.remix").alias("remix"))
    return storage.stored(rows.withColumn("rep", F.unhex(F.sha2(F.concat(F.array_join("tokens", " "), F.lit("|"), F.array_join("remix", " ")), 256))), "names")


def _members(plain: DataFrame, *columns: str) -> DataFrame:
    """rep, members: the different values of ``columns`` in each class, in pieces of some ``MEMBERS``."""
    rows = plain.select("rep", *columns).distinct().withColumn("n", F.count("*").over(Window.partitionBy("rep")))
    piece = F.pmod(F.xxhash64(*columns), F.ceil(F.col("n") / MEMBERS))
    return rows.groupBy("rep", piece.alias("piece")).agg(F.collect_list(F.struct(*columns)).alias("members")).drop("piece")


def _asked(x: Column, y: Column) -> Column:
    """The overlap that two sizes ask for, beyond ``EXACT`` down to a power of two so that few differ."""
    least = F.greatest(F.lit(2), F.least(F.ceil(F.lit(0.45) * F.greatest(x, y)), F.ceil(F.lit(0.8) * F.least(x, y)))).cast("int")
    several = F.when(least <= EXACT, least).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(least.cast("double")))).cast("int"))
    return F.when((x == 1) & (y == 1), 1).otherwise(several)


def _width(x: Column, y: Column) -> Column:
    """How many words are a key for two sizes."""
    most = F.when(F.greatest(x, y) <= NARROW, 3).when(F.greatest(x, y) <= WIDE, 2).otherwise(1)
    return F.least(_asked(x, y), most)


def _key(asked: Column, width: Column, words: Column) -> Column:
    return F.xxhash64(asked, width, words)


def _ranked(left: DataFrame, right: DataFrame) -> DataFrame:
    """rep, remix, words (rarest first) of each different key of two tables of ``_plain``. Stored, as both
    sides read it."""
    classes = left.select("rep", "tokens", "remix").union(right.select("rep", "tokens", "remix")).dropDuplicates(["rep"])
    each = classes.select("rep", "remix", F.explode("tokens").alias("word"))
    counts = classes.select(F.explode("tokens").alias("word")).groupBy("word").count()
    order = F.array_sort(F.collect_list(F.struct("count", "word")))
    return storage.stored(each.join(counts, "word").groupBy("rep").agg(F.any_value("remix").alias("remix"), F.transform(order, lambda w: w["word"]).alias("words")), "words")


def _postings(side: DataFrame, ranked: DataFrame, plan: DataFrame) -> DataFrame:
    """``side`` with words and remix, under each key that a partner may ask for (plan: x, asked, width)."""
    rows = side.join(ranked, "rep").withColumn("x", F.size("words")).join(F.broadcast(plan), "x")
    p = F.slice("words", F.lit(1), F.greatest(F.col("x") - F.col("asked") + F.col("width"), F.lit(0)))
    after = lambda i: F.slice(F.col("p"), i + 2, F.size("p"))
    two = F.flatten(F.transform("p", lambda u, i: F.transform(after(i), lambda v: F.concat_ws(" ", u, v))))
    three = F.flatten(F.flatten(F.transform("p", lambda u, i: F.transform(after(i), lambda v, j: F.transform(after(i + j + 1), lambda w: F.concat_ws(" ", u, v, w))))))
    sets = F.when(F.col("width") == 1, F.col("p")).when(F.col("width") == 2, two).otherwise(three)
    keys = F.array_distinct(F.transform(sets, lambda s: _key(F.col("asked"), F.col("width"), s)))
    return rows.withColumn("p", p).withColumn("k", F.explode(keys)).drop("p", "asked", "width")


def _met(left: DataFrame, right: DataFrame, own: DataFrame, other: DataFrame) -> DataFrame:
    """a, b, their words (words, words_, common) and remixes (remix, remix_), members and members_: each pair of classes of
    ``left`` and ``right`` (``_plain``) that share words enough to be compared, with each pair of their pieces
    in ``own`` and ``other`` (rep, members)."""
    ranked = _ranked(left, right)
    x, y = F.col("x"), F.col("y")
    sizes = lambda t, name: t.select(F.size("tokens").alias(name)).distinct()
    plan = sizes(left, "x").crossJoin(sizes(right, "y")).where((x > 1) == (y > 1)).select("x", "y", _asked(x, y).alias("asked"), _width(x, y).alias("width"))
    a = _postings(own, ranked, plan.select("x", "asked", "width").distinct()).withColumnRenamed("rep", "a")
    b = _postings(other, ranked, plan.select(y.alias("x"), "asked", "width").distinct()).select("k", F.col("rep").alias("b"), F.col("words").alias("words_"), F.col("remix").alias("remix_"), F.col("members").alias("members_"), x.alias("y"))
    width = _width(x, y)
    # A row of its own for each pair, so that the words they share are looked for once.
    both = a.join(b, "k").where((x > 1) == (y > 1)).select("*", F.explode(F.array(F.array_intersect("words", "words_"))).alias("common"))
    rarest = F.array_join(F.slice("common", F.lit(1), width), " ")
    return both.where(F.col("k") == _key(_asked(x, y), width, rarest)).drop("k", "x", "y")


def _matching(left: DataFrame, right: DataFrame, own: DataFrame, other: DataFrame) -> DataFrame:
    """As ``_met``, of all matching names, with their overlap."""
    key = lambda mark: F.struct(F.col(f"words{mark}").alias("tokens"), F.col(f"remix{mark}").alias("remix"))
    found = _met(left, right, own, other).where(text.names_match(key(""), key("_"), F.col("common")))
    return found.withColumn("overlap", F.size("common"))


def _bare(plain: DataFrame) -> DataFrame:
    """The classes alone."""
    return plain.select("rep").distinct().withColumn("members", F.lit(None).cast("int"))


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b: classes of two tables of (id, key) that share words enough to be compared."""
    left, right = _plain(left), _plain(right)
    return _met(left, right, _bare(left), _bare(right)).select("a", "b")


def matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id, overlap (shared words) of all matching names of two tables of (id, key)."""
    left, right = _plain(left), _plain(right)
    found = _matching(left, right, _members(left, "id"), _members(right, "id"))
    pairs = found.select("overlap", "members_", F.explode("members.id").alias("left_id"))
    return pairs.select("left_id", F.explode("members_.id").alias("right_id"), "overlap")


def related(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """left_id, ``column``: its different values among the rows of ``right`` (id, key, ``column``) whose names match."""
    left, right = _plain(left), _plain(right.select("key", column))
    found = _matching(left, right, _bare(left), _members(right, column)).select("a", F.explode(f"members_.{column}").alias(column)).distinct()
    return found.join(left.select(F.col("rep").alias("a"), F.col("id").alias("left_id")), "a").select("left_id", column)


def owned(names: DataFrame, collection: DataFrame) -> DataFrame:
    """id, owned of every row of ``names`` (id, key): whether a name of ``collection`` matches; null
    where there is no word to compare."""
    some, held = _plain(names.where(F.size("key.tokens") > 0)), _plain(collection.select("key"))
    hits = _matching(some, held, _bare(some), _bare(held)).select("a").distinct().join(some.select(F.col("rep").alias("a"), F.col("id").alias("hit")), "a").select("hit").distinct()
    return names.join(hits, names["id"] == hits["hit"], "left").select("id", F.when(F.size("key.tokens") > 0, F.col("hit").isNotNull()).alias("owned"))


def duplicates(tracks: DataFrame, collection: DataFrame, overrides: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """id, duplicate_of, manual for every track that is there already.

    ``tracks``: id, artist, title, duration_ms; ``collection``: id, artist, title, seconds, in the order
    of id; ``overrides``: id, override_type. An override decides first; then the first name that matches
    and whose length, where both are known, differs by ``tolerance`` seconds at most."""
    asked = keyed(tracks, "id", "artist", "title").join(tracks.select("id", F.when(F.col("duration_ms") > 0, F.col("duration_ms") / 1000).alias("own")), "id")
    held = keyed(collection, "id", "artist", "title").join(collection.select("id", F.col("seconds").alias("other")), "id")
    left, right = _plain(asked), _plain(held.groupBy("key", "other").agg(F.min("id").alias("first")))
    found = _matching(left, right, _members(left, "own"), _members(right, "other", "first"))
    pairs = found.select("a", "members_", F.explode("members.own").alias("own")).select("a", "own", F.explode("members_").alias("m")).select("a", "own", "m.*")
    fits = F.coalesce(F.abs(F.col("own") - F.col("other")) <= tolerance, F.lit(True))
    least = pairs.where(fits).groupBy("a", "own").agg(F.min("first").alias("first"))
    first = left.join(least, (F.col("rep") == F.col("a")) & left["own"].eqNullSafe(least["own"])).groupBy(F.col("id").alias("left_id")).agg(F.min("first").alias("first"))
    rows = tracks.select("id").join(first, F.col("id") == F.col("left_id"), "left").join(overrides.select(F.col("id").alias("o"), "override_type"), F.col("id") == F.col("o"), "left")
    manual = F.coalesce(F.col("override_type") == "already_in_collection", F.lit(False))
    freed = F.coalesce(F.col("override_type") == "not_duplicate", F.lit(False))
    return rows.where(manual | (F.col("first").isNotNull() & ~freed)).select("id", F.when(~manual, F.col("first")).alias("duplicate_of"), manual.alias("manual"))


def proposals(records: DataFrame, candidates: DataFrame, overrides: DataFrame) -> DataFrame:
    """record_id, candidate_id, overlap, ambiguous: for each record without an address the candidate of
    most shared words, the first of equals.

    ``records``: id, artist, title, path, source_url; ``candidates``: id, artist, title; candidates with
    an override are never proposed. A record without a title goes by its file's name."""
    stem = F.regexp_replace(F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", ""), r"^\[\d+\]\s*", "")
    titled = F.trim(F.coalesce("title", F.lit(""))) != ""
    open_ = records.where(F.col("id").isNotNull() & (F.trim(F.coalesce("source_url", F.lit(""))) == ""))
    named = open_.select("id", F.when(titled, F.col("artist")).alias("artist"), F.when(titled, F.col("title")).otherwise(stem).alias("title"))
    left = _plain(keyed(named, "id", "artist", "title"))
    rest = candidates.join(overrides.select("id"), "id", "left_anti").where("id is not null")
    full = text.name_key(F.col("artist"), F.col("title"))
    forms = F.explode(F.array_distinct(F.array(full, text.name_key(F.lit(None).cast("string"), F.col("title")))))
    both = rest.select("id", full["tokens"].alias("full"), forms.alias("key")).where(F.size("key.tokens") > 0)
    # Of candidates with the same words the first is proposed; the last tells whether there are several.
    right = _plain(both.groupBy("key", "full").agg(F.min("id").alias("first"), F.max("id").alias("last")))
    found = _matching(left, right, _bare(left), _members(right, "full", "first", "last")).select("a", "words", "overlap", F.explode("members_").alias("m"))
    # The words shared with either form of the candidate, whichever of them matched.
    shared = found.select("a", F.greatest("overlap", F.size(F.array_intersect("words", "m.full"))).alias("overlap"), "m.first", "m.last")
    each = shared.groupBy("a", "overlap").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    top = each.groupBy("a").agg(F.max_by("first", "overlap").alias("candidate_id"), F.max("overlap").alias("overlap"), (F.min("first") < F.max("last")).alias("ambiguous"))
    best = left.join(top, F.col("rep") == F.col("a")).select(F.col("id").alias("left_id"), "candidate_id", "overlap", "ambiguous")
    return best.withColumnRenamed("left_id", "record_id")


def apply_proposals(records: DataFrame, proposed: DataFrame, candidates: DataFrame) -> DataFrame:
    """``records`` with the candidates' addresses where they had none and the proposal is sure."""
    sure = proposed.where(~F.col("ambiguous")).join(candidates.select(F.col("id").alias("candidate_id"), F.col("url").alias("url_")), "candidate_id").select(F.col("record_id").alias("id"), "url_")
    return records.join(sure, "id", "left").withColumn("source_url", F.coalesce(F.nullif(F.trim("source_url"), F.lit("")), F.col("url_"))).drop("url_")
