"""Looking through a library of tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crateflow.functions import music, text

from . import digest, pairs

#: Columns that pages may be sorted by.
SORTS = ("id", "artist", "title", "bpm", "key_camelot", "energy", "taste_score", "breakdown_ratio", "duration", "status", "quality_status")
POOR = ("fake_transcode", "clipped", "corrupt")


def admitted() -> Column:
    """Neither rejected nor of poor quality."""
    return (F.coalesce("status", F.lit("")) != "rejected") & ~F.coalesce("quality_status", F.lit("")).isin(*POOR)


def track_filter(tracks: DataFrame, status: str | None = None, quality: str | None = None, key: str | None = None, bpm_min: float | None = None, bpm_max: float | None = None, most_breakdown: float | None = None, least_taste: float | None = None, adopted: bool | None = None, query: str = "") -> DataFrame:
    """The tracks that meet every condition given; a missing value meets no bound."""
    out = tracks
    for column, value in (("status", status), ("quality_status", quality), ("key_camelot", key)):
        if value:
            out = out.where(F.col(column) == value)
    bounds = [(F.col("bpm"), ">=", bpm_min), (F.col("bpm"), "<=", bpm_max), (F.col("breakdown_ratio"), "<=", most_breakdown), (F.col("taste_score"), ">=", least_taste)]
    for column, sign, bound in bounds:
        if bound is not None:
            out = out.where(column >= bound if sign == ">=" else column <= bound)
    if adopted is not None:
        out = out.where(F.col("adopted").isNotNull() if adopted else F.col("adopted").isNull())
    return out.where(text.contains_words(query, F.col("artist"), F.col("title"))) if query.strip() else out


def ordered(tracks: DataFrame, sort: str = "id", descending: bool = False) -> DataFrame:
    """By a column of ``SORTS`` (others: id), texts whatever their case, missing values last, then by id."""
    sort = sort if sort in SORTS else "id"
    value = F.lower(F.col(sort)) if dict(tracks.dtypes)[sort] == "string" else F.col(sort)
    return tracks.orderBy(value.desc_nulls_last() if descending else value.asc_nulls_last(), "id")


def explore(tracks: DataFrame, votes: DataFrame, snapshots: DataFrame, sort: str = "id", descending: bool = False, limit: int = 50, offset: int = 0, **conditions) -> tuple[DataFrame, DataFrame]:
    """(a page of the tracks that meet the conditions with vote and newest counts, total)."""
    found = track_filter(tracks, **conditions)
    one = digest.page(ordered(found, sort, descending), limit, offset)
    vote = votes.groupBy(F.col("sc_id").alias("v")).agg(F.max("value").alias("vote"))
    newest = snapshots.groupBy(F.col("sc_id").alias("s")).agg(F.max_by(F.struct("likes", "reposts", "comments"), F.struct("recorded_at", "id")).alias("counts"))
    with_id = one.withColumn("path_id", F.coalesce(text.id_from_file_name(F.col("path")), "sc_id"))
    rows = with_id.join(vote, F.col("path_id") == F.col("v"), "left").join(newest, F.col("path_id") == F.col("s"), "left").drop("v", "s")
    return ordered(rows, sort, descending), found.agg(F.count("*").alias("total"))


def _pool(tracks: DataFrame, centroid: tuple[float, float] | None) -> DataFrame:
    """Admitted tracks with tempo and key."""
    pool = tracks.where(admitted() & F.col("bpm").isNotNull() & F.col("key_camelot").isNotNull())
    return pool.where(F.col("centroid").between(*centroid)) if centroid else pool


def _all_neighbours(asked: DataFrame, tracks: DataFrame, tolerance: float, centroid: tuple[float, float] | None) -> DataFrame:
    """id, next_id, key_place, bpm_gap of every pair that goes together. Keys and tempos are paired first, then the
    lists of their tracks: the pairs of tracks, which are the result, go through no exchange and are made on all cores."""
    of = lambda t, i, k, b: t.where("id is not null and bpm is not null").select(F.col("id").alias(i), F.col("key_camelot").alias(k), F.col("bpm").cast("double").alias(b))
    own, other = of(asked, "id", "own_key", "own_bpm"), of(_pool(tracks, centroid), "next_id", "key", "tempo")
    piece = lambda c: F.floor(F.col(c) / F.lit(max(tolerance, 1e-9)))
    wanted = own.select("own_key", "own_bpm").distinct().select("*", F.posexplode(music.compatible_keys(F.col("own_key"))).alias("key_place", "key"))
    wanted = wanted.withColumn("piece", F.explode(F.sequence(piece("own_bpm") - 1, piece("own_bpm") + 1)))
    held = other.select("key", "tempo").distinct().withColumn("piece", piece("tempo"))
    met = wanted.join(held, ["key", "piece"]).withColumn("bpm_gap", F.abs(F.col("tempo") - F.col("own_bpm"))).where(F.col("bpm_gap") <= tolerance).drop("piece")
    rows = pairs.lists(own, ["own_key", "own_bpm"], "id").join(met, ["own_key", "own_bpm"]).join(pairs.lists(other, ["key", "tempo"], "next_id"), ["key", "tempo"])
    return pairs.each_pair(rows.select("id", "next_id", "key_place", "bpm_gap"), "id", "next_id").where("id <> next_id").select("id", "next_id", "key_place", "bpm_gap")


def harmonic_neighbours(asked: DataFrame, tracks: DataFrame, tolerance: float = 3.0, limit: int | None = 30, centroid: tuple[float, float] | None = None) -> DataFrame:
    """id, next_id, place, key_place, bpm_gap: for each of ``asked`` (id, key_camelot, bpm) its ``limit`` best
    partners among admitted ``tracks``: by the place of their key among those that go with its own, then
    by the gap in tempo, ``tolerance`` at most (0: equal tempo), artist, title, path and id. Without a limit (None)
    all of them, in no order and without a place.

    Partners depend on key and tempo alone, so they are looked up for each different pair of these.
    Tracks of one key and tempo are cut to the first ``limit`` + 1 in order before they meet, and of one
    key the ``limit`` + 1 next tempos to either side suffice: nothing grows with the square of the tracks."""
    if limit is None:
        return _all_neighbours(asked, tracks, tolerance, centroid)
    most = limit + 1  # one more, as a track is not its own partner
    pool = _pool(tracks, centroid)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    named = pool.select(F.col("id").alias("next_id"), F.col("key_camelot").alias("key"), F.col("bpm").cast("double").alias("tempo"), blank("artist"), blank("title"), blank("path"))
    names = ["artist", "title", "path", "next_id"]
    first = named.withColumn("k", F.row_number().over(Window.partitionBy("key", "tempo").orderBy(*names))).where(F.col("k") <= most).drop("k")
    wanted = asked.where(F.col("bpm").isNotNull()).select(F.col("key_camelot").alias("own_key"), F.col("bpm").cast("double").alias("own_bpm")).distinct()
    each = wanted.select("own_key", "own_bpm", F.posexplode(music.compatible_keys(F.col("own_key"))).alias("key_place", "key"))
    # Different tempos of a key in order, those asked for among them: ``at`` counts the pool's up to each.
    held = first.select("key", "tempo").distinct()
    marks = held.select("key", "tempo", F.lit(1).alias("one")).union(each.select("key", F.col("own_bpm").alias("tempo"), F.lit(0).alias("one")).distinct())
    counted = marks.groupBy("key", "tempo").agg(F.max("one").alias("one")).withColumn("at", F.sum("one").over(Window.partitionBy("key").orderBy("tempo")))
    near = each.join(counted.select("key", F.col("tempo").alias("own_bpm"), "at"), ["key", "own_bpm"]).withColumn("at", F.explode(F.sequence(F.col("at") - most, F.col("at") + most)))
    steps = near.join(counted.where("one = 1").select("key", "tempo", "at"), ["key", "at"]).withColumn("bpm_gap", F.abs(F.col("tempo") - F.col("own_bpm"))).where(F.col("bpm_gap") <= tolerance)
    order = ["key_place", "bpm_gap", *names]
    ranked = steps.join(first, ["key", "tempo"]).withColumn("k", F.row_number().over(Window.partitionBy("own_key", "own_bpm").orderBy(*order))).where(F.col("k") <= most)
    lists = ranked.groupBy("own_key", "own_bpm").agg(F.array_sort(F.collect_list(F.struct("k", "next_id", "key_place", "bpm_gap"))).alias("partners"))
    rows = asked.select("id", F.col("key_camelot").alias("own_key"), F.col("bpm").cast("double").alias("own_bpm")).join(lists, ["own_key", "own_bpm"])
    others = F.slice(F.filter("partners", lambda p: p["next_id"] != F.col("id")), 1, limit)
    return rows.select("id", F.posexplode(others).alias("place", "p")).select("id", "p.next_id", (F.col("place") + 1).alias("place"), "p.key_place", "p.bpm_gap")


def set_candidates(tracks: DataFrame, ids: list[int] | None = None, avoid_uncertain: bool = False, least_bpm: float = 0.5, least_key: float = 0.05) -> DataFrame:
    """Tracks with tempo and key for a set; ``ids`` chooses among them, an empty list none.
    ``avoid_uncertain`` leaves out those measured with little confidence; unknown confidence stays."""
    out = tracks.where(F.col("bpm").isNotNull() & (F.trim(F.coalesce("key_camelot", F.lit(""))) != ""))
    if ids is not None:
        out = out.where(F.col("id").isin(ids) if ids else F.lit(False))
    if avoid_uncertain:
        for column, least in (("bpm_confidence", least_bpm), ("key_margin", least_key)):
            if column in tracks.columns:
                out = out.where(F.col(column).isNull() | (F.col(column) >= least))
    return out


def path_or_name(others: DataFrame, tracks: DataFrame) -> DataFrame:
    """id, match_id, how (path, name, none) for rows (id, path) of another library: the track of the same
    path, else the first of the same file name."""
    base = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    by_path = pairs.lists(tracks.select(F.col("path").alias("p"), F.col("id").alias("by_path")).where("p is not null"), ["p"], "by_path")
    by_name = tracks.groupBy(base("path").alias("b")).agg(F.min("id").alias("by_name"))
    # The name first, of which there is one at most: a path that many tracks share makes many rows, which nothing sorts or exchanges.
    own = pairs.lists(others.select("id", "path"), ["path"], "id")
    met = own.join(by_name, base("path") == F.col("b"), "left").join(by_path, F.col("path") == F.col("p"), "left")
    one = F.array(F.lit(None).cast(tracks.schema["id"].dataType))
    rows = pairs.each_pair(met.select("id", F.coalesce("by_path", one).alias("by_path"), "by_name"), "id", "by_path")
    how = F.when(F.col("by_path").isNotNull(), "path").when(F.col("by_name").isNotNull(), "name").otherwise("none")
    return rows.select("id", F.coalesce("by_path", "by_name").alias("match_id"), how.alias("how"))


def map_paths(rows: DataFrame, mapping: dict[str, str], column: str = "path") -> Column:
    """The path on another machine: the longest prefix of ``mapping`` that ends at a folder is replaced;
    null where none fits. Backslashes count as slashes."""
    path, out = F.replace(F.col(column), F.lit("\\"), F.lit("/")), F.when(F.lit(False), F.lit(""))
    for prefix, target in sorted(mapping.items(), key=lambda kv: -len(kv[0].replace("\\", "/").rstrip("/"))):
        plain, new = prefix.replace("\\", "/").rstrip("/"), target.replace("\\", "/").rstrip("/")
        out = out.when((path == plain) | path.startswith(plain + "/"), F.concat(F.lit(new), F.substring(path, F.lit(len(plain) + 1), F.length(path))))
    return out


def file_location(path: Column) -> Column:
    """A path as a file address, percent-encoded but for slashes and colons."""
    coded = F.replace(F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%3A"), F.lit(":"))
    return F.concat(F.lit("file://localhost/"), F.replace(F.replace(coded, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A")))


def duplicates_by_id(files: DataFrame) -> DataFrame:
    """sc_id, id, keeper of files (id, path, key_camelot, bpm) whose names begin with the same number: the
    keeper is tagged before untagged, original before copy (``_2``), deeper before shallower, then by path and id."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    rank = F.struct(
        F.when((F.trim(F.coalesce("key_camelot", F.lit(""))) != "") | F.col("bpm").isNotNull(), 0).otherwise(1).alias("untagged"),
        stem.rlike(r"_\d+$").cast("int").alias("copy"), (-F.size(F.split("path", "/"))).alias("depth"), F.col("path"), F.col("id"),
    )
    own = files.select("id", text.id_from_file_name(F.col("path")).alias("sc_id"), rank.alias("rank")).where(F.col("sc_id").isNotNull())
    best = own.groupBy("sc_id").agg(F.min("rank").alias("best"), F.count("*").alias("n")).where(F.col("n") >= 2)
    return own.join(best, "sc_id").select("sc_id", "id", (F.col("rank") == F.col("best")).alias("keeper"))


def timeline(seen: DataFrame, votes: DataFrame, stores: DataFrame, tracks: DataFrame, jobs: DataFrame) -> DataFrame:
    """id, step, what, at: what happened to each track, in the order of steps."""
    step = lambda df, i, k, what, at: df.select(F.col(i).alias("id"), F.lit(k).alias("step"), what.alias("what"), at.cast("timestamp_ntz").alias("at"))
    none = F.lit(None)
    parts = [
        step(seen, "id", 1, F.lit("seen"), none), step(votes, "sc_id", 2, F.concat(F.lit("vote "), F.col("value")), none), step(stores, "sc_id", 3, F.lit("store"), F.col("last_seen")),
        step(tracks, "id", 4, F.concat(F.lit("library "), F.coalesce("status", F.lit("-"))), none), step(jobs, "track_id", 5, F.concat(F.lit("job "), F.col("status")), F.col("updated_at")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def evict(files: DataFrame, most_bytes: int) -> DataFrame:
    """Files (id, size, in the order of age: id) to delete, oldest first, until at most ``most_bytes`` are left."""
    from . import ranking

    total = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total_"))  # one row
    return ranking.running_sum(files, "size", "id", "older_").join(F.broadcast(total)).where(F.col("total_") - F.col("older_") > most_bytes).select("id")


def latest_by(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key: the last by ``order``."""
    return df.withColumn("k_", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).where("k_ = 1").drop("k_")
