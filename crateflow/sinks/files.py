"""Playlists, tables and messages as files and texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crateflow.functions import music, text
from crateflow.operators import library

#: The columns of a set's table, in the order that other programs read.
SET_COLUMNS = ("pos", "artist", "title", "bpm", "bpm_confidence", "bpm_octave", "camelot", "key_name", "key_confidence", "key_margin", "duration_s", "score", "path")


def m3u8_lines(tracks: DataFrame, order: list[str], segment: str | None = None) -> DataFrame:
    """place, line of a playlist of ``tracks`` (path, artist, title, duration): a header, a comment where a
    new segment begins, two lines a track. Numbering is one ordered window: a playlist is one list."""
    numbered = tracks.withColumn("k", F.row_number().over(Window.orderBy(*order)))
    title = F.concat_ws(" - ", F.nullif("artist", F.lit("")), "title")
    info = F.concat(F.lit("#EXTINF:"), F.coalesce(F.round("duration").cast("long"), F.lit(-1)).cast("string"), F.lit(","), title)
    lines = [F.struct(F.lit(1).alias("j"), info.alias("line")), F.struct(F.lit(2).alias("j"), F.col("path").alias("line"))]
    if segment:
        numbered = numbered.withColumn("before_", F.lag(segment).over(Window.orderBy("k")))
        fresh = F.col("before_").isNull() | (F.col("before_") != F.col(segment))
        lines.insert(0, F.when(fresh, F.struct(F.lit(0).alias("j"), F.concat(F.lit("# segment "), F.col(segment).cast("string")).alias("line"))))
    body = numbered.select("k", F.explode(F.array_compact(F.array(*lines))).alias("l")).select((F.col("k") * 3 + F.col("l.j")).alias("place"), "l.line")
    header = tracks.sparkSession.range(1).select(F.lit(0).cast("int").alias("place"), F.lit("#EXTM3U").alias("line"))
    return header.union(body)


def write_lines(lines: DataFrame, path: str) -> None:
    """(place, line) as one text file in a folder, in order."""
    lines.repartition(1).sortWithinPartitions("place").select("line").write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str, columns: tuple[str, ...] = SET_COLUMNS, separator: str = ",") -> None:
    """The columns in a fixed order with a header; missing ones are empty."""
    have = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]
    rows.select(*have).write.mode("overwrite").option("header", "true").option("sep", separator).csv(path)


def library_tracks(tracks: DataFrame, mapping: dict[str, str], archive_only: bool = False) -> DataFrame:
    """Rows of a library file, attributes as columns with a leading underscore and cues as elements: one
    track for each id of file names, admitted ones only, paths as on the other machine. ``tracks``: id, path,
    artist, title, bpm, key_camelot, duration, rb_rating, status, quality_status, cues (name, time, pad)."""
    rows = tracks.where(library.admitted())
    if archive_only:
        rows = rows.where("status = 'archive'")
    keep = library.duplicates_by_id(rows).where("NOT keeper").select("id")
    rows = rows.join(keep, "id", "left_anti").withColumn("location", library.map_paths(rows, mapping)).where("location is not null")
    cues = F.transform(F.array_sort(F.transform("cues", lambda c: F.struct(c["time"].alias("t"), c["pad"].alias("p"), c["name"].alias("n")))), lambda c: F.struct(c["n"].alias("_Name"), F.lit("0").alias("_Type"), F.format_string("%.3f", c["t"]).alias("_Start"), c["p"].cast("string").alias("_Num")))
    grid = F.when(F.col("bpm").isNotNull(), F.struct(F.lit("0.000").alias("_Inizio"), F.format_string("%.2f", "bpm").alias("_Bpm"), F.lit("4/4").alias("_Metro"), F.lit("1").alias("_Battito")))
    return rows.select(
        F.col("id").alias("_TrackID"), F.col("title").alias("_Name"), F.col("artist").alias("_Artist"), F.when(F.col("bpm").isNotNull(), F.format_string("%.2f", "bpm")).alias("_AverageBpm"), F.col("key_camelot").alias("_Tonality"),
        (F.coalesce("rb_rating", F.lit(0)) * 51).alias("_Rating"), F.round("duration").cast("long").alias("_TotalTime"), library.file_location(F.col("location")).alias("_Location"), grid.alias("TEMPO"), cues.alias("POSITION_MARK"),
    )


def write_library_xml(rows: DataFrame, path: str) -> None:
    """The file as one XML document; Spark's commit replaces what was there only when all is written."""
    rows.coalesce(1).write.mode("overwrite").format("xml").option("rootTag", "COLLECTION").option("rowTag", "TRACK").save(path)


def playlists(tracks: DataFrame) -> DataFrame:
    """kind (week, bpm, key, style), name, id, sort: the playlists of a library file. Weeks are ISO weeks of
    created_at, the newest first; unknown tempo and key come last."""
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), F.col("created_at")).cast("string"), F.lit("-"), F.lpad(F.weekofyear("created_at").cast("string"), 2, "0"))
    bucket = F.when(F.col("bpm").isNotNull(), music.bpm_bucket(F.col("bpm"))).otherwise("unknown")
    key = F.coalesce(music.normal_key(F.col("key_camelot")), F.lit("unknown"))
    number = music.key_number(key, strict=False)
    of = lambda kind, name, sort: F.struct(F.lit(kind).alias("kind"), name.alias("name"), sort.cast("long").alias("sort"))
    year_week = F.extract(F.lit("YEAROFWEEK"), F.col("created_at")) * 100 + F.weekofyear("created_at")
    each = F.array(
        of("week", week, -year_week), of("bpm", bucket, F.coalesce(F.floor(F.col("bpm")), F.lit(10**6))),
        of("key", key, F.coalesce(number * 2 + (F.right(key, F.lit(1)) == "B").cast("int"), F.lit(999))), of("style", F.coalesce("genre", F.lit("unknown")), F.lit(0)),
    )
    return tracks.select("id", F.explode(each).alias("p")).select("p.kind", "p.name", "id", "p.sort").where("name is not null")


def library_lines(tracks: DataFrame, mapping: dict[str, str], archive_only: bool = False) -> DataFrame:
    """section, sort, name, place, line: the whole library file in order, tracks first, then the tree of
    playlists: a folder for each kind, in it its playlists by ``sort`` and name, in these the tracks by id.
    Only tracks that are in the file stand in playlists; counts are those of what follows."""
    rows = library_tracks(tracks, mapping, archive_only)
    live = tracks.join(rows.select(F.col("_TrackID").alias("id")), "id", "left_semi")
    spark, plain = tracks.sparkSession, lambda c: F.regexp_replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    line = lambda df, section, sort, name, place, text_: df.select(F.lit(section).alias("section"), sort.cast("long").alias("sort"), name.cast("string").alias("name"), place.cast("long").alias("place"), text_.alias("line"))
    zero, none, one = F.lit(0), F.lit(""), spark.range(1)
    attributes = F.concat(*[F.concat(F.lit(f' {c[1:]}="'), plain(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit('"')) for c in rows.columns if c.startswith("_")])
    mark = lambda m: F.concat(F.lit('<POSITION_MARK Name="'), plain(m["_Name"]), F.lit('" Type="0" Start="'), m["_Start"], F.lit('" Num="'), m["_Num"], F.lit('"/>'))
    grid = F.when(F.col("TEMPO").isNotNull(), F.concat(F.lit('<TEMPO Inizio="0.000" Bpm="'), F.col("TEMPO._Bpm"), F.lit('" Metro="4/4" Battito="1"/>'))).otherwise("")
    track = F.concat(F.lit("<TRACK"), attributes, F.lit(">"), grid, F.array_join(F.transform(F.coalesce("POSITION_MARK", F.expr("cast(array() as array<struct<_Name: string, _Type: string, _Start: string, _Num: string>>)")), mark), ""), F.lit("</TRACK>"))
    lists = playlists(live)
    sized = lists.groupBy("kind", "name").agg(F.min("sort").alias("sort"), F.count("*").alias("n"))
    kinds = sized.groupBy("kind").agg(F.count("*").alias("n"))
    place = F.col("kind")
    section = lambda df: df.withColumn("s", F.when(place == "week", 4).when(place == "bpm", 6).when(place == "key", 8).otherwise(10))
    at = lambda df, offset, sort, name, number, text_: section(df).select((F.col("s") + offset).alias("section"), sort.cast("long").alias("sort"), name.cast("string").alias("name"), number.cast("long").alias("place"), text_.alias("line"))
    entries = lists.join(sized.select("kind", F.col("name"), F.col("sort").alias("first_")), ["kind", "name"])
    parts = [
        line(one, 0, zero, none, zero, F.lit('<?xml version="1.0" encoding="UTF-8"?>')), line(one, 0, F.lit(1), none, zero, F.lit('<DJ_PLAYLISTS Version="1.0.0">')),
        line(rows.agg(F.count("*").alias("n")), 1, zero, none, zero, F.concat(F.lit('<COLLECTION Entries="'), F.col("n").cast("string"), F.lit('">'))),
        line(rows, 2, zero, none, F.col("_TrackID"), track), line(one, 3, zero, none, zero, F.lit("</COLLECTION><PLAYLISTS>")),
        line(kinds.agg(F.count("*").alias("n")), 3, F.lit(1), none, zero, F.concat(F.lit('<NODE Type="0" Name="ROOT" Count="'), F.col("n").cast("string"), F.lit('">'))),
        at(kinds, 0, F.lit(-(2**62)), none, F.lit(-1), F.concat(F.lit('<NODE Type="0" Name="'), place, F.lit('" Count="'), F.col("n").cast("string"), F.lit('">'))),
        at(sized, 0, F.col("sort"), F.col("name"), F.lit(-(2**62)), F.concat(F.lit('<NODE Type="1" KeyType="0" Name="'), plain(F.col("name")), F.lit('" Entries="'), F.col("n").cast("string"), F.lit('">'))),
        at(entries, 0, F.col("first_"), F.col("name"), F.col("id"), F.concat(F.lit('<TRACK Key="'), F.col("id").cast("string"), F.lit('"/>'))),
        at(sized, 0, F.col("sort"), F.col("name"), F.lit(2**62), F.lit("</NODE>")),
        at(kinds, 1, zero, none, zero, F.lit("</NODE>")), line(one, 12, zero, none, zero, F.lit("</NODE></PLAYLISTS></DJ_PLAYLISTS>")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_library(tracks: DataFrame, mapping: dict[str, str], path: str, archive_only: bool = False) -> None:
    """The library file with its tree of playlists as one document: lines are worked out and sorted in
    many tasks, and one streams them to the file, which a single document needs."""
    order = ["section", "sort", "name", "place"]
    library_lines(tracks, mapping, archive_only).repartition(1).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)


def pack(rows: DataFrame, group: str, order: list[str], line: Column, most_chars: int = 3900, most_lines: int = 10) -> DataFrame:
    """group, page, message: the lines of each group, in order, on pages of bounded length. Lines of one
    group, a digest of one run, go through one task."""
    own = rows.select(F.col(group).cast("string").alias("g"), F.row_number().over(Window.partitionBy(group).orderBy(*order)).alias("k"), line.alias("line"))

    def work(lines: pd.DataFrame) -> pd.DataFrame:
        pages: list[list[str]] = [[]]
        for text_ in lines.sort_values("k")["line"]:
            used = sum(len(x) + 1 for x in pages[-1])
            if pages[-1] and (len(pages[-1]) >= most_lines or used + len(text_) > most_chars):
                pages.append([])
            pages[-1].append(text_)
        return pd.DataFrame({"g": lines["g"].iloc[0], "page": range(1, len(pages) + 1), "message": ["\n".join(p) for p in pages]}, dtype=object)

    return own.groupBy("g").applyInPandas(work, "g string, page int, message string").withColumnRenamed("g", group)


def digest_lines(digest: DataFrame) -> Column:
    """One row of a digest as a line, with markup escaped."""
    name = F.concat_ws(" – ", "artist", "title")
    return F.concat(text.html_escape(name), F.lit(" · "), F.format_number("likes", 0), F.lit(" likes"))


def text_export(tracks: DataFrame, folder: Column) -> DataFrame:
    """folder, body: the tracks of each folder, one a line by artist and title, under a count."""
    line = F.concat_ws(" - ", "artist", "title")
    grouped = tracks.select(folder.alias("folder"), line.alias("line")).groupBy("folder").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    return grouped.select("folder", F.concat(F.col("folder"), F.lit(" ("), F.size("lines").cast("string"), F.lit(")\n"), F.array_join("lines", "\n")).alias("body"))
