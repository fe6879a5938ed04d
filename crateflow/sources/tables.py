"""Tables that may be missing, and files found in folders."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

AUDIO = ("wav", "aiff", "aif", "flac", "mp3", "m4a")


def table_exists(spark: SparkSession, folder: str, name: str) -> bool:
    """Whether ``folder`` holds a Parquet table of that name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def read_table(spark: SparkSession, folder: str, name: str, schema: StructType | str | None = None) -> DataFrame:
    """The table, or an empty one of ``schema`` where it is missing. Columns of ``schema`` that an older
    table lacks are null; further ones stay."""
    wanted = spark.createDataFrame([], schema).schema if schema is not None else None
    if not table_exists(spark, folder, name):
        if wanted is None:
            raise AnalysisException(f"no table {name} in {folder}")
        return spark.createDataFrame([], wanted)
    found = spark.read.parquet(f"{folder}/{name}.parquet")
    for field in wanted or []:
        if field.name not in found.columns:
            found = found.withColumn(field.name, F.lit(None).cast(field.dataType))
    return found


def scan_files(spark: SparkSession, folder: str, endings: tuple[str, ...] = AUDIO, skipped: tuple[str, ...] = ("_", ".")) -> DataFrame:
    """path, relative, size, modified of files below ``folder`` with one of the endings, but for those in
    folders, or of names, that begin with a skipped mark; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    root = folder.rstrip("/")
    relative = F.regexp_replace(F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), r"^file:(?://)?", ""), r"^.*?" + "\\Q" + root + "\\E" + "/", "")
    named = files.select("path", relative.alias("relative"), "size", "modified")
    ending = F.lower(F.regexp_extract("relative", r"\.([^./]+)$", 1))
    hidden = F.exists(F.split("relative", "/"), lambda p: F.substring(p, 1, 1).isin(*skipped))
    return named.where(ending.isin(*endings) & ~hidden)


def ready_files(files: DataFrame, as_of, least_seconds: int = 60) -> DataFrame:
    """Files that have not changed for ``least_seconds``."""
    return files.where(F.timestamp_diff("SECOND", F.col("modified"), as_of) >= least_seconds)


def read_set(spark: SparkSession, path: str) -> DataFrame:
    """A set list from CSV with a header: pos, path, artist, title, bpm, camelot, duration_s; blanks get
    their defaults (bpm and duration null, texts empty), pos the line's number where missing."""
    raw = spark.read.option("header", "true").csv(path)
    have = lambda c: F.trim(F.col(c)) if c in raw.columns else F.lit(None).cast("string")
    number = lambda c, kind: F.nullif(have(c), F.lit("")).try_cast(kind)
    text = lambda c: F.coalesce(have(c), F.lit(""))
    return raw.select(F.coalesce(number("pos", "int"), F.lit(0)).alias("pos"), text("path").alias("path"), text("artist").alias("artist"), text("title").alias("title"), number("bpm", "double").alias("bpm"), text("camelot").alias("camelot"), number("duration_s", "double").alias("duration_s"))


def union_sources(*named: tuple[str, DataFrame]) -> DataFrame:
    """The rows of all sources with their name in ``source``; columns that one lacks are null there."""
    out = None
    for name, df in named:
        own = df.withColumn("source", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def ids_of(*sides: tuple[DataFrame, str]) -> DataFrame:
    """id: the different ids of several tables (table, column)."""
    out = None
    for df, column in sides:
        own = df.select(F.col(column).cast("long").alias("id")).where("id is not null")
        out = own if out is None else out.union(own)
    return out.distinct()
