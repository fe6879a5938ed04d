"""Sources that fail alone: recorded pages of many sources, read through Spark's file systems.

A page is a JSON file ``{"collection": [...], "next_href": ...}`` or ``{"error": {"class": ..., "message": ...}}``; a
next page lies beside the one that names it. A source is its chain of pages from a first one. It gives its
items, or, where a page is missing, broken or an error, one row that says so and no item. Errors of an
aborting class (no access, too many requests) end the collection: sources behind the first are not asked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Error classes that end a collection; pages and items of a source.
ABORTING, MOST_PAGES, LIMIT = ("client_id", "rate_limit"), 4, 200
_PAGE = "collection array<string>, next_href string, error struct<class: string, message: string>, broken string"


def _page(body: Column) -> Column:
    return F.from_json(body, _PAGE, {"columnNameOfCorruptRecord": "broken"})


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """path (below ``folder``), body of all pages, by any path that Spark can read."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    return files.select(_below(F.col("_metadata.file_path"), folder).alias("path"), F.col("value").alias("body"))


def _below(path: Column, folder: str) -> Column:
    name = folder.rstrip("/").rpartition("/")[2]
    return F.url_decode(F.replace(F.substring_index(path, f"/{name}/", -1), F.lit("+"), F.lit("%2B")))


def collect(pages: DataFrame, starts: DataFrame, most_pages: int = MOST_PAGES, limit: int = LIMIT, aborting: tuple[str, ...] = ABORTING) -> tuple[DataFrame, DataFrame]:
    """(items: place, source, pos, item; outcomes: place, source, status, error, items) of ``starts`` (place, source,
    path). Status is ok, failed or not asked; at most ``limit`` items of the first ``most_pages`` pages count."""
    held = pages.select(F.col("path").alias("at_"), "body")
    asked, chain = starts.select("place", "source", "path", F.lit(0).alias("hop"), F.array("path").alias("read")), []
    for hop in range(most_pages):
        p = asked.join(held, F.col("path") == F.col("at_"), "left").select("place", "source", "path", "hop", "read", F.col("body").isNull().alias("missing"), _page(F.col("body")).alias("p"))
        chain.append(p.drop("read"))
        beside = F.concat(F.regexp_extract("path", r"^(.*/)?[^/]*$", 1), F.col("p.next_href"))
        fresh = F.col("p.next_href").isNotNull() & ~F.array_contains("read", beside)  # a chain that comes back ends
        asked = p.where(fresh).select("place", "source", beside.alias("path"), F.lit(hop + 1).alias("hop"), F.array_append("read", beside).alias("read"))
    every = reduce(DataFrame.unionByName, chain)
    kind = F.when(F.col("missing"), "missing page").when(F.col("p.broken").isNotNull(), "broken page").when(F.col("p.error").isNotNull(), F.coalesce("p.error.class", F.lit("error"))).when(F.col("p.collection").isNull() & (F.col("hop") == 0), "no collection")
    said = F.concat(kind, F.lit(": "), F.coalesce("p.error.message", F.col("path")))
    rows = every.withColumn("kind", kind).withColumn("error", F.substring(said, 1, 200))
    first = rows.groupBy("place", "source").agg(F.min_by(F.struct("kind", "error"), F.when(F.col("kind").isNotNull(), F.col("hop"))).alias("e"), F.sum(F.greatest(F.coalesce(F.size("p.collection"), F.lit(0)), F.lit(0))).alias("n"))
    ended = first.agg(F.min(F.when(F.col("e.kind").isin(*aborting), F.col("place"))).alias("ended_"))
    status = F.when(F.col("place") > F.col("ended_"), "not asked").when(F.col("e.kind").isNotNull(), "failed").otherwise("ok")
    found = first.join(F.broadcast(ended)).withColumn("status", status)  # one row beside it
    outcomes = found.select("place", "source", "status", F.when(F.col("status") == "failed", F.col("e.error")).alias("error"), F.when(F.col("status") == "ok", F.least("n", F.lit(limit))).otherwise(0).cast("long").alias("items"))
    good = rows.join(found.where("status = 'ok'").select("place"), "place", "left_semi")
    parts = good.select("place", "source", "hop", F.posexplode("p.collection").alias("i", "item"))
    # A source's items are those of its few pages.
    numbered = parts.withColumn("pos", F.row_number().over(Window.partitionBy("place").orderBy("hop", "i")) - 1)
    return numbered.where(F.col("pos") < limit).select("place", "source", "pos", "item"), outcomes


def stream_pages(spark: SparkSession, folder: str) -> DataFrame:
    """path, pos, item, error of pages as they arrive: a row for each item, or one with an error for a page that is
    broken or an error itself. What was read is kept in the stream's checkpoint."""
    files = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(folder)
    p = files.select(_below(F.col("_metadata.file_path"), folder).alias("path"), _page(F.col("value")).alias("p"))
    error = F.when(F.col("p.broken").isNotNull(), "broken page").when(F.col("p.error").isNotNull(), F.coalesce("p.error.class", F.lit("error")))
    items = F.when(error.isNull(), F.col("p.collection"))
    return p.select("path", error.alias("error"), F.posexplode_outer(items).alias("pos", "item")).where("error is not null or item is not null").select("path", "pos", "item", "error")
