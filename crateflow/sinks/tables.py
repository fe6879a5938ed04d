"""Tables that changes are merged into, batch by batch.

A stored table is Parquet, dealt to buckets by a hash of its key. A batch of changes reads and rewrites
the buckets it touches and no others, by Spark's dynamic partition overwrite. Every row of a bucket
carries the number of the batch that wrote it, so a batch that is played again, whole or after it was
stopped half-way, changes only the buckets it had not reached.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crateflow.operators import merges, rules

#: Buckets of a table, and the names of the columns that the files hold besides its own.
BUCKETS, BUCKET, BATCH = 64, "bucket_", "batch_"


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias(BUCKET)


def _stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    whole = StructType([*schema.fields]).add(BATCH, "long").add(BUCKET, "integer")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(path)


def read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The table; empty where nothing was merged yet."""
    own = spark.createDataFrame([], schema).schema
    return _stored(spark, path, own).select(*own.names)


def merge(changes: DataFrame, batch: int, path: str, schema: StructType | str, key: list[str], fold: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> None:
    """Put ``fold(current rows, changes)`` in place of the rows of the buckets that ``changes`` touch.

    Batches must come in ascending order, each once or again; a row's key must not change in ``fold``.
    The new rows are written beside the table first, as a table cannot be read and replaced in one job."""
    spark = changes.sparkSession
    own = spark.createDataFrame([], schema).schema
    table = _stored(spark, path, own)
    dealt = changes.select("*", _bucket(key, buckets))
    reached = table.where(F.col(BATCH) >= batch).select(BUCKET).distinct()
    touched = sorted(r[0] for r in dealt.select(BUCKET).distinct().join(reached, BUCKET, "left_anti").collect())  # at most ``buckets`` numbers
    if not touched:
        return
    current, new = table.where(F.col(BUCKET).isin(touched)).select(*own.names), dealt.where(F.col(BUCKET).isin(touched)).drop(BUCKET)
    rows = fold(current, new).select(*[F.col(f.name).cast(f.dataType) for f in own.fields], F.lit(batch).cast("long").alias(BATCH), _bucket(key, buckets))
    beside = f"{path.rstrip('/')}_next-{uuid.uuid4().hex}"
    rows.repartition(BUCKET).write.parquet(beside)
    spark.read.schema(rows.schema).parquet(beside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(beside)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def merging(path: str, schema: StructType | str, key: list[str], fold: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` of a stream of changes needs; a stream numbers its batches and plays the
    last one again after a failure."""
    return lambda changes, batch: merge(changes, batch, path, schema, key, fold, buckets)


def upserts(key: list[str], kept: tuple[str, ...] = (), latest: str | None = None) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Changes by ``merges.upsert``: given values overwrite, ``kept`` columns are only filled."""
    return lambda current, changes: merges.upsert(current, changes, key, kept, latest)


def sightings(key: list[str], first: str, last: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Rows seen again and again (key, ``first``, ``last``, others): the first time stays, the last one grows,
    and of the other columns a value that a later batch gives overwrites."""

    def fold(current: DataFrame, changes: DataFrame) -> DataFrame:
        others = [c for c in changes.columns if c in current.columns and c not in (*key, first, last)]
        values = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(last))).alias(c) for c in others]
        new = changes.groupBy(*key).agg(F.min(first).alias("first_"), F.max(last).alias("last_"), *values)
        times = current.select(*key, F.col(first).alias("old_first_"), F.col(last).alias("old_last_"))
        both = new.join(times, [new[c].eqNullSafe(times[c]) for c in key], "left")
        given = both.select(*[new[c] for c in key], F.least("first_", "old_first_").alias(first), F.greatest("last_", "old_last_").alias(last), *[new[c] for c in others])
        return merges.upsert(current, given, key)

    return fold


def uses(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Counters of exploration tags by ``merges.count_uses``; a batch counts once, however often it is played."""
    return merges.count_uses(current, changes)


def save_smartlist(spark: SparkSession, path: str, profile: str, name: str, given: dict, at: str, batch: int) -> None:
    """Keep a checked rule set under its name in a profile; one of that name is replaced."""
    if not name.strip():
        raise ValueError("a smartlist needs a name")
    text = rules.parse(given).to_json()
    merge(spark.createDataFrame([(profile, name, text, at)], SMARTLISTS), batch, path, SMARTLISTS, ["profile_id", "name"], upserts(["profile_id", "name"]), buckets=8)


SMARTLISTS = "profile_id string, name string, rules string, updated_at string"


def smartlists(spark: SparkSession, path: str, profile: str) -> DataFrame:
    """name, rules of a profile by name, whatever its case."""
    return read(spark, path, SMARTLISTS).where(F.col("profile_id") == profile).orderBy(F.lower("name"), "name").select("name", "rules")

