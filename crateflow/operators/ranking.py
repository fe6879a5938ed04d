"""Ranks over whole tables without a task that holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import storage

#: Ranges that values are dealt to.
RANGES = 64


def _range_of(value: Column, cuts: list) -> Column:
    """How many cuts lie below a value."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value)) if cuts else F.lit(0)


def dealt(df: DataFrame, order: str, ranges: int = RANGES) -> DataFrame:
    """``df`` with ``range_``: the range of ``order`` that a row falls in, equal values in one, nulls in the first."""
    edges = sorted(set(df.agg(F.percentile_approx(order, [k / ranges for k in range(1, ranges)], 100 * ranges)).first()[0] or []))
    return df.withColumn("range_", _range_of(F.col(order), edges))


def percent_ranks(df: DataFrame, columns: list[str], ranges: int = RANGES) -> DataFrame:
    """``df`` with, for each of ``columns``, ``<column>_rank``: the share in per cent of all rows whose
    value is at most the row's. Null values have no rank and do not count. Columns of one call are
    compared as their common type.

    All columns are stacked and counted by value in one pass, so equal values meet in one row; the
    counts are dealt to ranges of values, summed inside each and raised by what lower ranges hold. The
    ranks, one row a distinct value, are stored; each column is looked up there. A value that most
    rows share is a hot key of that look-up only: the many rows are its side that may be split."""
    if not columns:
        return df
    cuts = df.agg(*[F.percentile_approx(c, [k / ranges for k in range(1, ranges)], 100 * ranges).alias(f"cuts_{k}") for k, c in enumerate(columns)]).first()
    placed = F.lit(0)
    for k in range(len(columns)):
        placed = F.when(F.col("column_") == k, _range_of(F.col("value_"), sorted(set(cuts[k] or [])))).otherwise(placed)
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("column_"), F.col(c).alias("value_")) for k, c in enumerate(columns)])).alias("cell_")).select("cell_.*")
    counts = stacked.where("value_ is not null").groupBy("column_", "value_").agg(F.count("*").alias("rows_")).withColumn("range_", placed)
    inside = counts.withColumn("upto_", F.sum("rows_").over(Window.partitionBy("column_", "range_").orderBy("value_")))
    # At most ``ranges`` rows a column.
    last = inside.groupBy("column_", "range_").agg(F.max("upto_").alias("all_"))
    of_column = Window.partitionBy("column_")
    sums = last.select("column_", "range_", (F.sum("all_").over(of_column.orderBy("range_")) - F.col("all_")).alias("before_"), F.sum("all_").over(of_column).alias("total_"))
    rank = 100.0 * (F.col("upto_") + F.col("before_")) / F.col("total_")
    ranked = storage.stored(inside.join(F.broadcast(sums), ["column_", "range_"]).select("column_", "value_", rank.alias("rank_")), "ranks")
    for k, c in enumerate(columns):
        own = ranked.where(F.col("column_") == k).select(F.col("value_").alias(f"value_{k}_"), F.col("rank_").alias(f"{c}_rank"))
        df = df.join(own, F.col(c) == F.col(f"value_{k}_"), "left").drop(f"value_{k}_")
    return df


def running_sum(df: DataFrame, value: str, order: str, out: str, descending: bool = False, ranges: int = RANGES) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows that come before in ``order``, dealt to
    ranges as in ``percent_ranks``. Rows without an order come first (last, if descending); of equal ones
    any comes first."""
    placed = dealt(df, order, ranges)
    by = F.col("range_").desc() if descending else F.col("range_").asc()
    sums = placed.groupBy("range_").agg(F.sum(value).alias("all_")).select("range_", (F.sum("all_").over(Window.orderBy(by)) - F.col("all_")).alias("before_"))
    inside = Window.partitionBy("range_").orderBy(F.col(order).desc() if descending else F.col(order).asc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumn("own_", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(F.broadcast(sums), "range_").withColumn(out, F.col("own_") + F.col("before_")).drop("range_", "own_", "before_")
