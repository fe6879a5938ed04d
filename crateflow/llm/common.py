"""Shared helpers of the corpus operators: inputs, shared storage, batch slicing."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to numpy in slices of about this many characters, which bounds a worker's memory.
SLICE_CHARS = 300_000
#: Least partitions of a step over few rows, and rows that are worth another one.
LEAST_PARTS, ROWS_A_PART = 12, 4000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir. Where it is unset, a temporary folder
    serves a local master; a cluster without it is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "crateflow")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def parts_for(rows: int) -> int:
    """Partitions that so many rows are worth. As a bound for ``coalesce`` it only ever lowers the
    number that the session sets, where most of those partitions would be nearly empty."""
    return max(LEAST_PARTS, rows // ROWS_A_PART)


def stored(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder, in at most ``parts`` partitions, and read it
    back: cuts the lineage durably, so a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/crateflow-{name}-{uuid.uuid4().hex}"
    (df.coalesce(parts) if parts else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def remove(*frames: DataFrame) -> None:
    """Delete what ``stored`` wrote for ``frames``, once nothing will read them any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and text columns, so that clashing extra columns never reach a worker."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_CHARS) -> Iterator[tuple[list, list[str | None]]]:
    """(ids, texts) lists of a worker's Arrow batches, each of about ``limit`` characters at most."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for i, t in zip(batch.column(0), batch.column(1), strict=True):
            t = t.as_py()
            if ids and size + len(t or "") > limit:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i.as_py())
            texts.append(t)
            size += len(t or "")
        if ids:
            yield ids, texts


def by_parts(texts: pa.Array, rows: int, limit: int = SLICE_CHARS) -> Iterator[list[str | None]]:
    """The texts of an Arrow column in lists of at most ``rows``, each of about ``limit`` characters at most."""
    part, held = [], 0
    for t in texts:
        t = t.as_py()
        if part and (len(part) == rows or held + len(t or "") > limit):
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t or "")
    if part:
        yield part
