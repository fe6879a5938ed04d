"""Streams with a state for each key: alarms, availability and retries as rows come in.

Each gives what its batch twin gives over the same rows, however they are split into batches, as long as
the rows of one key come in the order of their ids or times. State is kept by Spark's state store (RocksDB)
and found again from the checkpoint after a restart.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window


def prepare(spark: SparkSession) -> None:
    """Choose the state store that keyed state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _rows(parts: Iterator[pd.DataFrame], order: list[str]) -> list[dict]:
    """The rows of one key and batch in order."""
    own = [p for p in parts if len(p)]
    if not own:
        return []
    rows = pd.concat(own).sort_values(order, kind="stable").astype(object)
    return rows.where(rows.notna(), None).to_dict("records")


class _Alarms(StatefulProcessor):
    def __init__(self, threshold: int):
        self.threshold = max(threshold, 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.streak = handle.getValueState("streak", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, out = (self.streak.get()[0] if self.streak.exists() else 0), []
        for r in _rows(rows, ["id"]):
            bad = not r["ok"] or r["found"] == 0
            if bad:
                n += 1
                if n == self.threshold:
                    out.append((r["id"], key[0], "alarm"))
            else:
                if n >= self.threshold:
                    out.append((r["id"], key[0], "recovery"))
                n = 0
        self.streak.update((n,))
        yield pd.DataFrame(out, columns=["id", "mode", "message"])

    def close(self) -> None:
        pass


def alarms(runs: DataFrame, threshold: int = 3) -> DataFrame:
    """id, mode, message of a stream of runs (id, mode, ok, found); the twin of ``trends.alarms``."""
    prepare(runs.sparkSession)
    own = runs.select("id", "mode", "ok", "found")
    kinds = dict(own.dtypes)
    return own.groupBy("mode").transformWithStateInPandas(_Alarms(threshold), f"id {kinds['id']}, mode {kinds['mode']}, message string", "Append", "None")


class _Availability(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kind = handle.getValueState("kind", "kind string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, out = (self.kind.get()[0] if self.kind.exists() else None), []
        for r in _rows(rows, ["at"]):
            kind = r["kind"]
            if known == "none" and kind not in (None, "none"):
                out.append((key[0], r["at"], kind))
            known = kind or known or "none"  # what is gone keeps its kind
        self.kind.update((known,))
        yield pd.DataFrame(out, columns=["sc_id", "at", "kind"])

    def close(self) -> None:
        pass


def availability(checks: DataFrame) -> DataFrame:
    """sc_id, at, kind where a stream of checks (sc_id, at, kind; null: gone) first finds a way to get a track that
    had none. A first check only records."""
    prepare(checks.sparkSession)
    own = checks.select("sc_id", "at", "kind").where("sc_id is not null")
    kinds = dict(own.dtypes)
    return own.groupBy("sc_id").transformWithStateInPandas(_Availability(), f"sc_id {kinds['sc_id']}, at {kinds['at']}, kind string", "Append", "None")


def availability_of(checks: DataFrame) -> DataFrame:
    """The batch twin of ``availability``."""
    by = Window.partitionBy("sc_id").orderBy("at")
    known = F.last("kind", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    before = F.when(F.row_number().over(by) > 1, F.coalesce(known, F.lit("none")))
    return checks.where("sc_id is not null").select("sc_id", "at", "kind", before.alias("before")).where((F.col("before") == "none") & (F.col("kind") != "none")).select("sc_id", "at", "kind")


class _Retries(StatefulProcessor):
    def __init__(self, most: int, wait: dt.timedelta):
        self.most, self.wait = most, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "attempts long, error string, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        attempts, error, due = self.open.get() if self.open.exists() else (0, None, None)
        out = []
        for r in _rows(rows, ["at"]):
            now = int(pd.Timestamp(r["at"]).timestamp() * 1000)
            if due is not None and now >= due:  # an event behind the time it was due at, in one batch with it
                out.append((key[0], due, "due", attempts, error))
                self.handle.deleteTimer(due)
                due = None
            if due is not None:
                self.handle.deleteTimer(due)
                due = None
            if r["ok"]:
                if attempts:
                    out.append((key[0], now, "done", attempts, error))
                attempts, error = 0, None
                continue
            attempts, error = attempts + 1, (r["error"] or "")[:300]
            out.append((key[0], now, "failed" if attempts >= self.most else "pending", attempts, error))
            if attempts < self.most:
                due = now + int(self.wait.total_seconds() * 1000)
                self.handle.registerTimer(due)
        if attempts:
            self.open.update((attempts, error, due))
        else:
            self.open.clear()
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.open.exists():
            return
        attempts, error, due = self.open.get()
        if due is not None and due == expiredTimerInfo.getExpiryTimeInMs():
            self.open.update((attempts, error, None))
            yield self._frame([(key[0], due, "due", attempts, error)])

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["sc_id", "at_ms", "status", "attempts", "last_error"])

    def close(self) -> None:
        pass


def retries(log: DataFrame, most: int = 5, wait: dt.timedelta = dt.timedelta(minutes=30), late: str = "1 minute") -> DataFrame:
    """sc_id, at_ms, status, attempts, last_error of a stream of tries (sc_id, at, ok, error): pending or failed (from
    ``most`` on) after a failure, done after a success, due once ``wait`` has gone by without another try."""
    prepare(log.sparkSession)
    own = log.select("sc_id", F.col("at").cast("timestamp").alias("at"), "ok", "error").where("sc_id is not null").withWatermark("at", late)
    return own.groupBy("sc_id").transformWithStateInPandas(_Retries(most, wait), f"sc_id {dict(own.dtypes)['sc_id']}, at_ms long, status string, attempts long, last_error string", "Append", "EventTime")


def retries_of(log: DataFrame, most: int = 5, wait: dt.timedelta = dt.timedelta(minutes=30)) -> DataFrame:
    """The batch twin of ``retries``, with every due time that the log's newest time has passed."""
    ms = lambda c: F.unix_millis(c)
    by = Window.partitionBy("sc_id").orderBy("at")
    rows = log.where("sc_id is not null").select("sc_id", F.col("at").cast("timestamp").alias("at"), "ok", F.substring(F.coalesce("error", F.lit("")), 1, 300).alias("error"))
    marked = rows.withColumn("spell", F.coalesce(F.sum(F.col("ok").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("next", F.lead("at").over(by))
    spell = Window.partitionBy("sc_id", "spell").orderBy("at")
    counted = marked.withColumn("attempts", F.sum((~F.col("ok")).cast("long")).over(spell)).withColumn("last_error", F.last(F.when(~F.col("ok"), F.col("error")), ignorenulls=True).over(spell))
    state = F.when(F.col("ok"), F.when(F.col("attempts") > 0, "done")).when(F.col("attempts") >= most, "failed").otherwise("pending")
    columns = lambda at, status: ["sc_id", at.alias("at_ms"), status.alias("status"), "attempts", "last_error"]
    step = int(wait.total_seconds() * 1000)
    newest = log.agg(F.max(F.col("at").cast("timestamp")).alias("newest"))
    due = counted.where(~F.col("ok") & (F.col("attempts") < most)).join(F.broadcast(newest), ms(F.col("at")) + step <= ms(F.coalesce("next", "newest")))
    return counted.withColumn("state", state).where("state is not null").select(*columns(ms(F.col("at")), F.col("state"))).union(due.select(*columns(ms(F.col("at")) + step, F.lit("due"))))
