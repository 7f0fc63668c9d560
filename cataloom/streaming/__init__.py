"""Structured Streaming forms of the polling workers."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.resilience import Breaker
from ..operators.upsert import Fold, upsert_fold
from ..session import ship


def deduplicated(stream: DataFrame, keys: Sequence[str], at: str | None = None, delay: str | None = None) -> DataFrame:
    """The first row of each key: for good, or with ``delay`` within that of event time, so that state is bounded."""
    if at and delay:
        return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))
    return stream.dropDuplicates(list(keys))


def counted(stream: DataFrame, at: str, width: str, keys: Sequence[str], delay: str) -> DataFrame:
    """(start, keys, n) of event-time windows; rows later than ``delay`` are left out."""
    window = F.window(at, width)
    return stream.withWatermark(at, delay).groupBy(window, *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


class Snapshots:
    """A folded table in versions, one a batch: ``path/<batch>``. A batch that is run again writes the same version, so a restart loses and doubles nothing."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Complete versions, in order."""
        if not self._fs.exists(self._root):
            return []
        found = [s.getPath() for s in self._fs.listStatus(self._root)]
        whole = [p for p in found if p.getName().isdigit() and self._fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()) for p in whole)

    def before(self, batch: int) -> DataFrame | None:
        known = [v for v in self.versions() if v < batch]
        return self.spark.read.parquet(f"{self.path}/{known[-1]}") if known else None

    def latest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.versions()[-1]}")

    def keep(self, batch: int, df: DataFrame, versions: int = 2) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{batch}")
        for old in self.versions()[:-versions]:
            self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{old}"), True)


def upserting(stream: DataFrame, table: Snapshots, key: Callable[[], Column], seq: Sequence[str], fold: Fold, checkpoint: str, trigger: dict[str, Any] | None = None) -> StreamingQuery:
    """Folds each batch of a stream into a table."""

    def each(batch: DataFrame, number: int) -> None:
        table.keep(number, upsert_fold(batch, key(), seq, fold, table.before(number)))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def due(stream: DataFrame, next_run: str, at: Callable[[], Column]) -> DataFrame:
    """Items of a stream whose time has come."""
    return stream.filter(F.col(next_run) <= at())


def breakers(stream: DataFrame, threshold: int = 5, timeout: float = 120.0) -> DataFrame:
    """(service, state, failures) after each batch of events (service, seq, at in seconds, event); a breaker's state is kept by service."""
    ship(stream.sparkSession)

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        breaker = Breaker(threshold, timeout, wait=timeout)
        if state.exists:
            breaker.state, breaker.failures, breaker.opened, breaker.wait = state.get
        rows = pd.concat(list(batches)).sort_values("seq")
        for event, at in zip(rows["event"], rows["at"]):
            breaker.step(event, at)
        state.update((breaker.state, int(breaker.failures), float(breaker.opened), float(breaker.wait)))
        yield pd.DataFrame({"service": [key[0]], "state": [breaker.state], "failures": [breaker.failures]})

    rows = stream.select("service", "seq", "at", "event").groupBy("service")
    return rows.applyInPandasWithState(step, "service string, state string, failures int", "state string, failures int, opened double, wait double", "update", "NoTimeout")


class StatsListener(StreamingQueryListener):
    """A JSON line of rows and seconds for every batch, at most one in ``every`` seconds a query."""

    def __init__(self, every: float = 600.0, log: logging.Logger | None = None) -> None:
        self.every, self.log, self.last, self.rows = every, log or logging.getLogger("cataloom"), {}, {}

    def onQueryStarted(self, event: Any) -> None:
        self.log.info(json.dumps({"event": "started", "query": event.name or str(event.id)}))

    def onQueryProgress(self, event: Any) -> None:
        import time

        p = event.progress
        name = p.name or str(p.id)
        self.rows[name] = self.rows.get(name, 0) + p.numInputRows
        if time.monotonic() - self.last.get(name, -1e9) >= self.every:
            self.last[name] = time.monotonic()
            self.log.info(json.dumps({"event": "progress", "query": name, "batch": p.batchId, "rows": self.rows[name]}))

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        self.log.info(json.dumps({"event": "stopped", "query": str(event.id), "error": event.exception}))


def stop_all(spark: SparkSession, seconds: int = 60) -> None:
    """Ends all queries, each after the batch it is in."""
    for q in spark.streams.active:
        q.stop()
        q.awaitTermination(seconds)
