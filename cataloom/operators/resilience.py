"""Breakers, buckets and streaks over event logs.

The breaker and the bucket are folds in order of time, so a service's events go through one
Python call, batch by batch: their state is a few numbers, whatever the number of events.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship


@dataclass
class Breaker:
    """closed -> open at ``threshold`` failures; open -> half_open after a time; there a success closes, a failure opens."""

    threshold: int = 5
    timeout: float = 120.0
    most: float = 3600.0
    state: str = "closed"
    failures: int = 0
    opened: float = 0.0
    wait: float = 120.0

    def step(self, event: str, at: float, retry_after: float | None = None) -> str:
        if self.state == "open" and at - self.opened >= self.wait:
            self.state = "half_open"
        if event == "fail":
            self.failures += 1
            if self.state != "open" and (self.failures >= self.threshold or self.state == "half_open"):
                self.state, self.opened = "open", at
                self.wait = self.timeout if retry_after is None else min(retry_after, self.most)
        elif event == "ok" and self.state == "half_open":
            self.state, self.failures = "closed", 0
        elif event == "ok" and self.state == "closed":
            self.failures = max(0, self.failures - 1)
        return self.state


@dataclass
class Bucket:
    """``rate`` tokens a second up to a capacity of at least 1; a request beyond waits for what is missing."""

    rate: float
    capacity: float
    tokens: float | None = None
    last: float | None = None

    def take(self, at: float, n: float = 1.0) -> float:
        """Seconds that a request at a time has to wait."""
        most = max(self.capacity, 1.0)
        at = at if self.last is None else max(at, self.last)
        self.tokens = most if self.tokens is None else min(most, self.tokens + (at - self.last) * self.rate)
        self.last = at
        if self.tokens >= n:
            self.tokens -= n
            return 0.0
        wait = (n - self.tokens) / self.rate
        self.tokens, self.last = 0.0, at + wait
        return wait


def breaker_fold(events: DataFrame, threshold: int = 5, timeout: float = 120.0) -> DataFrame:
    """Events (service, seq, at in seconds, event: fail, ok or check) with the state after each, and the failures counted."""
    ship(events.sparkSession)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        breaker, service = Breaker(threshold, timeout, wait=timeout), None
        for batch in batches:
            states, failures = [], []
            for own, at, event in zip(*(batch.column(c).to_pylist() for c in ("service", "at", "event"))):
                if own != service:
                    breaker, service = Breaker(threshold, timeout, wait=timeout), own
                states.append(breaker.step(event, at))
                failures.append(breaker.failures)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(states, pa.string()), pa.array(failures, pa.int32())], [*batch.schema.names, "state", "failures"])

    rows = events.select("service", F.col("seq").cast("bigint").alias("seq"), F.col("at").cast("double").alias("at"), "event")
    rows = rows.repartition("service").sortWithinPartitions("service", "seq")
    return rows.mapInArrow(fold, "service string, seq bigint, at double, event string, state string, failures int")


def bucket_fold(requests: DataFrame, rate: float, capacity: float) -> DataFrame:
    """Requests (service, seq, at in seconds) with the seconds each waits."""
    ship(requests.sparkSession)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, service = Bucket(rate, capacity), None
        for batch in batches:
            waits = []
            for own, at in zip(*(batch.column(c).to_pylist() for c in ("service", "at"))):
                if own != service:
                    bucket, service = Bucket(rate, capacity), own
                waits.append(bucket.take(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(waits, pa.float64())], [*batch.schema.names, "wait"])

    rows = requests.select("service", F.col("seq").cast("bigint").alias("seq"), F.col("at").cast("double").alias("at"))
    return rows.repartition("service").sortWithinPartitions("service", "seq").mapInArrow(fold, "service string, seq bigint, at double, wait double")


def streaks(events: DataFrame, key: str, order: list[str], bad: Column) -> DataFrame:
    """Events with streak: how many bad ones in a row end there."""
    by = Window.partitionBy(key).orderBy(*order)
    run = F.sum(F.when(bad, 0).otherwise(1)).over(by)
    out = events.withColumn("_run", run)
    inside = Window.partitionBy(key, "_run").orderBy(*order)
    return out.withColumn("streak", F.sum(F.when(bad, 1).otherwise(0)).over(inside)).drop("_run")


def back_off(events: DataFrame, key: str, order: list[str], bad: Column, most: int = 5, seconds: int = 300) -> DataFrame:
    """``streaks`` with pause: seconds to sleep where a streak reaches a multiple of ``most``, as it is counted anew then."""
    out = streaks(events, key, order, bad)
    return out.withColumn("pause", F.when((F.col("streak") > 0) & (F.col("streak") % most == 0), seconds).otherwise(0))


def latched(events: DataFrame, key: str, order: list[str], flag: Column) -> DataFrame:
    """Events with latched: whether the flag was ever up, till then."""
    by = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("latched", F.max(F.coalesce(flag, F.lit(False))).over(by))


def early_exit(events: DataFrame, key: str, order: list[str], bad: Column, most: int = 3) -> DataFrame:
    """Events up to the one at which ``most`` bad ones in a row are reached, inclusive."""
    out = latched(streaks(events, key, order, bad), key, order, F.col("streak") >= most)
    before = F.coalesce(F.lag("latched").over(Window.partitionBy(key).orderBy(*order)), F.lit(False))
    return out.withColumn("_out", before).filter(~F.col("_out")).drop("_out", "latched")
