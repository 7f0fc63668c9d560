"""Work queues as tables: what would be claimed at a time, and what becomes of an item."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import lockable, not_true

LOCK_SECONDS = 300
RETRIES = 3


def claimed(items: DataFrame, now: Column, worker: str = "worker") -> DataFrame:
    """Items as a claim leaves them."""
    out = items.withColumns({"locked_at": now, "locked_by": F.lit(worker)})
    return out.withColumn("status", F.lit("processing")) if "status" in out.columns else out


def claim_pending(items: DataFrame, now: Column, n: int, order: Sequence[Column], lock: int = LOCK_SECONDS) -> DataFrame:
    """Up to ``n`` items that are pending, or were left in processing for longer than a lock lasts."""
    stale = (F.col("status") == "processing") & (F.col("locked_at") < now - F.make_interval(secs=F.lit(lock)))
    return items.filter((F.col("status") == "pending") | stale).orderBy(*order).limit(n)


def claim_unprocessed(items: DataFrame, now: Column, n: int, order: Sequence[Column], lock: int = LOCK_SECONDS) -> DataFrame:
    """Up to ``n`` items that aren't processed and can be locked; by priority where ``order`` begins with it."""
    return items.filter(not_true(F.col("processed")) & lockable(F.col("locked_at"), now, lock)).orderBy(*order).limit(n)


def claim_due(items: DataFrame, now: Column, n: int, lock: int = LOCK_SECONDS) -> DataFrame:
    """The most overdue items whose time has come."""
    return items.filter((F.col("next_run_at") <= now) & lockable(F.col("locked_at"), now, lock)).orderBy("next_run_at", "item_id").limit(n)


def claim_by_region(items: DataFrame, regions: Sequence[str], n: int) -> DataFrame:
    """Pending items of the first region, in order, that has any."""
    rank = F.array_position(F.array(*map(F.lit, regions)), F.col("region"))
    open_ = items.filter("status = 'pending'").withColumn("_rank", F.when(rank == 0, len(regions) + 1).otherwise(rank))
    first = open_.agg(F.min("_rank").alias("_first"))
    return open_.join(F.broadcast(first), F.col("_rank") == F.col("_first")).drop("_rank", "_first").orderBy("item_id").limit(n)


def claim_sorted(items: DataFrame, where: Column, order: Sequence[Column], n: int) -> DataFrame:
    return items.filter(where).orderBy(*order).limit(n)


def retry_or_fail(items: DataFrame, limit: int = RETRIES, back: str = "pending") -> DataFrame:
    """Failed items: one more retry, given up at the limit, unlocked."""
    n = F.coalesce("retry_count", F.lit(0)) + 1
    return items.withColumns({"retry_count": n, "status": F.when(n >= limit, "failed").otherwise(back), "locked_at": F.lit(None).cast("timestamp")})


def release(items: DataFrame, back: str = "pending") -> DataFrame:
    """Unlocked, without a retry counted: the source, not the item, was at fault."""
    return items.withColumns({"status": F.lit(back), "locked_at": F.lit(None).cast("timestamp")})


def advance(items: DataFrame, got: str = "got", page_size: int = 50, most: str = "max_pages") -> DataFrame:
    """The cursor after a page of ``got`` rows: done where it was empty or short, or the last page."""
    done = (F.col(got) == 0) | (F.col(got) < page_size) | (F.col("page") >= F.col(most))
    return items.withColumns({"page": F.when(done, F.col("page")).otherwise(F.col("page") + 1), "status": F.when(done, "done").otherwise("pending")})


def cycle_reset(items: DataFrame) -> DataFrame:
    """Where nothing is pending, what is done begins again from page 1."""
    left = items.agg((F.count_if(F.col("status") == "pending") == 0).alias("_over"))
    again = F.col("_over") & (F.col("status") == "done")
    out = items.crossJoin(F.broadcast(left))
    return out.withColumns({"page": F.when(again, 1).otherwise(F.col("page")), "status": F.when(again, "pending").otherwise(F.col("status"))}).drop("_over")


def reschedule(items: DataFrame, now: Column, hours: int, failed: Column) -> DataFrame:
    """After a run: due again in ``hours`` and one more run, or after a failure only unlocked."""
    return items.withColumns(
        {
            "next_run_at": F.when(failed, F.col("next_run_at")).otherwise(now + F.make_interval(hours=F.lit(hours))),
            "runs": F.col("runs") + F.when(failed, 0).otherwise(1),
            "locked_at": F.lit(None).cast("timestamp"),
        }
    )


def mark_visited(visited: DataFrame, done: DataFrame, key: str, now: Column) -> DataFrame:
    """The cache with what was done; what it has keeps its time."""
    return visited.select(key, "processed_at").unionByName(done.select(key, now.alias("processed_at"))).groupBy(key).agg(F.min("processed_at").alias("processed_at"))


#: Status -> next, of each stage; items move on whether the stage found anything or not.
STAGES = {"audio": ("base_collected", "audio_features_added"), "lyrics": ("audio_features_added", "lyrics_added")}


def transition(status: Column, stage: str, score: Column | None = None, threshold: float = 0.1) -> Column:
    if stage == "quality":
        return F.when(status.isin("lyrics_added", "audio_features_added"), F.when(score >= threshold, "enriched").otherwise("filtered_out")).otherwise(status)
    before, after = STAGES[stage]
    return F.when(status == before, after).otherwise(status)


def with_error(log: Column, message: Column, most: int = 200) -> Column:
    """An error log with one more entry, cut to ``most`` characters."""
    return F.concat(F.coalesce(log, F.array().cast("array<string>")), F.array(F.substring(message, 1, most)))
