"""Predicates and projections with the meaning that document stores give them: missing is null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_true(flag: Column) -> Column:
    """False, null or missing."""
    return ~F.coalesce(flag, F.lit(False))


def missing(value: Column) -> Column:
    return value.isNull()


def same_name(a: Column, b: Column | str) -> Column:
    """Equal but for case."""
    return F.lower(a) == F.lower(F.lit(b) if isinstance(b, str) else b)


def empty(array: Column) -> Column:
    return F.size(array) == 0


def placeholder(id_: Column, source: str | None = None) -> Column:
    """Whether an id is of the form '<source>:<id>'."""
    return F.startswith(id_, F.lit(f"{source}:")) if source else F.contains(id_, F.lit(":"))


def real_id(id_: Column) -> Column:
    """Not empty, and no placeholder."""
    return (F.coalesce(id_, F.lit("")) != "") & ~F.contains(id_, F.lit(":"))


def any_artist(artists: Column, name: Column | str) -> Column:
    return F.exists(artists, lambda a: a["name"] == (F.lit(name) if isinstance(name, str) else name))


def in_market(markets: Column, market: str) -> Column:
    return F.array_contains(markets, market)


def enough_followers(followers: Column, least: int = 10_000) -> Column:
    """Unknown (0) or enough."""
    return (followers == 0) | (followers >= least)


def quality_status(score: Column, threshold: float = 0.1) -> Column:
    return F.when(score >= threshold, "enriched").otherwise("filtered_out")


MB_STATUSES = ("audio_features_added", "base_collected", "enriched", "lyrics_added")


def mb_eligible(enriched: Column, status: Column, quality: Column, priority: Column, least: float = 0.3) -> Column:
    return not_true(enriched) & status.isin(*MB_STATUSES) & ((quality >= least) | (priority > 0))


def lockable(locked_at: Column, now: Column, seconds: int = 300) -> Column:
    """Never locked, or for longer than a lock lasts."""
    return locked_at.isNull() | (locked_at < now - F.make_interval(secs=F.lit(seconds)))


def threshold(value: float) -> float:
    """A confidence as a setting may have it, else ValueError."""
    if not 0 <= value <= 1:
        raise ValueError(f"a confidence lies between 0 and 1, not {value}")
    return value


def scan(df: DataFrame, where: Column | None = None, columns: Sequence[str] | None = None, order: Sequence[Column] = (), limit: int | None = None) -> DataFrame:
    """find(filter, projection).sort().limit()"""
    out = df if where is None else df.filter(where)
    out = out.orderBy(*order) if order else out
    out = out if limit is None else out.limit(limit)
    return out.select(*columns) if columns else out
