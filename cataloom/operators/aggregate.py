"""Aggregations."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_artists(tracks: DataFrame, limit: int = 500, placeholders: bool = True) -> DataFrame:
    """(artist_id, name, track_count, popularity, followers): artists of the most tracks; of a name's spellings that of the least track id; ties by id.

    Without ``placeholders``, ids with a colon take no place among the ``limit``.
    """
    rows = tracks.select("spotify_id", "popularity", "artist_followers", F.posexplode("artists").alias("pos", "a")).filter("a.spotify_id is not null")
    own = (rows if placeholders else rows.filter(~F.contains("a.spotify_id", F.lit(":")))).groupBy(F.col("a.spotify_id").alias("artist_id"))
    out = own.agg(F.min_by("a.name", F.struct("spotify_id", "pos")).alias("name"), F.count(F.lit(1)).alias("track_count"), F.max("popularity").alias("popularity"), F.max("artist_followers").alias("followers"))
    return out.orderBy(F.desc("track_count"), "artist_id").limit(limit)


def regional_top_artists(tracks: DataFrame, regions: Iterable[str] = ("cis", "central_asia", "mena"), limit: int = 5000, floor: float = 0.3) -> DataFrame:
    """``top_artists`` of tracks in any of the regions, without placeholder ids, with a priority of at least ``floor``."""
    from ..functions.scoring import artist_priority

    hit = F.lit(False)
    for r in regions:
        hit = hit | F.coalesce(F.col(f"regions.{r}"), F.lit(False))
    out = top_artists(tracks.filter(hit), limit, placeholders=False)
    return out.withColumn("priority", F.greatest(artist_priority(F.col("popularity"), F.col("followers")), F.lit(floor)))


def distinct_artist_names(tracks: DataFrame, limit: int = 200_000) -> DataFrame:
    """(name): distinct trimmed lower-case names of two characters or more."""
    names = tracks.select(F.explode("artists.name").alias("n")).filter("n <> ''").select(F.trim(F.lower("n")).alias("name"))
    return names.filter(F.length("name") >= 2).distinct().orderBy("name").limit(limit)


def status_counts(rows: DataFrame, column: str = "status") -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def depths(tables: dict[str, tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """(queue, what, n): filtered counts over several tables, one pass over each."""
    out = None
    for name, (df, conditions) in tables.items():
        row = df.agg(*(F.count_if(c).alias(w) for w, c in conditions.items()))
        own = row.select(F.lit(name).alias("queue"), F.explode(F.create_map(*(x for w in conditions for x in (F.lit(w), F.col(w))))).alias("what", "n"))
        out = own if out is None else out.unionAll(own)
    return out


def bounded_count(rows: DataFrame, key: str, most: int) -> DataFrame:
    """(key, n): counts of at most ``most``."""
    return rows.groupBy(key).agg(F.least(F.count(F.lit(1)), F.lit(most)).cast("bigint").alias("n"))


def found_and_missing(rows: DataFrame, column: str) -> DataFrame:
    """(found, unavailable)"""
    return rows.agg(F.count(column).alias("found"), (F.count(F.lit(1)) - F.count(column)).alias("unavailable"))


def by_priority(codes: Column, sets: Iterable[Iterable[str]]) -> Column:
    """The first code that is in the first set, else in the second, and so on, else the first code."""
    pick = lambda own: F.get(F.filter(codes, lambda c: c.isin(*own)), F.lit(0))
    return F.coalesce(*map(pick, sets), F.get(codes, F.lit(0)))


def counters(events: DataFrame, name: str, at: str) -> DataFrame:
    """(counter, n, started_at, updated_at): increments by name."""
    return events.groupBy(F.col(name).alias("counter")).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("started_at"), F.max(at).alias("updated_at"))
