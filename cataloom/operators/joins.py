"""Joins that stand for lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def left_lookup(rows: DataFrame, table: DataFrame, on: Column, column: str, default: Column) -> DataFrame:
    """``rows`` with one more column of ``table``, which has one row a key."""
    return rows.join(table, on, "left").select(*(rows[c] for c in rows.columns), F.coalesce(table[column], default).alias(column))


def anti_known(candidates: DataFrame, tracks: DataFrame) -> DataFrame:
    """Candidates that no track has by ISRC nor by fingerprint: two anti-joins, as one with OR would compare all pairs."""
    by_isrc = tracks.filter("isrc is not null").select(F.col("isrc").alias("_isrc")).distinct()
    by_print = tracks.select(F.col("fingerprint").alias("_fp")).distinct()
    out = candidates.join(by_isrc, F.col("isrc") == F.col("_isrc"), "left_anti") if "isrc" in candidates.columns else candidates
    return out.join(by_print, F.col("candidate_fingerprint") == F.col("_fp"), "left_anti")


def anti_visited(frontier: DataFrame, visited: DataFrame, key: str) -> DataFrame:
    return frontier.join(visited.select(key).distinct(), key, "left_anti")


def covered(artists: DataFrame, tracks: DataFrame, least: int = 50) -> DataFrame:
    """(…, track_count, skip): of ``artists`` (name), those who have at least ``least`` tracks are to be skipped; names compare without case, a track counts once for a name."""
    names = tracks.select("spotify_id", F.explode("artists.name").alias("n")).select("spotify_id", F.lower("n").alias("_name")).distinct()
    counts = names.groupBy("_name").agg(F.count(F.lit(1)).alias("_n"))
    out = artists.join(counts, F.lower("name") == F.col("_name"), "left")
    n = F.least(F.coalesce("_n", F.lit(0)), F.lit(least)).cast("bigint")
    return out.select(*artists.columns, n.alias("track_count"), (n >= least).alias("skip"))


def features(ids: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Ids with their features, null where there are none; by key, never by position."""
    return ids.join(found, key, "left")


def first_hit(results: DataFrame, key: str, sources: Sequence[str], threshold: float) -> DataFrame:
    """Of each key's results (key, source, score, ord, ...) of at least ``threshold`` the best of the first source that has one."""
    rank = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    order = Window.partitionBy(key).orderBy("_rank", F.desc("score"), "ord")
    good = results.withColumn("_rank", rank).filter((F.col("_rank") > 0) & (F.col("score") >= threshold))
    return good.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_rank")


def within(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: int) -> DataFrame:
    """Pairs of equal key whose values lie at most ``tolerance`` apart: buckets of the tolerance make it an equi-join."""
    bucket = lambda c: F.floor(F.col(c) / tolerance)
    left = a.withColumn("_b", bucket(value))
    right = b.select(F.col(key).alias("_k"), *(F.col(c).alias(f"other_{c}") for c in b.columns if c != key)).withColumn("_c", F.explode(F.array(*(bucket(f"other_{value}") + d for d in (-1, 0, 1)))))
    hit = (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_c")) & (F.abs(F.col(value) - F.col(f"other_{value}")) <= tolerance)
    return left.join(right, hit).drop("_b", "_c", "_k")
