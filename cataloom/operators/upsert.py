"""Upsert with dedup: one fold over a key in place of a merge a row.

``existing`` rows come before ``incoming`` ones, these in the order of ``seq``.  A key's first
row gives the fields that are set on insert; what later rows do is a ``Fold``.  One shuffle,
with partial aggregation before it, so a hot key costs each task one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fold:
    """What a hit does. Columns not named keep the value of the insert."""

    count: str | None = None  # + 1 a row
    start: int = 1  # what an insert begins with
    largest: Sequence[str] = ()
    union: Sequence[str] = ()  # arrays
    latest: Sequence[str] = ()  # overwritten
    if_empty: Sequence[str] = ()  # arrays, the first that isn't empty
    if_null: Sequence[str] = ()  # the first value there is
    real_id: str | None = None  # placeholders '<prefix>:...' give way to the first other id
    prefix: str = "deezer"
    tell: dict[str, str] = field(default_factory=dict)


#: The upserts of each kind of discovery.
PLAYLIST = Fold(count="appearance_score", latest=("updated_at",), if_empty=("markets",))
GENRE = ARTIST = Fold(latest=("updated_at",))
ARTIST_GRAPH = Fold(count="appearance_score", latest=("updated_at",), if_empty=("markets",), union=("version_album_ids",), real_id="spotify_id")
CANDIDATE_MATCH = Fold(count="appearance_score", latest=("updated_at",), real_id="spotify_id")
REGIONAL = Fold(latest=("updated_at",), largest=("mb_priority",))
DIRECT = Fold(count="appearance_score", latest=("updated_at",))
CANDIDATES = QUEUE = Fold()
METADATA = Fold(latest=("name", "followers", "popularity", "genres", "image_url"))
VIDEO = Fold(if_null=("youtube",))


def dedup_key(isrc: Column, fingerprint: Column) -> Column:
    """The ISRC if there is one, else the fingerprint; the two never meet."""
    return F.when(F.coalesce(isrc, F.lit("")) != "", F.concat(F.lit("i:"), isrc)).otherwise(F.concat(F.lit("f:"), fingerprint))


def upsert_fold(incoming: DataFrame, key: Column, seq: Sequence[str], fold: Fold = CANDIDATES, existing: DataFrame | None = None) -> DataFrame:
    """One row a key: columns of ``incoming`` without ``seq``, folded. Rows of ``existing`` have the same columns, folded before."""
    columns = [c for c in incoming.columns if c not in seq]
    zero = F.struct(F.lit(1).alias("late"), *(F.col(c) for c in seq))
    rows = incoming.select(*columns, key.alias("_key"), zero.alias("_seq"), F.lit(fold.start).cast("bigint").alias("_n"))
    if existing is not None:
        before = F.struct(F.lit(0).alias("late"), *(F.lit(None).cast(incoming.schema[c].dataType).alias(c) for c in seq))
        n = F.coalesce(F.col(fold.count), F.lit(0)).cast("bigint") if fold.count else F.lit(0).cast("bigint")
        rows = existing.select(*columns, key.alias("_key"), before.alias("_seq"), n.alias("_n")).unionByName(rows)
    aggs: list[Column] = []
    for c in columns:
        own = F.col(c)
        if c == fold.count:
            # the first row of a new key inserts ``start``, every other one adds 1
            kept = F.sum(F.when(F.col("_seq.late") == 0, F.col("_n")).otherwise(1)) + F.when(F.min("_seq.late") == 1, fold.start - 1).otherwise(0)
            aggs.append(kept.cast(incoming.schema[c].dataType).alias(c))
        elif c in fold.largest:
            aggs.append(F.max(own).alias(c))
        elif c in fold.latest:
            aggs.append(F.max_by(own, "_seq").alias(c))
        elif c in fold.union:
            aggs.append(F.array_sort(F.array_distinct(F.flatten(F.collect_set(own)))).alias(c))
        elif c in fold.if_empty:
            aggs.append(F.coalesce(F.min_by(own, F.when(F.size(own) > 0, F.col("_seq"))), F.min_by(own, "_seq")).alias(c))
        elif c in fold.if_null:
            aggs.append(F.min_by(own, F.when(own.isNotNull(), F.col("_seq"))).alias(c))
        elif c == fold.real_id:
            real = F.when(~F.startswith(own, F.lit(f"{fold.prefix}:")), F.col("_seq"))
            insert = F.min_by(own, "_seq")
            aggs.append(F.when(F.startswith(insert, F.lit(f"{fold.prefix}:")), F.coalesce(F.min_by(own, real), insert)).otherwise(insert).alias(c))
        else:
            aggs.append(F.min_by(own, "_seq").alias(c))
    return rows.groupBy("_key").agg(*aggs).drop("_key")


def inserted_and_repeated(incoming: DataFrame, key: str, existing: DataFrame) -> DataFrame:
    """(inserted, repeated): how many rows of a batch were new keys, and how many weren't."""
    known = existing.select(F.col(key).alias("_known")).distinct().withColumn("_hit", F.lit(1))
    per = incoming.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(known, F.col(key) == F.col("_known"), "left")
    new = F.when(F.col("_hit").isNull(), 1).otherwise(0)
    return per.agg(F.coalesce(F.sum(new), F.lit(0)).cast("bigint").alias("inserted"), F.coalesce(F.sum(F.col("n") - new), F.lit(0)).cast("bigint").alias("repeated"))
