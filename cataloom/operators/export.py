"""Sinks: JSON lines and CSV, one ordered write each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
_FEATURES = "danceability energy key loudness mode speechiness acousticness instrumentalness liveness valence tempo time_signature".split()


def _or(column: str, default: object) -> Column:
    return F.coalesce(F.col(column), F.lit(default))


def flat(tracks: DataFrame) -> DataFrame:
    """The 35 columns of the CSV export. Tracks have the nested columns artists, album, audio_features and lyrics; booleans print True and False."""
    yes = lambda c: F.when(F.coalesce(c, F.lit(False)), "True").otherwise("False")
    has_features = F.col("audio_features").isNotNull()
    return tracks.select(
        _or("spotify_id", "").alias("spotify_id"),
        _or("isrc", "").alias("isrc"),
        _or("name", "").alias("name"),
        F.coalesce(F.array_join(F.transform("artists", lambda a: F.coalesce(a["name"], F.lit(""))), ", "), F.lit("")).alias("artists_names"),
        F.coalesce(F.get("artists", F.lit(0))["spotify_id"], F.lit("")).alias("primary_artist_id"),
        _or("album.name", "").alias("album_name"),
        _or("album.album_type", "").alias("album_type"),
        _or("album.release_date", "").alias("release_date"),
        *(_or(c, 0).alias(c) for c in ("popularity", "duration_ms")),
        yes(F.col("explicit")).alias("explicit"),
        *(_or(c, 0).alias(c) for c in ("markets_count", "appearance_score")),
        _or("quality_score", 0.0).alias("quality_score"),
        _or("artist_followers", 0).alias("artist_followers"),
        yes(has_features).alias("has_audio_features"),
        *(F.col(f"audio_features.{c}").alias(c) for c in _FEATURES),
        yes(F.coalesce(F.col("lyrics.text"), F.lit("")) != "").alias("has_lyrics"),
        F.col("lyrics.language").alias("lyrics_language"),
        F.col("lyrics.genius_url").alias("genius_url"),
        F.col("lyrics.confidence_score").alias("lyrics_confidence"),
        _or("status", "").alias("status"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("created_at", "updated_at")),
    )


def ordered(tracks: DataFrame) -> DataFrame:
    """Enriched tracks, the best first; ties by id."""
    return tracks.filter("status = 'enriched'").orderBy(F.desc("quality_score"), "spotify_id")


def json_lines(tracks: DataFrame) -> DataFrame:
    """(value): each whole record as JSON, times in ISO form."""
    return tracks.select(F.to_json(F.struct("*"), {"timestampFormat": ISO}).alias("value"))


def export_jsonl(tracks: DataFrame, path: str) -> None:
    """Enriched tracks as JSON lines in order, over as many files as the sort has partitions."""
    json_lines(ordered(tracks)).write.mode("overwrite").text(path)


def export_csv(tracks: DataFrame, path: str) -> None:
    flat(ordered(tracks)).write.mode("overwrite").csv(path, header=True)
