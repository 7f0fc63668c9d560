"""Scores. Rounding is floor(x * 10^n + 0.5) / 10^n, which any engine repeats exactly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values at which a component is full.
MAX_FOLLOWERS, MAX_APPEARANCES, MAX_MARKETS = 50_000_000, 200, 185


def rounded(x: Column, places: int) -> Column:
    return F.floor(x * 10**places + 0.5).cast("double") / 10**places


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x.cast("double")))


def share(value: Column, most: float) -> Column:
    """value / most within 0 and 1; 0 where most isn't positive."""
    return clamp(F.coalesce(value.cast("double"), F.lit(0.0)) / most) if most > 0 else F.lit(0.0)


def quality_score(popularity: Column, followers: Column, appearances: Column, markets: Column) -> Column:
    return rounded(0.40 * share(popularity, 100) + 0.30 * share(followers, MAX_FOLLOWERS) + 0.20 * share(appearances, MAX_APPEARANCES) + 0.10 * share(markets, MAX_MARKETS), 6)


def quality_score_regional(base: Column, regional: Column, weight: float = 0.15) -> Column:
    """A rounded base score and a regional one, weighted."""
    w = min(max(weight, 0.0), 1.0)
    return rounded(base * (1 - w) + clamp(F.coalesce(regional, F.lit(0.0))) * w, 6)


def artist_priority(popularity: Column, followers: Column) -> Column:
    """0.4 of popularity and 0.3 of followers on a log scale, 0.7 at most."""
    fame = F.least(F.log1p(F.greatest(F.coalesce(followers, F.lit(0)), F.lit(0)).cast("double")) / 14, F.lit(1.0))
    return rounded(0.4 * share(popularity, 100) + 0.3 * fame, 4)


def rank_popularity(rank: Column) -> Column:
    """A chart rank in ten-thousands, rounded down, not clamped."""
    return F.floor(F.coalesce(rank, F.lit(0)) / 10000).cast("bigint")
