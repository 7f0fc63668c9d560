"""Similarity of names: Indel ratio (2 * longest common subsequence / both lengths) of whole strings, sorted tokens and token sets.

Arrow UDFs; a worker keeps what it has compared.  Callers pass distinct pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..session import ship
from .scoring import rounded
from .text import normalize_title
from .translit import to_latin


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    every = row = (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & every
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """0 to 100; two empty strings are alike."""
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both, one, two = (sorted(x) for x in (left & right, left - right, right - left))
    if both and (not one or not two):
        return 100.0
    base, first, second = " ".join(both), " ".join(both + one), " ".join(both + two)
    return max(ratio(first, second), *((ratio(base, first), ratio(base, second)) if both else (0.0,)))


@lru_cache(200_000)
def str_similarity(a: str, b: str) -> float:
    """The better of both token ratios, 0 to 1; 0 where either is empty."""
    if not a.split() or not b.split():
        return 0.0
    return 1.0 if a == b else max(token_sort_ratio(a, b), token_set_ratio(a, b)) / 100


@lru_cache(200_000)
def _sort(a: str, b: str) -> float:
    return token_sort_ratio(a, b) / 100


@lru_cache(200_000)
def _name(a: str, b: str) -> float:
    return ratio(a.lower().strip(), b.lower().strip())


def _compare(f: Callable[[str, str], float], a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else f(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


@F.arrow_udf(DoubleType())
def _similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    return _compare(str_similarity, a, b)


@F.arrow_udf(DoubleType())
def _sort_similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    return _compare(_sort, a, b)


@F.arrow_udf(DoubleType())
def _name_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    return _compare(_name, a, b)


def similarity(a: Column, b: Column) -> Column:
    """The better of both token ratios, 0 to 1."""
    ship()
    return _similarity(a, b)


def sort_similarity(a: Column, b: Column) -> Column:
    """Ratio of the sorted tokens, 0 to 1."""
    ship()
    return _sort_similarity(a, b)


def name_ratio(a: Column, b: Column) -> Column:
    """Ratio of whole names without case and outer spaces, 0 to 100."""
    ship()
    return _name_ratio(a, b)


def best_similarity(a: Column, b: Column) -> Column:
    """The better of the similarities of two normalised texts and of their Latin forms."""
    return F.greatest(similarity(a, b), similarity(to_latin(a), to_latin(b)))


def duration_adjustment(a: Column, b: Column) -> Column:
    """+0.05 where durations agree within 5 %, -0.05 where by more than 25 % they don't, else 0; only of positive ones."""
    near = F.least(a, b).cast("double") / F.greatest(a, b)
    return F.when((a > 0) & (b > 0), F.when(near >= 0.95, 0.05).when(near < 0.75, -0.05).otherwise(0.0)).otherwise(0.0)


def adjusted(base: Column, a: Column, b: Column) -> Column:
    """A score with ``duration_adjustment``, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + duration_adjustment(a, b)))


def match_score(title: Column, artist: Column, other_title: Column, other_artist: Column, ms: Column, other_ms: Column, isrc: Column, other_isrc: Column) -> Column:
    """0.6 of the title's and 0.4 of the artist's similarity, adjusted by duration; 1 where the ISRCs agree."""
    base = 0.6 * best_similarity(title, other_title) + 0.4 * best_similarity(artist, other_artist)
    same = F.coalesce(F.upper(isrc) == F.upper(other_isrc), F.lit(False)) & (F.coalesce(isrc, F.lit("")) != "")
    return F.when(same, 1.0).otherwise(adjusted(base, ms, other_ms))


def duration_score(ms: Column, other: Column, tolerance: int = 3000) -> Column:
    """1 within the tolerance, 0.5 within twice that or where either is missing, else 0."""
    apart = F.abs(ms - other)
    known = (F.coalesce(ms, F.lit(0)) != 0) & (F.coalesce(other, F.lit(0)) != 0)
    return F.when(~known, 0.5).when(apart <= tolerance, 1.0).when(apart <= 2 * tolerance, 0.5).otherwise(0.0)


def mb_confidence(title: Column, artist: Column, other_title: Column, other_artist: Column, ms: Column, other_ms: Column, score: Column, tolerance: int = 3000) -> Column:
    parts = 0.65 * sort_similarity(normalize_title(title), normalize_title(other_title)) + 0.20 * sort_similarity(normalize_title(artist), normalize_title(other_artist))
    total = parts + 0.15 * duration_score(ms, other_ms, tolerance) + F.coalesce(score, F.lit(0)).cast("double") / 100 * 0.05
    return rounded(F.least(total, F.lit(1.0)), 4)


def name_confidence(title: Column, artist: Column, other_title: Column, other_artist: Column, places: int = 4) -> Column:
    """0.6 of the title's and 0.4 of the artist's similarity, both normalised: for lyrics (4 places) and videos (3)."""
    parts = 0.6 * similarity(normalize_title(title), normalize_title(other_title)) + 0.4 * similarity(normalize_title(artist), normalize_title(other_artist))
    return rounded(parts, places)
