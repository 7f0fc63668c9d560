"""Entity resolution: block, score, take the best.

Equal ISRCs are joined first and never compared.  The rest meets within blocks, of which only
what can be among a candidate's first results is paired, distinct pairs of texts are compared
once, and the best of each candidate's first results stays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S


def pick_best(scored: DataFrame, key: str, order: Sequence[str], threshold: float) -> DataFrame:
    """The best result of each key if it reaches the threshold; of equals the first."""
    best = Window.partitionBy(key).orderBy(F.desc("score"), *order)
    return scored.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n").filter(F.col("score") >= threshold)


def first_results(results: DataFrame, key: str, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` results of each key, as a search returns them."""
    place = Window.partitionBy(key).orderBy(*order)
    return results.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= n).drop("_n")


def first_pairs(own: DataFrame, other: DataFrame, block: str, key: str, n: int) -> DataFrame:
    """Pairs of a block and unequal keys, with all of each key's first ``n`` by ``other_<key>``.

    Those are among the first ``n + 1`` keys of the block, as only its own is left out: a block
    of m rows gives (n + 1) * m pairs, not m * m.
    """
    place = Window.partitionBy(block).orderBy(f"other_{key}")
    firsts = other.filter(F.col(f"other_{key}").isNotNull()).withColumn("_n", F.dense_rank().over(place)).filter(F.col("_n") <= n + 1).drop("_n")
    return own.join(firsts, block).filter(F.col(key) != F.col(f"other_{key}"))


def fuzzy_match(pairs: DataFrame, key: str, order: Sequence[str], threshold: float = 0.7, n: int = 5) -> DataFrame:
    """Pairs (key, title, artist, duration_ms, isrc, other_title, other_artist, other_ms, other_isrc, ...) to the best of each key's first ``n``."""
    near = first_results(pairs, key, order, n)
    same = (F.upper("isrc") == F.upper("other_isrc")) & (F.col("isrc") != "")
    exact = near.filter(F.coalesce(same, F.lit(False))).withColumn("score", F.lit(1.0))
    texts = near.filter(~F.coalesce(same, F.lit(False)))
    compared = texts.select("title", "other_title", "artist", "other_artist").distinct()
    compared = compared.withColumn("_base", 0.6 * S.best_similarity(F.col("title"), F.col("other_title")) + 0.4 * S.best_similarity(F.col("artist"), F.col("other_artist")))
    scored = texts.join(compared, ["title", "other_title", "artist", "other_artist"]).withColumn("score", S.adjusted(F.col("_base"), F.col("duration_ms"), F.col("other_ms"))).drop("_base")
    return pick_best(exact.unionByName(scored.select(exact.columns)), key, order, threshold)


def scored_match(pairs: DataFrame, key: str, order: Sequence[str], score: Column, threshold: float, n: int) -> DataFrame:
    """As ``fuzzy_match`` with any score: recordings (0.75 of 10), lyrics (0.6 of 5), videos (0.65 of 1), artist names (60 of 5)."""
    return pick_best(first_results(pairs, key, order, n).withColumn("score", score), key, order, threshold)


def search_strategies(candidates: DataFrame) -> DataFrame:
    """(…, strategy, query): the searches of a candidate in order: by ISRC, by fields, plain."""
    from ..functions import text as T

    strategies = F.array(
        F.struct(F.lit(0).alias("strategy"), T.isrc_query(F.col("isrc")).alias("query")),
        F.struct(F.lit(1).alias("strategy"), T.field_query(F.col("title"), F.col("artist")).alias("query")),
        F.struct(F.lit(2).alias("strategy"), T.plain_query(F.col("title"), F.col("artist")).alias("query")),
    )
    return candidates.select("*", F.inline(strategies)).filter("query is not null")
