"""Scripts of writing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import SCRIPTS


def java_class(ranges: tuple[tuple[int, int], ...]) -> str:
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges)


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once a row, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _held(text: Column, inside: str) -> Column:
    """The signs of a text that are in a class."""
    return F.regexp_replace(text, f"[^{inside}]", "")


def detect_script(text: Column) -> Column:
    """The script of most of a text's letters; of equally frequent ones that which comes first in the text, Latin last.

    Characters of a script's block all count for it, letters of no block count as Latin.
    Texts with kana of which at least half are kana or Han are 'japanese'; 'mixed' if none
    of several scripts makes up a half; 'unknown' if nothing counts.
    """
    every = "".join(java_class(r) for r in SCRIPTS.values())
    latin = F.length(F.regexp_replace(text, rf"[^\p{{L}}]|[{every}]", ""))

    def entries(signs: Column) -> Column:
        first = lambda own: -F.length(F.substring_index(F.regexp_replace(signs, f"[{own}]", "\x00"), "\x00", 1))
        own = [F.struct(F.length(_held(signs, java_class(r))).alias("n"), first(java_class(r)).alias("first"), F.lit(n).alias("script")) for n, r in SCRIPTS.items()]
        return F.filter(F.array(*own), lambda e: e["n"] > 0)

    # the signs of all blocks keep their order, so each block is counted and sought among them only
    of_blocks = once(_held(text, every), entries)
    of_latin = F.struct(latin.alias("n"), F.lit(-(1 << 30)).alias("first"), F.lit("latin").alias("script"))
    held = F.concat(of_blocks, F.filter(F.array(of_latin), lambda e: e["n"] > 0))

    def decide(own: Column) -> Column:
        best = F.array_max(own)
        total = F.aggregate(own, F.lit(0), lambda s, e: s + e["n"])
        kana = F.aggregate(own, F.lit(0), lambda s, e: s + F.when(e["script"].isin("hiragana", "katakana"), e["n"]).otherwise(0))
        han = F.aggregate(own, F.lit(0), lambda s, e: s + F.when(e["script"] == "cjk", e["n"]).otherwise(0))
        return (
            F.when(F.size(own) == 0, "unknown")
            .when((kana > 0) & ((kana + han) * 2 >= total), "japanese")
            .when((best["n"] * 2 < total) & (F.size(own) > 1), "mixed")
            .otherwise(best["script"])
        )

    ascii_only = ~text.rlike(r"[^\x00-\x7F]")
    plain = F.when(text.rlike("[A-Za-z]"), "latin").otherwise("unknown")
    return F.when(text.isNull(), F.lit(None)).when(ascii_only, plain).otherwise(once(held, decide))


def script_or_null(text: Column) -> Column:
    """The script, or null where it is unknown or mixed."""
    return once(detect_script(text), lambda script: F.when(~script.isin("unknown", "mixed"), script))
