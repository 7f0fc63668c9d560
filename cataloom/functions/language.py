"""Language of a text.

The detector is a stand-in for a third-party library: scripts of one language decide by themselves,
Latin and Cyrillic texts by the share of common words.  It is deterministic and may be replaced
(``detector=``) by any Column function that gives struct(language, probability).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .script import detect_script, once, script_or_null

WORDS = {
    "en": "the and of to in that is it for with was on as be by this are from at or not have you",
    "de": "der die und das den von zu mit ist im nicht ein eine auf dem des sich als auch für",
    "fr": "le la les et des en un une du que est pour dans qui sur pas au avec ce par",
    "es": "el los y que en las por un una para con no se del su al es como más lo",
    "ru": "и в не на что он с как это по но из у за от же так вы",
    "uk": "і в не на що він з як це по але із та за від же так ви є",
}
OF_SCRIPT = {"arabic": "ar", "georgian": "ka", "armenian": "hy", "hebrew": "he", "devanagari": "hi", "thai": "th", "hiragana": "ja", "katakana": "ja", "japanese": "ja", "cjk": "zh", "hangul": "ko"}
FIRST_CHARS = 1000


def detect(text: Column) -> Column:
    """struct(language, probability) of the first 1,000 characters, or null where nothing is known."""
    own = F.substring(text, 1, FIRST_CHARS)
    pairs = F.create_map(*(F.lit(x) for pair in OF_SCRIPT.items() for x in pair))

    def hits(words: Column) -> Column:
        size = lambda known: F.size(F.filter(words, lambda w: w.isin(*known.split())))
        return F.array(*(F.struct(size(known).alias("n"), F.lit(-k).alias("order"), F.lit(name).alias("language")) for k, (name, known) in enumerate(WORDS.items())))

    def likeliest(found: Column) -> Column:
        total = F.aggregate(found, F.lit(0), lambda n, h: n + h["n"])
        return once(F.array_max(found), lambda best: F.when(best["n"] > 0, F.struct(best["language"].alias("language"), (best["n"].cast("double") / total).alias("probability"))))

    by_words = once(once(F.split(F.lower(own), r"[^\p{L}]+"), hits), likeliest)
    by_script = lambda script: F.struct(F.element_at(pairs, script).alias("language"), F.lit(1.0).alias("probability"))
    return once(detect_script(own), lambda script: F.when(script.isin(*OF_SCRIPT), by_script(script)).otherwise(by_words))


def resolve_language(
    mb_language: Column, mb_script: Column, mb_enriched: Column, lyrics: Column, title: Column, artists: Column, min_text: int = 20, detector: Callable[[Column], Column] = detect
) -> Column:
    """struct(language, script, source): by MusicBrainz, else the lyrics, else title and the first two artists."""
    names = F.filter(F.concat(F.array(title), F.slice(F.coalesce(artists, F.array().cast("array<string>")), 1, 2)), lambda x: x.isNotNull() & (x != ""))
    combined = F.array_join(names, " ")
    known = (F.coalesce(mb_language, F.lit("")) != "") & F.coalesce(mb_enriched, F.lit(False))
    from_lyrics = F.when(~known & (F.length(lyrics) >= min_text), detector(lyrics)["language"])
    guess = F.when(~known & (F.length(combined) >= 10), detector(combined))
    out = lambda language, script, source: F.struct(language.alias("language"), script.alias("script"), F.lit(source).alias("source"))

    def decide(own: Column) -> Column:
        said, guess = own["said"], own["guess"]
        return (
            F.when(known, out(mb_language, mb_script, "musicbrainz"))
            .when(said.isNotNull(), out(said, script_or_null(lyrics), "lyrics"))
            .otherwise(out(F.when(guess["probability"] >= 0.8, guess["language"]), F.when(combined != "", script_or_null(combined)), "title_detection"))
        )

    return once(F.struct(from_lyrics.alias("said"), guess.alias("guess")), decide)
