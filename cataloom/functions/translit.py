"""Transliteration to Latin letters.

Tables for Uzbek, other Cyrillic and Arabic are native expressions.  Han, kana and other scripts would
need third-party tables; as where those are missing, their non-ASCII signs are dropped, and
a name of which nothing is left stays as it is.  Hangul is spelled by the arithmetic of its syllable blocks
(``hangul_to_latin``), which callers may ask for.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..constants import ARABIC, CYRILLIC_PLAIN, UZBEK
from .script import detect_script

TAG = r"\d{4}\s+remaster|acoustic|clean|club\s+mix|edit|explicit|extended|instrumental|live|mix|original\s+mix|radio\s+edit|remaster|remix|single\s+version|version"
TAG_EAST = "现场|重制|重混|翻唱|混音|纯音乐|伴奏|精简版|完整版|原版|アコースティック|インスト|カバー|ライブ|リマスター|라이브|리마스터|어쿠스틱|커버"
SUFFIX = rf"\s*[(（\[【〔「『《](?:{TAG}|{TAG_EAST}).*?[)）\]】〕」』》]"
GUESTS = r"\s*(?:featuring|feat\.?|ft\.?)\s+.+$"
_SPACE = r"\s+"


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def normalize_name(text: Column) -> Column:
    """A name for comparison in any script: NFKC, without edition and guests, in lower case; punctuation stays. Only texts beyond ASCII leave the JVM."""
    wide = text.rlike(r"[^\x00-\x7F]")
    out = F.when(wide, _nfkc(F.when(wide, text))).otherwise(text)
    out = F.regexp_replace(F.regexp_replace(out, f"(?iu){SUFFIX}", ""), f"(?iu){GUESTS}", "")
    return F.regexp_replace(F.trim(F.lower(out)), _SPACE, " ")


def by_table(text: Column, table: dict[str, str], key: str = "c") -> Column:
    """Every character by a table, others as they are."""
    pairs = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    chars = F.split(text, "")
    return F.array_join(F.transform(chars, lambda c: F.coalesce(F.element_at(pairs, F.lower(c) if key == "lower" else c), c)), "")


def uzbek_to_latin(text: Column) -> Column:
    return by_table(text, UZBEK)


def arabic_to_latin(text: Column) -> Column:
    return F.trim(F.regexp_replace(by_table(text, ARABIC), _SPACE, " "))


def cyrillic_to_latin(text: Column, language: Column) -> Column:
    """Uzbek by its own table; other languages by the bare one, which drops case."""
    return F.when(F.coalesce(language, F.lit("ru")) == "uz", uzbek_to_latin(text)).otherwise(by_table(text, CYRILLIC_PLAIN, "lower"))


def ascii_to_latin(text: Column) -> Column:
    """The ASCII signs of a text."""
    return F.trim(F.regexp_replace(text, r"[^\x00-\x7F]", ""))


_LEAD = "g kk n d tt r m b pp s ss _ j jj ch k t p h".replace("_", "").split(" ")
_VOWEL = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split(" ")
_TAIL = "_ k k k n n n t l k m l l l p l m p p t t ng t t k t p t".replace("_", "").split(" ")


def hangul_to_latin(text: Column) -> Column:
    """Syllable blocks by lead, vowel and tail (revised romanisation, letter by letter); other signs as they are."""
    of = lambda names: F.array(*map(F.lit, names))

    def spell(c: Column) -> Column:
        # a code point from its UTF-8 bytes, for the three-byte range that the blocks are in
        raw = F.hex(F.encode(c, "UTF-8"))
        part = lambda k: F.conv(F.substring(raw, k, 2), 16, 10).cast("int")
        at = (part(1) - 0xE0) * 4096 + (part(3) - 0x80) * 64 + (part(5) - 0x80) - 0xAC00
        block = (F.length(raw) == 6) & at.between(0, 11171)
        return F.when(block, F.concat(F.get(of(_LEAD), (at / 588).cast("int")), F.get(of(_VOWEL), (at % 588 / 28).cast("int")), F.get(of(_TAIL), at % 28))).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), spell), "")


def transliterate(name: Column, script: Column, language: Column) -> Column:
    """A name in Latin letters by its script; null for Latin, Hebrew, mixed, unknown, and for an empty name; a blank result gives the name itself."""

    def spell(r: Column) -> Column:
        name, script = r["name"], r["script"]
        out = F.when(script == "arabic", arabic_to_latin(name)).when(script.isin("cyrillic", "georgian", "armenian"), cyrillic_to_latin(name, r["language"]))
        out = out.when(script.isin("cjk", "japanese", "hiragana", "katakana", "hangul", "devanagari", "indic", "thai"), ascii_to_latin(name))
        return F.when(out.isNotNull(), F.coalesce(F.when(F.trim(out) != "", out), name))

    # bound once, so that the script isn't worked out again where it is named
    row = F.struct(name.alias("name"), script.alias("script"), language.alias("language"))
    return F.when(F.coalesce(name, F.lit("")) != "", F.get(F.transform(F.array(row), spell), F.lit(0)))


def to_latin(text: Column) -> Column:
    """A text transliterated by its own script, or as it is."""
    made = transliterate(text, detect_script(text), F.lit(None).cast("string"))
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.coalesce(made, text)).otherwise(text)


def transliteration_columns(name: Column, artist: Column, script: Column, language: Column) -> dict[str, Column]:
    """normalized_name, normalized_artist_name, transliterated_name, transliteration_done; the script is detected where it is missing."""
    found = detect_script(name)
    own = F.coalesce(script, F.when(~found.isin("unknown", "latin", "mixed"), found))
    return {
        "normalized_name": normalize_name(name),
        "normalized_artist_name": normalize_name(artist),
        "transliterated_name": transliterate(name, own, language),
        "transliteration_done": F.lit(True),
    }
