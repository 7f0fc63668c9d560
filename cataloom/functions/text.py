"""Titles, fingerprints, durations and query strings."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: An edition tag in brackets: what it begins with decides, so anything up to the bracket's end goes.
EDITION = r"\s*[(\[](?:\d{4}|4k|acoustic|album|bonus\s+track|clean|edit|explicit|extended|full\s+version|hd|hq|live|lyric|mix|mono|official\s+(?:audio|lyric|music\s+video|video)|original|radio\s+edit|remaster|remix|single|stereo|version|visuali[sz]er).*?[)\]]"
FEATURING = r"\s*[(\[]?(?:featuring|feat\.?|ft\.?|prod\.?\s+by)\s+[^)\]]+[)\]]?"
TRACK_NUMBER = r"^\d{1,3}[.\s-]\s*"
#: Edition tags that single sources strip before their own fingerprint.
SOURCE_EDITION = r"\s*[(\[](?:clean|edit|explicit|live|mix|radio edit|remaster|remix|version).*?[)\]]"
_BRACKETS, _WIDE_BRACKETS = r"\s*[(\[].*?[)\]]", r"\s*[(\[（【].*?[)\]）】]"


def normalize_title(title: Column) -> Column:
    """A title or name as fingerprints and matching see it: without edition, guests and leading track number; letters and digits only, in lower case."""
    out = F.regexp_replace(title, f"(?iu){EDITION}", "")
    out = F.regexp_replace(out, f"(?iu){FEATURING}", "")
    out = F.lower(F.regexp_replace(out, TRACK_NUMBER, ""))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def duration_bucket(ms: Column, bucket: int = 2000) -> Column:
    """Milliseconds rounded half-even to whole buckets."""
    return (F.bround(ms.cast("double") / bucket, 0) * bucket).cast("bigint")


def fingerprint_track(name: Column, artist_id: Column, ms: Column) -> Column:
    """SHA-256 of normalised name, artist id and duration bucket."""
    return F.sha2(F.concat_ws("|", normalize_title(name), artist_id, duration_bucket(ms).cast("string")), 256)


def fingerprint_candidate(title: Column, artist: Column, ms: Column) -> Column:
    """SHA-256 of normalised title and artist, and of the duration bucket where there is a duration other than 0."""
    bucket = F.when(F.coalesce(ms, F.lit(0)) != 0, duration_bucket(ms).cast("string"))
    return F.sha2(F.concat_ws("|", normalize_title(title), normalize_title(artist), bucket), 256)


#: Source -> (what is stripped, whether the duration counts, salt).
SOURCES = {
    "deezer": (SOURCE_EDITION, True, None),
    "yandex": (SOURCE_EDITION, True, None),
    "shazam": (SOURCE_EDITION, False, "shazam"),
    "jiosaavn": (_BRACKETS, True, "jiosaavn"),
    "netease": (_WIDE_BRACKETS, True, "netease"),
    "soundcloud": (_BRACKETS, True, "soundcloud"),
}


def fingerprint_source(title: Column, artist: Column, ms: Column, source: str) -> Column:
    """The fingerprint of a source that has its own: stripped title and artist in lower case, duration bucket (null counts 0), salt."""
    strip, timed, salt = SOURCES[source]
    parts = [F.trim(F.lower(F.regexp_replace(title, f"(?iu){strip}", ""))), F.trim(F.lower(artist))]
    parts += [duration_bucket(F.coalesce(ms, F.lit(0))).cast("string")] if timed else []
    return F.sha2(F.concat_ws("|", *parts, *([F.lit(salt)] if salt else [])), 256)


def parse_duration(text: Column) -> Column:
    """'M:SS' or 'H:MM:SS' as milliseconds, else null; parts aren't checked for range."""
    parts = F.transform(F.split(text, ":"), lambda p: F.trim(p).try_cast("bigint"))
    whole = ~F.exists(parts, lambda p: p.isNull())
    minutes = F.get(parts, F.lit(0)) * 60 + F.get(parts, F.lit(1))
    hours = F.get(parts, F.lit(0)) * 3600 + F.get(parts, F.lit(1)) * 60 + F.get(parts, F.lit(2))
    return F.when(whole & (F.size(parts) == 2), minutes * 1000).when(whole & (F.size(parts) == 3), hours * 1000)


@F.arrow_udf(StringType())
def _unescape(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else html.unescape(t).strip() for t in texts.to_pylist()], pa.string())


def html_unescape(text: Column) -> Column:
    """Entities as characters, trimmed (Arrow UDF, only for texts that hold an '&')."""
    return F.when(F.contains(text, F.lit("&")), _unescape(F.when(F.contains(text, F.lit("&")), text))).otherwise(F.trim(text))


def script_urls(page: Column) -> Column:
    """Addresses of the scripts of a page, in order."""
    return F.regexp_extract_all(page, F.lit("<script[^>]+" + 'src="(https://[^"]+[.]js)"'), F.lit(1))


def client_id(script: Column) -> Column:
    """The first client id (20 to 40 letters and digits) that a script sets, or null."""
    return F.nullif(F.regexp_extract(script, 'client_id:"([0-9A-Za-z]{20,40})"', 1), F.lit(""))


def isrc(raw: Column) -> Column:
    """external_ids.isrc of a JSON record; empty is null."""
    return F.nullif(F.get_json_object(raw, "$.external_ids.isrc"), F.lit(""))


#: Parts of a message that tell of a ban.
BAN_SIGNALS = ("access denied", "banned", "blocked", "captcha", "forbidden", "rate limit", "too many requests", "unauthorized", "unavailable for legal reasons", "451", "429", "403", "401")


def ban_signal(message: Column) -> Column:
    """Whether a message tells of a ban."""
    low = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit(False)
    for part in BAN_SIGNALS:
        out = out | F.contains(low, F.lit(part))
    return out


def csv_list(text: Column) -> Column:
    """A setting 'a, b,,c' as [a, b, c]."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")


def lucene_escape(text: Column) -> Column:
    """A backslash before every sign that a Lucene query reads as its own."""
    return F.regexp_replace(text, r'([\[\](){}^"~*?:\\!&|+-])', r"\\$1")


def plain_query(title: Column, artist: Column) -> Column:
    return F.concat_ws(" ", artist, title)


def field_query(title: Column, artist: Column) -> Column:
    return F.concat(F.lit("track:"), title, F.lit(" artist:"), artist)


def isrc_query(code: Column) -> Column:
    return F.concat(F.lit("isrc:"), code)


def recording_query(title: Column, artist: Column) -> Column:
    return F.concat(F.lit('recording:"'), lucene_escape(title), F.lit('" AND artist:"'), lucene_escape(artist), F.lit('"'))


def cover_url(template: Column, size: str = "200x200") -> Column:
    """A cover's address of a size; a template has %% in its place."""
    return F.replace(template, F.lit("%%"), F.lit(size))


def mapped(code: Column, table: dict[str, str], otherwise: Column) -> Column:
    """``code`` by a table, or ``otherwise``."""
    pairs = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.element_at(pairs, code), otherwise)
