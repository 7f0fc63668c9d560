"""Titles, durations, scripts and transliteration: golden cases, and plain statements of the rules."""

import hashlib
import html
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from cataloom.constants import ARABIC, CYRILLIC_PLAIN, SCRIPTS, UZBEK
from cataloom.functions import html as H
from cataloom.functions import language, script, text, translit


def _one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).head()["y"]


def _all(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "k int, x string").select("k", f(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows)]


TITLES = {
    "  Hello World  ": "hello world", "Song (Remastered 2019)": "song", "Song [2019 Remaster]": "song", "Song (Live)": "song", "Song [Live Version]": "song", "Song (Official Video)": "song",
    "Song (Official Audio)": "song", "Song [Lyrics Video]": "song", "Shape of You (feat. Zara Larsson)": "shape of you", "Song feat. Artist": "song", "Song ft. Artist": "song", "Song featuring Artist": "song",
    "01. Song Title": "song title", "1 - Song Title": "song title", "12 Song Title": "song title", "Jay-Z": "jay z", "It's A Man's World": "it s a man s world", "": "",
    "Left Behind": "le", "Tune (Mixed Feelings)": "tune", "99 Problems": "problems", " 7 rings": "7 rings", "Песня (Live)": "песня", "Naïve_2": "naïve_2",
}


def test_titles(spark):
    assert dict(zip(TITLES, _all(spark, list(TITLES), text.normalize_title))) == TITLES


def test_fingerprints(spark):
    f = lambda t, a, d: spark.createDataFrame([(t, a, d)], "t string, a string, d bigint").select(text.fingerprint_candidate(F.col("t"), F.col("a"), F.col("d"))).head()[0]
    one = f("Song (Live)", "Artist", 180_400)
    assert one == hashlib.sha256(b"song|artist|180000").hexdigest() == f("SONG", "artist", 179_500)
    assert f("Song", "Artist", None) == f("Song", "Artist", 0) == hashlib.sha256(b"song|artist").hexdigest() != one
    assert f("Song", "Artist", 181_001) != one and f("Song", "Other", 180_400) != one and re.fullmatch("[0-9a-f]{64}", one)
    track = spark.sql("select 'Song' n, 'id' a, 180400L d").select(text.fingerprint_track(F.col("n"), F.col("a"), F.col("d"))).head()[0]
    assert track == hashlib.sha256(b"song|id|180000").hexdigest() != one


@pytest.mark.parametrize("ms,bucket", [(999, 0), (1000, 0), (1001, 2000), (3000, 4000), (201_000, 200_000), (0, 0)])
def test_buckets_round_half_even(spark, ms, bucket):
    assert _one(spark, ms, text.duration_bucket, "bigint") == bucket == round(ms / 2000) * 2000


@pytest.mark.parametrize("said,ms", [("3:45", 225_000), ("1:02:03", 3_723_000), ("", None), ("not-a-time", None), ("abc", None), ("5", None), ("1:2:3:4", None), (" 1 : 30 ", 90_000), (None, None)])
def test_durations(spark, said, ms):
    assert _one(spark, said, text.parse_duration) == ms


def test_entities(spark):
    values = ["a &amp; b", " plain ", "&quot;x&#39;", None, "&lt;p&gt;&eacute;"]
    assert _all(spark, values, text.html_unescape) == [None if v is None else html.unescape(v).strip() for v in values]


def _script(s):
    counts = {}
    for ch in s:
        name = next((n for n, ranges in SCRIPTS.items() if any(a <= ord(ch) <= b for a, b in ranges)), "latin" if ch.isalpha() else None)
        if name:
            counts[name] = counts.get(name, 0) + 1
    if "latin" in counts:
        counts["latin"] = counts.pop("latin")  # last of equals
    if not counts:
        return "unknown"
    total, best = sum(counts.values()), max(counts, key=counts.get)
    kana = sum(n for name, n in counts.items() if name in ("hiragana", "katakana"))
    if kana and (kana + counts.get("cjk", 0)) * 2 >= total:
        return "japanese"
    return "mixed" if counts[best] * 2 < total and len(counts) > 1 else best


def test_scripts(spark):
    draw = random.Random(3)
    signs = "ab éЖп مس ქ Ա ש हि ক ไ ひカ漢𠀀 한 1.!-α"
    values = ["".join(draw.choices(signs, k=draw.randint(0, 12))) for _ in range(300)] + ["", "123", "Звонкий", "abc", "日本のうた", "한국", "αβγ", "\n"]
    assert _all(spark, values, script.detect_script) == [_script(v) for v in values]
    assert _one(spark, None, script.detect_script) is None and _one(spark, "12", script.script_or_null) is None


def test_transliteration(spark):
    draw = random.Random(5)
    values = ["".join(draw.choices("АБЕЁЖЪъьЩщЮяўқғҳ abc-1 اپعلّة  ", k=20)) for _ in range(60)]
    assert _all(spark, values, translit.uzbek_to_latin) == ["".join(UZBEK.get(c, c) for c in v) for v in values]
    assert _all(spark, values, translit.arabic_to_latin) == [re.sub(r"\s+", " ", "".join(ARABIC.get(c, c) for c in v)).strip() for v in values]
    plain = lambda c: translit.cyrillic_to_latin(c, F.lit(None).cast("string"))
    assert _all(spark, values, plain) == ["".join(CYRILLIC_PLAIN.get(c.lower(), c) for c in v) for v in values]
    assert (UZBEK["Ъ"], UZBEK["ъ"], UZBEK["Ў"], UZBEK["ш"], UZBEK["Щ"], CYRILLIC_PLAIN["щ"], CYRILLIC_PLAIN["ь"]) == ("", "'", "O'", "sh", "Sh", "shch", "")
    assert len(UZBEK) == 76 and len(ARABIC) == 51 and len(CYRILLIC_PLAIN) == 33


def test_to_latin(spark):
    values = ["Звонкий", "abc", "Été", "漢字 ab", "漢字", "سلام", "", None]
    assert _all(spark, values, translit.to_latin) == ["zvonkiy", "abc", "Été", "漢字 ab" if _script("漢字 ab") == "mixed" else "ab", "漢字", "slam", "", None]
    assert _all(spark, ["한국어", "가", "x힣"], translit.hangul_to_latin) == ["hangukeo", "ga", "xhit"]


def test_names(spark):
    values = ["Ｆｕｌｌ Ｗｉｄｔｈ", "Song（现场版）", "Song【Live】", "A feat. B", "It's  Fine!", "노래 (라이브)", "ﬁne"]
    assert _all(spark, values, translit.normalize_name) == ["full width", "song", "song", "a", "it's fine!", "노래", "fine"]
    assert all(unicodedata.is_normalized("NFKC", x) for x in _all(spark, values, translit.normalize_name))


def test_languages(spark):
    values = ["The cat is on the mat and it was not there", "Der Hund und die Katze sind nicht im Haus", "le chat est dans la maison et les enfants", "el perro y los gatos en la casa", "שלום", "xyz", "これは", None]
    assert _all(spark, values, lambda c: language.detect(c)["language"]) == ["en", "de", "fr", "es", "he", None, "ja", None]


def test_lyrics():
    page = '<div><div data-lyrics-container="true">One line<br>two <a href="x">linked</a><div>deep</div></div></div><p>no</p><div data-lyrics-container="true">Second part</div>'
    assert H.lyrics_of(page) == "One line\ntwo linkeddeep\n\nSecond part"
    assert H.lyrics_of('<div class="x Lyrics__Container-y">Some text that is long enough</div>') == "Some text that is long enough"
    assert H.lyrics_of('<div data-lyrics-container="true">short</div>') is None and H.lyrics_of(None) is None and H.lyrics_of("<p>none</p>") is None
