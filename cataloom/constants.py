"""Code sets and tables: regions, languages, scripts, transliterations."""

from __future__ import annotations


def _codes(text: str) -> tuple[str, ...]:
    return tuple(sorted(text.split()))


#: Region -> countries (ISO 3166-1). Some countries belong to two regions.
COUNTRIES = {
    "cis": _codes("AM AZ BY EE GE KG KZ LT LV MD RU TJ TM UA UZ"),
    "central_asia": _codes("AF KG KZ TJ TM UZ"),
    "mena": _codes("AE BH DZ EG IL IQ IR JO KW LB LY MA OM PK PS QA SA SY TN TR YE"),
    "eastern_europe": _codes("AL BA BG CY CZ GR HR HU ME MK PL RO RS SI SK XK"),
    "south_asia": _codes("BD BT IN LK MV NP PK"),
    "east_asia": _codes("CN HK JP KR MN MO TW"),
    "southeast_asia": _codes("BN ID KH LA MM MY PH SG TH TL VN"),
}
#: Region -> languages (ISO 639-1) of its own.
LANGUAGES = {
    "cis": _codes("az be hy ka mo ro ru uk"),
    "central_asia": _codes("kk ky tg tk uz"),
    "mena": _codes("ar fa he ku ps tr ur"),
    "eastern_europe": _codes("bg bs cs el hr hu mk pl ro sk sl sq sr"),
    "south_asia": _codes("bn gu hi kn ml mr ne pa si ta te ur"),
    "east_asia": _codes("ja ko mn zh"),
    "southeast_asia": _codes("id km lo ms my th tl vi"),
}
REGIONS = tuple(COUNTRIES)
#: The order in which an artist's country is given a region, and regions a priority.
REGION_ORDER = ("central_asia", "cis", *REGIONS[2:])
EURASIA = tuple(sorted({c for own in COUNTRIES.values() for c in own}))
MB_PRIORITY = {"central_asia": 3, "cis": 2} | dict.fromkeys(REGIONS[2:], 1)


def region_languages(region: str) -> tuple[str, ...]:
    """Languages that count for a region: for cis those of Central Asia too."""
    return _codes(" ".join(LANGUAGES[region] + (LANGUAGES["central_asia"] if region == "cis" else ())))


#: Script -> ranges of code points. A character of no range is Latin if it is a letter.
SCRIPTS = {
    "cyrillic": ((0x400, 0x52F),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "georgian": ((0x10A0, 0x10FF),),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "devanagari": ((0x900, 0x97F),),
    "indic": ((0x980, 0xDFF),),
    "thai": ((0xE00, 0xE7F),),
    "hiragana": ((0x3040, 0x309F),),
    "katakana": ((0x30A0, 0x30FF),),
    "cjk": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2A6DF)),
    "hangul": ((0xAC00, 0xD7AF), (0x1100, 0x11FF), (0xA960, 0xA97F)),
}

_RUSSIAN = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
#: Bare Cyrillic table of lower-case letters, for any language without one of its own.
CYRILLIC_PLAIN = dict(zip(_RUSSIAN, "a b v g d e yo zh z i y k l m n o p r s t u f kh ts ch sh shch _ y _ e yu ya".replace("_", "").split(" ")))
_UZBEK = dict(zip(_RUSSIAN + "ғқҳўҷ", "a b v g d ye yo j z i y k l m n o p r s t u f x ts ch sh sh ' i _ e yu ya g' q h o' j".replace("_", "").split(" ")))
#: Uzbek Cyrillic to the Latin alphabet of 1995, both cases; the capital hard sign is dropped.
UZBEK = _UZBEK | {k.upper(): v[:1].upper() + v[1:] for k, v in _UZBEK.items()} | {"Ъ": ""}
_ARABIC = """ا=a أ=a إ=i آ=a ٱ=a ٲ=a ب=b پ=p ت=t ث=th ج=j چ=ch ح=h خ=kh د=d ذ=dh ر=r ز=z ژ=zh س=s ش=sh ص=s ض=d ط=t ظ=z ع= غ=gh
ف=f ق=q ك=k گ=g ل=l م=m ن=n ه=h و=w ي=y ى=a ة=a ء= ئ=i ؤ=u َ=a ِ=i ُ=u ً=an ٍ=in ٌ=un ّ= ْ= ـ="""
#: Arabic and Persian letters to Latin, for search.
ARABIC = {pair.split("=")[0]: pair.split("=")[1] for pair in _ARABIC.split()}

#: MusicBrainz language (ISO 639-3) -> ISO 639-1, and script (ISO 15924) -> script name.
LANGUAGE_3_TO_1 = dict(x.split(":") for x in "ara:ar arm:hy aze:az bel:be ben:bn dan:da deu:de eng:en fin:fi fra:fr geo:ka heb:he hin:hi ind:id ita:it jpn:ja kaz:kk kir:ky kor:ko nld:nl nor:no pes:fa pol:pl por:pt ron:ro rus:ru spa:es swe:sv tgk:tg tha:th tuk:tk tur:tr ukr:uk uzb:uz vie:vi zho:zh".split())
#: Codes of several or of no languages: they have none.
NO_LANGUAGE = ("[mul]", "[zxx]")
SCRIPT_NAMES = dict(x.split(":") for x in "Arab:arabic Armn:armenian Cyrl:cyrillic Deva:devanagari Geor:georgian Hang:cjk Hani:cjk Hans:cjk Hant:cjk Hebr:hebrew Jpan:cjk Latn:latin".split())
COMPOSER_ROLES = _codes("composer co-composer music written-by")
LYRICIST_ROLES = _codes("lyricist co-lyricist lyrics librettist")
