"""Expressions in DuckDB's SQL, written apart from the engine's own."""

from __future__ import annotations

from collections.abc import Iterable

from ..constants import ARABIC, COUNTRIES, CYRILLIC_PLAIN, EURASIA, LANGUAGES, MB_PRIORITY, REGION_ORDER, REGIONS, SCRIPTS, UZBEK, region_languages
from ..functions.text import BAN_SIGNALS, EDITION, FEATURING, SOURCES


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values: Iterable[str]) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def title(x: str) -> str:
    out = f"regexp_replace({x}, {quoted(EDITION)}, '', 'gi')"
    out = f"regexp_replace({out}, {quoted(FEATURING)}, '', 'gi')"
    out = f"lower(regexp_replace({out}, '^[0-9]{{1,3}}[.\\s-]\\s*', ''))"
    return f"trim(regexp_replace(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def bucket(ms: str) -> str:
    return f"cast(round_even(cast({ms} as double) / 2000, 0) * 2000 as bigint)"


def fp_track(name: str, artist_id: str, ms: str) -> str:
    return f"sha256(concat({title(name)}, '|', {artist_id}, '|', {bucket(ms)}))"


def fp_candidate(name: str, artist: str, ms: str) -> str:
    return f"sha256(concat({title(name)}, '|', {title(artist)}, case when coalesce({ms}, 0) <> 0 then concat('|', {bucket(ms)}) else '' end))"


def fp_source(name: str, artist: str, ms: str, source: str) -> str:
    strip, timed, salt = SOURCES[source]
    tail = (f", '|', {bucket(f'coalesce({ms}, 0)')}" if timed else "") + (f", '|{salt}'" if salt else "")
    return f"sha256(concat(trim(lower(regexp_replace({name}, {quoted(strip)}, '', 'gi'))), '|', trim(lower({artist})){tail}))"


def rounded(x: str, places: int) -> str:
    return f"floor(({x}) * {10**places} + 0.5) / {10**places}"


def share(x: str, most: int) -> str:
    return f"greatest(0.0, least(1.0, cast(coalesce({x}, 0) as double) / {most}))"


def quality(popularity: str, followers: str, appearances: str, markets: str) -> str:
    parts = ((0.40, popularity, 100), (0.30, followers, 50_000_000), (0.20, appearances, 200), (0.10, markets, 185))
    return rounded(" + ".join(f"cast({w} as double) * {share(x, most)}" for w, x, most in parts), 6)


def priority(popularity: str, followers: str) -> str:
    return rounded(f"cast(0.4 as double) * {share(popularity, 100)} + cast(0.3 as double) * least(ln(1 + cast(greatest(coalesce({followers}, 0), 0) as double)) / 14, 1.0)", 4)


def ban(message: str) -> str:
    return "(" + " or ".join(f"contains(lower(coalesce({message}, '')), {quoted(s)})" for s in BAN_SIGNALS) + ")"


def upper_list(markets: str) -> str:
    return f"list_distinct(list_transform(coalesce({markets}, []), lambda m: upper(m)))"


def region_flags(markets: str, language: str, country: str) -> dict[str, str]:
    own = f"list_concat({upper_list(markets)}, case when coalesce({country}, '') <> '' then [upper({country})] else [] end)"
    flags = {r: f"list_has_any({own}, {listed(COUNTRIES[r])}) or coalesce(list_contains({listed(region_languages(r))}, {language}), false)" for r in REGIONS}
    return flags | {"countries": f"list_sort(list_distinct(list_intersect({own}, {listed(EURASIA)})))", "artist_origin_region": artist_region(country)}


def artist_region(country: str) -> str:
    return "case " + " ".join(f"when list_contains({listed(COUNTRIES[r])}, upper({country})) then '{r}'" for r in REGION_ORDER) + " end"


def mb_priority(flags: dict[str, str] | None, language: str, markets: str) -> str:
    rules = [f"when {flags[r]} then {MB_PRIORITY[r]}" for r in REGION_ORDER] if flags else []
    rules += [f"when list_contains({listed(LANGUAGES[r])}, {language}) then {MB_PRIORITY[r]}" for r in REGION_ORDER]
    rules += [f"when list_has_any({upper_list(markets)}, {listed(COUNTRIES[r])}) then {MB_PRIORITY[r]}" for r in REGION_ORDER]
    return f"case {' '.join(rules)} else 0 end"


def regional_score(markets: str, language: str, country: str, targets: Iterable[str]) -> str:
    countries = sorted({c for r in targets for c in COUNTRIES[r]})
    languages = sorted({x for r in targets for x in region_languages(r)})
    hits = f"cast(len(list_intersect({upper_list(markets)}, {listed(countries)})) as double)"
    high = (*LANGUAGES["east_asia"], *LANGUAGES["southeast_asia"])
    spoken = f"case when not coalesce(list_contains({listed(languages)}, {language}), false) then 0.0 when list_contains({listed(LANGUAGES['central_asia'])}, {language}) then 0.3 when list_contains({listed(high)}, {language}) then 0.25 else 0.2 end"
    home = f"case when list_contains({listed(countries)}, upper({country})) then 0.2 else 0.0 end"
    return rounded(f"least(least({hits} / cast({max(len(countries) * 0.1, 1)!r} as double), 1.0) * 0.5 + cast({spoken} as double) + cast({home} as double), 1.0)", 4)


def _class(ranges: tuple[tuple[int, int], ...]) -> str:
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges)


def script(x: str) -> str:
    every = "".join(map(_class, SCRIPTS.values()))
    entries = [f"struct_pack(n := length(regexp_replace({x}, '[^{_class(r)}]', '', 'g')), pos := -length(regexp_extract({x}, '^[^{_class(r)}]*')), script := '{s}')" for s, r in SCRIPTS.items()]
    entries.append(f"struct_pack(n := length(regexp_replace({x}, '[^\\p{{L}}]|[{every}]', '', 'g')), pos := -1000000000, script := 'latin')")
    own = f"list_filter([{', '.join(entries)}], lambda e: e.n > 0)"
    total = lambda names=None: f"coalesce(list_sum(list_transform(list_filter(o, lambda e: {'true' if names is None else f'list_contains({listed(names)}, e.script)'}), lambda e: e.n)), 0)"
    decide = f"case when len(o) = 0 then 'unknown' when {total(('hiragana', 'katakana'))} > 0 and {total(('hiragana', 'katakana', 'cjk'))} * 2 >= {total()} then 'japanese' when list_reverse_sort(o)[1].n * 2 < {total()} and len(o) > 1 then 'mixed' else list_reverse_sort(o)[1].script end"
    return f"list_transform([{own}], lambda o: {decide})[1]"


def by_table(x: str, table: dict[str, str], low: bool = False) -> str:
    pairs = ", ".join(f"{quoted(a)}: {quoted(b)}" for a, b in table.items())
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: coalesce(map {{{pairs}}}[{'lower(c)' if low else 'c'}], c)), '')"


def uzbek(x: str) -> str:
    return by_table(x, UZBEK)


def arabic(x: str) -> str:
    return f"trim(regexp_replace({by_table(x, ARABIC)}, '\\s+', ' ', 'g'))"


def cyrillic(x: str, language: str) -> str:
    return f"case when coalesce({language}, 'ru') = 'uz' then {uzbek(x)} else {by_table(x, CYRILLIC_PLAIN, True)} end"


def ascii_only(x: str) -> str:
    return f"trim(regexp_replace({x}, '[^\\x00-\\x7F]', '', 'g'))"


def transliterate(x: str, own: str, language: str) -> str:
    """``own`` is a column: the script of ``x``."""
    out = f"case when {own} = 'arabic' then {arabic(x)} when {own} in ('cyrillic', 'georgian', 'armenian') then {cyrillic(x, language)} when {own} in ('cjk', 'japanese', 'hiragana', 'katakana', 'hangul', 'devanagari', 'indic', 'thai') then {ascii_only(x)} end"
    return f"case when coalesce({x}, '') <> '' then list_transform([{out}], lambda r: case when r is null then null when trim(r) <> '' then r else {x} end)[1] end"


def seconds(text: str) -> str:
    """A duration text as milliseconds."""
    parts = f"list_transform(string_split({text}, ':'), lambda p: try_cast(trim(p) as bigint))"
    whole = "len(list_filter(p, lambda n: n is null)) = 0"
    return f"list_transform([{parts}], lambda p: case when {whole} and len(p) = 2 then (p[1] * 60 + p[2]) * 1000 when {whole} and len(p) = 3 then (p[1] * 3600 + p[2] * 60 + p[3]) * 1000 end)[1]"
