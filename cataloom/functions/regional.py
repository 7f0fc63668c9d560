"""Regions of a record by markets, language and artist country."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import COUNTRIES, EURASIA, LANGUAGES, MB_PRIORITY, REGION_ORDER, REGIONS, region_languages
from .scoring import rounded


def _array(codes: Iterable[str]) -> Column:
    return F.array(*map(F.lit, codes))


def _upper(codes: Column) -> Column:
    return F.array_distinct(F.transform(F.coalesce(codes, F.array().cast("array<string>")), F.upper))


def classify_regions(markets: Column, language: Column, artist_country: Column, release_countries: Column | None = None) -> dict[str, Column]:
    """One boolean a region, and countries: the Eurasian ones of all signals, sorted."""
    own = F.concat(_upper(markets), F.when(F.coalesce(artist_country, F.lit("")) != "", F.array(F.upper(artist_country))).otherwise(F.array().cast("array<string>")))
    if release_countries is not None:
        own = F.concat(own, _upper(release_countries))
    out = {r: F.arrays_overlap(own, _array(COUNTRIES[r])) | F.coalesce(language.isin(*region_languages(r)), F.lit(False)) for r in REGIONS}
    return out | {"countries": F.array_sort(F.array_intersect(own, _array(EURASIA))), "artist_origin_region": artist_region(artist_country)}


def artist_region(country: Column) -> Column:
    """The first region, in order, that a country belongs to."""
    out = F.when(F.upper(country).isin(*COUNTRIES[REGION_ORDER[0]]), REGION_ORDER[0])
    for region in REGION_ORDER[1:]:
        out = out.when(F.upper(country).isin(*COUNTRIES[region]), region)
    return out


def mb_priority(regions: dict[str, Column] | None, language: Column, markets: Column) -> Column:
    """3 to 0: by the flags of ``regions``, else by language, else by markets."""
    rules: list[tuple[Column, int]] = []
    if regions is not None:
        rules += [(F.coalesce(regions[r], F.lit(False)), MB_PRIORITY[r]) for r in REGION_ORDER]
    rules += [(language.isin(*LANGUAGES[r]), MB_PRIORITY[r]) for r in REGION_ORDER]
    rules += [(F.arrays_overlap(_upper(markets), _array(COUNTRIES[r])), MB_PRIORITY[r]) for r in REGION_ORDER]
    out = F.when(rules[0][0], rules[0][1])
    for rule, value in rules[1:]:
        out = out.when(rule, value)
    return out.otherwise(0)


def regional_score(markets: Column, language: Column, artist_country: Column, targets: Iterable[str] = REGIONS) -> Column:
    """0 to 1: up to half for markets in the target regions, which a tenth of all of them fills; up to .3 for the language; .2 for the artist's country."""
    targets = [r for r in targets if r in COUNTRIES]
    if not targets:
        return F.lit(0.0)
    countries = sorted({c for r in targets for c in COUNTRIES[r]})
    languages = sorted({x for r in targets for x in region_languages(r)})
    hits = F.size(F.array_intersect(_upper(markets), _array(countries))).cast("double")
    market = F.least(hits / max(len(countries) * 0.1, 1), F.lit(1.0)) * 0.5
    full, high = LANGUAGES["central_asia"], (*LANGUAGES["east_asia"], *LANGUAGES["southeast_asia"])
    spoken = F.when(~F.coalesce(language.isin(*languages), F.lit(False)), 0.0).when(language.isin(*full), 0.3).when(language.isin(*high), 0.25).otherwise(0.2)
    home = F.when(F.upper(artist_country).isin(*countries), 0.2).otherwise(0.0)
    return rounded(F.least(market + spoken + home, F.lit(1.0)), 4)
