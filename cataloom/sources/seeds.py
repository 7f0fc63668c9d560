"""Literal seed relations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def literal(spark: SparkSession, column: str, values: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def crossed(spark: SparkSession, **lists: Sequence[str]) -> DataFrame:
    """Every combination of the lists' values, a column each: queries by market, kinds by genre, countries by chart."""
    return reduce(DataFrame.crossJoin, (literal(spark, name, values) for name, values in lists.items()))


#: Genres, keywords and the like are the caller's; these are a start.
GENRES = "pop rock hip-hop electronic folk jazz classical metal reggae soul country blues punk latin k-pop".split()
#: Charts by country.
SHAZAM_COUNTRIES = tuple(sorted("AE AM AR AT AU AZ BD BE BG BR BY CA CH CL CN CO CZ DE DK DZ EC EG ES ET FI FR GB GE GH GR HK HR HU ID IE IL IN IQ IT JO JP KE KR KW KZ LB LK MA MD MX MY NG NL NO NZ PE PH PK PL PT QA RO RS RU SA SE SG SI SK TH TN TR TW UA US UZ VE VN ZA".split()))
APPLE_COUNTRIES = tuple(sorted("ae am au az bd bg br by ca cn cz de dz eg fr gb ge gr hk hr hu id in iq ir jp kg kr kw kz lb lk ma md mm mn mx my np ph pk pl qa ro rs ru sa sg sk th tj tn tr tw ua us uz vn za".split()))
APPLE_CHARTS = ("hot-tracks", "most-played")
YTMUSIC_COUNTRIES = tuple(sorted("AE AR AU BD BR CA CL CO CZ DE EG ES FR GB GH HK ID IN IT JP KE KR MA MX MY NG NL NZ PE PH PK PL RU SA SE SG TH TR TW UA US VN ZA".split()))
SOUNDCLOUD_KINDS = ("top", "trending")
LASTFM_METHODS = ("chart", "tag")
#: Searches by market alone: keywords crossed with the markets of each region.
MARKET_KEYWORDS = tuple(sorted("best folk hits music pop popular rap top".split()))
MARKETS = {"central_asia": "KG KZ TJ UZ", "cis": "AM AZ GE", "mena": "AE EG KW QA SA", "eastern_europe": "BG GR HU PL RO RS", "south_asia": "BD IN", "east_asia": "HK JP KR TW", "southeast_asia": "ID MY PH TH VN"}
#: Playlists of the NetEase charts.
NETEASE_PLAYLISTS = tuple(sorted((180106, 351952284, 2250011882, 2809513713, 2809577409, 2884035, 3082010842, 3136952023, 3778678, 3779629, 5059644681, 5082060500, 19723756)))


def market_seeds(spark: SparkSession) -> DataFrame:
    """(query, market, region) of the searches by market."""
    rows = [(word, market, region) for region, markets in MARKETS.items() for market in markets.split() for word in MARKET_KEYWORDS]
    return spark.createDataFrame(rows, "query string, market string, region string")


def queue_seeds(spark: SparkSession, **lists: Sequence[str]) -> DataFrame:
    """Crossed lists as fresh queue items: pending, page 1, no retry."""
    from pyspark.sql import functions as F

    return crossed(spark, **lists).withColumns({"status": F.lit("pending"), "page": F.lit(1), "retry_count": F.lit(0)})
