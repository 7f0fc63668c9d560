"""The queries of the catalogue engine over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming as Z
from ..constants import REGIONS
from ..functions import language as L
from ..functions import regional as R
from ..functions import scoring as N
from ..functions import similarity as S
from ..functions import text as T
from ..functions import translit as X
from ..functions.html import extract_lyrics
from ..functions.script import detect_script, script_or_null
from ..operators import aggregate as A
from ..operators import export as K
from ..operators import filters as P
from ..operators import graph as G
from ..operators import joins as J
from ..operators import match as M
from ..operators import queue as W
from ..operators import resilience as B
from ..operators import upsert as U
from ..session import shared_dir
from . import duck as D
from .views import Views, duck

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
c = F.col
NOW_SQL = "timestamp '2024-01-20 00:00:00'"


def now() -> Column:
    """The time at which queues are looked at."""
    return F.lit("2024-01-20 00:00:00").cast("timestamp")


def query(sql: str | None = None) -> Callable[[Callable[[Views], DataFrame]], Callable[[Views], DataFrame]]:
    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = duck(sql)
        return f

    return add


# titles and fingerprints


@query(f"select spotify_id, {D.title('name')} as title from v_tracks union all select concat('doc:', doc_id), {D.title('title')} from v_candidates")
def normalize_title(v: Views) -> DataFrame:
    tracks = v("v_tracks").select("spotify_id", T.normalize_title(c("name")).alias("title"))
    return tracks.unionAll(v("v_candidates").select(F.concat(F.lit("doc:"), "doc_id"), T.normalize_title(c("title"))))


@query(f"select spotify_id, {D.fp_track('name', 'artist_id', 'duration_ms')} as fingerprint from v_tracks")
def fingerprint_track(v: Views) -> DataFrame:
    return v("v_tracks").select("spotify_id", T.fingerprint_track(c("name"), c("artist_id"), c("duration_ms")).alias("fingerprint"))


@query(f"select doc_id, {D.fp_candidate('title', 'artist', 'duration_ms')} as fingerprint from v_candidates")
def fingerprint_candidate(v: Views) -> DataFrame:
    return v("v_candidates").select("doc_id", T.fingerprint_candidate(c("title"), c("artist"), c("duration_ms")).alias("fingerprint"))


@query("select spotify_id, " + ", ".join(f"{D.fp_source('name', 'artists[1].name', 'duration_ms', s)} as {s}" for s in T.SOURCES) + " from v_tracks")
def fingerprint_source(v: Views) -> DataFrame:
    artist = F.get("artists", F.lit(0))["name"]
    return v("v_tracks").select("spotify_id", *(T.fingerprint_source(c("name"), artist, c("duration_ms"), s).alias(s) for s in T.SOURCES))


@query(f"select spotify_id, {D.bucket('duration_ms + n % 4000')} as bucket from v_tracks")
def duration_bucket(v: Views) -> DataFrame:
    return v("v_tracks").select("spotify_id", T.duration_bucket(c("duration_ms") + c("n") % 4000).alias("bucket"))


_DURATION = "case n % 5 when 0 then concat(n % 60, ':', lpad(cast(n % 60 as string), 2, '0')) when 1 then concat(n % 3, ':', n % 60, ':', n % 7) when 2 then 'abc' when 3 then '' else concat(n, ':x') end"


@query(f"select spotify_id, {D.seconds('text')} as duration_ms from (select spotify_id, {_DURATION} as text from v_tracks)")
def parse_duration(v: Views) -> DataFrame:
    return v("v_tracks").select("spotify_id", T.parse_duration(F.expr(_DURATION)).alias("duration_ms"))


@query(r"""select spotify_id, regexp_replace(name, '([\[\](){}^"~*?:\\!&|+-])', '\\\1', 'g') as escaped from v_tracks""")
def lucene_escape(v: Views) -> DataFrame:
    return v("v_tracks").select("spotify_id", T.lucene_escape(c("name")).alias("escaped"))


@query(r"""with e as (select *, artists[1].name as artist from v_tracks)
select spotify_id, concat(artist, ' ', name) as plain, concat('track:', name, ' artist:', artist) as fields, 'isrc:' || isrc as by_isrc,
  concat('recording:"', regexp_replace(name, '([\[\](){}^"~*?:\\!&|+-])', '\\\1', 'g'), '" AND artist:"', artist, '"') as recording from e""")
def query_builders(v: Views) -> DataFrame:
    artist = F.get("artists", F.lit(0))["name"]
    return v("v_tracks").select("spotify_id", T.plain_query(c("name"), artist).alias("plain"), T.field_query(c("name"), artist).alias("fields"), T.isrc_query(c("isrc")).alias("by_isrc"), T.recording_query(c("name"), artist).alias("recording"))


@query("""select n, s as strategy, case s when 0 then 'isrc:' || isrc when 1 then concat('track:', name, ' artist:', artists[1].name) else concat(artists[1].name, ' ', name) end as query
from v_tracks cross join (select cast(unnest([0, 1, 2]) as int) as s) where s > 0 or isrc is not null""")
def search_strategies(v: Views) -> DataFrame:
    rows = v("v_tracks").select("n", "isrc", c("name").alias("title"), F.get("artists", F.lit(0))["name"].alias("artist"))
    return M.search_strategies(rows).select("n", "strategy", "query")


_MESSAGE = "case when event_type = 'error' then concat('HTTP ', cast(400 + event_id % 32 as string)) when event_id % 17 = 0 then 'Too Many Requests' when event_id % 19 = 0 then null else event_type end"


@query(f"select event_id, {D.ban('message')} as banned from (select event_id, {_MESSAGE} as message from events)")
def ban_signals(v: Views) -> DataFrame:
    return v("events").select("event_id", T.ban_signal(F.expr(_MESSAGE)).alias("banned"))


@query("select doc_id, list_filter(list_transform(string_split(title, ','), lambda p: trim(p)), lambda p: p <> '') as parts from v_candidates")
def csv_list(v: Views) -> DataFrame:
    return v("v_candidates").select("doc_id", T.csv_list(c("title")).alias("parts"))


_RAW = """case n % 3 when 0 then concat('{"external_ids":{"isrc":"US', n, '"}}') when 1 then '{"external_ids":{"isrc":""}}' else '{"id":1}' end"""


@query(f"select n, nullif(json_extract_string({_RAW}, '$.external_ids.isrc'), '') as isrc from v_tracks")
def extract_isrc(v: Views) -> DataFrame:
    return v("v_tracks").select("n", T.isrc(F.expr(_RAW)).alias("isrc"))


@query("select n, case when code = 'rus' then 'ru' when code = 'eng' then 'en' when code = 'uzb' then 'uz' else substr(code, 1, 2) end as language from (select n, split_part('rus,eng,uzb,xyz', ',', cast(n % 4 + 1 as int)) as code from v_tracks)")
def language_codes(v: Views) -> DataFrame:
    from ..constants import LANGUAGE_3_TO_1

    code = F.expr("split_part('rus,eng,uzb,xyz', ',', cast(n % 4 + 1 as int))")
    return v("v_tracks").select("n", T.mapped(code, LANGUAGE_3_TO_1, F.substring(code, 1, 2)).alias("language"))


# pages

_HOSTED = """replace(html, '</head>', concat('<script src="https://cdn.example/', page_id, '.js"></script><script src="/local.js"></script><script>x={client_id:"abcdefghij', lpad(cast(page_id as string), 12, '0'), '"}</script></head>'))"""


@query(rf"""select page_id, regexp_extract_all(h, '<script[^>]+src="(https:' || '//[^"]+[.]js)"', 1) as urls, nullif(regexp_extract(h, 'client_id:"([A-Za-z0-9]{{20,40}})"', 1), '') as client_id from (select page_id, {_HOSTED} as h from pages)""")
def script_urls(v: Views) -> DataFrame:
    return v("pages").withColumn("h", F.expr(_HOSTED)).select("page_id", T.script_urls(c("h")).alias("urls"), T.client_id(c("h")).alias("client_id"))


@query()
def html_unescape(v: Views) -> DataFrame:
    return v("pages").select("page_id", T.html_unescape(c("html")).alias("text"))


@query()
def lyrics_of_pages(v: Views) -> DataFrame:
    page = F.concat(F.lit('<div data-lyrics-container="true">'), c("html"), F.lit("</div>"))
    return v("pages").select("page_id", extract_lyrics(page).alias("lyrics"))


# scripts, transliteration, language


@query(f"select id, {D.script('text')} as script from v_text")
def detect_scripts(v: Views) -> DataFrame:
    return v("v_text").select("id", detect_script(c("text")).alias("script"))


@query(f"select id, case when script not in ('unknown', 'mixed') then script end as script from (select id, {D.script('text')} as script from v_text)")
def known_scripts(v: Views) -> DataFrame:
    return v("v_text").select("id", script_or_null(c("text")).alias("script"))


@query(f"select id, {D.uzbek('text')} as text from v_text")
def uzbek_to_latin(v: Views) -> DataFrame:
    return v("v_text").select("id", X.uzbek_to_latin(c("text")).alias("text"))


@query(f"select id, {D.arabic('text')} as text from v_text")
def arabic_to_latin(v: Views) -> DataFrame:
    return v("v_text").select("id", X.arabic_to_latin(c("text")).alias("text"))


@query(f"select id, {D.cyrillic('text', 'language')} as text from (select id, text, case when id % 2 = 0 then 'uz' end as language from v_text)")
def cyrillic_to_latin(v: Views) -> DataFrame:
    return v("v_text").select("id", X.cyrillic_to_latin(c("text"), F.expr("case when id % 2 = 0 then 'uz' end")).alias("text"))


@query(f"select id, {D.ascii_only('text')} as text from v_text")
def ascii_to_latin(v: Views) -> DataFrame:
    return v("v_text").select("id", X.ascii_to_latin(c("text")).alias("text"))


@query(f"with s as materialized (select id, text, {D.script('text')} as own, case when id % 2 = 0 then 'uz' end as language from v_text) select id, {D.transliterate('text', 'own', 'language')} as text from s")
def transliterated(v: Views) -> DataFrame:
    return v("v_text").select("id", X.transliterate(c("text"), detect_script(c("text")), F.expr("case when id % 2 = 0 then 'uz' end")).alias("text"))


@query(f"with s as materialized (select id, text, {D.script('text')} as own, cast(null as varchar) as language from v_text) select id, coalesce({D.transliterate('text', 'own', 'language')}, text) as text from s")
def to_latin(v: Views) -> DataFrame:
    return v("v_text").select("id", X.to_latin(c("text")).alias("text"))


@query()
def hangul_to_latin(v: Views) -> DataFrame:
    return v("v_text").select("id", X.hangul_to_latin(c("text")).alias("text"))


@query(
    rf"""select id, trim(regexp_replace(trim(lower(regexp_replace(regexp_replace(nfkc, {D.quoted(X.SUFFIX)}, '', 'gi'), {D.quoted(X.GUESTS)}, '', 'gi'))), '\s+', ' ', 'g')) as name
from (select id, case when id % 4 = 0 then concat(replace(text, chr(10), ' '), ' (Live)') when id % 4 = 1 then concat(replace(text, chr(10), ' '), ' feat. X') else replace(text, chr(10), ' ') end as nfkc from v_text)"""
)
def normalize_names(v: Views) -> DataFrame:
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    text = F.when(c("id") % 4 == 0, F.concat(flat, F.lit(" (Live)"))).when(c("id") % 4 == 1, F.concat(flat, F.lit(" feat. X"))).otherwise(flat)
    return v("v_text").select("id", F.trim(X.normalize_name(text)).alias("name"))


@query()
def transliteration_columns(v: Views) -> DataFrame:
    own = X.transliteration_columns(c("text"), c("lang"), F.expr("case when id % 3 = 0 then 'arabic' end"), F.expr("case when id % 2 = 0 then 'uz' end"))
    return v("v_text").select("id", *(e.alias(n) for n, e in own.items()))


@query()
def detect_language(v: Views) -> DataFrame:
    return v("documents").select("doc_id", L.detect(c("text"))["language"].alias("language"))


@query()
def resolve_language(v: Views) -> DataFrame:
    own = L.resolve_language(F.expr("case when doc_id % 5 = 0 then 'uz' end"), F.lit("latin"), F.expr("doc_id % 2 = 0"), F.expr("case when doc_id % 3 = 0 then text end"), c("source"), F.array(F.substring("text", 1, 60)))
    return v("documents").select("doc_id", own.alias("r")).select("doc_id", "r.*")


# regions and scores


def _located(v: Views) -> DataFrame:
    artists = v("v_artists").select(c("spotify_id").alias("artist_id"), "country", "followers")
    return v("v_tracks").join(v("v_markets"), "spotify_id").join(artists, "artist_id")


_LOCATED = "(select t.*, m.markets, a.country, a.followers from v_tracks t join v_markets m using (spotify_id) join v_artists a on a.spotify_id = t.artist_id)"
_FLAGS = D.region_flags("[markets[1]]", "language", "country")


@query("select spotify_id, " + ", ".join(f"{e} as {n}" for n, e in _FLAGS.items()) + f" from {_LOCATED}")
def classify_regions(v: Views) -> DataFrame:
    own = R.classify_regions(F.array(F.get("markets", F.lit(0))), c("language"), c("country"))
    return _located(v).select("spotify_id", *(e.alias(n) for n, e in own.items()))


@query(f"select spotify_id, {D.artist_region('country')} as region from v_artists")
def artist_region(v: Views) -> DataFrame:
    return v("v_artists").select("spotify_id", R.artist_region(c("country")).alias("region"))


@query(f"select spotify_id, {D.mb_priority(_FLAGS, 'language', 'markets')} as by_regions, {D.mb_priority(None, 'language', '[markets[2]]')} as by_language from {_LOCATED}")
def mb_priority(v: Views) -> DataFrame:
    flags = R.classify_regions(F.array(F.get("markets", F.lit(0))), c("language"), c("country"))
    return _located(v).select("spotify_id", R.mb_priority(flags, c("language"), c("markets")).alias("by_regions"), R.mb_priority(None, c("language"), F.array(F.get("markets", F.lit(1)))).alias("by_language"))


@query(f"select spotify_id, {D.regional_score('markets', 'language', 'country', REGIONS)} as every_region, {D.regional_score('markets', 'language', 'country', ('cis', 'mena'))} as two_regions from {_LOCATED}")
def regional_score(v: Views) -> DataFrame:
    own = lambda targets: R.regional_score(c("markets"), c("language"), c("country"), targets)
    return _located(v).select("spotify_id", own(REGIONS).alias("every_region"), own(("cis", "mena")).alias("two_regions"))


@query(f"select spotify_id, {D.quality('popularity', 'followers', 'n', 'len(markets)')} as score from {_LOCATED}")
def quality_score(v: Views) -> DataFrame:
    return _located(v).select("spotify_id", N.quality_score(c("popularity"), c("followers"), c("n"), F.size("markets")).alias("score"))


@query(f"select spotify_id, {D.rounded('base * (1 - 0.15::double) + greatest(0.0, least(1.0, regional)) * 0.15::double', 6)} as score from (select spotify_id, {D.quality('popularity', 'followers', 'n', 'len(markets)')} as base, {D.regional_score('markets', 'language', 'country', REGIONS)} as regional from {_LOCATED})")
def quality_score_regional(v: Views) -> DataFrame:
    base = N.quality_score(c("popularity"), c("followers"), c("n"), F.size("markets"))
    return _located(v).select("spotify_id", N.quality_score_regional(base, R.regional_score(c("markets"), c("language"), c("country"))).alias("score"))


@query(f"select spotify_id, {D.priority('popularity', 'followers')} as priority, {D.priority('popularity', 'followers')} * 0.6::double as related, cast(floor(followers / 10000) as bigint) as rank_popularity from v_artists")
def artist_priority(v: Views) -> DataFrame:
    return v("v_artists").select("spotify_id", N.artist_priority(c("popularity"), c("followers")).alias("priority"), G.related_priority(c("popularity"), c("followers")).alias("related"), N.rank_popularity(c("followers")).alias("rank_popularity"))


# filters


@query(f"""select count(*) filter (where not coalesce(musicbrainz_enriched, false)) as not_true, count(*) filter (where isrc is null) as missing_isrc, count(*) filter (where status in ('failed', 'enriched')) as of_status,
 count(*) filter (where not coalesce(musicbrainz_enriched, false) and status in ('audio_features_added', 'base_collected', 'enriched', 'lyrics_added') and (quality_score >= 0.3 or mb_priority > 0)) as mb_eligible,
 count(*) filter (where lower(artists[1].name) = 'supplier 7') as same_name, count(*) filter (where quality_score between 0.2 and 0.4) as in_range from v_tracks""")
def null_safe_filters(v: Views) -> DataFrame:
    conditions = {
        "not_true": P.not_true(c("musicbrainz_enriched")),
        "missing_isrc": P.missing(c("isrc")),
        "of_status": c("status").isin("failed", "enriched"),
        "mb_eligible": P.mb_eligible(c("musicbrainz_enriched"), c("status"), c("quality_score"), c("mb_priority")),
        "same_name": P.same_name(F.get("artists", F.lit(0))["name"], "SUPPLIER 7"),
        "in_range": c("quality_score").between(0.2, 0.4),
    }
    return v("v_tracks").agg(*(F.count_if(e).alias(n) for n, e in conditions.items()))


@query("""select spotify_id, list_contains(markets, 'UZ') as in_market, len(list_filter(artists, lambda a: a.name = 'Supplier 3')) > 0 as by_artist, len(list_filter(markets, lambda m: m = 'ZZ')) = 0 as empty,
 artist_id <> '' and not contains(artist_id, ':') as real_id, starts_with(artist_id, 'deezer:') as deezer, followers = 0 or followers >= 10000 as enough from """ + _LOCATED)
def membership_filters(v: Views) -> DataFrame:
    return _located(v).select("spotify_id", P.in_market(c("markets"), "UZ").alias("in_market"), P.any_artist(c("artists"), "Supplier 3").alias("by_artist"), P.empty(F.filter("markets", lambda m: m == "ZZ")).alias("empty"), P.real_id(c("artist_id")).alias("real_id"), P.placeholder(c("artist_id"), "deezer").alias("deezer"), P.enough_followers(c("followers")).alias("enough"))


@query(f"select spotify_id from {_LOCATED} where {_FLAGS['cis']} or {_FLAGS['central_asia']} or {_FLAGS['mena']}")
def regional_or_filter(v: Views) -> DataFrame:
    own = R.classify_regions(F.array(F.get("markets", F.lit(0))), c("language"), c("country"))
    return _located(v).filter(own["cis"] | own["central_asia"] | own["mena"]).select("spotify_id")


@query("select spotify_id, name from v_tracks where status = 'enriched' order by popularity desc, spotify_id limit 25")
def scan_projected(v: Views) -> DataFrame:
    return P.scan(v("v_tracks"), c("status") == "enriched", ["spotify_id", "name"], [F.desc("popularity"), c("spotify_id")], 25)


@query("select spotify_id, case when quality_score >= 0.1 then 'enriched' else 'filtered_out' end as status from v_tracks")
def quality_threshold(v: Views) -> DataFrame:
    return v("v_tracks").select("spotify_id", P.quality_status(c("quality_score"), P.threshold(0.1)).alias("status"))


# joins


@query("select t.spotify_id, coalesce(a.followers, 0) as followers from v_tracks t left join v_artists a on a.spotify_id = t.artist_id and t.n % 3 > 0")
def left_lookup_followers(v: Views) -> DataFrame:
    tracks, artists = v("v_tracks"), v("v_artists").withColumnRenamed("spotify_id", "a_id")
    own = J.left_lookup(tracks, artists, (tracks["artist_id"] == artists["a_id"]) & (tracks["n"] % 3 > 0), "followers", F.lit(0))
    return own.select("spotify_id", "followers")


def _known(v: Views) -> tuple[DataFrame, DataFrame]:
    candidates = v("v_candidates").select("doc_id", T.fingerprint_candidate(c("title"), c("artist"), c("duration_ms")).alias("candidate_fingerprint"), F.expr("case when doc_id % 2 = 0 then concat('ISRC', cast(doc_id % 1500 as string)) end").alias("isrc"))
    tracks = v("v_tracks").select("isrc", F.lit("none").alias("fingerprint")).unionAll(candidates.filter("doc_id % 9 = 0").select(F.lit(None).cast("string"), "candidate_fingerprint"))
    return candidates, tracks


@query(f"""with k as (select doc_id, {D.fp_candidate('title', 'artist', 'duration_ms')} as fp, case when doc_id % 2 = 0 then concat('ISRC', cast(doc_id % 1500 as string)) end as isrc from v_candidates)
select doc_id from k where not exists (select 1 from v_tracks t where t.isrc = k.isrc) and not exists (select 1 from k o where o.doc_id % 9 = 0 and o.fp = k.fp)""")
def anti_known(v: Views) -> DataFrame:
    return J.anti_known(*_known(v)).select("doc_id")


@query("select distinct dst as node from v_edges where dst not in (select src from v_edges where src % 2 = 0)")
def anti_visited(v: Views) -> DataFrame:
    edges = v("v_edges")
    return J.anti_visited(edges.select(c("dst").alias("node")).distinct(), edges.filter("src % 2 = 0").select(c("src").alias("node")), "node")


@query("""with n as (select distinct spotify_id, lower(unnest(artists).name) as name from v_tracks), k as (select name, count(*) as n from n group by name)
select a.name, least(coalesce(k.n, 0), 50) as track_count, coalesce(k.n, 0) >= 50 as skip from (select distinct concat('SUPPLIER ', cast(n % 60 as string)) as name from v_tracks) a left join k on k.name = lower(a.name)""")
def semi_existing_artist(v: Views) -> DataFrame:
    return J.covered(v("v_tracks").select(F.concat(F.lit("SUPPLIER "), (c("n") % 60).cast("string")).alias("name")).distinct(), v("v_tracks"))


@query("select t.spotify_id, f.energy from v_tracks t left join (select spotify_id, cast(n % 100 as double) / 100 as energy from v_tracks where n % 3 <> 1) f using (spotify_id)")
def positional_features(v: Views) -> DataFrame:
    found = v("v_tracks").filter("n % 3 <> 1").select("spotify_id", ((c("n") % 100).cast("double") / 100).alias("energy"))
    return J.features(v("v_tracks").select("spotify_id"), found, "spotify_id")


_RESULTS = "select l_orderkey % 500 as key, split_part('spotify,deezer,jiosaavn,itunes', ',', cast(l_suppkey % 4 + 1 as int)) as source, l_quantity / 50 as score, {seq} as ord from lineitem"


@query(f"""with r as ({_RESULTS.format(seq="concat(lpad(cast(l_orderkey as string), 12, '0'), lpad(cast(l_partkey as string), 12, '0'), lpad(cast(l_suppkey as string), 12, '0'), lpad(cast(l_linenumber as string), 3, '0'))")}), g as (select *, list_position(['spotify', 'deezer', 'jiosaavn', 'itunes'], source) as p from r where score >= 0.9)
select key, source, score, ord from (select *, row_number() over (partition by key order by p, score desc, ord) as n from g) where n = 1""")
def fallback_match_rank(v: Views) -> DataFrame:
    seq = F.concat(*(F.lpad(c(x).cast("string"), w, "0") for x, w in (("l_orderkey", 12), ("l_partkey", 12), ("l_suppkey", 12), ("l_linenumber", 3))))
    source = F.get(F.array(*map(F.lit, ("spotify", "deezer", "jiosaavn", "itunes"))), (c("l_suppkey") % 4).cast("int"))
    results = v("lineitem").select((c("l_orderkey") % 500).alias("key"), source.alias("source"), (c("l_quantity") / 50).alias("score"), seq.alias("ord"))
    return J.first_hit(results, "key", ("spotify", "deezer", "jiosaavn", "itunes"), 0.9)


@query("select a.n, b.n as other_n, a.duration_ms, b.duration_ms as other_duration_ms from v_tracks a join v_tracks b on a.language = b.language and a.artist_id = b.artist_id and abs(a.duration_ms - b.duration_ms) <= 3000 where a.n <> b.n")
def interval_proximity(v: Views) -> DataFrame:
    rows = v("v_tracks").select(F.concat_ws("/", "language", "artist_id").alias("key"), "n", "duration_ms")
    return J.within(rows, rows, "key", "duration_ms", 3000).filter("n <> other_n").select("n", "other_n", "duration_ms", "other_duration_ms")


@query(f"""select n, {D.title('name')} as title, case when duration_ms > 0 and other > 0 then case when least(duration_ms, other)::double / greatest(duration_ms, other) >= 0.95 then 0.05 when least(duration_ms, other)::double / greatest(duration_ms, other) < 0.75 then -0.05 else 0.0 end else 0.0 end::double as adjustment
from (select n, name, duration_ms, case when n % 7 = 0 then 0 else duration_ms * (60 + n % 41) // 100 end as other from v_tracks)""")
def duration_adjustment(v: Views) -> DataFrame:
    other = F.expr("case when n % 7 = 0 then 0 else duration_ms * (60 + n % 41) div 100 end")
    return v("v_tracks").select("n", T.normalize_title(c("name")).alias("title"), S.duration_adjustment(c("duration_ms"), other).alias("adjustment"))


# aggregations

_WITH_FOLLOWERS = "(select t.*, a.followers as artist_followers from v_tracks t join v_artists a on a.spotify_id = t.artist_id)"


def _followed(v: Views) -> DataFrame:
    artists = v("v_artists").select(c("spotify_id").alias("artist_id"), c("followers").alias("artist_followers"))
    return v("v_tracks").join(artists, "artist_id")


@query(f"select artist_id, arg_min(artists[1].name, spotify_id) as name, count(*) as track_count, max(popularity) as popularity, max(artist_followers) as followers from {_WITH_FOLLOWERS} group by artist_id order by track_count desc, artist_id limit 500")
def top_artists(v: Views) -> DataFrame:
    return A.top_artists(_followed(v))


@query(f"""select artist_id, arg_min(name, spotify_id) as name, count(*) as track_count, max(popularity) as popularity, max(artist_followers) as followers, greatest({D.priority('max(popularity)', 'max(artist_followers)')}, 0.3) as priority
from (select replace(artist_id, ':', '-') as artist_id, artists[1].name as name, spotify_id, popularity, artist_followers from {_WITH_FOLLOWERS} where n % 5 < 3 and n % 11 > 0) group by artist_id order by track_count desc, artist_id limit 5000""")
def regional_top_artists(v: Views) -> DataFrame:
    rows = _followed(v).withColumn("artists", F.transform("artists", lambda a: F.struct(F.when(c("n") % 11 > 0, F.replace(a["spotify_id"], F.lit(":"), F.lit("-"))).otherwise(a["spotify_id"]).alias("spotify_id"), a["name"].alias("name"))))
    flags = F.struct((c("n") % 5 == 0).alias("cis"), (c("n") % 5 == 1).alias("central_asia"), (c("n") % 5 == 2).alias("mena"))
    return A.regional_top_artists(rows.withColumn("regions", flags))


@query("select distinct trim(lower(unnest(artists).name)) as name from v_tracks order by name")
def distinct_artist_names(v: Views) -> DataFrame:
    return A.distinct_artist_names(v("v_tracks"))


@query("select status, count(*) as n from v_tracks group by status")
def status_counts(v: Views) -> DataFrame:
    return A.status_counts(v("v_tracks"))


@query("""select 'queue' as queue, 'pending' as what, count(*) filter (where status = 'pending') as n from v_queue union all select 'queue', 'failed', count(*) filter (where status = 'failed') from v_queue
union all select 'candidates', 'open', count(*) filter (where not processed) from v_candidates union all select 'candidates', 'all', count(*) from v_candidates""")
def queue_depths(v: Views) -> DataFrame:
    queue = {"pending": c("status") == "pending", "failed": c("status") == "failed"}
    return A.depths({"queue": (v("v_queue"), queue), "candidates": (v("v_candidates"), {"open": ~c("processed"), "all": F.lit(True)})})


@query("select user_id, least(count(*), 50) as n from v_queue group by user_id")
def bounded_count(v: Views) -> DataFrame:
    return A.bounded_count(v("v_queue"), "user_id", 50)


@query("select count(isrc) as found, count(*) - count(isrc) as unavailable from v_tracks")
def feature_counts(v: Views) -> DataFrame:
    return A.found_and_missing(v("v_tracks"), "isrc")


@query("select event_type as counter, count(*) as n, cast(min(next_run_at) as string) as started_at, cast(max(next_run_at) as string) as updated_at from v_queue group by event_type")
def stat_counters(v: Views) -> DataFrame:
    own = A.counters(v("v_queue"), "event_type", "next_run_at")
    return own.withColumns({x: c(x).cast("string") for x in ("started_at", "updated_at")})


@query("select spotify_id, coalesce(list_filter(markets, lambda m: m in ('UZ', 'KZ', 'TJ'))[1], list_filter(markets, lambda m: m in ('RU', 'UA'))[1], markets[1]) as country from v_markets")
def country_by_priority(v: Views) -> DataFrame:
    return v("v_markets").select("spotify_id", A.by_priority(c("markets"), (("UZ", "KZ", "TJ"), ("RU", "UA"))).alias("country"))


@query("select playlist_id, list_sort(list_distinct(list(album_id))) as albums, min(cast(at_time as date))::varchar as first_date, list_sort(list_distinct(list(album_id)))[1:3] as some from v_occurrences group by playlist_id")
def mb_detail_sets(v: Views) -> DataFrame:
    albums = F.array_sort(F.collect_set("album_id"))
    return v("v_occurrences").groupBy("playlist_id").agg(albums.alias("albums"), F.min(c("at_time").cast("date")).cast("string").alias("first_date"), F.slice(albums, 1, 3).alias("some"))


# upserts


def _hits(v: Views) -> DataFrame:
    """Occurrences with what a discovery knows of its track."""
    tracks = v("v_tracks").select("spotify_id", "isrc", "name", T.fingerprint_track(c("name"), c("artist_id"), c("duration_ms")).alias("fingerprint"), "n")
    markets = F.expr("case when playlist_id % 3 = 0 then array(concat('M', cast(playlist_id % 50 as string))) else cast(array() as array<string>) end")
    placed = F.expr("case when playlist_id % 4 < 3 then concat('deezer:', spotify_id) else spotify_id end")
    return v("v_occurrences").join(tracks, "spotify_id").select(
        placed.alias("spotify_id"), "isrc", "fingerprint", "name", F.lit(1).alias("appearance_score"), markets.alias("markets"), F.array("album_id").alias("version_album_ids"), "mb_priority", c("at_time").cast("string").alias("updated_at"), F.when(c("playlist_id") % 5 == 0, c("playlist_id")).alias("youtube"), "seq"
    )


_HITS = f"""select case when o.playlist_id % 4 < 3 then concat('deezer:', o.spotify_id) else o.spotify_id end as spotify_id, t.isrc, t.fingerprint, t.name, case when o.playlist_id % 3 = 0 then [concat('M', cast(o.playlist_id % 50 as string))] else [] end as markets, o.album_id, o.mb_priority, cast(o.at_time as string) as updated_at, case when o.playlist_id % 5 = 0 then o.playlist_id end as youtube, o.seq,
  coalesce('i:' || t.isrc, 'f:' || t.fingerprint) as key from v_occurrences o join (select *, {D.fp_track('name', 'artist_id', 'duration_ms')} as fingerprint from v_tracks) t using (spotify_id)"""


def _folded(v: Views, fold: U.Fold, *columns: str) -> DataFrame:
    return U.upsert_fold(_hits(v), U.dedup_key(c("isrc"), c("fingerprint")), ["seq"], fold).select(*columns)


@query(f"with h as ({_HITS}) select arg_min(name, seq) as name, arg_min(fingerprint, seq) as fingerprint, cast(count(*) as integer) as appearance_score, arg_max(updated_at, seq) as updated_at from h group by key")
def upsert_count(v: Views) -> DataFrame:
    return _folded(v, U.DIRECT, "name", "fingerprint", "appearance_score", "updated_at")


@query(f"with h as ({_HITS}) select arg_min(name, seq) as name, arg_min(spotify_id, seq) as spotify_id, 1 as appearance_score, arg_max(updated_at, seq) as updated_at from h group by key")
def upsert_first_wins(v: Views) -> DataFrame:
    return _folded(v, U.GENRE, "name", "spotify_id", "appearance_score", "updated_at")


@query(f"""with h as ({_HITS}) select arg_min(name, seq) as name, cast(count(*) as integer) as appearance_score, list_sort(list_distinct(list(album_id))) as version_album_ids, coalesce(arg_min(markets, seq) filter (where len(markets) > 0), []) as markets,
 case when starts_with(arg_min(spotify_id, seq), 'deezer:') then coalesce(arg_min(spotify_id, seq) filter (where not starts_with(spotify_id, 'deezer:')), arg_min(spotify_id, seq)) else arg_min(spotify_id, seq) end as spotify_id from h group by key""")
def upsert_graph(v: Views) -> DataFrame:
    """Sets of albums, empty markets and placeholder ids filled."""
    return _folded(v, U.ARTIST_GRAPH, "name", "appearance_score", "version_album_ids", "markets", "spotify_id")


@query(f"with h as ({_HITS}) select arg_min(name, seq) as name, max(mb_priority) as mb_priority from h group by key")
def upsert_max(v: Views) -> DataFrame:
    return _folded(v, U.REGIONAL, "name", "mb_priority")


@query("select spotify_id, arg_max(album_id, seq) as name from v_occurrences group by spotify_id")
def upsert_overwrite(v: Views) -> DataFrame:
    return U.upsert_fold(v("v_occurrences").select("spotify_id", c("album_id").alias("name"), "seq"), c("spotify_id"), ["seq"], U.METADATA)


@query(f"with h as ({_HITS}) select arg_min(name, seq) as name, arg_min(youtube, seq) filter (where youtube is not null) as youtube from h group by key")
def upsert_conditional(v: Views) -> DataFrame:
    return _folded(v, U.VIDEO, "name", "youtube")


def _candidates(v: Views) -> DataFrame:
    return v("v_candidates").select("doc_id", "title", T.fingerprint_candidate(c("title"), c("artist"), c("duration_ms")).alias("candidate_fingerprint"))


@query(f"with k as (select doc_id, title, {D.fp_candidate('title', 'artist', 'duration_ms')} as fp from v_candidates) select arg_min(title, doc_id) as title, fp as candidate_fingerprint from k group by fp")
def upsert_candidates(v: Views) -> DataFrame:
    return U.upsert_fold(_candidates(v), c("candidate_fingerprint"), ["doc_id"], U.CANDIDATES)


@query(f"with k as (select doc_id, {D.fp_candidate('title', 'artist', 'duration_ms')} as fp from v_candidates), e as (select distinct fp from k where doc_id % 4 = 0), i as (select * from k where doc_id % 4 > 0) select count(distinct fp) filter (where fp not in (select fp from e)) as inserted, count(*) - count(distinct fp) filter (where fp not in (select fp from e)) as repeated from i")
def upsert_batch_counts(v: Views) -> DataFrame:
    rows = _candidates(v)
    return U.inserted_and_repeated(rows.filter("doc_id % 4 > 0"), "candidate_fingerprint", rows.filter("doc_id % 4 = 0"))


@query(f"with h as ({_HITS}) select arg_min(name, seq) as name, cast(count(*) as integer) as appearance_score from h group by key")
def upsert_in_two_batches(v: Views) -> DataFrame:
    """The earlier rows folded first, the others into what came of it."""
    rows, key = _hits(v), U.dedup_key(c("isrc"), c("fingerprint"))
    first = U.upsert_fold(rows.filter("seq < '1998'"), key, ["seq"], U.DIRECT)
    return U.upsert_fold(rows.filter("seq >= '1998'"), key, ["seq"], U.DIRECT, first).select("name", "appearance_score")


@query("select query, market from (select unnest(['pop', 'rock', 'folk']) as query) cross join (select distinct split_part('UZ,KZ,RU', ',', cast(n_nationkey % 3 + 1 as int)) as market from nation)")
def seed_cross_product(v: Views) -> DataFrame:
    from ..sources.seeds import crossed

    return crossed(v.spark, query=("pop", "rock", "folk"), market=("KZ", "RU", "UZ"))


# queue


def _when(sql: str) -> Column:
    return F.expr(sql)


_LOCK = f"(locked_at is null or locked_at < {NOW_SQL} - interval 300 second)"


@query(f"select item_id from v_queue where status = 'pending' or (status = 'processing' and locked_at < {NOW_SQL} - interval 300 second) order by item_id limit 50")
def claim_pending(v: Views) -> DataFrame:
    return W.claim_pending(v("v_queue"), now(), 50, [c("item_id")]).select("item_id")


@query(f"select item_id from v_queue where not processed and {_LOCK} order by item_id limit 50")
def claim_unprocessed(v: Views) -> DataFrame:
    return W.claim_unprocessed(v("v_queue"), now(), 50, [c("item_id")]).select("item_id")


@query(f"select item_id, priority from v_queue where not processed and {_LOCK} order by priority desc, item_id limit 50")
def claim_priority(v: Views) -> DataFrame:
    return W.claim_unprocessed(v("v_queue"), now(), 50, [F.desc("priority"), c("item_id")]).select("item_id", "priority")


@query(f"select item_id, cast(next_run_at as string) as due from v_queue where next_run_at <= {NOW_SQL} and {_LOCK} order by next_run_at, item_id limit 20")
def claim_due(v: Views) -> DataFrame:
    return W.claim_due(v("v_queue"), now(), 20).select("item_id", c("next_run_at").cast("string").alias("due"))


@query("select item_id, page from v_queue where status = 'pending' order by item_id limit 1")
def claim_one(v: Views) -> DataFrame:
    return W.claim_sorted(v("v_queue"), c("status") == "pending", [c("item_id")], 1).select("item_id", "page")


@query("select item_id, region from v_queue where status = 'pending' and region = 'central_asia' order by item_id limit 30")
def claim_region(v: Views) -> DataFrame:
    return W.claim_by_region(v("v_queue"), ("absent", "central_asia", "cis"), 30).select("item_id", "region")


@query(f"select item_id, 'processing' as status, 'w1' as locked_by, cast({NOW_SQL} as string) as locked_at from v_queue where status = 'pending' order by item_id limit 100")
def claim_bulk(v: Views) -> DataFrame:
    got = W.claimed(W.claim_sorted(v("v_queue"), c("status") == "pending", [c("item_id")], 100), now(), "w1")
    return got.select("item_id", "status", "locked_by", c("locked_at").cast("string").alias("locked_at"))


@query("select n, mb_priority from v_tracks where not coalesce(musicbrainz_enriched, false) order by status desc, mb_priority desc, n limit 40")
def claim_sorted(v: Views) -> DataFrame:
    return W.claim_sorted(v("v_tracks"), P.not_true(c("musicbrainz_enriched")), [F.desc("status"), F.desc("mb_priority"), c("n")], 40).select("n", "mb_priority")


@query("select item_id, retry_count + 1 as retry_count, case when retry_count + 1 >= 3 then 'failed' else 'pending' end as status from v_queue where status = 'processing'")
def retry_or_fail(v: Views) -> DataFrame:
    return W.retry_or_fail(v("v_queue").filter("status = 'processing'")).select("item_id", "retry_count", "status")


@query("select item_id, retry_count, 'pending' as status, true as unlocked from v_queue where status = 'processing'")
def release_without_penalty(v: Views) -> DataFrame:
    return W.release(v("v_queue").filter("status = 'processing'")).select("item_id", "retry_count", "status", c("locked_at").isNull().alias("unlocked"))


@query("select item_id, case when got < 50 or page >= max_pages then page else page + 1 end as page, case when got < 50 or page >= max_pages then 'done' else 'pending' end as status from v_queue")
def advance_cursor(v: Views) -> DataFrame:
    return W.advance(v("v_queue")).select("item_id", "page", "status")


@query("select item_id, case when status = 'done' then 1 else page end as page, case when status = 'done' then 'pending' else status end as status from v_queue where status <> 'pending'")
def cycle_reset(v: Views) -> DataFrame:
    return W.cycle_reset(v("v_queue").filter("status <> 'pending'")).select("item_id", "page", "status")


@query(f"select item_id, cast(case when status = 'failed' then next_run_at else {NOW_SQL} + interval 24 hour end as string) as next_run_at, runs + case when status = 'failed' then 0 else 1 end as runs from v_queue")
def reschedule(v: Views) -> DataFrame:
    return W.reschedule(v("v_queue"), now(), 24, c("status") == "failed").select("item_id", c("next_run_at").cast("string").alias("next_run_at"), "runs")


@query(f"select user_id, cast(min(t) as string) as processed_at from (select user_id, next_run_at as t from v_queue where status = 'done' union all select user_id, {NOW_SQL} from v_queue where status = 'failed') group by user_id")
def visited_cache(v: Views) -> DataFrame:
    rows = v("v_queue")
    cache = rows.filter("status = 'done'").select("user_id", c("next_run_at").alias("processed_at"))
    return W.mark_visited(cache, rows.filter("status = 'failed'").select("user_id"), "user_id", now()).select("user_id", c("processed_at").cast("string").alias("processed_at"))


@query("""select spotify_id, case when status = 'base_collected' then 'audio_features_added' else status end as audio, case when status = 'audio_features_added' then 'lyrics_added' else status end as lyrics,
 case when status in ('lyrics_added', 'audio_features_added') then case when quality_score >= 0.1 then 'enriched' else 'filtered_out' end else status end as quality from v_tracks""")
def state_transition(v: Views) -> DataFrame:
    return v("v_tracks").select("spotify_id", W.transition(c("status"), "audio").alias("audio"), W.transition(c("status"), "lyrics").alias("lyrics"), W.transition(c("status"), "quality", c("quality_score")).alias("quality"))


@query("select item_id, ['before', substr(repeat(event_type, 60), 1, 200)] as error_log from v_queue")
def error_log(v: Views) -> DataFrame:
    return v("v_queue").select("item_id", W.with_error(F.array(F.lit("before")), F.repeat("event_type", 60)).alias("error_log"))


# graph

_BFS = """with recursive b as (select c_custkey as node, 0 as depth from customer where c_custkey < 3 union select e.dst, b.depth + 1 from b join {edges} e on e.src = b.node where b.depth < 5) select node, min(depth) as depth from b group by node"""


def _seeds(v: Views) -> DataFrame:
    return v("customer").filter("c_custkey < 3").select(c("c_custkey").alias("node"), F.lit(1.0).alias("priority"))


@query(_BFS.format(edges="v_edges"))
def bfs_min_depth(v: Views) -> DataFrame:
    return G.bfs(v("v_edges"), _seeds(v), 5).select("node", "depth")


@query(_BFS.format(edges="(select * from (select *, row_number() over (partition by src order by dst) as k from v_edges) where k <= 2)"))
def bfs_capped(v: Views) -> DataFrame:
    edges = G.capped(v("v_edges").withColumn("kind", F.lit("appears_on")), {"appears_on": 2, "album": 0}, c("dst"))
    return G.bfs(edges.select("src", "dst"), _seeds(v), 5).select("node", "depth")


@query("""with recursive b as (select c_custkey as node, 0 as depth from customer where c_custkey < 3 union select e.dst, b.depth + 1 from b join v_edges e on e.src = b.node where b.depth < 30),
d as (select node, min(depth) as depth from b group by node) select d.node, d.depth, case when d.depth = 0 then 1.0 else (select max(cast(e.src % 10 as double) / 10) from v_edges e join d p on p.node = e.src and p.depth = d.depth - 1 where e.dst = d.node) end::double as priority from d""")
def bfs_unlimited(v: Views) -> DataFrame:
    return G.bfs(v("v_edges").withColumn("priority", (c("src") % 10).cast("double") / 10), _seeds(v), None).filter("depth <= 30")


@query(f"select artist_id from (select artist_id, count(*) as n from {_WITH_FOLLOWERS} group by artist_id order by n desc, artist_id limit 500)")
def graph_bootstrap(v: Views) -> DataFrame:
    return G.bootstrap(v("v_queue").filter("false"), _followed(v), v("v_artists").select("spotify_id"))


# matching


def _pairs(v: Views, n: int) -> DataFrame:
    """Tracks of one artist, as a search for each would find them: its first ``n`` at least."""
    own = v("v_tracks").select("n", "artist_id", T.normalize_title(c("name")).alias("title"), F.get("artists", F.lit(0))["name"].alias("artist"), "duration_ms", "isrc")
    other = own.select("artist_id", *(c(x).alias(f"other_{y}") for x, y in (("n", "n"), ("title", "title"), ("artist", "artist"), ("duration_ms", "ms"), ("isrc", "isrc"))))
    return M.first_pairs(own, other, "artist_id", "n", n)


@query()
def fuzzy_best_match(v: Views) -> DataFrame:
    return M.fuzzy_match(_pairs(v, 5), "n", ["other_n"]).select("n", "other_n", N.rounded(c("score"), 6).alias("score"))


@query("select a.n, b.n as other_n from v_tracks a join v_tracks b on upper(a.isrc) = upper(b.isrc) and a.n <> b.n")
def isrc_fast_path(v: Views) -> DataFrame:
    tracks = v("v_tracks").filter("isrc is not null").select("n", F.upper("isrc").alias("i"))
    return tracks.join(tracks.withColumnRenamed("n", "other_n"), "i").filter("n <> other_n").select("n", "other_n")


@query()
def mb_confidence(v: Views) -> DataFrame:
    score = S.mb_confidence(c("title"), c("artist"), c("other_title"), c("other_artist"), c("duration_ms"), c("other_ms"), c("other_n") % 101)
    return M.scored_match(_pairs(v, 10), "n", ["other_n"], score, 0.75, 10).select("n", "other_n", "score")


@query()
def genius_confidence(v: Views) -> DataFrame:
    return M.scored_match(_pairs(v, 5), "n", ["other_n"], S.name_confidence(c("title"), c("artist"), c("other_title"), c("other_artist")), 0.6, 5).select("n", "other_n", "score")


@query()
def video_confidence(v: Views) -> DataFrame:
    return M.scored_match(_pairs(v, 1), "n", ["other_n"], S.name_confidence(c("title"), c("artist"), c("other_title"), c("other_artist"), 3), 0.65, 1).select("n", "other_n", "score")


@query()
def artist_name_ratio(v: Views) -> DataFrame:
    return M.scored_match(_pairs(v, 5), "n", ["other_n"], S.name_ratio(c("title"), c("other_title")), 60, 5).select("n", "other_n", "score")


# resilience


def _events(v: Views) -> DataFrame:
    event = F.when(c("event_type") == "error", "fail").when(c("event_type") == "view", "check").otherwise("ok")
    return v("v_queue").select(c("user_id").cast("string").alias("service"), c("item_id").alias("seq"), F.unix_micros("next_run_at").cast("double").alias("us"), event.alias("event"))


@query()
def breaker_fold(v: Views) -> DataFrame:
    return B.breaker_fold(_events(v).withColumn("at", c("us") / 1e6), 2, 120.0)


@query()
def token_bucket_fold(v: Views) -> DataFrame:
    return B.bucket_fold(_events(v).withColumn("at", c("us") / 1e6), 0.001, 1.0)


_RUNS = "with e as (select user_id, item_id, status = 'failed' as bad from v_queue), r as (select *, sum(case when bad then 0 else 1 end) over (partition by user_id order by item_id) as run from e), s as (select user_id, item_id, cast(sum(case when bad then 1 else 0 end) over (partition by user_id, run order by item_id) as bigint) as streak from r)"


@query(f"{_RUNS} select user_id, item_id, streak, case when streak > 0 and streak % 2 = 0 then 300 else 0 end as pause from s")
def error_streaks(v: Views) -> DataFrame:
    return B.back_off(v("v_queue").select("user_id", "item_id", (c("status") == "failed").alias("bad")), "user_id", ["item_id"], c("bad"), 2).select("user_id", "item_id", "streak", "pause")


@query("select item_id, max(case when status = 'failed' then 1 else 0 end) over (partition by user_id order by item_id) = 1 as latched from v_queue")
def sticky_flag(v: Views) -> DataFrame:
    return B.latched(v("v_queue"), "user_id", ["item_id"], c("status") == "failed").select("item_id", "latched")


@query(f"{_RUNS}, m as (select user_id, min(item_id) as stop from s where streak >= 2 group by user_id) select item_id from s left join m using (user_id) where item_id <= coalesce(stop, item_id)")
def seeder_early_exit(v: Views) -> DataFrame:
    return B.early_exit(v("v_queue"), "user_id", ["item_id"], c("status") == "failed", 2).select("item_id")


# export and the flagship


def _documents(v: Views) -> DataFrame:
    """Tracks with all nested columns, some of them null."""
    return v("v_tracks").select(
        "*",
        F.when(c("n") % 3 > 0, F.struct(F.concat(F.lit("Album "), (c("n") % 9).cast("string")).alias("name"), F.lit("album").alias("album_type"), F.lit(None).cast("string").alias("release_date"))).alias("album"),
        F.when(c("n") % 4 > 0, F.struct(*(((c("n") % k).cast("double") / k).alias(x) for k, x in enumerate("danceability energy key loudness mode speechiness acousticness instrumentalness liveness valence tempo time_signature".split(), 2)))).alias("audio_features"),
        F.when(c("n") % 5 > 0, F.struct(F.when(c("n") % 2 > 0, F.lit("la la")).otherwise("").alias("text"), c("language"), F.lit("g").alias("genius_url"), F.lit(0.5).alias("confidence_score"))).alias("lyrics"),
        (c("n") % 20).cast("int").alias("markets_count"), F.lit(1).alias("appearance_score"), F.lit(0).cast("bigint").alias("artist_followers"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"),
    )


_FLAT_FEATURES = ", ".join(f"case when n % 4 > 0 then cast(n % {k} as double) / {k} end as {x}" for k, x in enumerate("danceability energy key loudness mode speechiness acousticness instrumentalness liveness valence tempo time_signature".split(), 2))


@query(f"""select spotify_id, coalesce(isrc, '') as isrc, name, artists[1].name as artists_names, artist_id as primary_artist_id, case when n % 3 > 0 then concat('Album ', n % 9) else '' end as album_name, case when n % 3 > 0 then 'album' else '' end as album_type, '' as release_date,
 popularity, duration_ms, case when explicit then 'True' else 'False' end as explicit, cast(n % 20 as integer) as markets_count, 1 as appearance_score, quality_score, cast(0 as bigint) as artist_followers, case when n % 4 > 0 then 'True' else 'False' end as has_audio_features, {_FLAT_FEATURES},
 case when n % 5 > 0 and n % 2 > 0 then 'True' else 'False' end as has_lyrics, case when n % 5 > 0 then language end as lyrics_language, case when n % 5 > 0 then 'g' end as genius_url, case when n % 5 > 0 then 0.5::double end as lyrics_confidence, status, '2024-01-01 00:00:00' as created_at, '' as updated_at
from v_tracks where status = 'enriched'""")
def export_flat(v: Views) -> DataFrame:
    return K.flat(K.ordered(_documents(v)))


@query("""select '{"spotify_id":"' || spotify_id || '","n":' || n || ',"at":"2024-01-01T00:00:00.000000Z"}' as value from v_tracks where status = 'enriched'""")
def export_json(v: Views) -> DataFrame:
    own = K.ordered(v("v_tracks")).select("spotify_id", "n", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("at"))
    return K.json_lines(own)


@query(f"""with t as (select *, {D.fp_track('name', 'artist_id', 'duration_ms')} as fingerprint from v_tracks),
h as (select t.*, m.markets, o.seq, coalesce('i:' || t.isrc, 'f:' || t.fingerprint) as key from v_occurrences o join t using (spotify_id) join v_markets m using (spotify_id)),
u as (select arg_min(spotify_id, seq) as spotify_id, arg_min(name, seq) as name, arg_min(artist_id, seq) as artist_id, arg_min(popularity, seq) as popularity, arg_min(markets, seq) as markets, count(*) as appearances from h group by key),
s as (select u.spotify_id, {D.title('u.name')} as title, u.appearances, {D.quality('u.popularity', 'a.followers', 'u.appearances', 'len(u.markets)')} as score from u left join v_artists a on a.spotify_id = u.artist_id)
select * from s where score >= 0.1 order by score desc, spotify_id limit 100""")
def score_filter_topk(v: Views) -> DataFrame:
    """Normalise, fingerprint, upsert, look up followers, score, filter, and the best 100."""
    tracks = v("v_tracks").join(v("v_markets"), "spotify_id").withColumn("fingerprint", T.fingerprint_track(c("name"), c("artist_id"), c("duration_ms")))
    hits = v("v_occurrences").select("spotify_id", "seq").join(tracks, "spotify_id").select("spotify_id", "isrc", "fingerprint", "name", "artist_id", "popularity", "markets", F.lit(1).cast("bigint").alias("appearances"), "seq")
    rows = U.upsert_fold(hits, U.dedup_key(c("isrc"), c("fingerprint")), ["seq"], U.Fold(count="appearances"))
    artists = v("v_artists").withColumnRenamed("spotify_id", "a_id")
    rows = J.left_lookup(rows, artists, rows["artist_id"] == artists["a_id"], "followers", F.lit(0))
    scored = rows.select("spotify_id", T.normalize_title(c("name")).alias("title"), "appearances", N.quality_score(c("popularity"), c("followers"), c("appearances"), F.size("markets")).alias("score"))
    return scored.filter(P.quality_status(c("score")) == "enriched").orderBy(F.desc("score"), "spotify_id").limit(100)


# streams, run to the end of what there is


def _stream(v: Views) -> DataFrame:
    kinds = v("events").schema
    rows = v.spark.readStream.schema(kinds).parquet(f"{v.sf_dir}/events.parque[t]")
    return rows.withColumn("at", c("ts").cast("timestamp"))


def _drained(v: Views, stream: DataFrame, mode: str) -> DataFrame:
    """All that a stream gives, written to the shared folder and read again; of a mode other than append what its last batch gives."""
    at = f"{shared_dir(v.spark)}/cataloom-stream-{uuid.uuid4().hex}"
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if mode == "append":
        out.format("parquet").option("path", f"{at}/out").start().awaitTermination(600)
    else:
        out.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/out")).start().awaitTermination(600)
    return v.spark.read.schema(stream.schema).parquet(f"{at}/out")


@query("select distinct user_id, event_type from events")
def stream_dedup(v: Views) -> DataFrame:
    return _drained(v, Z.deduplicated(_stream(v).select("user_id", "event_type"), ["user_id", "event_type"]), "append")


@query("select event_type, arg_min(event_id, event_id) as first_event, count(*) as n from events group by event_type")
def stream_upsert(v: Views) -> DataFrame:
    at = f"{shared_dir(v.spark)}/cataloom-stream-{uuid.uuid4().hex}"
    rows = _stream(v).select("event_type", c("event_id").alias("first_event"), F.lit(1).cast("bigint").alias("n"), c("event_id").alias("seq"))
    table = Z.Snapshots(v.spark, f"{at}/table")
    Z.upserting(rows, table, lambda: c("event_type"), ["seq"], U.Fold(count="n"), f"{at}/state", {"availableNow": True}).awaitTermination(600)
    return table.latest()


@query("select cast(date_trunc('day', ts) as string) as day, event_type, count(*) as n from events group by 1, 2")
def stream_windows(v: Views) -> DataFrame:
    """One file is one batch, so nothing is late."""
    own = Z.counted(_stream(v), "at", "1 day", ["event_type"], "1 hour")
    return _drained(v, own.withColumn("day", F.date_format("start", "yyyy-MM-dd HH:mm:ss")).select("day", "event_type", "n"), "complete")


@query(f"select event_id from events where ts <= {NOW_SQL}")
def stream_due(v: Views) -> DataFrame:
    return _drained(v, Z.due(_stream(v), "at", now).select("event_id"), "append")


@query()
def stream_breaker(v: Views) -> DataFrame:
    event = F.when(c("event_type") == "error", "fail").when(c("event_type") == "view", "check").otherwise("ok")
    rows = _stream(v).select(c("user_id").cast("string").alias("service"), c("event_id").alias("seq"), (F.unix_micros("at") / 1e6).alias("at"), event.alias("event"))
    return _drained(v, Z.breakers(rows, 2), "update")
