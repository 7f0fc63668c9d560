"""Queries over parsers: records of each service are spelled as JSON from the tracks, parsed, and held to the tracks themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import parsers as R
from . import duck as D
from .catalogue import query
from .views import Views


def text(path: str, value: str) -> str:
    """SQL for a member with a text."""
    return f"""'"{path}":"', {value}, '"'"""


def number(path: str, value: str) -> str:
    return f"""'"{path}":', cast({value} as string)"""


def record(*members: str) -> str:
    """SQL for a JSON record."""
    return "concat('{', " + ", ',', ".join(members) + ", '}')"


def inside(path: str, *members: str) -> str:
    return f"""'"{path}":', {record(*members)}"""


def among(path: str, *records: str) -> str:
    return f"""'"{path}":[', """ + ", ',', ".join(records) + ", ']'"


A = "concat('Artist ', cast(n % 40 as string))"
NAME = text("name", "name")
OF_ARTIST = inside("artist", text("name", A))
SECONDS = "n % 300 + 1"


def parsed(raw: str, expected: str, *select: str) -> Callable[[Callable[[DataFrame], DataFrame]], object]:
    """Registers a parser: ``raw`` over v_tracks is the record, ``select`` flattens what the parser gives, ``expected`` is the SQL."""

    def add(parser: Callable[[DataFrame], DataFrame]) -> object:
        def run(v: Views) -> DataFrame:
            out = parser(v("v_tracks").selectExpr("*", f"{raw} as raw"))
            return out.selectExpr(*select) if select else out

        run.__name__ = f"parse_{parser.__name__}"
        return query(expected)(run)

    return add


parsed(
    f"case n % 5 when 0 then {record(NAME, OF_ARTIST, text('duration', f'cast({SECONDS} as string)'))} when 1 then {record(text('name', 'concat(name, chr(32))'), text('artist', A))} when 2 then {record(NAME)} when 3 then {record(text('name', 'chr(32)'), text('artist', A))} else {record(NAME, OF_ARTIST, number('duration', '0'))} end",
    f"select trim(name) as title, {A} as artist, case when n % 5 = 0 then ({SECONDS}) * 1000 end as duration_ms from v_tracks where n % 5 in (0, 1, 4)",
)(R.lastfm)
parsed(
    f"case n % 3 when 0 then {record(text('title', 'name'), among('artists', record(text('name', A)), record(text('name', 'name'))), number('duration_seconds', SECONDS), text('duration', repr('9:59')), text('videoId', 'spotify_id'))} when 1 then {record(text('title', 'name'), among('artists', record(text('name', A))), text('duration', repr('1:02:03')))} else {record(text('title', 'name'))} end",
    f"select name as title, {A} as artist, cast(case when n % 3 = 0 then ({SECONDS}) * 1000 else 3723000 end as bigint) as duration_ms, case when n % 3 = 0 then spotify_id end as youtube_video_id from v_tracks where n % 3 < 2",
)(R.ytmusic)
parsed(
    f"case n % 4 when 0 then {record(inside('songs', among('items', record(NAME), record(number('id', 'n')))))} when 1 then {record(inside('Songs', among('content', record(NAME))))} when 2 then {record(inside('songs', text('items', 'name')))} else {record(NAME)} end",
    "select concat('{\"name\":\"', name, '\"}') as raw from v_tracks where n % 4 < 2 union all select concat('{\"id\":', n, '}') from v_tracks where n % 4 = 0",
)(R.chart_songs)
parsed(
    f"case n % 4 when 0 then {record(number('id', 'n + 1'), text('title', f'concat({A}, {chr(39)} - {chr(39)}, name)'))} when 1 then {record(number('id', 'n + 1'), text('title', 'name'))} when 2 then {record(text('title', 'name'))} else {record(number('id', 'n + 1'), text('title', 'substr(name, 1, 0)'))} end",
    f"select case when n % 4 = 0 then {A} else 'Various Artists' end as artist, name as title, n + 1 as release_id from v_tracks where n % 4 < 2",
)(R.discogs_search)


def _tracklist(rows: DataFrame) -> DataFrame:
    return R.discogs_tracklist(rows.withColumn("fallback", F.lit("None")))


_tracklist.__name__ = "discogs_tracklist"
parsed(
    record(number("id", "n"), among("artists", record(text("name", A))), among("tracklist", record(text("type_", "'heading'"), text("title", "'Side'")), record(text("title", "name"), text("duration", "concat(cast(n % 60 as string), ':07')")), record(text("title", "'Two'"), among("artists", record(text("name", "'Own'")))))),
    f"select name as title, {A} as artist, (n % 60) * 60000 + 7000 as duration_ms, n as discogs_release_id, 1 as position from v_tracks union all select 'Two', 'Own', null, n, 2 from v_tracks",
)(_tracklist)
parsed(
    f"case n % 3 when 0 then {record(inside('track', inside('heading', text('title', 'name'), text('subtitle', A)), number('key', 'n + 1'), inside('stores', inside('apple', text('isrc', 'concat(chr(32), spotify_id)'), number('trackid', 'n + 5')))))} when 1 then {record(inside('heading', text('title', 'name'), text('subtitle', A)), text('key', 'spotify_id'))} else {record(inside('heading', text('title', 'name'), text('subtitle', A)))} end",
    f"select name as title, {A} as artist, case when n % 3 = 0 then spotify_id end as isrc, case when n % 3 = 0 then cast(n + 1 as string) else spotify_id end as shazam_key, case when n % 3 = 0 then cast(n + 5 as string) end as apple_track_id from v_tracks where n % 3 < 2",
)(R.shazam)
parsed(
    f"case n % 3 when 0 then {record(text('id', 'spotify_id'), text('title', 'concat(name, chr(38), chr(97), chr(109), chr(112), chr(59))'), inside('more_info', text('primary_artists', f'concat({A}, {chr(39)}, B{chr(39)})'), text('duration', f'cast({SECONDS} as string)'), text('language', repr('Hindi'))))} when 1 then {record(text('song_id', 'spotify_id'), text('song', 'name'), inside('more_info', inside('artistMap', among('primary_artists', record(text('name', A))))), text('duration', repr('x')))} else {record(text('id', 'spotify_id'), text('title', 'name'))} end",
    f"select spotify_id as id, case when n % 3 = 0 then concat(name, chr(38)) else name end as title, {A} as artist, case when n % 3 = 0 then ({SECONDS}) * 1000 else 0 end as duration_ms, case when n % 3 = 0 then 'hindi' else '' end as language from v_tracks where n % 3 < 2",
)(R.jiosaavn)
parsed(
    f"case n % 3 when 0 then {record(number('id', 'n + 1'), NAME, among('ar', record(text('name', A))), number('dt', 'duration_ms'))} when 1 then {record(number('id', 'n + 1'), NAME, among('artists', record(text('name', A))), number('duration', 'n'))} else {record(number('id', '0'), NAME, among('ar', record(text('name', A))))} end",
    f"select n + 1 as id, name, {A} as artist_name, case when n % 3 = 0 then duration_ms else n end as duration_ms from v_tracks where n % 3 < 2",
)(R.netease)
parsed(
    f"case n % 3 when 0 then {record(number('id', 'n + 1'), text('title', 'name'), inside('user', text('username', A)), number('duration', 'duration_ms'), text('genre', 'language'))} when 1 then {record(number('id', 'n + 1'), text('title', 'name'), inside('user', text('username', 'substr(name, 1, 0)'), text('full_name', A)), text('permalink_url', 'spotify_id'))} else {record(number('id', 'n + 1'), text('title', 'name'))} end",
    f"select n + 1 as id, name as title, {A} as artist, case when n % 3 = 0 then duration_ms else 0 end as duration_ms, case when n % 3 = 0 then language else '' end as genre, case when n % 3 = 0 then '' else spotify_id end as permalink_url from v_tracks where n % 3 < 2",
)(R.soundcloud)
parsed(
    record(number("id", "n"), text("title", "name"), among("artists", record(number("id", "n % 2"), text("name", A)), record(number("id", "7"), text("name", "'B'"))), among("albums", record(number("id", "n % 3"), text("title", "name"))), number("duration_ms", "duration_ms")),
    f"select cast(n as string) as id, name as title, case when n % 2 = 1 then [{A}, 'B'] else ['B'] end as artists, case when n % 3 > 0 then name end as album, duration_ms from v_tracks",
    "id",
    "title",
    "transform(artists, a -> a.name) as artists",
    "album.title as album",
    "duration_ms",
)(R.yandex)

_SPOTIFY = record(text("id", "spotify_id"), NAME, among("artists", record(text("id", "artist_id"), text("name", A)), record(text("name", "'no id'"))), inside("album", text("id", "'al'"), NAME), number("popularity", "popularity"), number("duration_ms", "duration_ms"), number("explicit", "explicit"), among("available_markets", "'\"UZ\"'", "'\"KZ\"'"), inside("external_ids", text("isrc", "coalesce(isrc, '')")))
_TRACK_SELECT = ("spotify_id", "isrc", "fingerprint", "name", "artists[0].spotify_id as artist_id", "size(artists) as n_artists", "markets_count", "popularity", "explicit", "status", "duration_ms")
parsed(
    f"case n % 4 when 3 then {record(text('id', 'spotify_id'), NAME)} else {_SPOTIFY} end",
    f"select spotify_id, isrc, {D.fp_track('name', 'artist_id', 'duration_ms')} as fingerprint, name, artist_id, 1 as n_artists, popularity, duration_ms, explicit, 2 as markets_count, 'base_collected' as status, 'al' as album, 1 as appearance_score from v_tracks where n % 4 < 3",
    *_TRACK_SELECT,
    "album.spotify_id as album",
    "appearance_score",
)(R.spotify_track)
parsed(
    f"case n % 4 when 3 then {record(text('id', 'spotify_id'), NAME)} else {_SPOTIFY} end",
    f"select spotify_id, case when n % 4 < 3 then isrc end as isrc, {D.fp_track('name', 'artist_id', 'case when n % 4 < 3 then duration_ms else 0 end')} as fingerprint, name, artist_id, 1 as n_artists, case when n % 4 < 3 then popularity else 0 end as popularity, case when n % 4 < 3 then duration_ms else 0 end as duration_ms, n % 4 < 3 and explicit as explicit, case when n % 4 < 3 then 2 else 0 end as markets_count, 'base_collected' as status from v_tracks",
    *_TRACK_SELECT,
)(R.album_track)

_PLACED = ("spotify_id", "isrc", "fingerprint", "name", "artists[0].spotify_id as artist_id", "artists[0].name as artist", "album.spotify_id as album", "popularity", "duration_ms", "explicit")
parsed(
    f"case n % 3 when 2 then {record(number('id', 'n + 1'), text('title', 'name'))} else {record(number('id', 'n + 1'), text('title', 'case when n % 2 = 0 then name else substr(name, 1, 0) end'), text('title_short', 'name'), inside('artist', number('id', 'n % 40'), text('name', A)), number('rank', 'n * 7919'), number('duration', SECONDS), text('isrc', 'coalesce(isrc, substr(name, 1, 0))'), number('explicit_lyrics', 'explicit'), inside('album', number('id', 'n + 2'), text('title', 'name')))} end",
    f"select concat('deezer:', n + 1) as spotify_id, isrc, {D.fp_candidate('name', A, f'({SECONDS}) * 1000')} as fingerprint, name, concat('deezer:', n % 40) as artist_id, {A} as artist, concat('deezer_album:', n + 2) as album, n * 7919 // 10000 as popularity, ({SECONDS}) * 1000 as duration_ms, explicit from v_tracks where n % 3 < 2",
    *_PLACED,
)(R.deezer_track)
parsed(
    f"case n % 3 when 2 then {record(text('id', 'spotify_id'), text('title', 'name'))} else {record(text('id', 'spotify_id'), text('title', 'name'), text('artist', A), number('duration_ms', 'duration_ms'))} end",
    f"select concat('jiosaavn:', spotify_id) as spotify_id, cast(null as varchar) as isrc, {D.fp_candidate('name', A, 'duration_ms')} as fingerprint, name, concat('jiosaavn_artist:', spotify_id) as artist_id, {A} as artist, cast(null as varchar) as album, cast(0 as bigint) as popularity, duration_ms, false as explicit from v_tracks where n % 3 < 2",
    *_PLACED,
)(R.jiosaavn_track)
_ITUNES = record(text("wrapperType", "'track'"), text("kind", "case when n % 4 = 3 then 'album' else 'song' end"), number("trackId", "n + 1"), text("trackName", "name"), text("artistName", A), number("collectionId", "n + 2"), text("releaseDate", "'2020-01-02T00:00:00Z'"), number("trackTimeMillis", "duration_ms"), text("trackExplicitness", "case when explicit then 'explicit' else 'no' end"))
parsed(
    _ITUNES,
    f"select concat('itunes:', n + 1) as spotify_id, cast(null as varchar) as isrc, {D.fp_candidate('name', A, 'duration_ms')} as fingerprint, name, concat('itunes_artist:', n + 1) as artist_id, {A} as artist, cast(null as varchar) as album, cast(0 as bigint) as popularity, duration_ms, explicit from v_tracks",
    *_PLACED,
)(R.itunes_track)
parsed(
    _ITUNES,
    f"select concat('itunes:', n + 1) as spotify_id, cast(null as varchar) as isrc, {D.fp_candidate('name', A, 'duration_ms')} as fingerprint, name, 'itunes:0' as artist_id, {A} as artist, concat('itunes_album:', n + 2) as album, cast(0 as bigint) as popularity, duration_ms, explicit, '2020-01-02' as released from v_tracks where n % 4 < 3",
    *_PLACED,
    "album.release_date as released",
)(R.itunes_song)
parsed(
    f"case n % 3 when 2 then {record(NAME, text('artistName', A))} else {record(text('id', 'spotify_id'), NAME, text('artistName', A))} end",
    f"select concat('itunes:', spotify_id) as spotify_id, cast(null as varchar) as isrc, {D.fp_candidate('name', A, 'null::bigint')} as fingerprint, name, concat('itunes:rss:', {A}) as artist_id, {A} as artist, cast(null as varchar) as album, cast(0 as bigint) as popularity, cast(0 as bigint) as duration_ms, false as explicit from v_tracks where n % 3 < 2",
    *_PLACED,
)(R.rss_entry)
parsed(
    record(text("id", "spotify_id"), text("title", "name"), among("aliases", record(NAME), record(text("name", "substr(name, 1, 0)"))), among("relations", record(text("type", "'Composer'"), inside("artist", text("name", A))), record(text("type", "'composer'"), inside("artist", text("name", A))), record(text("type", "'lyrics'"), inside("artist", text("name", "name")))), among("releases", record(text("country", "'KZ'"), text("date", "'2001'"), among("label-info", record(inside("label", text("name", "'Z'"))), record(inside("label", text("name", "'A'"))))), record(text("country", "'UZ'"), text("date", "concat('19', cast(10 + n % 90 as string))"), among("release-events", record(text("date", "'1950'"))), inside("text-representation", text("language", "'rus'"), text("script", "'Cyrl'"))))),
    f"select spotify_id as mbid, name as canonical_title, [name] as aliases, [{A}] as composers, [name] as lyricists, concat('19', 10 + n % 90) as first_release_date, ['KZ', 'UZ'] as release_countries, ['A', 'Z'] as labels, 'ru' as language, 'cyrillic' as script, cast([] as varchar[]) as tags from v_tracks",
)(R.mb_detail)


@query("select spotify_id, replace(concat('host/', artist_id, '/%%'), '%%', '200x200') as cover from v_tracks")
def cover_url(v: Views) -> DataFrame:
    return v("v_tracks").select("spotify_id", T.cover_url(F.concat(F.lit("host/"), "artist_id", F.lit("/%%"))).alias("cover"))
