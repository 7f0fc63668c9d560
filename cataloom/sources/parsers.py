"""Raw JSON records to normalised rows.  Each parser takes a DataFrame with a string column ``raw`` and gives one row a usable record (``release`` and ``chart`` parsers: one a track)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import COMPOSER_ROLES, LANGUAGE_3_TO_1, LYRICIST_ROLES, NO_LANGUAGE, SCRIPT_NAMES
from ..functions import text as T

RAW = "raw"


def at(path: str, raw: str | Column = RAW) -> Column:
    """A value of a JSON record as text, null where it is missing."""
    return F.get_json_object(F.col(raw) if isinstance(raw, str) else raw, f"$.{path}")


def said(value: Column) -> Column:
    """Trimmed; null if blank."""
    return F.nullif(F.trim(value), F.lit(""))


def first(*values: Column) -> Column:
    return F.coalesce(*values)


def _true(value: Column) -> Column:
    """Null for what counts as nothing: '', '0' of a number, 'false', '[]', '{}'."""
    return F.when(~value.isin("", "0", "false", "[]", "{}", "null"), value)


def _parts(json: Column) -> Column:
    """The elements of a JSON list, as texts."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def _int(value: Column) -> Column:
    return value.try_cast("bigint")


def lastfm(rows: DataFrame) -> DataFrame:
    """(title, artist, duration_ms): the artist may be a record or a name; seconds, of which the text '0' is 0."""
    artist = F.when(F.substring(F.ltrim(at("artist")), 1, 1) == "{", at("artist.name")).otherwise(at("artist"))
    quoted = F.regexp_like(F.col(RAW), F.lit(r'"duration"\s*:\s*"'))
    seconds = F.when(quoted, _int(F.nullif(at("duration"), F.lit("")))).otherwise(F.nullif(_int(at("duration")), F.lit(0)))
    return rows.select(said(at("name")).alias("title"), said(artist).alias("artist"), (seconds * 1000).alias("duration_ms")).filter("title is not null and artist is not null")


def ytmusic(rows: DataFrame) -> DataFrame:
    """(title, artist, duration_ms, youtube_video_id): the first artist; seconds before 'M:SS'."""
    head = F.get(_parts(at("artists")), F.lit(0))
    artist = F.when(F.substring(F.ltrim(head), 1, 1) == "{", F.get_json_object(head, "$.name")).otherwise(head)
    ms = first(_int(at("duration_seconds")) * 1000, T.parse_duration(at("duration")))
    return rows.select(said(at("title")).alias("title"), said(artist).alias("artist"), ms.alias("duration_ms"), _true(at("videoId")).alias("youtube_video_id")).filter("title is not null and artist is not null")


def chart_songs(rows: DataFrame) -> DataFrame:
    """(raw) of every song of a chart: songs or Songs, of that items or content."""
    section = first(_true(at("songs")), _true(at("Songs")))
    items = first(_true(F.get_json_object(section, "$.items")), _true(F.get_json_object(section, "$.content")))
    return rows.select(F.explode(_parts(F.when(F.substring(F.ltrim(items), 1, 1) == "[", items))).alias(RAW))


def discogs_search(rows: DataFrame) -> DataFrame:
    """(artist, title, release_id): 'Artist - Title', or Various Artists."""
    title = at("title")
    split = F.split(title, " - ", 2)
    pair = F.size(split) == 2
    artist = F.when(pair, said(F.get(split, F.lit(0)))).otherwise(F.lit("Various Artists"))
    own = F.when(pair, said(F.get(split, F.lit(1)))).otherwise(said(title))
    out = rows.select(artist.alias("artist"), own.alias("title"), F.nullif(_int(at("id")), F.lit(0)).alias("release_id"))
    return out.filter("artist is not null and title is not null and release_id is not null")


def discogs_tracklist(rows: DataFrame, fallback: str = "fallback") -> DataFrame:
    """(title, artist, duration_ms, discogs_release_id, position) of every track: headings are left out; the track's artist counts before the release's, that before the column ``fallback``."""
    kind = "struct<id: bigint, artists: array<struct<name: string>>, tracklist: array<struct<type_: string, title: string, duration: string, artists: array<struct<name: string>>>>>"
    doc = rows.select(F.from_json(RAW, kind).alias("d"), F.col(fallback).alias("f"))
    head = lambda artists, other: F.when(F.size(artists) > 0, F.trim(F.coalesce(F.get(artists, F.lit(0))["name"], other))).otherwise(other)
    tracks = doc.select(F.coalesce("d.id", F.lit(0)).alias("discogs_release_id"), head(F.col("d.artists"), F.col("f")).alias("of"), F.posexplode("d.tracklist").alias("position", "t"))
    tracks = tracks.filter("coalesce(t.type_, '') not in ('heading', 'index')")
    return tracks.select(said(F.col("t.title")).alias("title"), head(F.col("t.artists"), F.col("of")).alias("artist"), T.parse_duration(F.col("t.duration")).alias("duration_ms"), "discogs_release_id", "position").filter("title is not null")


def shazam(rows: DataFrame) -> DataFrame:
    """(title, artist, isrc, shazam_key, apple_track_id); the record may lie under track."""
    own = F.when(_true(at("track")).isNotNull(), at("track")).otherwise(F.col(RAW))
    key = first(_true(at("key", own)), _true(at("key")))
    out = rows.select(said(at("heading.title", own)).alias("title"), said(at("heading.subtitle", own)).alias("artist"), said(at("stores.apple.isrc", own)).alias("isrc"), key.alias("shazam_key"), said(_true(at("stores.apple.trackid", own))).alias("apple_track_id"))
    return out.filter("title is not null and artist is not null and shazam_key is not null")


def jiosaavn(rows: DataFrame) -> DataFrame:
    """(id, title, artist, duration_ms, language): the artist by the map's first, else the first name of a list with commas; entities as characters."""
    blank = lambda c: F.nullif(T.html_unescape(c), F.lit(""))
    head = F.get(_parts(at("more_info.artistMap.primary_artists")), F.lit(0))
    # members are read once a row: what names them more than once stands in selects of its own
    read = rows.select(
        said(first(_true(at("id")), _true(at("song_id")))).alias("id"),
        first(_true(at("title")), _true(at("song"))).alias("_title"),
        head.alias("_head"),
        first(*(_true(at(p)) for p in ("more_info.primary_artists", "more_info.artist", "primary_artists", "artist"))).alias("_listed"),
        first(_true(at("more_info.duration")), _true(at("duration")), F.lit("0")).alias("_seconds"),
        F.trim(F.lower(first(_true(at("more_info.language")), _true(at("language")), F.lit("")))).alias("language"),
    )
    read = read.select("*", F.when(F.substring(F.ltrim("_head"), 1, 1) == "{", F.get_json_object("_head", "$.name")).otherwise(F.col("_head")).alias("_mapped"))
    names = F.filter(F.transform(F.split(T.html_unescape(F.col("_listed")), ","), lambda n: F.trim(n)), lambda n: n != "")
    out = F.struct(
        "id",
        blank(F.col("_title")).alias("title"),
        first(blank(F.col("_mapped")), F.get(names, F.lit(0))).alias("artist"),
        (F.coalesce(_int(F.col("_seconds")), F.lit(0)) * 1000).alias("duration_ms"),
        "language",
    )
    # filtered as a record, as a filter of columns would be pushed below the UDFs and repeat them
    return read.select(F.inline(F.filter(F.array(out), lambda r: r["id"].isNotNull() & r["title"].isNotNull() & r["artist"].isNotNull())))


def netease(rows: DataFrame) -> DataFrame:
    """(id, name, artist_name, duration_ms): the first of ar or artists; dt or duration."""
    head = F.get(_parts(first(_true(at("ar")), _true(at("artists")))), F.lit(0))
    ms = F.coalesce(_int(first(_true(at("dt")), _true(at("duration")))), F.lit(0))
    out = rows.select(F.nullif(_int(at("id")), F.lit(0)).alias("id"), said(at("name")).alias("name"), said(F.get_json_object(head, "$.name")).alias("artist_name"), ms.alias("duration_ms"))
    return out.filter("id is not null and name is not null and artist_name is not null")


def soundcloud(rows: DataFrame) -> DataFrame:
    """(id, title, artist, duration_ms, genre, permalink_url): the uploader is the artist."""
    text = lambda p: F.trim(F.coalesce(at(p), F.lit("")))
    artist = said(first(_true(at("user.username")), at("user.full_name")))
    out = rows.select(F.nullif(_int(at("id")), F.lit(0)).alias("id"), said(at("title")).alias("title"), artist.alias("artist"), F.coalesce(_int(at("duration")), F.lit(0)).alias("duration_ms"), text("genre").alias("genre"), text("permalink_url").alias("permalink_url"))
    return out.filter("id is not null and title is not null and artist is not null")


def yandex(rows: DataFrame) -> DataFrame:
    """(id, title, artists, album, duration_ms): artists with id and name, the first album if it has an id."""
    kind = "struct<id: string, title: string, artists: array<struct<id: bigint, name: string>>, albums: array<struct<id: bigint, title: string, year: int, cover_uri: string>>, duration_ms: bigint>"
    d = F.from_json(RAW, kind)
    artists = F.filter(F.coalesce(d["artists"], F.array().cast("array<struct<id: bigint, name: string>>")), lambda a: (F.coalesce(a["id"], F.lit(0)) != 0) & (F.coalesce(a["name"], F.lit("")) != ""))
    album = F.get(d["albums"], F.lit(0))
    album = F.when(F.coalesce(album["id"], F.lit(0)) != 0, F.struct(album["id"].alias("id"), F.coalesce(album["title"], F.lit("")).alias("title"), album["year"].alias("year"), album["cover_uri"].alias("cover_uri")))
    return rows.select(d["id"].alias("id"), F.coalesce(d["title"], F.lit("")).alias("title"), artists.alias("artists"), album.alias("album"), d["duration_ms"].alias("duration_ms"))


_IMAGES = "array<map<string,string>>"
_TRACK = "struct<id: string, name: string, artists: array<struct<id: string, name: string>>, album: struct<id: string, name: string, release_date: string, album_type: string, total_tracks: int, images: array<map<string,string>>>, popularity: int, duration_ms: bigint, explicit: boolean, available_markets: array<string>, external_ids: struct<isrc: string>>"


def _artists(d: Column) -> Column:
    own = F.filter(F.coalesce(d["artists"], F.array().cast("array<struct<id: string, name: string>>")), lambda a: F.coalesce(a["id"], F.lit("")) != "")
    return F.transform(own, lambda a: F.struct(a["id"].alias("spotify_id"), F.coalesce(a["name"], F.lit("")).alias("name")))


def _album(d: Column) -> Column:
    a = d["album"]
    return F.when(F.coalesce(a["id"], F.lit("")) != "", F.struct(a["id"].alias("spotify_id"), F.coalesce(a["name"], F.lit("")).alias("name"), a["release_date"].alias("release_date"), a["album_type"].alias("album_type"), a["total_tracks"].alias("total_tracks"), F.coalesce(a["images"], F.array().cast(_IMAGES)).alias("images")))


def _track_columns(d: Column, artists: Column, album: Column, markets: Column) -> dict[str, Column]:
    ms = F.coalesce(d["duration_ms"], F.lit(0)).cast("bigint")
    return {
        "spotify_id": d["id"],
        "isrc": F.nullif(d["external_ids"]["isrc"], F.lit("")),
        "fingerprint": T.fingerprint_track(d["name"], F.get(artists, F.lit(0))["spotify_id"], ms),
        "name": d["name"],
        "artists": artists,
        "album": album,
        "popularity": F.coalesce(d["popularity"], F.lit(0)),
        "duration_ms": ms,
        "explicit": F.coalesce(d["explicit"], F.lit(False)),
        "markets_count": F.size(F.coalesce(d["available_markets"], F.array().cast("array<string>"))),
        "markets": markets,
        "status": F.lit("base_collected"),
    }


def spotify_track(rows: DataFrame) -> DataFrame:
    """Track rows; without id, name or an artist with an id there is none."""
    d = F.from_json(RAW, _TRACK)
    own = rows.select(d.alias("d")).filter("coalesce(d.id, '') <> '' and coalesce(d.name, '') <> ''").withColumn("a", _artists(F.col("d"))).filter("size(a) > 0")
    markets = F.coalesce(F.col("d.available_markets"), F.array().cast("array<string>"))
    return own.select(*(c.alias(n) for n, c in _track_columns(F.col("d"), F.col("a"), _album(F.col("d")), markets).items()), F.lit(1).alias("appearance_score"))


def album_track(rows: DataFrame, artist_id: str = "artist_id") -> DataFrame:
    """Track rows of an album's listing: without artists the column ``artist_id`` is the artist, with an empty name; markets are counted, not kept."""
    d = F.from_json(RAW, _TRACK)
    seed = F.array(F.struct(F.col(artist_id).alias("spotify_id"), F.lit("").alias("name")))
    own = rows.select(d.alias("d"), seed.alias("s")).filter("coalesce(d.id, '') <> '' and coalesce(d.name, '') <> ''").withColumn("a", _artists(F.col("d"))).withColumn("a", F.when(F.size("a") > 0, F.col("a")).otherwise(F.col("s")))
    return own.select(*(c.alias(n) for n, c in _track_columns(F.col("d"), F.col("a"), _album(F.col("d")), F.array().cast("array<string>")).items()))


def _placed(id_: Column, artist_id: Column, artist: Column, title: Column, ms: Column, *, isrc: Column | None = None, popularity: Column | None = None, explicit: Column | None = None, album: Column | None = None, timed: bool = True) -> list[Column]:
    """Columns of a track whose ids are placeholders '<source>:<id>'."""
    none = F.lit(None).cast("string")
    return [
        id_.alias("spotify_id"),
        (none if isrc is None else isrc).alias("isrc"),
        T.fingerprint_candidate(title, artist, ms if timed else F.lit(None).cast("bigint")).alias("fingerprint"),
        title.alias("name"),
        F.array(F.struct(artist_id.alias("spotify_id"), artist.alias("name"))).alias("artists"),
        (F.lit(None).cast("struct<spotify_id: string, name: string, release_date: string, cover: string>") if album is None else album).alias("album"),
        (F.lit(0).cast("bigint") if popularity is None else popularity).alias("popularity"),
        ms.alias("duration_ms"),
        (F.lit(False) if explicit is None else explicit).alias("explicit"),
        F.lit("base_collected").alias("status"),
        F.lit(1).alias("appearance_score"),
    ]


def _with_names(rows: DataFrame, columns: list[Column]) -> DataFrame:
    return rows.select(*columns).filter("spotify_id is not null and name is not null and artists[0].name is not null")


def _album_of(id_: Column, prefix: str, name: Column, date: Column, cover: Column) -> Column:
    return F.when(_true(id_).isNotNull(), F.struct(F.concat(F.lit(prefix), id_).alias("spotify_id"), F.coalesce(name, F.lit("")).alias("name"), date.cast("string").alias("release_date"), _true(cover).alias("cover")))


def deezer_track(rows: DataFrame) -> DataFrame:
    title = said(first(_true(at("title")), at("title_short")))
    popularity = F.floor(F.coalesce(_int(at("rank")), F.lit(0)) / 10000).cast("bigint")
    album = _album_of(at("album.id"), "deezer_album:", first(_true(at("album.title")), at("album.name")), F.lit(None), at("album.cover"))
    return _with_names(rows, _placed(F.concat(F.lit("deezer:"), _true(at("id"))), F.concat(F.lit("deezer:"), F.coalesce(at("artist.id"), F.lit("0"))), said(at("artist.name")), title, F.coalesce(_int(at("duration")), F.lit(0)) * 1000, isrc=_true(at("isrc")), popularity=popularity, explicit=F.coalesce(at("explicit_lyrics") == "true", F.lit(False)), album=album))


def jiosaavn_track(rows: DataFrame) -> DataFrame:
    """Of rows that ``jiosaavn`` gives, as JSON."""
    id_ = _true(at("id"))
    return _with_names(rows, _placed(F.concat(F.lit("jiosaavn:"), id_), F.concat(F.lit("jiosaavn_artist:"), id_), _true(at("artist")), _true(at("title")), F.coalesce(_int(at("duration_ms")), F.lit(0))))


def itunes_track(rows: DataFrame) -> DataFrame:
    """As matches give it: without an album."""
    id_ = _true(at("trackId"))
    return _with_names(rows, _placed(F.concat(F.lit("itunes:"), id_), F.concat(F.lit("itunes_artist:"), F.coalesce(at("artistId"), id_)), said(at("artistName")), said(at("trackName")), F.coalesce(_int(at("trackTimeMillis")), F.lit(0)), explicit=F.coalesce(at("trackExplicitness") == "explicit", F.lit(False))))


def itunes_song(rows: DataFrame) -> DataFrame:
    """As searches give it: songs only, with the album; the release date is its first ten signs."""
    songs = rows.filter(at("wrapperType") == "track").filter(at("kind") == "song")
    album = _album_of(at("collectionId"), "itunes_album:", at("collectionName"), F.nullif(F.substring(at("releaseDate"), 1, 10), F.lit("")), at("artworkUrl100"))
    return _with_names(songs, _placed(F.concat(F.lit("itunes:"), _true(at("trackId"))), F.concat(F.lit("itunes:"), F.coalesce(at("artistId"), F.lit("0"))), said(at("artistName")), said(at("trackName")), F.coalesce(_int(at("trackTimeMillis")), F.lit(0)), explicit=F.coalesce(at("trackExplicitness") == "explicit", F.lit(False)), album=album))


def rss_entry(rows: DataFrame) -> DataFrame:
    """A chart entry: without a duration."""
    artist = said(at("artistName"))
    return _with_names(rows, _placed(F.concat(F.lit("itunes:"), _true(at("id"))), F.concat(F.lit("itunes:rss:"), artist), artist, said(at("name")), F.lit(0).cast("bigint"), timed=False))


_MB = "struct<id: string, title: string, aliases: array<struct<name: string>>, relations: array<struct<type: string, artist: struct<name: string>>>, tags: array<struct<name: string>>, releases: array<struct<country: string, date: string, `release-events`: array<struct<date: string, area: struct<`iso-3166-1-codes`: array<string>>>>, `label-info`: array<struct<label: struct<name: string>>>, `text-representation`: struct<language: string, script: string>>>>"


def mb_detail(rows: DataFrame) -> DataFrame:
    """A recording: roles, countries and labels as sorted sets, the earliest date, the first language and script, with caps.

    A release's date counts only where it has release events.
    """
    d = F.col("d")
    none = F.array().cast("array<string>")
    names = lambda c: F.filter(F.coalesce(F.transform(c, lambda a: a["name"]), none), lambda n: F.coalesce(n, F.lit("")) != "")
    in_role = lambda roles: F.slice(F.array_distinct(F.transform(F.filter(d["relations"], lambda r: F.lower(r["type"]).isin(*roles) & (F.coalesce(r["artist"]["name"], F.lit("")) != "")), lambda r: r["artist"]["name"])), 1, 10)
    releases = F.coalesce(d["releases"], F.array().cast(_MB.split("releases: ")[1][:-1]))
    events = lambda r: F.coalesce(r["release-events"], F.array().cast("array<struct<date: string, area: struct<`iso-3166-1-codes`: array<string>>>>"))
    countries = F.flatten(F.transform(releases, lambda r: F.concat(F.flatten(F.transform(events(r), lambda e: F.coalesce(e["area"]["iso-3166-1-codes"], none))), F.array(r["country"]))))
    dates = F.transform(F.filter(releases, lambda r: F.size(events(r)) > 0), lambda r: F.coalesce(F.nullif(r["date"], F.lit("")), F.get(events(r), F.lit(0))["date"]))
    labels = F.flatten(F.transform(releases, lambda r: F.coalesce(F.transform(r["label-info"], lambda x: x["label"]["name"]), none)))
    held = lambda c: F.array_distinct(F.array_sort(F.filter(c, lambda x: F.coalesce(x, F.lit("")) != "")))
    first_of = lambda key: F.get(F.filter(F.transform(releases, lambda r: r["text-representation"][key]), lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0))
    known = F.filter(F.transform(releases, lambda r: r["text-representation"]["language"]), lambda x: (F.coalesce(x, F.lit("")) != "") & ~x.isin(*NO_LANGUAGE))
    language = F.get(known, F.lit(0))
    script = first_of("script")
    out = rows.select(F.from_json(RAW, _MB).alias("d"))
    return out.select(
        F.coalesce(d["id"], F.lit("")).alias("mbid"),
        F.coalesce(d["title"], F.lit("")).alias("canonical_title"),
        F.slice(names(d["aliases"]), 1, 10).alias("aliases"),
        F.coalesce(in_role(COMPOSER_ROLES), none).alias("composers"),
        F.coalesce(in_role(LYRICIST_ROLES), none).alias("lyricists"),
        F.array_min(F.filter(dates, lambda x: F.coalesce(x, F.lit("")) != "")).alias("first_release_date"),
        held(countries).alias("release_countries"),
        F.slice(held(labels), 1, 10).alias("labels"),
        T.mapped(language, LANGUAGE_3_TO_1, F.substring(language, 1, 2)).alias("language"),
        T.mapped(script, SCRIPT_NAMES, F.lower(script)).alias("script"),
        F.slice(names(d["tags"]), 1, 20).alias("tags"),
    )


PARSERS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f for f in (lastfm, ytmusic, chart_songs, discogs_search, discogs_tracklist, shazam, jiosaavn, netease, soundcloud, yandex, spotify_track, album_track, deezer_track, jiosaavn_track, itunes_track, itunes_song, rss_entry, mb_detail)
}
