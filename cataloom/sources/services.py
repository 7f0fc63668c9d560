"""Readers of the catalogue services as a Python data source.

    spark.dataSource.register(CatalogSource)
    spark.read.format("catalog").option("endpoint", "deezer_search").option("keys", '["a", "b"]').load()

A row is (key, page, ord, raw): what was asked for, the page, the place on it, and the record as
JSON for a parser.  Keys are split over partitions, so requests of one service go out from as many
tasks as ``partitions`` says, which share its rate.  What a failed request gives depends on the
endpoint: an error, nothing, or a null a key.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.resilience import Breaker, Bucket


@dataclass(frozen=True)
class Endpoint:
    """``items``: paths to the list of records, the first that is there counts; '' is the body itself."""

    base: str
    path: str
    params: dict[str, str] = field(default_factory=dict)
    items: tuple[str, ...] = ("",)
    chunk: int = 1  # keys a request, joined by commas
    page: str | None = None  # parameter that moves on
    first: int = 1  # its first value
    step: int = 1  # by how much it moves
    size: tuple[str, int] | None = None  # parameter and value of the page size
    more: str | None = None  # path that is there while pages follow; None: while pages are full
    on_error: str = "raise"  # or empty, null
    empty_on: tuple[int, ...] = ()  # statuses that mean: nothing there
    need: str | None = None  # path that a record has to have
    where: dict[str, str] = field(default_factory=dict)  # values that a record has to have
    rate: float = 3.0
    header: str | None = None  # header that carries the token
    error: str | None = None  # path in a body of status 200 that tells of an error


_SPOTIFY = {"base": "https://api.spotify.com/v1", "header": "Authorization"}
_DEEZER = {"base": "https://api.deezer.com", "error": "error"}
_LASTFM = {"base": "https://ws.audioscrobbler.com/2.0", "path": "/", "page": "page", "on_error": "empty", "rate": 4.0, "error": "error"}
_DISCOGS = {"base": "https://api.discogs.com", "on_error": "empty", "rate": 1.0, "header": "Authorization"}
_ITUNES = {"base": "https://itunes.apple.com", "items": ("results",), "where": {"wrapperType": "track", "kind": "song"}, "rate": 4.0, "on_error": "empty"}
_SAAVN = {"base": "https://www.jiosaavn.com", "on_error": "empty"}
_NETEASE = {"base": "https://music.163.com/api", "rate": 2.0, "on_error": "empty"}
_CLOUD = {"base": "https://api-v2.soundcloud.com", "items": ("collection",), "rate": 2.0, "on_error": "empty"}
_BRAINZ = {"base": "https://musicbrainz.org/ws/2", "rate": 1.0, "empty_on": (404,)}
_YT = {"base": "https://music.youtube.com/youtubei/v1", "rate": 10.0, "on_error": "empty"}
_YANDEX = {"base": "https://api.music.yandex.net", "rate": 2.0, "on_error": "empty", "header": "Authorization"}

ENDPOINTS: dict[str, Endpoint] = {
    "spotify_tracks": Endpoint(path="/tracks", params={"ids": "{key}"}, items=("tracks",), chunk=50, on_error="null", **_SPOTIFY),
    "spotify_audio_features": Endpoint(path="/audio-features", params={"ids": "{key}"}, items=("audio_features",), chunk=100, on_error="null", **_SPOTIFY),
    "spotify_artists": Endpoint(path="/artists", params={"ids": "{key}"}, items=("artists",), chunk=50, on_error="null", **_SPOTIFY),
    "spotify_artist": Endpoint(path="/artists/{key}", empty_on=(404,), **_SPOTIFY),
    "spotify_related": Endpoint(path="/artists/{key}/related-artists", items=("artists",), on_error="empty", **_SPOTIFY),
    "spotify_featured": Endpoint(path="/browse/featured-playlists", params={"country": "{key}"}, items=("playlists.items",), size=("limit", 50), more="-", **_SPOTIFY),
    "spotify_playlist_search": Endpoint(path="/search", params={"q": "{key}", "type": "playlist"}, items=("playlists.items",), size=("limit", 50), more="-", **_SPOTIFY),
    "spotify_categories": Endpoint(path="/browse/categories", items=("categories.items",), size=("limit", 50), more="-", empty_on=(403, 404), **_SPOTIFY),
    "spotify_category_playlists": Endpoint(path="/browse/categories/{key}/playlists", items=("playlists.items",), size=("limit", 50), more="-", empty_on=(403, 404), **_SPOTIFY),
    "spotify_playlist_tracks": Endpoint(path="/playlists/{key}/tracks", items=("items",), page="offset", first=0, step=100, size=("limit", 100), more="next", need="track.id", on_error="empty", **_SPOTIFY),
    "spotify_artist_albums": Endpoint(path="/artists/{key}/albums", items=("items",), page="offset", first=0, step=50, size=("limit", 50), more="next", need="id", on_error="empty", **_SPOTIFY),
    "spotify_album_tracks": Endpoint(path="/albums/{key}/tracks", items=("items",), page="offset", first=0, step=50, size=("limit", 50), more="next", need="id", on_error="empty", **_SPOTIFY),
    "spotify_search": Endpoint(path="/search", params={"q": "{key}", "type": "track", "market": "US"}, items=("tracks.items",), page="offset", first=0, step=50, size=("limit", 50), **_SPOTIFY),
    "lastfm_tag": Endpoint(params={"method": "tag.gettoptracks", "tag": "{key}", "format": "json"}, items=("tracks.track",), **_LASTFM),
    "lastfm_chart": Endpoint(params={"method": "chart.gettoptracks", "format": "json"}, items=("tracks.track",), **_LASTFM),
    "ytmusic_search": Endpoint(path="/search", params={"q": "{key}"}, items=("items", ""), **_YT),
    "ytmusic_video": Endpoint(path="/search", params={"q": "{key}", "first": "1"}, items=("items", ""), **_YT),
    "ytmusic_charts": Endpoint(path="/charts", params={"country": "{key}"}, **_YT),
    "discogs_search": Endpoint(path="/database/search", params={"style": "{key}", "type": "release"}, items=("results",), page="page", size=("per_page", 100), more="pagination.urls.next", **_DISCOGS),
    "discogs_release": Endpoint(path="/releases/{key}", **_DISCOGS),
    "deezer_genres": Endpoint(path="/genre", items=("data",), **_DEEZER),
    "deezer_genre_artists": Endpoint(path="/genre/{key}/artists", items=("data",), **_DEEZER),
    "deezer_artist_top": Endpoint(path="/artist/{key}/top", items=("data",), size=("limit", 100), more="-", **_DEEZER),
    "deezer_artist_albums": Endpoint(path="/artist/{key}/albums", items=("data",), page="index", first=0, step=25, size=("limit", 25), more="next", **_DEEZER),
    "deezer_album_tracks": Endpoint(path="/album/{key}/tracks", items=("data",), **_DEEZER),
    "deezer_album": Endpoint(path="/album/{key}", **_DEEZER),
    "deezer_chart": Endpoint(path="/chart/{key}/tracks", items=("data",), size=("limit", 100), more="-", **_DEEZER),
    "deezer_artist_search": Endpoint(path="/search/artist", params={"q": "{key}"}, items=("data",), **_DEEZER),
    "deezer_track": Endpoint(path="/track/{key}", **_DEEZER),
    "deezer_search": Endpoint(path="/search", params={"q": "{key}"}, items=("data",), size=("limit", 50), more="-", **_DEEZER),
    "deezer_related": Endpoint(path="/artist/{key}/related", items=("data",), size=("limit", 20), more="-", **_DEEZER),
    "itunes_artist": Endpoint(path="/search", params={"term": "{key}", "entity": "song", "attribute": "artistTerm"}, size=("limit", 200), more="-", **_ITUNES),
    "itunes_search": Endpoint(path="/search", params={"term": "{key}", "entity": "song"}, size=("limit", 25), more="-", **_ITUNES),
    "apple_chart": Endpoint(base="https://rss.applemarketingtools.com", path="/api/v2/{key}/songs.json", items=("feed.results",), on_error="empty"),
    "yandex_chart": Endpoint(path="/landing3/chart/{key}", items=("result.chart.tracks",), **_YANDEX),
    "yandex_artist_tracks": Endpoint(path="/artists/{key}/tracks", items=("result.tracks",), page="page", first=0, size=("page-size", 50), **_YANDEX),
    "yandex_similar": Endpoint(path="/artists/{key}/brief-info", items=("result.similarArtists",), **_YANDEX),
    "shazam_chart": Endpoint(base="https://www.shazam.com", path="/services/charts/country/{key}", items=("chart", "tracks"), on_error="empty", rate=1.5),
    "jiosaavn_charts": Endpoint(path="/api.php", params={"__call": "content.getCharts", "_format": "json"}, **_SAAVN),
    "jiosaavn_playlist": Endpoint(path="/api.php", params={"__call": "playlist.getDetails", "listid": "{key}", "_format": "json"}, items=("list", "songs"), **_SAAVN),
    "jiosaavn_search": Endpoint(path="/api.php", params={"q": "{key}", "_format": "json", "__call": "search.getResults"}, items=("results",), page="p", size=("n", 20), **_SAAVN),
    "netease_search": Endpoint(path="/search/get", params={"s": "{key}", "type": "1"}, items=("result.songs",), page="offset", first=0, step=100, size=("limit", 100), **_NETEASE),
    "netease_playlist": Endpoint(path="/playlist/detail", params={"id": "{key}"}, items=("result.tracks", "playlist.tracks"), **_NETEASE),
    "netease_artist_top": Endpoint(path="/artist/{key}", items=("hotSongs",), **_NETEASE),
    "netease_similar": Endpoint(path="/discovery/simiArtist", params={"artistid": "{key}"}, items=("artists",), **_NETEASE),
    "soundcloud_chart": Endpoint(path="/charts", params={"kind": "top", "genre": "soundcloud:genres:{key}"}, size=("limit", 50), more="-", **_CLOUD),
    "soundcloud_search": Endpoint(path="/search/tracks", params={"q": "{key}"}, page="offset", first=0, step=50, size=("limit", 50), more="next_href", **_CLOUD),
    "soundcloud_user": Endpoint(path="/users/{key}/tracks", size=("limit", 50), more="-", **_CLOUD),
    "soundcloud_related": Endpoint(path="/tracks/{key}/related", size=("limit", 20), more="-", **_CLOUD),
    "musicbrainz_isrc": Endpoint(path="/isrc/{key}", params={"fmt": "json"}, items=("recordings",), **_BRAINZ),
    "musicbrainz_search": Endpoint(path="/recording", params={"query": "{key}", "fmt": "json"}, items=("recordings",), size=("limit", 10), more="-", **_BRAINZ),
    "musicbrainz_recording": Endpoint(path="/recording/{key}", params={"fmt": "json", "inc": "aliases+artist-rels+releases+tags"}, **_BRAINZ),
    "musicbrainz_artist": Endpoint(path="/artist/{key}", params={"fmt": "json"}, **_BRAINZ),
    "genius_search": Endpoint(base="https://api.genius.com", path="/search", params={"q": "{key}"}, items=("response.hits",), header="Authorization", where={"type": "song"}),
    "genius_page": Endpoint(base="https://genius.com", path="/{key}"),
}


def dig(body: Any, path: str) -> Any:
    for name in path.split(".") if path else ():
        body = body.get(name) if isinstance(body, dict) else None
    return body


def records(body: Any, endpoint: Endpoint) -> list[Any]:
    """The records of a body: a lone one counts as a list, a list may be a JSON text."""
    found = next((x for x in (dig(body, p) for p in endpoint.items) if x not in (None, "")), [])
    if isinstance(found, str) and endpoint.items != ("",):
        found = json.loads(found)
    found = found if isinstance(found, list) else [found]
    good = lambda r: (not endpoint.need or dig(r, endpoint.need)) and all(dig(r, p) == v for p, v in endpoint.where.items())
    return [r for r in found if good(r)]


class Keys(InputPartition):
    def __init__(self, keys: list[str]) -> None:
        self.keys = keys


class CatalogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.endpoint = ENDPOINTS[options["endpoint"]]
        self.base = options.get("base", self.endpoint.base)
        self.keys = json.loads(options.get("keys", '[""]'))
        self.token = options.get("token")
        self.max_pages = int(options.get("max_pages", 1))
        self.tasks = max(int(options.get("partitions", 1)), 1)
        self.attempts = max(int(options.get("attempts", 4)), 1)
        self.rate = float(options.get("rate", self.endpoint.rate)) / self.tasks

    def partitions(self) -> list[InputPartition]:
        chunks = [self.keys[k : k + self.endpoint.chunk] for k in range(0, len(self.keys), self.endpoint.chunk)]
        return [Keys([x for c in own for x in c]) for own in (chunks[k :: self.tasks] for k in range(self.tasks)) if own]

    def _url(self, key: str, page: int) -> str:
        e = self.endpoint
        params = {k: v.replace("{key}", key) for k, v in e.params.items()} | ({e.size[0]: str(e.size[1])} if e.size else {}) | ({e.page: str(e.first + page * e.step)} if e.page else {})
        return self.base + e.path.replace("{key}", urllib.parse.quote(key, safe="")) + ("?" + urllib.parse.urlencode(params) if params else "")

    def _get(self, url: str, bucket: Bucket, breaker: Breaker) -> Any:
        """The body; None where there is nothing; tries again with growing, jittered pauses. While the breaker is open nothing is asked."""
        for attempt in range(self.attempts):
            if breaker.step("check", time.monotonic()) == "open":
                raise RuntimeError("too many failures in a row")
            time.sleep(bucket.take(time.monotonic()))
            try:
                request = urllib.request.Request(url, headers={"User-Agent": "cataloom"} | ({self.endpoint.header: self.token} if self.endpoint.header and self.token else {}))
                with urllib.request.urlopen(request, timeout=30) as answer:
                    text = answer.read().decode("utf-8", "replace")
                body = json.loads(text) if text[:1] in "{[" else text
                if self.endpoint.error and dig(body, self.endpoint.error):
                    raise ValueError(f"{url}: {dig(body, self.endpoint.error)}")
                breaker.step("ok", time.monotonic())
                return body
            except urllib.error.HTTPError as e:
                if e.code in self.endpoint.empty_on:
                    return None
                after = e.headers.get("Retry-After", "")
                breaker.step("fail", time.monotonic(), float(after) if after.isdigit() else None)
                if e.code not in (408, 429) and e.code < 500 or attempt == self.attempts - 1:
                    raise
            except (urllib.error.URLError, ValueError):
                breaker.step("fail", time.monotonic())
                if attempt == self.attempts - 1:
                    raise
            time.sleep(min(2.0**attempt, 30) * random.random() / 4)
        return None

    def read(self, partition: Keys) -> Iterator[tuple[str, int, int, str | None]]:
        e, bucket, breaker = self.endpoint, Bucket(self.rate, max(self.rate, 1)), Breaker()
        for at in range(0, len(partition.keys), e.chunk):
            keys = partition.keys[at : at + e.chunk]
            for page in range(self.max_pages if e.page else 1):
                try:
                    body = self._get(self._url(",".join(keys), page), bucket, breaker)
                except Exception:
                    if e.on_error == "raise":
                        raise
                    if e.on_error == "null":
                        yield from ((key, page, k, None) for k, key in enumerate(keys))
                    break
                found = [] if body is None else records(body, e)
                for k, record in enumerate(found):
                    key = keys[k] if e.chunk > 1 and k < len(keys) else ",".join(keys)
                    yield key, page, k, None if record is None else json.dumps(record, ensure_ascii=False)
                if not (dig(body, e.more) if e.more else e.size and len(found) >= e.size[1] or not e.size and found):
                    break


class CatalogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalog"

    def schema(self) -> str:
        return "key string, page int, ord int, raw string"

    def reader(self, schema: Any) -> CatalogReader:
        return CatalogReader(dict(self.options))
