"""Raw records to rows."""

import json

import pytest

from cataloom.sources import parsers


def _rows(spark, parser, *records, **extra):
    rows = [(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False), *extra.values()) for r in records]
    df = spark.createDataFrame(rows, "raw string" + "".join(f", {k} string" for k in extra))
    return [tuple(r) for r in parser(df).collect()]


NAMED = {"name": "A"}
LASTFM = [
    ({"artist": NAMED, "name": "Song", "duration": "200"}, ("Song", "A", 200_000)),
    (dict(artist="A", name=" Song "), ("Song", "A", None)),
    ({"artist": NAMED, "name": "Song", "duration": 0}, ("Song", "A", None)),
    ({"artist": NAMED, "name": "Song", "duration": "0"}, ("Song", "A", 0)),
    ({"name": "Song", "artist": "A", "duration": "x"}, ("Song", "A", None)),
    ({"name": "", "artist": "A"}, None),
    ({"name": "Song"}, None),
    (dict(name="Song", artist={"name": " "}), None),
    ("not json", None),
]


@pytest.mark.parametrize("raw,row", LASTFM)
def test_lastfm(spark, raw, row):
    assert _rows(spark, parsers.lastfm, raw) == ([row] if row else [])


def test_ytmusic(spark):
    assert _rows(spark, parsers.ytmusic, {"title": "T", "artists": [NAMED | {"id": 1}], "duration": "3:45", "videoId": "v"}) == [("T", "A", 225_000, "v")]
    assert _rows(spark, parsers.ytmusic, {"title": "T", "artists": ["A"], "duration": "3:45", "duration_seconds": 10}) == [("T", "A", 10_000, None)]
    assert _rows(spark, parsers.ytmusic, {"title": "", "artists": ["A"]}, {"title": "T", "artists": []}, {"title": "T"}) == []
    assert [json.loads(r[0])["a"] for r in _rows(spark, parsers.chart_songs, {"songs": {"items": [{"a": 1}]}}, {"Songs": {"content": [{"a": 2}]}}, {"songs": {"items": "x"}}, {})] == [1, 2]


def test_discogs(spark):
    assert _rows(spark, parsers.discogs_search, {"id": 1, "title": "A - B - C"}, {"id": 2, "title": "Only"}) == [("A", "B - C", 1), ("Various Artists", "Only", 2)]
    assert _rows(spark, parsers.discogs_search, {"title": "A - B"}, {"id": 3, "title": ""}, {"id": 3, "title": " - x"}, {"id": 0, "title": "x"}) == []
    heading, index = (dict(title="Side A", type_=k) for k in ("heading", "index"))
    tracks = [heading, dict(duration="1:00", title="One"), dict(artists=[{"name": "Own"}], title="Two", duration="1:00:00"), dict(title=" "), index]
    release = dict(tracklist=tracks, artists=[{"name": "R"}], id=7)
    assert [r[:4] for r in _rows(spark, parsers.discogs_tracklist, release, fallback="F")] == [("One", "R", 60_000, 7), ("Two", "Own", 3_600_000, 7)]
    assert [r[1] for r in _rows(spark, parsers.discogs_tracklist, {"id": 7, "tracklist": [{"title": "One"}]}, fallback="F")] == ["F"]


def test_shazam(spark):
    heading = {"title": " T ", "subtitle": "A"}
    full = {"track": {"heading": heading, "key": 5, "stores": {"apple": {"isrc": " I ", "trackid": 9}}}}
    assert _rows(spark, parsers.shazam, full, {"heading": heading, "key": "k", "stores": {"apple": {"isrc": " "}}}) == [("T", "A", "I", "5", "9"), ("T", "A", None, "k", None)]
    assert _rows(spark, parsers.shazam, {"heading": heading}, {"key": "k"}, {"track": {"heading": heading}, "key": "out"})[:1] == [("T", "A", None, "out", None)]


def test_jiosaavn(spark):
    old = {"id": "1", "title": "A &amp; B", "more_info": {"primary_artists": "X &amp; Y, Z", "duration": "200", "language": " Hindi "}}
    new = {"song_id": "2", "song": "S", "more_info": {"artistMap": {"primary_artists": [{"name": "N"}]}}, "duration": "x", "language": "Tamil"}
    assert _rows(spark, parsers.jiosaavn, old, new) == [("1", "A & B", "X & Y", 200_000, "hindi"), ("2", "S", "N", 0, "tamil")]
    assert _rows(spark, parsers.jiosaavn, {"id": "1", "title": "T"}, {"title": "T", "artist": "A"}, {"id": "1", "title": "T", "artist": " , "}) == []


def test_netease_soundcloud_yandex(spark):
    assert _rows(spark, parsers.netease, {"id": 1, "name": "N", "ar": [{"name": "A"}], "dt": 5}, {"id": 2, "name": "N", "artists": [{"name": "B"}], "duration": "7"}, {"id": 0, "name": "N", "ar": [{"name": "A"}]}, {"id": 3, "name": "N"}) == [(1, "N", "A", 5), (2, "N", "B", 7)]
    assert _rows(spark, parsers.soundcloud, {"id": 1, "title": "T", "user": {"username": "", "full_name": "F"}, "duration": 9, "genre": " g "}, {"id": 1, "title": "T"}) == [(1, "T", "F", 9, "g", "")]
    own = _rows(spark, parsers.yandex, {"id": 4, "artists": [{"id": 1, "name": "A"}, {"id": 2}, {"name": "x"}], "albums": [{"id": 3, "title": "L", "year": 2000}]})[0]
    assert own[:2] == ("4", "") and [tuple(a) for a in own[2]] == [(1, "A")] and tuple(own[3]) == (3, "L", 2000, None) and own[4] is None


TRACK = {"id": "t", "name": "Song (Live)", "artists": [{"id": "a", "name": "A"}, {"name": "x"}], "album": {"id": "l", "name": "L"}, "popularity": 3, "duration_ms": 1000, "explicit": True, "available_markets": ["UZ", "KZ"], "external_ids": {"isrc": "I"}}


def test_tracks(spark):
    (row,) = parsers.spotify_track(spark.createDataFrame([(json.dumps(TRACK),), (json.dumps({"id": "t", "name": "x"}),), (json.dumps({"name": "x"}),)], "raw string")).collect()
    assert (row["isrc"], row["markets_count"], row["markets"], row["explicit"], row["album"]["name"], [tuple(a) for a in row["artists"]]) == ("I", 2, ["UZ", "KZ"], True, "L", [("a", "A")])
    (row,) = parsers.album_track(spark.createDataFrame([(json.dumps({"id": "t", "name": "x"}), "seed")], "raw string, artist_id string")).collect()
    assert [tuple(a) for a in row["artists"]] == [("seed", "")] and row["isrc"] is None and row["album"] is None


def test_placeholders(spark):
    deezer = {"id": 5, "title_short": "T", "artist": {"id": 6, "name": "A"}, "rank": 123_456, "duration": 3, "isrc": "", "album": {"id": 7, "title": "L", "cover": "u"}, "explicit_lyrics": True}
    (row,) = parsers.deezer_track(spark.createDataFrame([(json.dumps(deezer),), ('{"id": 5}',)], "raw string")).collect()
    assert (row["spotify_id"], row["popularity"], row["duration_ms"], row["isrc"], row["explicit"], row["album"]["spotify_id"], row["artists"][0]["spotify_id"]) == ("deezer:5", 12, 3000, None, True, "deezer_album:7", "deezer:6")
    song = {"wrapperType": "track", "kind": "song", "trackId": 1, "trackName": "T", "artistName": "A", "collectionId": 2, "releaseDate": "2020-01-02T00:00:00Z", "trackExplicitness": "explicit"}
    rows = spark.createDataFrame([(json.dumps(song),), (json.dumps(song | {"kind": "album"}),)], "raw string")
    (row,) = parsers.itunes_song(rows).collect()
    assert row["album"]["release_date"] == "2020-01-02" and row["explicit"] and row["artists"][0]["spotify_id"] == "itunes:0" and parsers.itunes_track(rows).count() == 2
    (row,) = parsers.rss_entry(spark.createDataFrame([('{"id": "3", "name": "T", "artistName": "A"}',)], "raw string")).collect()
    assert row["artists"][0]["spotify_id"] == "itunes:rss:A" and row["duration_ms"] == 0
    (row,) = parsers.jiosaavn_track(spark.createDataFrame([('{"id": "3", "title": "T", "artist": "A", "duration_ms": 9}',)], "raw string")).collect()
    assert row["spotify_id"] == "jiosaavn:3" and row["duration_ms"] == 9


def test_recordings(spark):
    detail = {
        "id": "m", "title": "T", "aliases": [{"name": f"a{k}"} for k in range(12)] + [{"name": ""}], "tags": [{"name": "x"}],
        "relations": [{"type": "Composer", "artist": {"name": "C"}}, {"type": "composer", "artist": {"name": "C"}}, {"type": "lyricist", "artist": {"name": "L"}}, {"type": "mix", "artist": {"name": "M"}}, {"type": "music", "artist": {}}],
        "releases": [
            {"country": "UZ", "date": "2001", "label-info": [{"label": {"name": "Z"}}, {"label": {"name": "A"}}], "text-representation": {"language": "uzb", "script": "Cyrl"}},
            {"date": "2003-05", "release-events": [{"date": "1999", "area": {"iso-3166-1-codes": ["KZ"]}}], "text-representation": {"language": "eng"}},
            {"release-events": [{"date": "2002"}], "country": "KZ"},
        ],
    }
    (row,) = parsers.mb_detail(spark.createDataFrame([(json.dumps(detail),)], "raw string")).collect()
    assert row["aliases"] == [f"a{k}" for k in range(10)] and row["composers"] == ["C"] and row["lyricists"] == ["L"]
    assert row["first_release_date"] == "2002" and row["release_countries"] == ["KZ", "UZ"] and row["labels"] == ["A", "Z"] and (row["language"], row["script"]) == ("uz", "cyrillic")
    (row,) = parsers.mb_detail(spark.createDataFrame([("{}",)], "raw string")).collect()
    assert row["mbid"] == "" and row["labels"] == [] and row["first_release_date"] is None and row["composers"] == []
