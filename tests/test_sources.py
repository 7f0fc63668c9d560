"""The services' reader against a server of our own, and the streams."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from cataloom import streaming
from cataloom.operators.upsert import Fold
from cataloom.session import ship
from cataloom.sources import seeds
from cataloom.sources.services import ENDPOINTS, CatalogReader, CatalogSource, records


class Handler(BaseHTTPRequestHandler):
    failures = {"n": 0}

    def do_GET(self):
        url = urlparse(self.path)
        q = {k: v[0] for k, v in parse_qs(url.query).items()}
        status, body = 200, {}
        if url.path == "/tracks":
            status, body = (500, {}) if "bad" in q["ids"] else (200, {"tracks": [{"id": i} for i in q["ids"].split(",")]})
        elif url.path.startswith("/playlists"):
            at = int(q["offset"])
            body = {"items": [{"track": {"id": str(at + k)}} for k in range(2)] + [{"track": {}}], "next": "x" if at < 200 else None}
        elif url.path == "/search":
            body = {"error": {"code": 4}} if q.get("q") == "ban" else {"data": [{"id": k} for k in range(3)], "results": [{"wrapperType": "track", "kind": "song", "id": 1}, {"wrapperType": "artist"}]}
        elif url.path == "/artists/none":
            status = 404
        elif url.path == "/flaky":
            Handler.failures["n"] += 1
            status, body = (503, {}) if Handler.failures["n"] < 3 else (200, {"tracks": {"track": {"name": "one"}}})
        self.send_response(status)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def base():
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def _read(base, endpoint, keys, **options):
    reader = CatalogReader({"endpoint": endpoint, "base": base, "keys": json.dumps(keys), "rate": "1000", "attempts": "2", **options})
    return [r for p in reader.partitions() for r in reader.read(p)]


def test_through_spark(spark, base):
    ship(spark)
    spark.dataSource.register(CatalogSource)
    rows = spark.read.format("catalog").option("endpoint", "spotify_tracks").option("base", base).option("rate", "1000").option("partitions", "2").option("keys", json.dumps([f"k{i}" for i in range(120)])).load()
    got = {r["key"]: json.loads(r["raw"])["id"] for r in rows.collect()}
    assert got == {f"k{i}": f"k{i}" for i in range(120)}


def test_failures_by_endpoint(base):
    assert _read(base, "spotify_tracks", ["bad", "b"]) == [("bad", 0, 0, None), ("b", 0, 1, None)]
    assert _read(base, "spotify_artist", ["none"]) == []
    with pytest.raises(ValueError):
        _read(base, "deezer_search", ["ban"])
    assert [r[2] for r in _read(base, "deezer_search", ["ok"])] == [0, 1, 2]
    assert len(_read(base, "itunes_search", ["x"])) == 1


def test_pages_end(base):
    rows = _read(base, "spotify_playlist_tracks", ["p"], max_pages="10")
    assert [(r[1], json.loads(r[3])["track"]["id"]) for r in rows] == [(0, "0"), (0, "1"), (1, "100"), (1, "101"), (2, "200"), (2, "201")]


def test_lone_records_and_lists_in_texts():
    assert records({"tracks": {"track": {"a": 1}}}, ENDPOINTS["lastfm_tag"]) == [{"a": 1}]
    assert records({"list": '[{"a": 1}]'}, ENDPOINTS["jiosaavn_playlist"]) == [{"a": 1}]
    assert records({}, ENDPOINTS["shazam_chart"]) == [] and records({"tracks": [1]}, ENDPOINTS["shazam_chart"]) == [1]


def test_seeds(spark):
    rows = seeds.queue_seeds(spark, genre=seeds.GENRES, kind=seeds.SOUNDCLOUD_KINDS)
    assert rows.count() == 2 * len(seeds.GENRES) and rows.filter("status = 'pending' and page = 1").count() == rows.count()


def test_batches_that_run_again_change_nothing(spark, tmp_path):
    table = streaming.Snapshots(spark, str(tmp_path / "t"))
    for k in range(3):
        spark.createDataFrame([(f"k{j}", 1, k * 10 + j) for j in range(3)], "k string, n long, seq int").write.mode("append").parquet(str(tmp_path / "in"))
    rows = lambda: spark.readStream.schema("k string, n long, seq int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = lambda at: streaming.upserting(rows(), table, lambda: F.col("k"), ["seq"], Fold(count="n"), str(tmp_path / at), {"availableNow": True}).awaitTermination(120)
    run("a")
    first = sorted(map(tuple, table.latest().collect()))
    last = table.versions()[-1]
    table.keep(last, spark.createDataFrame(first, table.latest().schema))
    assert sorted(map(tuple, table.latest().collect())) == first and sum(r[1] for r in first) == 9 and len(table.versions()) <= 2


def test_listener_logs(spark, caplog):
    import logging

    caplog.set_level(logging.INFO, "cataloom")
    listener = streaming.StatsListener(0)
    spark.streams.addListener(listener)
    q = spark.readStream.format("rate").load().writeStream.format("noop").trigger(availableNow=True)
    q.start().awaitTermination(60)
    streaming.stop_all(spark)
    spark.streams.removeListener(listener)
