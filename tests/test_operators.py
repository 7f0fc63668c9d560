"""Similarity, matching, upserts, graphs, breakers and buckets, sinks and settings against plain statements."""

import json
import random
from collections import deque

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cataloom.functions import similarity as S
from cataloom.operators import export, filters, graph, match, resilience, upsert


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b):
            last, row[k + 1] = row[k + 1], last + 1 if x == y else max(row[k + 1], row[k])
    return row[-1]


@given(st.text("abcé ", max_size=30), st.text("abcé ", max_size=30))
@settings(max_examples=300, deadline=None)
def test_common_subsequence(a, b):
    assert S.lcs(a, b) == _lcs(a, b)


def test_token_ratios():
    assert S.token_sort_ratio("the beatles", "beatles the") == 100 and S.token_set_ratio("beatles", "the beatles") == 100
    assert S.token_set_ratio("", "a") == 0 and S.str_similarity("", "") == 0 and S.ratio("", "") == 100
    assert S.token_set_ratio("a b x", "a b yy") == max(S.ratio("a b x", "a b yy"), S.ratio("a b", "a b x"), S.ratio("a b", "a b yy"))
    assert S.ratio("kitten", "sitting") == pytest.approx(200 * 4 / 13)


def test_match_takes_the_best_of_the_first(spark):
    kind = "key int, ord int, title string, artist string, duration_ms bigint, isrc string, other_title string, other_artist string, other_ms bigint, other_isrc string"
    rows = [
        (1, 0, "song", "artist", 1000, None, "song x", "artist", 1000, None), (1, 1, "song", "artist", 1000, None, "song", "artist", 1000, None), (1, 2, "song", "artist", 1000, None, "song", "artist", 1000, None),
        (2, 0, "one", "two", None, "ab", "zzz", "yyy", None, "AB"), (3, 0, "one", "two", None, None, "zzz", "yyy", None, None), (4, 9, "звонкий", "x", 0, None, "zvonkiy", "x", 0, None),
    ]
    got = {r["key"]: (r["ord"], round(r["score"], 4)) for r in match.fuzzy_match(spark.createDataFrame(rows, kind), "key", ["ord"]).collect()}
    assert got == {1: (1, 1.0), 2: (0, 1.0), 4: (9, 1.0)} or got == {1: (0, 1.0), 2: (0, 1.0), 4: (9, 1.0)}
    assert 3 not in match.fuzzy_match(spark.createDataFrame(rows, kind), "key", ["ord"], 0.7, 1).select("key").toPandas()["key"].tolist()


def _fold(rows, key):
    out = {}
    for r in rows:
        if r[key] not in out:
            out[r[key]] = dict(r, n=1, tags=list(r["tags"]))
        else:
            o = out[r[key]]
            o["n"] += 1
            o["most"] = max((x for x in (o["most"], r["most"]) if x is not None), default=None)
            o["last"] = r["last"]
            o["tags"] = o["tags"] or list(r["tags"])
            if o["id"].startswith("deezer:") and not r["id"].startswith("deezer:"):
                o["id"] = r["id"]
    return out


def test_upsert_as_row_by_row(spark):
    draw = random.Random(6)
    rows = [{"k": draw.choice("abcdef"), "id": draw.choice(["deezer:1", "deezer:2", "x", "y"]), "n": 1, "most": draw.choice([None, 1, 5]), "last": str(k), "tags": draw.choice([[], ["t"], ["u"]]), "seq": k} for k in range(200)]
    kind = "k string, id string, n int, most int, last string, tags array<string>, seq int"
    fold = upsert.Fold(count="n", largest=("most",), latest=("last",), if_empty=("tags",), real_id="id")
    expected = {k: (o["id"], o["n"], o["most"], o["last"], o["tags"]) for k, o in _fold(rows, "k").items()}
    frame = lambda own: spark.createDataFrame([tuple(r.values()) for r in own], kind)
    whole = upsert.upsert_fold(frame(rows), F.col("k"), ["seq"], fold)
    parts = upsert.upsert_fold(frame(rows[70:]), F.col("k"), ["seq"], fold, upsert.upsert_fold(frame(rows[:70]), F.col("k"), ["seq"], fold))
    for got in (whole, parts):
        assert {r["k"]: (r["id"], r["n"], r["most"], r["last"], r["tags"]) for r in got.collect()} == expected
    assert upsert.upsert_fold(frame(rows[:1]).limit(0), F.col("k"), ["seq"], fold).count() == 0


def test_bfs(spark):
    draw = random.Random(8)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(110)]
    depth, todo = {0: 0, 1: 0}, deque([0, 1])
    while todo:
        a = todo.popleft()
        for s, d in edges:
            if s == a and d not in depth and depth[a] < 4:
                depth[d] = depth[a] + 1
                todo.append(d)
    seeds = spark.createDataFrame([(0, 1.0), (1, 1.0), (1, 0.5)], "node long, priority double")
    got = graph.bfs(spark.createDataFrame(edges, "src long, dst long"), seeds, 4)
    assert {r["node"]: r["depth"] for r in got.collect()} == depth
    none = graph.bfs(spark.createDataFrame([], "src long, dst long"), seeds, 4)
    assert none.count() == 2


def test_breaker_transitions(spark):
    b = resilience.Breaker(3, 10, wait=10)
    assert [b.step(e, t) for e, t in (("fail", 0), ("fail", 1), ("ok", 2), ("fail", 3), ("fail", 4))] == ["closed"] * 4 + ["open"]
    assert b.step("check", 13.9) == "open" and b.step("check", 14) == "half_open" and b.step("ok", 14) == "closed" and b.failures == 0
    for t in range(3):
        b.step("fail", 20 + t, 9_999.0)
    assert b.state == "open" and b.wait == 3600 and b.step("check", 3621) == "open" and b.step("check", 3622) == "half_open" and b.step("fail", 3623) == "open"
    events = spark.createDataFrame([("a", 1, 0.0, "fail"), ("b", 2, 0.0, "fail"), ("a", 3, 1.0, "fail"), ("a", 4, 200.0, "ok")], "service string, seq long, at double, event string")
    got = {(r["service"], r["seq"]): (r["state"], r["failures"]) for r in resilience.breaker_fold(events, 2).collect()}
    assert got == {("a", 1): ("closed", 1), ("b", 2): ("closed", 1), ("a", 3): ("open", 2), ("a", 4): ("closed", 0)}


def test_bucket():
    b = resilience.Bucket(0.5, 0.1)
    assert b.take(0) == 0 and b.take(0) == 2 and b.take(2) == 2 and b.take(100) == 0


def test_sinks(spark, tmp_path):
    nested = "struct<" + ", ".join(f"{c}: double" for c in "danceability energy key loudness mode speechiness acousticness instrumentalness liveness valence tempo time_signature".split()) + ">"
    kind = f"spotify_id string, isrc string, name string, artists array<struct<spotify_id: string, name: string>>, album struct<name: string, album_type: string, release_date: string>, popularity int, duration_ms bigint, explicit boolean, markets_count int, appearance_score int, quality_score double, artist_followers bigint, audio_features {nested}, lyrics struct<text: string, language: string, genius_url: string, confidence_score: double>, status string, created_at timestamp, updated_at timestamp"
    row = lambda k, q, s: (k, None, "Ü", [("a", "A"), ("b", "B")], None, 1, 2, True, 3, 4, q, 5, None, None, s, None, None)
    tracks = spark.createDataFrame([row("x", 0.1, "enriched"), row("z", 0.9, "failed"), row("y", 0.5, "enriched"), row("w", 0.5, "enriched")], kind)
    export.export_jsonl(tracks, str(tmp_path / "j"))
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert sorted(x["spotify_id"] for x in lines) == ["w", "x", "y"] and lines[0]["name"] == "Ü"
    export.export_csv(tracks.coalesce(1), str(tmp_path / "c"))
    back = spark.read.csv(str(tmp_path / "c"), header=True)
    assert len(back.columns) == 35 and {r["artists_names"] for r in back.collect()} == {"A, B"} and {r["explicit"] for r in back.collect()} == {"True"}
    assert [r["spotify_id"] for r in export.ordered(tracks).collect()] == ["w", "y", "x"]


def test_settings():
    assert filters.threshold(0.7) == 0.7
    for bad in (-0.1, 1.1):
        with pytest.raises(ValueError):
            filters.threshold(bad)
