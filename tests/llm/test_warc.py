"""Revisits against a search through all captures, and the defined outcomes."""

import random

from cataloom.llm import warc

SCHEMA = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, url_key string"


def _rows():
    draw = random.Random(9)
    urls = ["http://A.example/x", "https://a.example:443/x/", "http://a.example/x?utm_source=q#f", "http://a.example/x?b=2&a=1", "http://a.example/x?a=1&b=2&ref=z", None, "http://u@b.example/"]
    rows = []
    for k in range(400):
        headers = draw.choice([None, {}, {"ETag": "z", "Content-Length": "1"}, {"Date": f"d{k}", "X-Own": "1", "CACHE-control": "no"}])
        rows.append((k, draw.choice(urls), draw.choice([None, *range(60)]), draw.choice(["response", "revisit", "request"]), draw.choice([None, "", '"a"', 'W/"a"', '"b"']), draw.choice([None, "", "m1", "m2"]), headers, "clash"))
    return rows


KEYS = {"http://A.example/x": "a.example/x", "https://a.example:443/x/": "a.example/x", "http://a.example/x?utm_source=q#f": "a.example/x", "http://a.example/x?b=2&a=1": "a.example/x?a=1&b=2", "http://a.example/x?a=1&b=2&ref=z": "a.example/x?a=1&b=2", None: None, "http://u@b.example/": "b.example"}


def _brute(rows):
    out = []
    tag = lambda t: (t or "").removeprefix("W/") or None
    low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    for r in rows:
        if r[3] != "revisit":
            continue
        key = KEYS[r[1]]
        earlier = [o for o in rows if o[3] == "response" and key is not None and KEYS[o[1]] == key and o[2] is not None and r[2] is not None and o[2] < r[2]]
        if not earlier:
            out.append((r[0], key, r[2], "no earlier response", None, None, None))
            continue
        o = max(earlier, key=lambda x: (x[2], x[0]))
        by = "etag" if tag(r[4]) and tag(o[4]) else "last-modified" if r[5] and o[5] else None
        same = tag(r[4]) == tag(o[4]) if by == "etag" else r[5] == o[5]
        outcome = "unvalidated" if by is None else "resolved" if same else "changed"
        merged = low(o[6]) | {k: v for k, v in low(r[6]).items() if k in warc.PERMITTED}
        text = "\n".join(sorted(f"{k}: {v}" for k, v in merged.items()))
        out.append((r[0], key, r[2], outcome, *((o[0], by, text) if outcome == "resolved" else (None, None, None))))
    return sorted(out)


def test_as_by_searching_all_captures(spark):
    rows = _rows()
    got = sorted(tuple(r) for r in warc.resolve(spark.createDataFrame(rows, SCHEMA)).collect())
    expected = _brute(rows)
    assert got == expected and {r[3] for r in got} == {"resolved", "changed", "unvalidated", "no earlier response"}


def test_empty_and_repeated_rows(spark):
    assert warc.resolve(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "http://a/", 1, "response", '"a"', None, None, ""), (2, "http://a", 2, "revisit", '"a"', None, None, "")]
    got = warc.resolve(spark.createDataFrame(rows + rows, SCHEMA)).collect()
    assert [(r["record_id"], r["refers_to"]) for r in got] == [(2, 1), (2, 1)]


def test_header_names_that_clash(spark):
    rows = [(1, "http://a/", 1, "response", '"a"', None, {"X": "b", "x": "a"}, ""), (2, "http://a", 2, "revisit", '"a"', None, {}, "")]
    assert warc.resolve(spark.createDataFrame(rows, SCHEMA)).head()["headers"] == "x: b"


def test_bodies_and_every_outcome_of_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    captures = warc.captures_of_pages(pages)
    out = warc.resolve(captures)
    assert {r[0] for r in out.select("outcome").distinct().collect()} >= {"resolved", "changed", "no earlier response"}
    bodies = captures.join(pages.selectExpr("page_id * 2 as record_id", "html as body"), "record_id", "left")
    whole = warc.with_bodies(out, bodies)
    assert whole.count() == out.filter("outcome = 'resolved'").count() and whole.filter("body is null").isEmpty()
