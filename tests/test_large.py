"""What shows only on larger tables: limits, bounded searches, and what grows faster than the input."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from cataloom.functions import html, language
from cataloom.operators import aggregate, match
from cataloom.sources import parsers


def test_placeholders_take_no_place_of_an_artist(spark):
    kind = "spotify_id string, popularity int, artist_followers bigint, artists array<struct<spotify_id: string, name: string>>, regions struct<cis: boolean, mena: boolean>"
    rows = [(f"t{k}", k, 10, [("deezer:1", "D")] + ([("a", "A")] if k else []) + ([("b", "B")] if k > 1 else []), (True, None)) for k in range(4)]
    got = aggregate.regional_top_artists(spark.createDataFrame(rows, kind), ("cis", "mena"), 2).collect()
    assert [(r["artist_id"], r["track_count"]) for r in got] == [("a", 3), ("b", 2)]


def test_a_block_is_not_paired_whole(spark):
    rows = spark.range(300).select(F.col("id").alias("n"), (F.col("id") % 2).alias("block"), F.col("id").cast("string").alias("title"))
    other = rows.select("block", F.col("n").alias("other_n"), F.col("title").alias("other_title"))
    pairs = match.first_pairs(rows, other, "block", "n", 4)
    assert pairs.count() <= 5 * 300
    by = lambda df: sorted(tuple(r) for r in match.first_results(df, "n", ["other_n"], 4).select("n", "other_n", "title", "other_title").collect())
    assert by(pairs) == by(rows.join(other, "block").filter("n <> other_n"))


def test_language_reads_a_text_once(spark):
    plan = spark.range(1).select(language.detect(F.col("id").cast("string")).alias("l"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 1


def test_a_record_is_read_once(spark):
    rows = spark.createDataFrame([('{"id":"1","title":"a &amp; b","more_info":{"primary_artists":"x &amp; y, z"}}',), ('{"id":"2","title":"t"}',)], "raw string")
    got = parsers.jiosaavn(rows)
    assert [tuple(r) for r in got.collect()] == [("1", "a & b", "x & y", 0, "")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_unescape(") <= 3, plan.count("_unescape(")


def test_a_batch_of_pages_is_not_held_as_strings():
    batch = pa.array(["<p>" + "x" * 20_000 + f"{k}</p>" for k in range(2000)])
    tracemalloc.start()
    found = html._extract.func(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.null_count == len(found) == 2000
    assert peak < 10_000_000
