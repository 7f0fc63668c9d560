"""Benchmark decontamination by a prefix-filtered set join (operator 6).

A benchmark item is the set of its five-word shingles; an item of fewer words is one shingle, all of them.  A document leaks it if some window
of the document, as long as the item, contains at least ``least`` of that set.  Steps:

1. one scan of the documents finds where any shingle of the benchmark occurs (postings); a
   bitmap of fixed size that every worker has lets few others through, an equi-join the rest;
2. shingles are ordered by rarity, the number of documents that hold them, over all documents;
3. of an item with s shingles, t = ceil(least * s) of which are needed, only the s - t + 1
   rarest (its prefix) are joined to the postings: a leak holds one of them;
4. length bound: the document has at least t shingles; positional bound: what follows in the
   rarity order and what the document has around the hit can still make t;
5. the containment is counted exactly over all item-sized windows.

Defined results: null and wordless texts match nothing; a shingle that recurs in an item counts
once; every benchmark row is judged apart, of rows that share an item_id the best is reported,
a null item_id is reported as null; documents are judged row by row, rows that share a doc_id are
reported once an item, by their best window, and a null doc_id as null; equal rarity is ordered
by hash; ``decontaminate`` removes the rows that leak, not others of their doc_id; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _bytes
from ._spark import BROADCAST_KEYS, clashless, hint, table, workers_find_package

N = 5
LEAST = 0.5
#: Bits of the bitmap (4 MB), whatever the size of the benchmark; with 10^6 shingles 3 % of others pass it.
BITS = 25
_POSTINGS = "doc_id long, dk long, words int, shingle long, pos int"


def _shingles(column: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, row, position within the row) of every shingle; words of every row."""
    words, bounds = _bytes.word_batch(column)
    grams, at = _bytes.ngrams(words, bounds, n)
    row = np.searchsorted(bounds, at, "right") - 1
    return grams.view(np.int64), row, at - bounds[row], np.diff(bounds)


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n in range(1, N + 1):
            grams, row, _, words = _shingles(batch.column(1), n)
            own = words[row] >= N if n == N else words[row] == n
            row = row[own]
            columns = [batch.column(0).take(pa.array(row)), pa.array(grams[own]), pa.array(words[row].astype(np.int32)), pa.array(np.full(len(row), n, np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["item", "shingle", "item_words", "n"])


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """(item: hash of the text, shingle, item_words, n: words of the shingle), distinct, as a written table."""
    rows = benchmark.select(F.xxhash64(F.col("text").cast("string")), F.col("text").cast("string")).filter("text is not null")
    return table(rows.mapInArrow(_item_rows, "item long, shingle long, item_words int, n int").distinct())


def bitmap(items: DataFrame) -> bytes:
    """The lowest ``BITS`` bits of every shingle as a bitmap, put together where the data is."""
    low = F.col("shingle").bitwiseAND(F.lit((1 << BITS) - 1))
    rows = items.select(F.shiftright(low, 15).alias("k"), low.bitwiseAND(F.lit(0x7FFF)).alias("bit")).groupBy("k").agg(F.bitmap_construct_agg("bit").alias("b")).collect()
    whole = bytearray(1 << (BITS - 3))
    for r in rows:
        whole[r["k"] << 12 : (r["k"] + 1) << 12] = r["b"]
    return zlib.compress(bytes(whole), 1)


def _scan(packed: bytes, sizes: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Postings of the shingles of ``sizes`` words that the bitmap lets through."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(zlib.decompress(packed), np.uint8)
        for batch in batches:
            for part in _bytes.parts(batch, "text"):
                for n in sizes:
                    grams, row, pos, words = _shingles(part.column(2), n)
                    low = grams & ((1 << BITS) - 1)
                    hit = np.flatnonzero((bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1)
                    row = row[hit]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(words[row].astype(np.int32)), pa.array(grams[hit]), pa.array(pos[hit].astype(np.int32))], ["doc_id", "dk", "words", "shingle", "pos"])

    return scan


def _keyed(docs: DataFrame) -> Column:
    """What tells rows apart: doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def postings(docs: DataFrame, items: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """Where shingles of the benchmark occur in the documents, as a written table."""
    workers_find_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), _keyed(docs).alias("dk"), F.col("text").cast("string")).filter("text is not null")
    wanted = table(items.select("shingle").distinct())
    sizes = sorted(r[0] for r in items.select("n").distinct().collect())
    return table(rows.mapInArrow(_scan(bitmap(items), sizes), _POSTINGS).join(hint(wanted, limit), "shingle", "left_semi").select("doc_id", "dk", "words", "shingle", "pos"))


def best_window(pos: list[int], shingle: list[int], span: int) -> tuple[int, int]:
    """(most distinct shingles in a window of ``span`` positions, where the first such window begins)."""
    inside: dict[int, int] = {}
    most = start = first = 0
    for k, own in enumerate(shingle):
        inside[own] = inside.get(own, 0) + 1
        while pos[first] <= pos[k] - span:
            inside[shingle[first]] -= 1
            if not inside[shingle[first]]:
                del inside[shingle[first]]
            first += 1
        if len(inside) > most:
            most, start = len(inside), pos[first]
    return most, start


def _best_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "dk", "item", "span", "shingles", "needed", "hits"]
    for batch in batches:
        doc, _, item, spans, shingles, least, hits = (batch.column(batch.schema.get_field_index(c)) for c in names)
        off = hits.offsets.to_numpy() - hits.offsets[0].as_py()
        pos, shingle = (x.to_pylist() for x in hits.flatten().flatten())
        best = [best_window(pos[i:j], shingle[i:j], w) for i, j, w in zip(off[:-1], off[1:], spans.to_pylist())]
        keep = pa.array([m >= n for (m, _), n in zip(best, least.to_pylist())], pa.bool_())
        most, start = (pa.array([b[k] for b in best], pa.int32()) for k in range(2))
        yield pa.RecordBatch.from_arrays([doc, batch.column("dk"), item, most, shingles, start], ["doc_id", "dk", "item", "matched", "shingles", "start"]).filter(keep)


def found(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, limit: int = BROADCAST_KEYS) -> DataFrame:
    """(doc_id, dk, item, matched, shingles, start): the best window of every leaked benchmark text in every row; ``dk`` tells rows apart."""
    workers_find_package(docs.sparkSession)
    items = item_shingles(benchmark)
    hits = postings(docs, items, limit)
    rarity = hits.groupBy("shingle").agg(F.countDistinct("dk").alias("held_by"))
    of_item = Window.partitionBy("item")
    ranked = items.join(rarity, "shingle", "left").withColumns(
        {
            "rank": F.row_number().over(of_item.orderBy(F.coalesce("held_by", F.lit(0)), "shingle")),
            "shingles": F.count(F.lit(1)).over(of_item).cast("int"),
        }
    )
    ranked = ranked.withColumn("needed", F.ceil(F.col("shingles") * F.lit(least)).cast("int")).withColumn("span", F.col("item_words") - F.col("n") + 1)
    ranked = table(ranked.select("item", "shingle", "rank", "shingles", "needed", "span", "n").filter("needed > 0"))
    prefix = ranked.filter("rank <= shingles - needed + 1")
    around = "least(words - n, pos + span - 1) - greatest(0, pos - span + 1) + 1"
    likely = hits.join(hint(prefix, limit), "shingle").filter("words - n + 1 >= needed").filter(f"shingles - rank + 1 >= needed and {around} >= needed")
    pairs = likely.select("dk", "item").distinct()
    all_hits = hits.join(hint(ranked, limit), "shingle").join(pairs, ["dk", "item"], "left_semi")
    groups = all_hits.groupBy("doc_id", "dk", "item", "span", "shingles", "needed").agg(F.sort_array(F.collect_list(F.struct("pos", "shingle"))).alias("hits"))
    return groups.mapInArrow(_best_windows, "doc_id long, dk long, item long, matched int, shingles int, start int")


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, limit: int = BROADCAST_KEYS) -> DataFrame:
    """(doc_id, item_id, matched, shingles, containment, start): the best window of every leaked item in every document."""
    ids = table(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(F.col("text").cast("string")).alias("item")).distinct())
    windows = found(docs, benchmark, least, limit).join(hint(ids, limit), "item")
    best = windows.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", "shingles", (-F.col("start")).alias("start"))).alias("best"))
    return best.select("doc_id", "item_id", "best.matched", "best.shingles", (F.col("best.matched") / F.col("best.shingles")).alias("containment"), (-F.col("best.start")).alias("start"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` without the rows that leak an item."""
    key = clashless(docs, "decontam_key")
    gone = table(found(docs, benchmark, least).select(F.col("dk").alias(key)).distinct())
    return docs.withColumn(key, _keyed(docs)).join(hint(gone), key, "left_anti").select(*docs.columns)


def sql(least: float = LEAST) -> str:
    """``leaks`` for DuckDB over documents and benchmark."""
    apart = r"[\x00-/:-@\[-`{-\x7f\x{80}-\x{a9}\x{ab}-\x{b4}\x{b6}-\x{b9}\x{bb}-\x{bf}\x{2000}-\x{206f}\x{3000}-\x{303f}]+"
    words = f"list_filter(regexp_split_to_array(lower(text), '{apart}'), lambda w: w <> '')"
    return f"""
with d as (select doc_id, row_number() over () as dk, {words} as w from documents where text is not null),
b as (select item_id, row_number() over () as item, {words} as w from benchmark where text is not null),
i as (select item, item_id, len(w) as item_words, least(len(w), {N}) as n, w from b where len(w) > 0),
s as (select distinct item, n, item_words, array_to_string(w[p:p + n - 1], ' ') as shingle from (select *, unnest(range(1, item_words - n + 2)) as p from i)),
t as (select item, n, any_value(item_words) - n + 1 as span, count(*) as shingles, cast(ceil(count(*) * {least}) as integer) as needed from s group by item, n),
g as (select doc_id, dk, n, p - 1 as pos, array_to_string(w[p:p + n - 1], ' ') as shingle from (select *, unnest(range(1, len(w) - n + 2)) as p from d cross join (select distinct n from s))),
h as (select g.doc_id, g.dk, s.item, g.pos, g.shingle from g join s using (n, shingle)),
k as (select h.doc_id, h.dk, h.item from h join t using (item) group by h.doc_id, h.dk, h.item, t.needed having count(distinct h.shingle) >= t.needed),
c as (select h.* from h semi join k using (dk, item)),
v as (select a.doc_id, a.dk, a.item, a.pos as at_end, count(distinct z.shingle) as matched, min(z.pos) as start from c a join t using (item) join c z on z.dk = a.dk and z.item = a.item and z.pos > a.pos - t.span and z.pos <= a.pos group by a.doc_id, a.dk, a.item, a.pos),
o as (select *, row_number() over (partition by dk, item order by matched desc, at_end) as r from v),
q as (select o.doc_id, i.item_id, o.matched, t.shingles, o.start, row_number() over (partition by o.doc_id, i.item_id order by o.matched desc, t.shingles desc, o.start) as r from o join t using (item) join i using (item) where o.r = 1 and o.matched >= t.needed)
select doc_id, item_id, cast(matched as integer) as matched, cast(shingles as integer) as shingles, matched / shingles as containment, cast(start as integer) as start from q where r = 1"""
