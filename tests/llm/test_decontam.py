"""Leaks against comparing every item with every window of every document."""

import random

import pytest

from cataloom.llm import _bytes, decontam


def _brute(docs, items, least=0.5):
    """{(doc_id, item_id): (matched, shingles, start)}"""
    best: dict = {}
    for doc_id, text in docs:
        words = _bytes.words_of(text)
        for item_id, item in items:
            own = _bytes.words_of(item)
            n = min(len(own), 5)
            if not n or text is None:
                continue
            wanted = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)}
            grams = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
            span = len(own) - n + 1
            most, start = 0, 0
            for end in range(len(grams)):
                first = max(0, end - span + 1)
                inside = {g for g in grams[first : end + 1] if g in wanted}
                if len(inside) > most:
                    most, start = len(inside), next(k for k in range(first, end + 1) if grams[k] in wanted)
            if most and most >= -(-len(wanted) * least // 1):
                key = (doc_id, item_id)
                best[key] = max(best.get(key, (0, 0, 0)), (most, len(wanted), -start))
    return best


def _cases():
    draw = random.Random(3)
    vocabulary = [f"w{k}" for k in range(30)]
    say = lambda n: draw.choices(vocabulary, k=n)
    items = [(k % 9, " ".join(say(draw.randint(1, 14)))) for k in range(14)] + [(None, " ".join(say(8))), (20, None), (21, "..."), (22, "Only four words here"), (23, "a a a a a a a a")]
    docs = []
    for k in range(60):
        words = say(draw.randint(0, 60))
        if k % 3 == 0:
            own = (items[draw.randrange(15)][1] or "").split()
            for j in range(len(own)):
                if draw.random() < 0.15:
                    own[j] = "x"
            words[5:5] = own
        docs.append((k if k % 10 else None, " ".join(words)))
    docs += [(7, "Yes: ONLY four, words -- here!"), (8, None), (9, ""), (10, "a " * 9), (1, docs[3][1])]
    return docs + docs[:2], items


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_as_by_comparing_all_windows(spark, limit):
    docs, items = _cases()
    frame = spark.createDataFrame([(*d, "clash", 0) for d in docs], "doc_id long, text string, item string, shingle int")
    bench = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, n string")
    got = {(r["doc_id"], r["item_id"]): (r["matched"], r["shingles"], -r["start"]) for r in decontam.leaks(frame, bench, limit=limit).collect()}
    assert got == _brute(docs, items) and len(got) > 20
    kept = decontam.decontaminate(frame, bench)
    assert kept.schema == frame.schema
    clean = [d for d in docs if not _brute([d], items)]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(clean, key=str)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert decontam.leaks(docs.limit(0), bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0
    assert decontam.decontaminate(docs, bench.limit(0)).count() == 1 and decontam.decontaminate(docs, bench).count() == 0


def test_very_long_text(spark):
    item = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, "filler words " * 300_000 + item)], "doc_id long, text string")
    r = decontam.leaks(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(x["item_id"], x["matched"], x["start"]) for x in r] == [(5, 4, 600_000)]
