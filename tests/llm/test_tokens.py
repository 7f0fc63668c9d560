"""Encoding, decoding and prefix counts against the tokenizer applied to every text and prefix alone."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cataloom.llm import bpe, token_counts

VOCABULARY = bpe.Vocabulary.read()
ODD = ["", " ", "  ", "a", "a  b", "we're they'll I've don't 'r 'll''s 're", "x\n\n\ny", "  lead", "tail   ", "\t\tz", "漢字 かな 🙂🙂", "é 　x", "<|endoftext|>", "123 4567", "a  b", "=" * 300, "\r\n\r\n.", "…!? --", "\x1c \x1d a", "aaaa" * 40]


def _random_texts(n: int = 150) -> list[str]:
    draw = random.Random(4)
    parts = ["the", " The", "ing", " ", "  ", "\n", "'re", "'", "ll", "é", "ß", "漢", "12", "...", "\t", "Xq", "-", "🙂", " a"]
    return ["".join(draw.choices(parts, k=draw.randint(1, 40))) for _ in range(n)]


def test_cut_texts_have_the_same_tokens():
    codec = VOCABULARY.codec()
    for text in [*ODD, *_random_texts()]:
        expected = codec.encoding.encode_ordinary(text)
        assert codec.encode(text).tolist() == expected
        assert codec.encode(text, 7).tolist() == expected


def test_decoding_is_of_raw_bytes():
    codec = VOCABULARY.codec()
    tokens = codec.encode("🙂x").tolist()
    lists = pa.array([tokens, tokens[:1], [], None, [50_300], [-1], [None]], pa.list_(pa.int32()))
    out = bpe.decoded(codec, lists).to_pylist()
    assert out[0] == "🙂x".encode() and out[0].startswith(out[1]) and out[2:] == [b"", None, None, None, None]
    assert bpe.decoded(codec, lists.slice(1, 2)).to_pylist() == out[1:3]


def test_tokenize_rows(spark):
    rows = [(1, "A b", 7), (1, "A b", 8), (2, None, 9), (3, "", 1), (None, "long " * 50_000, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Tokens int")
    out = bpe.tokenize(docs, VOCABULARY).collect()
    assert bpe.tokenize(docs, VOCABULARY).columns == ["doc_id", "text", "tokens", "n_tokens", "exact"]
    got = {(r["doc_id"], r["n_tokens"]): r for r in out}
    assert len(out) == 5 and got[(2, None)]["exact"] is None and got[(3, 0)]["tokens"] == []
    assert all(r["exact"] for r in out if r["text"] is not None)
    back = bpe.tokenize(docs, VOCABULARY).select("text", bpe.decode(F.col("tokens"), VOCABULARY).cast("string").alias("back")).collect()
    assert all(r["text"] == r["back"] for r in back)
    assert bpe.tokenize(docs.limit(0), VOCABULARY).count() == 0


def test_every_token_is_what_its_bytes_merge_to():
    codec = VOCABULARY.codec()
    draw = random.Random(1)
    for token in draw.sample(sorted(codec.ranks), 5000):
        assert token_counts.merge(codec.ranks, token) == [token]


def test_prefix_counts_as_by_encoding_each_prefix():
    codec = VOCABULARY.codec()
    texts = [*ODD, *_random_texts()]
    counts, ends = token_counts.Counter(codec, VOCABULARY.pattern).count(texts)
    for k, text in enumerate(texts):
        expected = [len(codec.encoding.encode_ordinary(text[: j + 1])) for j in range(len(text))]
        assert counts[ends[k] : ends[k + 1]].tolist() == expected, repr(text)
    for a, b in zip(token_counts.packed(counts, ends), range(len(texts))):
        assert token_counts.unpacked(a).tolist() == counts[ends[b] : ends[b + 1]].tolist()


def test_forgetting_changes_nothing(monkeypatch):
    texts = _random_texts(30)
    one = token_counts.Counter(VOCABULARY.codec(), VOCABULARY.pattern)
    expected = [one.count([t])[0].tolist() for t in texts]
    monkeypatch.setattr(token_counts, "HELD", 3)
    other = token_counts.Counter(VOCABULARY.codec(), VOCABULARY.pattern)
    assert [other.count([t])[0].tolist() for t in texts] == expected


def test_no_pair_of_tokens_is_merged_twice(monkeypatch):
    texts = _random_texts(60)
    merged = []
    merge = token_counts.merge
    monkeypatch.setattr(token_counts, "merge", lambda ranks, piece: merged.append(piece) or merge(ranks, piece))
    monkeypatch.setattr(token_counts, "HELD", 3)
    counter = token_counts.Counter(VOCABULARY.codec(), VOCABULARY.pattern)
    first = [counter.count([t])[0].tolist() for t in texts]
    before = len(merged)
    assert before and [counter.count([t])[0].tolist() for t in texts] == first
    assert len(merged) == before


def test_the_pieces_met_most_outlast_forgetting(monkeypatch):
    monkeypatch.setattr(token_counts, "HELD", 4)
    codec = VOCABULARY.codec()
    counter = token_counts.Counter(codec, VOCABULARY.pattern)
    counter.count(["漢字 bee bee bee cad cad cad dew dew ewe"])
    counter.forget()
    assert list(counter) == [" bee", " cad"]
    text = "x cad fee bee漢"
    assert counter.count([text])[0].tolist() == [len(codec.encoding.encode_ordinary(text[: j + 1])) for j in range(len(text))]
    counter.forget()
    assert not counter


@pytest.mark.parametrize("name, most", [("SHORT", 1), ("SHORT", 5), ("TOGETHER", 2), ("PAIRS", 2)])
def test_bounds_of_counting_together_change_nothing(monkeypatch, name, most):
    codec = VOCABULARY.codec()
    texts = [*ODD, *_random_texts(60), "x" * 63, "y" * 64, "z" * 65, "é" * 32, "ß" * 33]
    expected = token_counts.Counter(codec, VOCABULARY.pattern).count(texts)
    monkeypatch.setattr(token_counts, name, most)
    got = token_counts.Counter(codec, VOCABULARY.pattern).count(texts)
    assert got[0].tolist() == expected[0].tolist() and got[1].tolist() == expected[1].tolist()
    for k, text in enumerate(texts):
        assert got[0][got[1][k] : got[1][k + 1]].tolist() == [len(codec.encoding.encode_ordinary(text[: j + 1])) for j in range(len(text))]


def test_merging_as_the_tokenizer_merges():
    codec = VOCABULARY.codec()
    draw = random.Random(7)
    tokens = sorted(codec.ranks)
    for _ in range(3000):
        piece = b"".join(draw.choices(tokens, k=draw.randint(1, 3)))
        assert token_counts.merge(codec.ranks, piece) == [codec.bytes_of[t] for t in codec.encoding._encode_single_piece(piece)]


def test_steps_out_of_range_of_a_byte():
    counts = np.array([1, 400, 2, 5], np.int64)
    (steps,) = token_counts.packed(counts, np.array([0, 4]))
    assert token_counts.unpacked(steps).tolist() == counts.tolist()


@pytest.mark.parametrize("at", ["/root/testdata/sf0.001"])
def test_questions_answered_from_steps(spark, at):
    docs = spark.read.parquet(f"{at}/documents.parquet").limit(40)
    extra = spark.createDataFrame([(None, None), (1, ""), (1, "a b")], "doc_id long, text string")
    own = token_counts.counts(docs.select("doc_id", "text").unionAll(extra), VOCABULARY)
    own = own.withColumns({"fit": token_counts.within(F.col("steps"), 20), "at": token_counts.count_at(F.col("steps"), 50), "none": token_counts.within(F.col("steps"), 0)})
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    encode = VOCABULARY.codec().encoding.encode_ordinary
    for r in own.collect():
        if r["doc_id"] in texts and r["n_tokens"] > 2:
            text = texts[r["doc_id"]]
            assert r["n_tokens"] == len(encode(text)) and r["at"] == len(encode(text[:50])) and r["none"] == 0
            assert r["fit"] == max(k for k in range(len(text) + 1) if len(encode(text[:k])) <= 20)
        elif r["doc_id"] is None:
            assert r["steps"] is None and r["n_tokens"] is None and r["fit"] is None
