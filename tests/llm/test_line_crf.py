"""The field: Viterbi against all labellings, slopes against finite differences, spliced texts held out, odd rows."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from cataloom.llm import line_crf


def test_viterbi_as_by_all_labellings():
    draw = np.random.default_rng(1)
    for _ in range(60):
        sizes = draw.integers(0, 7, 3)
        features = draw.normal(0, 1, (sizes.sum(), len(line_crf.FEATURES)))
        field = line_crf.Field(draw.normal(0, 1, len(line_crf.FEATURES)), draw.normal(0, 2, (2, 2)))
        bounds = np.r_[0, np.cumsum(sizes)]
        got = field.label(features, bounds)
        for a, b in zip(bounds[:-1], bounds[1:]):
            emit = features[a:b] @ field.state
            score = lambda y: sum(e * k for e, k in zip(emit, y)) + sum(field.move[p, q] for p, q in zip(y, y[1:]))
            best = max(itertools.product((0, 1), repeat=int(b - a)), key=score)
            assert got[a:b].astype(int).tolist() == list(best)


def test_slopes():
    draw = np.random.default_rng(2)
    x = draw.normal(0, 1, (4, 5, len(line_crf.FEATURES)))
    real = (np.arange(5) < np.array([5, 3, 1, 4])[:, None]).astype(float)
    x *= real[:, :, None]
    truth = draw.integers(0, 2, (4, 5)) * real
    share, theta = np.array([0.1, 0.4, 0.2, 0.3]), draw.normal(0, 1, len(line_crf.FEATURES) + 4)
    _, slope = line_crf.likelihood(theta, x, real, truth, share)
    for k in range(len(theta)):
        step = np.eye(len(theta))[k] * 1e-6
        near = (line_crf.likelihood(theta + step, x, real, truth, share)[0] - line_crf.likelihood(theta - step, x, real, truth, share)[0]) / 2e-6
        assert abs(near - slope[k]) < 1e-6


@pytest.fixture(scope="module")
def labelled(spark):
    at = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{at}/documents.parquet").join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id")
    return docs.select("doc_id", "text", "quality").orderBy("doc_id").collect()


def _lines(rows, poor):
    return [[x for x in r["text"].split("\n") if x.strip()] for r in rows if (r["quality"] == 0) == poor]


@pytest.fixture(scope="module")
def field(spark, labelled):
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in labelled if r["doc_id"] % 2 == 0], "doc_id long, text string")
    labels = spark.createDataFrame([(r["doc_id"], r["quality"]) for r in labelled], "doc_id long, quality int")
    return line_crf.fit(docs, labels)


@pytest.mark.parametrize("fine,poor", [(6, 6), (6, 3), (3, 3), (6, 1), (1, 6)])
def test_short_blocks_of_held_out_texts_are_found(labelled, field, fine, poor):
    other = [r for r in labelled if r["doc_id"] % 2]
    good, bad = [x for x in _lines(other, False) if len(x) >= fine], [x for x in _lines(other, True) if x]
    texts, truth = [], []
    for k in range(200):
        tail = list(itertools.islice(itertools.cycle(bad[k % len(bad)]), poor))
        texts.append("\n".join(good[k % len(good)][:fine] + tail))
        truth += [False] * fine + [True] * len(tail)
    lines = line_crf.Lines(pa.array(texts))
    right = (field.label(lines.features, lines.bounds) == np.array(truth)).mean()
    print(fine, poor, right)
    assert right >= 0.85


def test_held_out_documents(spark, labelled, field):
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["quality"]) for r in labelled if r["doc_id"] % 2], "doc_id long, text string, quality int")
    kept = line_crf.retain(docs, field)
    fine, poor = (docs.filter(c).count() for c in ("quality <> 0", "quality = 0"))
    assert kept.filter("quality <> 0").count() >= 0.99 * fine and kept.filter("quality = 0").count() <= 0.05 * poor


def test_stretches_cover_all_or_spread():
    assert line_crf.stretches(np.array([0, 70, 70]), 8, 32) == [(0, 0, 32), (0, 32, 64), (0, 64, 70)]
    assert [a for _, a, _ in line_crf.stretches(np.array([0, 320]), 4, 32)] == [0, 64, 160, 224]


def test_odd_rows(spark, field):
    rows = [(1, "A plain sentence of words.", "x"), (1, "A plain sentence of words.", "x"), (2, None, "x"), (3, "", "x"), (4, " \n\t\n", "x"), (None, "Another sentence, quite plain.\n" * 3, "x"), (5, "Words of a line that goes on.\n" * 20_000, "x")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, source string, content_share string, lines int")
    kept = line_crf.retain(docs, field)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert sum(r["doc_id"] in (2, 3, 4) for r in kept.collect()) == 0 and kept.filter("doc_id = 1").count() == 2
    out = line_crf.retained(docs, field)
    assert out.count() == kept.count() and all(len(r["marks"]) == r["lines"] and r["marks"].count("C") == r["content_lines"] for r in out.collect())
    assert line_crf.retain(docs.limit(0), field).count() == 0 and line_crf.retained(docs.limit(0), field).count() == 0
    none = line_crf.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert line_crf.retained(docs, none, 0.9).count() == 4
