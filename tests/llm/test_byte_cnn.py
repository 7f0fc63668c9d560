"""Slopes against finite differences, inference against a plain convolution, held-out accuracy, odd texts."""

import numpy as np
import pyarrow as pa

from cataloom.llm import _bytes, byte_cnn


def _plain(net, window):
    pools = []
    padded = np.r_[window, np.zeros(4, np.uint8)]
    for w in net.conv:
        pools.append(np.max([sum(w[k][padded[t + k]] for k in range(len(w))) for t in range(len(window))], 0))
    z = np.maximum(np.concatenate(pools) + net.bias, 0) @ net.dense + net.base
    return z - np.log(np.exp(z).sum())


def test_tables_give_the_convolution():
    draw = np.random.default_rng(1)
    net = byte_cnn.Network.new(["a", "b", "c"])
    seen = draw.integers(0, 256, (5, 40)).astype(np.uint8)
    assert np.allclose(net.scores(seen), [_plain(net, w) for w in seen], atol=1e-4)


def test_slopes():
    draw = np.random.default_rng(3)
    net = byte_cnn.Network.new(["a", "b"], widths=(2, 3), filters=3)
    net.conv, net.dense = [w.astype(np.float64) for w in net.conv], net.dense.astype(np.float64)
    seen, truth = draw.integers(0, 9, (6, 12)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0])
    _, slopes = byte_cnn.gradients(net, seen, truth)
    for weights, slope in zip([*net.conv, net.dense], [*slopes[:2], slopes[3]]):
        for at in [tuple(x) for x in np.argwhere(slope != 0)[:6]]:
            kept = weights[at]
            weights[at] = kept + 1e-6
            up = byte_cnn.gradients(net, seen, truth)[0]
            weights[at] = kept - 1e-6
            down = byte_cnn.gradients(net, seen, truth)[0]
            weights[at] = kept
            assert abs((up - down) / 2e-6 - slope[at]) < 1e-5


def test_windows_cover_whole_texts():
    raw, off = _bytes.flat(pa.array(["abcde", "", None, "x" * 8]))
    seen, of, held = byte_cnn.windows(raw, off, 4)
    assert of.tolist() == [0, 0, 3, 3] and held.tolist() == [4, 1, 4, 4]
    assert [bytes(w) for w in seen] == [b"abcd", b"e\0\0\0", b"xxxx", b"xxxx"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("pmod(xxhash64(doc_id), 5) < 2")
    known, other = docs.filter("pmod(xxhash64(doc_id), 5) = 0"), docs.filter("pmod(xxhash64(doc_id), 5) = 1")
    out = byte_cnn.identify(other, byte_cnn.fit(known)).join(other.select("doc_id", "lang"), "doc_id")
    right = out.filter("language = lang").count() / out.count()
    assert right > 0.985, right


def test_odd_rows(spark):
    rows = [(1, "the thing of that", "en"), (2, "der die und das ist", "de"), (3, None, "en"), (4, "", None), (5, " \n ", "de"), (5, "und die der", "de"), (None, "und " * 300_000, None)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, language string")
    net = byte_cnn.fit(docs)
    out = byte_cnn.identify(docs, net).collect()
    assert len(out) == len(rows)
    assert [r["language"] for r in out if r["doc_id"] in (3, 4)] == [None, None] and sum(r["language"] is None for r in out) == 3
    assert {r["probability"] for r in out if r["language"] is None} == {0.0}
    assert {r["language"] for r in byte_cnn.identify(docs, byte_cnn.fit(docs.filter("lang = 'en'"))).collect()} == {"en", None}
    assert {r["language"] for r in byte_cnn.identify(docs, byte_cnn.fit(docs.filter("lang is null"))).collect()} == {None}
    assert byte_cnn.identify(docs.limit(0), net).count() == 0
