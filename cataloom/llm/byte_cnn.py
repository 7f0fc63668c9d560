"""Language identification by a byte convolutional network (operator 7).

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes, the last one padded with
zeros.  Filters of several widths slide over a window; a filter's weights are one vector a
byte value and offset, so a convolution is a sum of table rows.  The greatest value of each
filter over the window, clipped at 0, goes through a softmax layer.  A text's language is the
one with the greatest mean log-probability over all its windows, each weighted by its bytes.

The network is trained here, in numpy, with Adam on windows of at most ``sample`` labelled
documents (those first in hash order of doc_id, an equal share of each language; at most
``per_text`` windows of each, spread evenly over it).  Everything else reads whole texts.

Two bytes at once are looked up in tables made once a worker, so a byte costs two rows of
table, one of all widths' beginnings and one of the rest.

Defined results: null and empty texts, and texts of white space only, have no language and
probability 0; ties go to the language that sorts first; without labelled documents of two
languages every other text has the only language, or none; rows that repeat are judged apart;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _bytes
from ._spark import workers_find_package

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
SAMPLE, PER_TEXT = 1200, 8
#: Windows that one numpy step handles.
BATCH = 512


def windows(raw: np.ndarray, offsets: np.ndarray, length: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows x length bytes, text of each window, bytes of it that are the text's) of all texts."""
    size = np.diff(offsets)
    count = -(-size // length)
    of = np.repeat(np.arange(len(size)), count)
    place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][of] + place * length
    held = np.minimum(size[of] - place * length, length)
    padded = np.concatenate([raw, np.zeros(length, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, length)[start] if len(of) else np.zeros((0, length), np.uint8)
    return np.where(np.arange(length) < held[:, None], out, 0).astype(np.uint8), of, held


@dataclass
class Network:
    """``conv[w]``: offsets x 256 x filters of each width; ``dense``: filters of all widths x languages."""

    languages: list[str]
    conv: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    base: np.ndarray

    @classmethod
    def new(cls, languages: list[str], widths: tuple[int, ...] = WIDTHS, filters: int = FILTERS, seed: int = 7) -> Network:
        draw = np.random.default_rng(seed)
        conv = [draw.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in widths]
        n = filters * len(widths)
        return cls(languages, conv, np.zeros(n, np.float32), draw.normal(0, 0.3, (n, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tables"}

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Two bytes -> what offsets 0 and 1 of all filters give; two bytes -> what offsets 2 and 3 of those of width 3 and more give."""
        two = np.arange(65536)
        a, b = two & 255, two >> 8  # little-endian: the first byte is the low one
        head = np.concatenate([w[0][a] + (w[1][b] if len(w) > 1 else 0) for w in self.conv], 1)
        tail = np.concatenate([w[2][a] + (w[3][b] if len(w) > 3 else 0) for w in self.conv if len(w) > 2], 1)
        return head, tail

    def pooled(self, seen: np.ndarray) -> np.ndarray:
        """Greatest value of every filter over each window (windows x length bytes)."""
        head, tail = self.tables
        n, length = seen.shape
        wide = np.zeros((n, length + 4), np.uint8)
        wide[:, :length] = seen
        pairs = wide[:, :-1].astype(np.uint16) | (wide[:, 1:].astype(np.uint16) << 8)
        filters, short = head.shape[1], head.shape[1] - tail.shape[1]
        out = np.empty((n, filters), np.float32)
        for k in range(0, n, 64):
            own = pairs[k : k + 64]
            value = head[own[:, :length]]
            value[:, :, short:] += tail[own[:, 2 : length + 2]]
            out[k : k + 64] = value.max(1)
        return out

    def scores(self, seen: np.ndarray) -> np.ndarray:
        """Log-probabilities (windows x languages)."""
        z = np.maximum(self.pooled(seen) + self.bias, 0) @ self.dense + self.base
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def texts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean log-probabilities (texts x languages); nan for a text without bytes."""
        seen, of, held = windows(raw, offsets)
        total = np.zeros((len(offsets) - 1, len(self.languages)))
        for k in range(0, len(seen), BATCH):
            np.add.at(total, of[k : k + BATCH], self.scores(seen[k : k + BATCH]) * held[k : k + BATCH, None])
        with np.errstate(invalid="ignore", divide="ignore"):
            return total / np.diff(offsets)[:, None]


def gradients(net: Network, seen: np.ndarray, truth: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """(mean cross-entropy, its slopes by conv of each width, bias, dense, base)."""
    n, length = seen.shape
    wide = np.zeros((n, length + 4), np.uint8)
    wide[:, :length] = seen
    best, pools = [], []
    for w in net.conv:
        value = sum(w[k][wide[:, k : k + length]] for k in range(len(w)))
        best.append(value.argmax(1))
        pools.append(value.max(1))
    pool = np.concatenate(pools, 1) + net.bias
    live = np.maximum(pool, 0)
    z = live @ net.dense + net.base
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(1, keepdims=True)
    loss = float(-np.log(np.maximum(p[np.arange(n), truth], 1e-12)).mean())
    slope = p
    slope[np.arange(n), truth] -= 1
    slope /= n
    back = (slope @ net.dense.T) * (pool > 0)
    out, first = [], 0
    for w, at in zip(net.conv, best):
        filters = w.shape[2]
        own, grad = back[:, first : first + filters], np.zeros_like(w)
        for k in range(len(w)):
            byte = wide[np.arange(n)[:, None], at + k]
            np.add.at(grad[k], (byte, np.arange(filters)[None, :]), own)
        out.append(grad)
        first += filters
    return loss, [*out, back.sum(0), live.T @ slope, slope.sum(0)]


def sampled(raw: np.ndarray, offsets: np.ndarray, per_text: int = PER_TEXT) -> tuple[np.ndarray, np.ndarray]:
    """(windows, text of each): at most ``per_text`` windows of each text, spread evenly over it."""
    seen, of, _ = windows(raw, offsets)
    count = np.bincount(of, minlength=len(offsets) - 1)
    place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    most = np.maximum(count[of], per_text)
    chosen = place * per_text // most != (place - 1) * per_text // most
    return seen[chosen], of[chosen]


def train(seen: np.ndarray, labels: list[str], steps: int = 240, batch: int = 96, rate: float = 0.02, seed: int = 7) -> Network | None:
    """A network fitted to labelled windows; None where there are none."""
    names = sorted(set(labels))
    if not names:
        return None
    net = Network.new(names, seed=seed)
    if len(names) < 2:
        return net
    truth = np.searchsorted(names, np.array(labels))
    rows = [np.flatnonzero(truth == k) for k in range(len(names))]
    draw = np.random.default_rng(seed)
    weights = [*net.conv, net.bias, net.dense, net.base]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        own = np.concatenate([draw.choice(r, max(batch // len(rows), 1)) for r in rows])
        _, slopes = gradients(net, seen[own], truth[own])
        for w, g, a, b in zip(weights, slopes, m, v):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return net


def fit(docs: DataFrame, label: str = "lang", sample: int = SAMPLE, per_text: int = PER_TEXT) -> Network | None:
    """A network trained on windows of at most ``sample`` documents that have a label; only those windows come to the driver."""
    workers_find_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(f"`{label}`").cast("string").alias("label"))
    rows = rows.filter("doc_id is not null and label is not null and text is not null")
    names = sorted(r[0] for r in rows.select("label").distinct().collect())
    if not names:
        return None
    first = lambda name: rows.filter(F.col("label") == name).select("doc_id", "label").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max(sample // len(names), 1))
    chosen = first(names[0])
    for name in names[1:]:
        chosen = chosen.unionAll(first(name))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, of = sampled(*_bytes.flat(batch.column("text")), per_text)
            yield pa.RecordBatch.from_arrays([batch.column("label").take(pa.array(of)), pa.array([w.tobytes() for w in seen], pa.binary())], ["label", "seen"])

    found = sorted(map(tuple, rows.join(F.broadcast(chosen), ["doc_id", "label"]).select("text", "label").mapInArrow(cut, "label string, seen binary").limit(2 * sample * per_text).collect()))
    seen = np.frombuffer(b"".join(bytes(w) for _, w in found), np.uint8).reshape(-1, WINDOW)
    return train(seen, [name for name, _ in found])


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, language, probability): the language of every document, and its share of the mean probabilities."""
    workers_find_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _bytes.parts(batch, "text"):
                texts = part.column(1)
                empty = ~pa.compute.match_substring_regex(texts.fill_null(""), r"[^\s\pZ]").to_numpy(zero_copy_only=False)
                if net is None:
                    languages, share = [None] * len(part), np.zeros(len(part))
                else:
                    mean = np.where(empty[:, None], 0, net.texts(*_bytes.flat(texts)))
                    best = mean.argmax(1)
                    odds = np.exp(mean - mean.max(1, keepdims=True))
                    share = np.where(empty, 0, 1 / odds.sum(1))
                    languages = [None if no else net.languages[k] for no, k in zip(empty, best)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(languages, pa.string()), pa.array(share, pa.float64())], ["doc_id", "language", "probability"])

    return rows.mapInArrow(judge, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, language string, probability double")
