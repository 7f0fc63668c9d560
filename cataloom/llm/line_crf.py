"""Quality rules by line labelling (operator 8).

Every line of a document is described by a dozen features (shares of capitals, symbols,
bars, digits, repeated words, ...).  A linear-chain conditional random field over the lines
marks each as content or boilerplate (Viterbi); a document is retained if at least
``least`` of its letters lie in content lines.

The field is trained here, in numpy, by maximum likelihood with forward-backward
gradients on at most ``sample`` labelled documents (those first in hash order of doc_id), of
each at most ``per_text`` stretches of ``STRETCH`` lines, spread evenly over it.  The lines of a
document labelled quality 0 count as boilerplate, those of others as content.  Such documents
are of one kind throughout, so as many sequences again are spliced from blocks of 1 to 6 lines
of both kinds in turn; from them the field learns what a change of kind is like.

Defined results: without labelled documents of both kinds every line is content; blank
lines are left out; a null text, or one without any visible character, has no line, share
0 and is not retained; a tie in Viterbi is content; rows that repeat a doc_id are judged apart; rows whose doc_id
is null are judged like others; a doc_id with several labels has the least; other columns, whatever
their names, pass unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes
from ._spark import clashless, hint, table, workers_find_package

LEAST = 0.5
#: Labelled documents that the field is trained on at most, and stretches of such a document.
SAMPLE, PER_TEXT = 3000, 8
STRETCH = 32

_KIND = np.zeros((256, 8), np.uint8)  # letter, capital, digit, space, symbol, bar, loud, character
_KIND[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)], 0] = 1
_KIND[65:91, 1] = 1
_KIND[48:58, 2] = 1
_KIND[[9, 11, 12, 13, 32], 3] = 1
_KIND[[ord(c) for c in "#$%&*<>{}[]\\^~`@=+_/"], 4] = 1
_KIND[ord("|"), 5] = 1
_KIND[ord("!"), 6] = 1
_KIND[[*range(0x80), *range(0xC0, 0x100)], 7] = 1
FEATURES = ["bias", "capitals", "all capitals", "symbols", "noisy words", "bars", "bar list", "digits", "loud", "repeats", "repeated line", "short", "sentence", "long words"]


class Lines:
    """The visible lines of a column of texts and their features."""

    def __init__(self, column: pa.Array) -> None:
        raw, off = _bytes.flat(column)
        n = len(raw)
        ends = np.unique(np.concatenate([np.flatnonzero(raw == 10), off[1:]]))
        starts = np.r_[0, ends[:-1] + (raw[np.minimum(ends[:-1], max(n - 1, 0))] == 10)] if len(ends) else ends
        keep = starts < ends
        starts, ends = starts[keep], ends[keep]
        kinds = np.empty((len(starts), 8), np.int64)
        two = np.stack([starts, ends], 1).ravel()
        if len(two) and two[-1] == n:
            two = two[:-1]
        for k in range(8):
            sums = np.add.reduceat(_KIND[raw, k], two, dtype=np.int64)[::2] if len(two) else np.zeros(0, np.int64)
            kinds[:, k] = sums
        capital = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)) if n else np.zeros(0, np.int64)
        kinds[:, 1] += np.searchsorted(capital, ends) - np.searchsorted(capital, starts)
        seen = kinds[:, 7] > kinds[:, 3]
        self.starts, self.ends, kinds = starts[seen], ends[seen], kinds[seen]
        self.bounds = np.searchsorted(self.starts, off)
        self.letters = kinds[:, 0]
        self.visible = kinds[:, 7] - kinds[:, 3]
        self.features = self._features(raw, off, kinds)

    def _features(self, raw: np.ndarray, off: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        letters, capitals, digits, spaces, symbols, bars, loud, _ = (kinds[:, k].astype(np.float64) for k in range(8))
        visible = np.maximum(self.visible, 1)
        hashes, at = _bytes.words(raw, np.unique(np.concatenate([off, self.starts])))
        first, last = np.searchsorted(at, self.starts), np.searchsorted(at, self.ends)
        n_words = np.maximum(last - first, 1)
        same = np.zeros(len(hashes) + 1, np.int64)
        for back in (1, 2):
            hit = np.zeros(len(hashes), np.int64)
            hit[back:] = hashes[back:] == hashes[:-back]
            same[1:] |= hit
        same = np.cumsum(same)
        repeats = (same[last] - same[first]) / n_words
        sums = np.r_[np.uint64(0), np.cumsum(hashes)]
        own = _bytes.mix(sums[last] - sums[first]) >> np.uint64(24)
        doc = np.searchsorted(self.bounds, np.arange(len(own)), "right").astype(np.uint64) - np.uint64(1)
        _, back, times = np.unique((doc << np.uint64(40)) | own, return_inverse=True, return_counts=True)
        end = raw[self.ends - 1] if len(self.ends) else raw[:0]
        end = np.where((end == 13) & (self.ends - self.starts > 1), raw[np.maximum(self.ends - 2, 0)], end) if len(self.ends) else end
        upper, sym, bar = capitals / np.maximum(letters, 1), symbols / visible, bars / n_words
        return np.stack(
            [
                np.ones(len(letters)), upper, upper > 0.6, np.minimum(sym * 4, 1), symbols / n_words > 1, np.minimum(bar, 1), bar > 0.3, digits / visible,
                np.minimum(loud / n_words, 1), repeats, (times[back.ravel()] > 1), visible < 20, np.isin(end, [ord(c) for c in ".?!"]), np.minimum(letters / n_words / 20, 1),
            ],
            1,
        ).astype(np.float64) if len(letters) else np.zeros((0, len(FEATURES)))


class Field:
    """Weights: ``state`` scores boilerplate against content, ``move[a, b]`` a line of kind b after one of kind a (1: boilerplate)."""

    def __init__(self, state: np.ndarray, move: np.ndarray) -> None:
        self.state, self.move = state, move

    @classmethod
    def content_only(cls) -> Field:
        state = np.zeros(len(FEATURES))
        state[0] = -50
        return cls(state, np.zeros((2, 2)))

    def label(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """True for lines of boilerplate: the best labelling of each text, all texts of a batch at once."""
        emit = features @ self.state
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        begin, left = bounds[:-1][order], size[order]
        came = np.zeros((len(emit), 2), bool)  # the best kind before a line of either kind
        score = np.zeros((int((left > 0).sum()), 2))
        live = len(score)
        last = np.zeros(len(size), bool)
        for t in range(int(left[0]) if len(left) else 0):
            now = int(np.searchsorted(-left, -t, "left"))  # texts of more than t lines
            if now < live:
                last[now:live] = score[now:live, 1] > score[now:live, 0]
                live = now
            at = begin[:live] + t
            if t:
                old = score[:live]
                for kind in (0, 1):
                    stay, turn = old[:, 0] + self.move[0, kind], old[:, 1] + self.move[1, kind]
                    came[at, kind] = turn > stay
                    score_kind = np.maximum(stay, turn)
                    if kind == 0:
                        first = score_kind
                score = np.stack([first, score_kind + emit[at]], 1)
            else:
                score = np.stack([np.zeros(live), emit[at]], 1)
        last[:live] = score[:live, 1] > score[:live, 0]
        out = np.zeros(len(emit), bool)
        kind = last
        for t in range(int(left[0]) - 1 if len(left) else -1, -1, -1):
            live = int(np.searchsorted(-left, -t, "left"))
            at = begin[:live] + t
            out[at] = kind[:live]
            kind = kind.copy()
            kind[:live] = came[at, kind[:live].astype(np.int64)]
        return out


def stretches(bounds: np.ndarray, per_text: int = PER_TEXT, length: int = STRETCH) -> list[tuple[int, int, int]]:
    """(text, first line, end) of at most ``per_text`` stretches of each text, spread evenly over it."""
    out = []
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        n = -(-(b - a) // length)
        for i in sorted({j * n // min(n, per_text) for j in range(min(n, per_text))}):
            out.append((k, a + i * length, min(a + (i + 1) * length, b)))
    return out


def spliced(sequences: list[np.ndarray], poor: list[bool], how_many: int, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, marks) of sequences made of 2 to 5 blocks of 1 to 6 lines, of both kinds in turn."""
    draw = np.random.default_rng(seed)
    of = [[s for s, p in zip(sequences, poor) if p == kind and len(s)] for kind in (False, True)]
    out = []
    for _ in range(how_many if of[0] and of[1] else 0):
        kind, rows, marked = bool(draw.integers(2)), [], []
        for _ in range(draw.integers(2, 6)):
            own = of[kind][draw.integers(len(of[kind]))]
            n = min(int(draw.integers(1, 7)), len(own))
            at = int(draw.integers(len(own) - n + 1))
            rows.append(own[at : at + n])
            marked.append(np.full(n, kind))
            kind = not kind
        out.append((np.concatenate(rows), np.concatenate(marked)))
    return out


def likelihood(theta: np.ndarray, x: np.ndarray, real: np.ndarray, truth: np.ndarray, share: np.ndarray) -> tuple[float, np.ndarray]:
    """(weighted log-likelihood of marked sequences, its slope). ``x``: sequences x lines x features; ``real``: which lines there are."""
    n, most, _ = x.shape
    state, move = theta[:-4], theta[-4:].reshape(2, 2)
    emit = np.zeros((n, most, 2))
    emit[:, :, 1] = x @ state
    forward, backward = np.zeros((n, most, 2)), np.zeros((n, most, 2))
    forward[:, 0] = emit[:, 0]
    for t in range(1, most):
        forward[:, t] = np.where(real[:, t, None] > 0, np.logaddexp(forward[:, t - 1, 0, None] + move[0], forward[:, t - 1, 1, None] + move[1]) + emit[:, t], forward[:, t - 1])
    for t in range(most - 2, -1, -1):
        ahead = emit[:, t + 1] + backward[:, t + 1]
        backward[:, t] = np.where(real[:, t + 1, None] > 0, np.logaddexp(ahead[:, None, 0] + move[:, 0], ahead[:, None, 1] + move[:, 1]), 0)
    total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    prob = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None]) * real
    joint = np.exp(np.minimum(forward[:, :-1, :, None] + move + (emit + backward)[:, 1:, None, :] - total[:, None, None, None], 0)) * real[:, 1:, None, None]
    kinds = np.stack([1 - truth, truth], 2)
    pairs = np.einsum("nta,ntb,nt->nab", kinds[:, :-1], kinds[:, 1:], real[:, 1:])
    fit = (emit[:, :, 1] * truth * real).sum(1) + (pairs * move).sum((1, 2)) - total
    slope = np.concatenate([np.einsum("n,nt,ntf->f", share, truth * real - prob, x), (share[:, None, None] * (pairs - joint.sum(1))).sum(0).ravel()])
    return float((share * fit).sum()), slope


def train(sequences: list[np.ndarray], poor: list[bool], steps: int = 150, rate: float = 0.1, decay: float = 1e-4) -> Field:
    """A field fitted to sequences of lines that all are boilerplate (``poor``) or content, and to ones spliced of them, by Adam on the likelihood."""
    known = [(s, np.full(len(s), p)) for s, p in zip(sequences, poor) if len(s)]
    bad = sum(bool(m[0]) for _, m in known)
    if not 0 < bad < len(known):
        return Field.content_only()
    mixed = spliced(sequences, poor, len(known))
    marked = known + mixed
    # both kinds count alike, spliced sequences as much as whole ones, and each sequence whatever its length
    weight = np.array([0.25 / (bad if m[0] else len(known) - bad) for _, m in known] + [0.5 / len(mixed)] * len(mixed))
    size = np.array([len(m) for _, m in marked])
    n, most = len(size), int(size.max())
    where = (np.repeat(np.arange(n), size), np.concatenate([np.arange(k) for k in size]))
    x, real, truth = np.zeros((n, most, len(FEATURES))), np.zeros((n, most)), np.zeros((n, most))
    x[where], real[where], truth[where] = np.concatenate([s for s, _ in marked]), 1, np.concatenate([m for _, m in marked])
    theta, m, v = np.zeros(len(FEATURES) + 4), 0.0, 0.0
    for step in range(1, steps + 1):
        slope = likelihood(theta, x, real, truth, weight / size)[1] - decay * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(theta[:-4], theta[-4:].reshape(2, 2))


def _described(per_text: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _bytes.parts(batch, "text"):
                lines = Lines(part.column(2))
                cut = stretches(lines.bounds, per_text)
                of = pa.array([k for k, _, _ in cut], pa.int64())
                features = pa.array([lines.features[a:b].astype(np.float32).tobytes() for _, a, b in cut], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), features], ["doc_id", "quality", "features"])

    return describe


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, per_text: int = PER_TEXT) -> Field:
    """A field trained on at most ``sample`` labelled documents, half of them of quality 0 where there are so many; only the features of their lines come to the driver."""
    workers_find_package(docs.sparkSession)
    marked = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).filter("doc_id is not null and quality is not null")
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    poor, fine = (marked.filter(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for c in ("quality = 0", "quality <> 0"))
    chosen = table(poor.unionAll(fine))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(hint(chosen), "doc_id").select("doc_id", "quality", "text")
    found = rows.mapInArrow(_described(per_text), "doc_id long, quality int, features binary").limit(sample * per_text).collect()
    found.sort(key=lambda r: (r["doc_id"], bytes(r["features"])))
    return train([np.frombuffer(r["features"], np.float32).reshape(-1, len(FEATURES)).astype(np.float64) for r in found], [r["quality"] == 0 for r in found])


def label_texts(field: Field, texts: pa.Array) -> list[pa.Array]:
    """lines, content_lines, content_share, marks of a column of texts: marks has C or B for each visible line."""
    lines = Lines(texts)
    bad = field.label(lines.features, lines.bounds)
    count = np.diff(lines.bounds)
    amount = np.r_[0, np.cumsum(np.maximum(lines.letters, 1))]
    good = np.r_[0, np.cumsum(np.maximum(lines.letters, 1) * ~bad)]
    share = (good[lines.bounds[1:]] - good[lines.bounds[:-1]]) / np.maximum(amount[lines.bounds[1:]] - amount[lines.bounds[:-1]], 1)
    content = np.r_[0, np.cumsum(~bad)]
    signs = np.where(bad, ord("B"), ord("C")).astype(np.uint8).tobytes()
    named = pa.Array.from_buffers(pa.string(), len(count), [None, pa.py_buffer(lines.bounds.astype(np.int32)), pa.py_buffer(signs)])
    return [pa.array(count.astype(np.int32)), pa.array((content[lines.bounds[1:]] - content[lines.bounds[:-1]]).astype(np.int32)), pa.array(share), named]


def retained(docs: DataFrame, field: Field, least: float = LEAST) -> DataFrame:
    """(doc_id, lines, content_lines, content_share, marks) of the documents that are retained."""
    workers_find_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "lines", "content_lines", "content_share", "marks"]
        for batch in batches:
            for part in _bytes.parts(batch, "text"):
                out = pa.RecordBatch.from_arrays([part.column(0), *label_texts(field, part.column(1))], names)
                yield out.filter(pa.array((out.column(3).to_numpy() >= least) & (out.column(1).to_numpy() > 0)))

    return rows.mapInArrow(mark, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lines int, content_lines int, content_share double, marks string")


def retain(docs: DataFrame, field: Field, least: float = LEAST) -> DataFrame:
    """``docs`` without those of too little content; only texts go to Python, and only shares come back."""
    workers_find_package(docs.sparkSession)

    @F.arrow_udf("double")
    def share(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        done = []
        for part in _bytes.parts(batch, "text"):
            lines, _, content, _ = label_texts(field, part.column(0))
            done.append(np.where(lines.to_numpy() > 0, content.to_numpy(), -1.0))
        return pa.array(np.concatenate([np.zeros(0), *done]))

    own = clashless(docs, "content_share")
    return docs.withColumn(own, share(F.col("text").cast("string"))).filter(F.col(own) >= max(least, 0)).drop(own)
