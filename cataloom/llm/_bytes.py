"""Vectorised text kernel: whole Arrow batches as flat UTF-8 bytes in numpy.

A *word* is a maximal run of characters that are neither ASCII non-alphanumerics nor
in the ranges U+0080-00BF (but for the letters U+00AA, 00B5, 00BA), U+2000-206F and
U+3000-303F, after lower-casing.  ``words_of`` is the plain-Python statement of the
same rule; tests hold the two together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that one numpy step handles; temporaries are about 40 times as large.
BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POW: dict[str, np.ndarray] = {}

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(65, 91)]] = True
_WORD[128:] = True
_SPLIT = re.compile(r"[\x00-/:-@\[-`{-\x7f\x80-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf\u2000-\u206f\u3000-\u303f]+")


def words_of(text: str | None) -> list[str]:
    """The words of a text, by the rule above."""
    low = pc.utf8_lower(pa.scalar(text or "")).as_py()
    return [w for w in _SPLIT.split(low) if w]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("p", ())) < n:
        size = max(n, BLOCK + 1)
        for key, base in (("p", _BASE), ("i", _INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POW[key] = np.multiply.accumulate(steps)
    return _POW["p"][:n], _POW["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and where each begins (n + 1 offsets). A null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def parts(batch: pa.RecordBatch, text: str, most: int = 2 * BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text at most each (a longer text is a slice of its own)."""
    if not len(batch):
        return
    _, off = flat(batch.column(batch.schema.get_field_index(text)))
    start = 0
    while start < len(batch):
        stop = int(np.searchsorted(off, off[start] + most, "right")) - 1
        stop = min(max(stop, start + 1), len(batch))
        yield batch.slice(start, stop - start)
        start = stop


def _separators(raw: np.ndarray) -> np.ndarray:
    """True for bytes of words."""
    is_word = _WORD[raw]
    high = np.flatnonzero((raw == 0xC2) | (raw == 0xE2) | (raw == 0xE3))
    if len(high):
        b1 = raw[np.minimum(high + 1, len(raw) - 1)]
        c2 = high[(raw[high] == 0xC2) & ~np.isin(b1, (0xAA, 0xB5, 0xBA))]
        e2 = high[((raw[high] == 0xE2) & ((b1 == 0x80) | ((b1 == 0x81) & (raw[np.minimum(high + 2, len(raw) - 1)] <= 0xAF)))) | ((raw[high] == 0xE3) & (b1 == 0x80))]
        for at in (c2, c2 + 1, e2, e2 + 1, e2 + 2):
            is_word[at] = False
    return is_word


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start byte) of every word of lower-cased bytes ``raw``. No word spans two texts."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    is_word = _separators(raw)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    ends = np.flatnonzero(is_word & (~after | cut[1:])) + 1
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        at = int(starts[first])
        last = max(int(np.searchsorted(ends, at + BLOCK, "right")), first + 1)
        stop = int(ends[last - 1])
        power, inverse = _powers(stop - at)
        sums = np.zeros(stop - at + 1, np.uint64)
        np.cumsum((raw[at:stop].astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
        s, e = starts[first:last] - at, ends[first:last] - at
        out[first:last] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        first = last
    return out, starts


def word_batch(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each text (n + 1 offsets)) of a column of texts."""
    raw, off = flat(pc.utf8_lower(column.cast(pa.large_string())))
    hashes, starts = words(raw, off)
    return hashes, np.searchsorted(starts, off)


def ngrams(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of all runs of ``n`` words within a text."""
    total = len(hashes) - n + 1
    if total <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(total, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + total]
    left = np.repeat(bounds[1:], np.diff(bounds))[:total] - np.arange(total)
    at = np.flatnonzero(left >= n)
    return mix(out[at]), at
