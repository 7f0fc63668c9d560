"""Token counts at every prefix (operator 10).

For every text the number of BPE tokens of each of its prefixes, one a character, is stored
as steps: by how many tokens the count changes when the character is added.  The counts are
exact, so a prefix has the count that encoding it alone would give.  They come from dynamic
programming over prefixes: the encoding of a prefix is the encoding of a shorter one plus a
last token, and of all tokens that end there exactly one may follow, the one that the merges
leave standing beside the shorter prefix's last token.  So no prefix is encoded anew.  New
pieces are taken together, end by end; which tokens may follow which is remembered.

A text is split into pieces as before encoding.  A prefix that ends within a piece has the
same pieces before it, but in two places: white space before a space that belongs to the
next word, and a contraction that isn't complete ('r of 're); both are counted as they are cut
when the text ends there.

``within`` and ``count_at`` answer truncation and budget questions from the steps alone.  Counts
don't always rise with the prefix; the longest prefix within a budget is asked for.

Defined results: a null text has null steps and counts, an empty one 0; a budget below one
token fits 0 characters; a length beyond the text counts the whole text; rows that repeat
are counted apart; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bytes
from ._spark import workers_find_package
from .bpe import Codec, Vocabulary

_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = frozenset(c for c in map(chr, range(0x3001)) if regex.match(f"[{_SPACE}]", c))
#: Pieces that a worker keeps the counts of; beyond it keeps those it met most, half as many at most.
HELD = 250_000
#: Pairs of tokens that a worker remembers; beyond it starts anew.
PAIRS = 500_000
#: Bytes of a piece up to which it is counted together with others, and how many are taken at once.
SHORT, TOGETHER = 64, 5_000
#: Steps of a text are bytes unless one is out of their range; the first byte has their width.
_WIDTHS = {1: np.int8, 4: np.int32}


def merge(ranks: dict[bytes, int], piece: bytes) -> list[bytes]:
    """The tokens of a piece: again and again the leftmost pair of the lowest rank is merged."""
    parts = [piece[k : k + 1] for k in range(len(piece))]
    never = 1 << 40
    rank = [ranks.get(a + b, never) for a, b in zip(parts, parts[1:])]
    while rank and (best := min(rank)) < never:
        at = rank.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del rank[at]
        if at:
            rank[at - 1] = ranks.get(parts[at - 1] + parts[at], never)
        if at < len(rank):
            rank[at] = ranks.get(parts[at] + parts[at + 1], never)
    return parts


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes of runs of these starts and sizes, one after the other."""
    ends = np.cumsum(sizes)
    steps = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    if len(steps):
        steps[0] = starts[0]
        steps[ends[:-1]] += starts[1:] - starts[:-1] - sizes[:-1]
    return np.cumsum(steps, out=steps)


class Fits(dict):
    """Pair of tokens (left << 32 | right) -> whether the merges leave the two standing side by side."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec = codec

    def __missing__(self, pair: int) -> bool:
        if len(self) >= PAIRS:
            self.clear()
        left, right = self.codec.bytes_of[pair >> 32], self.codec.bytes_of[pair & 0xFFFFFFFF]
        known = self[pair] = merge(self.codec.ranks, left + right) == [left, right]
        return known


class Counter(dict):
    """Piece -> its number, under which the counts of its prefixes lie in ``values``."""

    def __init__(self, codec: Codec, pattern: str) -> None:
        super().__init__()
        self.codec = codec
        space = pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")
        self.split = regex.compile(space).findall
        self.size = codec.lengths.tolist()
        self.fits = Fits(codec)
        self.ends = ahocorasick.Automaton()
        for token, rank in codec.ranks.items():
            self.ends.add_word(token.decode("latin-1"), rank)
        self.ends.make_automaton()
        self.fresh: list[str] = []
        self.joined: dict[tuple[str, str], int] = {}
        self.values, self.starts, self.chars, self.met = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.blank, self.opens = np.zeros(0, bool), np.zeros(0, bool)

    def forget(self) -> None:
        """Only pieces met more than once since the last time stay, of those the ones met most."""
        keep = np.flatnonzero(self.met > 1)
        if (over := len(keep) - HELD // 2) > 0:
            keep = np.sort(keep[np.argsort(self.met[keep], kind="stable")[over:]])
        names = list(self)
        self.clear()
        self.update((names[k], own) for own, k in enumerate(keep.tolist()))
        self.joined.clear()
        n = self.chars[keep]
        self.values = self.values[_runs(self.starts[keep], n)]
        self.starts, self.chars, self.met = np.cumsum(n) - n, n, np.zeros(len(keep), np.int64)
        self.blank, self.opens = self.blank[keep], self.opens[keep]

    def prefixes(self, piece: bytes) -> list[int]:
        """Tokens of every prefix of a piece, from 0 bytes on."""
        count, last = [0] * (len(piece) + 1), [0] * (len(piece) + 1)
        done = -1
        for end, token in self.ends.iter(piece.decode("latin-1")):  # the longest token that ends there first
            if end == done:
                continue
            at = end + 1 - self.size[token]
            if not at or self.fits[last[at] << 32 | token]:
                count[end + 1], last[end + 1], done = count[at] + 1, token, end
        return count

    def together(self, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of every prefix of one byte or more, of short pieces in a row."""
        stops = np.cumsum(sizes)
        count, last = np.zeros(len(raw), np.int32), np.zeros(len(raw), np.int64)
        found = np.fromiter(self.ends.iter(raw.tobytes().decode("latin-1")), np.dtype("i4,i4"))
        end, token = found["f0"], found["f1"].astype(np.int64)
        start = np.repeat(stops - sizes, sizes)[end]
        at = end + 1 - self.codec.lengths[token]
        own = at >= start
        end, token, at, start = end[own], token[own], at[own], start[own]
        turn = np.arange(len(end))
        turn -= np.maximum.accumulate(np.where(np.diff(end, prepend=-1) > 0, turn, 0))  # the longest token that ends there first
        turn += (end - start) * SHORT
        order = np.argsort(turn.astype(np.int16), kind="stable")
        bounds = np.flatnonzero(np.diff(turn[order], prepend=-1)).tolist()
        end, token, before, whole = end[order], token[order], at[order] - 1, (at == start)[order]
        for a, b in zip(bounds, [*bounds[1:], len(end)]):
            left = np.flatnonzero(count[end[a:b]] == 0) + a
            fit = whole[left]
            rest = left[~fit]
            pairs = last[before[rest]] << 32 | token[rest]
            fit[~fit] = np.fromiter(map(self.fits.__getitem__, pairs.tolist()), bool, len(rest))
            left = left[fit]
            last[end[left]] = token[left]
            count[end[left]] = np.where(whole[left], 0, count[before[left]]) + 1
        return count

    def of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of every prefix of one character or more, piece by piece; characters of each piece)."""
        data = "".join(pieces).encode()
        raw = np.frombuffer(data, np.uint8)
        lead = np.flatnonzero(raw & 0xC0 != 0x80)
        chars = np.fromiter(map(len, pieces), np.int64, len(pieces))
        first = np.cumsum(chars) - chars
        starts = lead[first]
        sizes = np.diff(starts, append=len(raw))
        count = np.zeros(len(raw), np.int32)
        short = sizes <= SHORT
        for k in np.flatnonzero(~short):
            at, stop = starts[k], starts[k] + sizes[k]
            count[at:stop] = self.prefixes(data[at:stop])[1:]
        if short.any():
            of_short = np.repeat(short, sizes)
            count[of_short] = self.together(raw[of_short], sizes[short])
        out = count[np.append(lead[1:], len(raw)) - 1]
        for k, piece in enumerate(pieces):
            if piece in ("'re", "'ve", "'ll"):
                out[first[k] + 1] = 2
        return out, chars

    def __missing__(self, piece: str) -> int:
        own = self[piece] = len(self)
        self.fresh.append(piece)
        return own

    def learn(self) -> None:
        """Counts the pieces that were met since."""
        if not self.fresh:
            return
        parts = [self.of_pieces(self.fresh[k : k + TOGETHER]) for k in range(0, len(self.fresh), TOGETHER)]
        chars = np.concatenate([n for _, n in parts])
        self.starts = np.append(self.starts, len(self.values) + np.cumsum(chars) - chars)
        self.chars = np.append(self.chars, chars)
        self.values = np.concatenate([self.values, *(counts for counts, _ in parts)])
        self.blank = np.append(self.blank, np.array([p.isspace() and _SPACES.issuperset(p) for p in self.fresh]))
        self.opens = np.append(self.opens, np.array([p[0] in _SPACES for p in self.fresh]))
        self.met = np.append(self.met, np.zeros(len(self.fresh), np.int64))
        self.fresh = []

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of every prefix of one character or more, text by text; where each text ends)."""
        if len(self) > HELD:
            self.forget()
        own: list[int] = []
        pieces: list[str] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for k, text in enumerate(texts):
            found = self.split(text)
            pieces += found
            own += map(self.__getitem__, found)
            ends[k + 1] = len(own)
        self.learn()
        ids = np.array(own, np.int64)
        self.met += np.bincount(ids, minlength=len(self))
        n = self.chars[ids]
        at = np.r_[0, np.cumsum(n)]
        whole = self.values[(self.starts + self.chars - 1)[ids]].astype(np.int64)
        before = np.r_[0, np.cumsum(whole)]
        before = before[:-1] - np.repeat(before[ends[:-1]], np.diff(ends))
        out = self.values[_runs(self.starts[ids], n)]
        out += np.repeat(before.astype(np.int32), n)
        blank, opens = self.blank[ids], self.opens[ids]
        of = np.repeat(np.arange(len(texts)), np.diff(ends))
        for k in np.flatnonzero(blank[:-1] & opens[1:] & (of[:-1] == of[1:])):
            key = (pieces[k], pieces[k + 1][0])
            if (tokens := self.joined.get(key)) is None:
                tokens = self.joined[key] = self.prefixes("".join(key).encode())[-1]
            out[at[k + 1]] = before[k] + tokens
        return out, at[ends]


@lru_cache(2)
def _counter(vocabulary: Vocabulary) -> Counter:
    return Counter(vocabulary.codec(), vocabulary.pattern)


def packed(counts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The steps of each text as bytes."""
    out = []
    for a, b in zip(ends[:-1], ends[1:]):
        steps = np.diff(counts[a:b], prepend=0)
        width = 1 if not len(steps) or -128 <= steps.min() <= steps.max() <= 127 else 4
        out.append(bytes([width]) + steps.astype(_WIDTHS[width]).tobytes())
    return out


def unpacked(steps: bytes) -> np.ndarray:
    """Tokens of every prefix, from one character on."""
    return np.cumsum(np.frombuffer(steps, _WIDTHS[steps[0]], offset=1), dtype=np.int64)


def counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_tokens, steps): the tokens of the whole text, and the steps that give those of every prefix."""
    workers_find_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for batch in batches:
            for part in _bytes.parts(batch, "text"):
                texts = part.column(1)
                null = texts.is_null().to_numpy(zero_copy_only=False)
                at, ends = counter.count([t or "" for t in texts.to_pylist()])
                total = np.where(np.diff(ends) > 0, np.r_[at, 0][np.maximum(ends[1:] - 1, 0)], 0)
                steps = pa.array([None if no else s for no, s in zip(null, packed(at, ends))], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total.astype(np.int32), mask=null), steps], ["doc_id", "n_tokens", "steps"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_tokens int, steps binary")


def within(steps: Column, budget: int) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens."""

    @F.arrow_udf("int")
    def longest(column: pa.Array) -> pa.Array:
        out: list[int | None] = []
        for s in column.to_pylist():
            fits = np.flatnonzero(unpacked(s) <= budget) if s is not None else None
            out.append(None if fits is None else int(fits[-1]) + 1 if len(fits) else 0)
        return pa.array(out, pa.int32())

    return longest(steps)


def count_at(steps: Column, chars: int) -> Column:
    """Tokens of the first ``chars`` characters."""

    @F.arrow_udf("int")
    def tokens(column: pa.Array) -> pa.Array:
        return pa.array([None if s is None else int(np.frombuffer(s, _WIDTHS[s[0]], offset=1)[: max(chars, 0)].sum(dtype=np.int64)) for s in column.to_pylist()], pa.int32())

    return tokens(steps)
