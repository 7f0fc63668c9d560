"""Byte-level BPE encoding and decoding (operator 2).

The tokenizer is tiktoken over a rank file that the caller names; the driver reads the file
and sends its bytes along, so executors need no copy, and nothing is trained.  A text of more
than ``CUT`` characters is cut into stretches first.  A cut lies between a visible character
and a space: the splitting pattern never has a piece that goes over such a place, nor looks
back across it, so the stretches' tokens in a row are the text's tokens.  Decoding works on
raw bytes, so a list that ends within a character keeps its bytes.

Defined results: a null text has null tokens, an empty one none; a text with no place to cut
is encoded in one stretch; strings that look like special tokens are ordinary text; rows that
repeat, or share a doc_id, are encoded apart; a list with a null, negative or unknown id is
decoded to null; columns called like an added one give way to it, all others pass unchanged.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bytes
from ._spark import workers_find_package

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CUT = 1 << 16
_SAFE = re.compile(r"(?<=\S)(?= )")


@dataclass(frozen=True)
class Vocabulary:
    """A rank file's bytes (compressed) and the pattern that splits texts before merging."""

    packed: bytes
    pattern: str = PATTERN

    @classmethod
    def read(cls, path: str = RANKS, pattern: str = PATTERN) -> Vocabulary:
        return cls(zlib.compress(Path(path).read_bytes()), pattern)

    def codec(self) -> Codec:
        return _codec(self)


class Codec:
    """Encoder and decoder of a vocabulary; a worker makes one and keeps it."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        lines = zlib.decompress(vocabulary.packed).split(b"\n")
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=vocabulary.pattern, mergeable_ranks=self.ranks, special_tokens={})
        size = max(self.ranks.values()) + 1
        self.bytes_of: list[bytes | None] = [None] * size
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.known = np.array([b is not None for b in self.bytes_of])
        self.lengths = np.array([len(b or b"") for b in self.bytes_of], np.int64)
        self.starts = np.r_[0, np.cumsum(self.lengths)[:-1]]
        self.flat = np.frombuffer(b"".join(b or b"" for b in self.bytes_of), np.uint8)

    def encode(self, text: str, cut: int = CUT) -> np.ndarray:
        """Tokens of a text, 32-bit."""
        one = lambda part: self.encoding.encode_to_numpy(part, disallowed_special=()).view(np.int32)
        if len(text) <= cut:
            return one(text)
        out, at = [], 0
        for stop in stretches(text, cut):
            out.append(one(text[at:stop]))
            at = stop
        return np.concatenate(out)

    def decode_all(self, tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all lists in a row, where each list's bytes end, whether all ids of a list are known)."""
        safe = (tokens >= 0) & (tokens < len(self.known))
        safe[safe] = self.known[tokens[safe]]
        bad = np.r_[0, np.cumsum(~safe)]
        begins = np.r_[0, ends[:-1]]
        ids = np.where(safe, tokens, 0)
        length = np.where(safe, self.lengths[ids], 0)
        total = np.r_[0, np.cumsum(length)]
        at = np.repeat(self.starts[ids] - total[:-1], length) + np.arange(total[-1])
        return self.flat[at], total[ends], bad[ends] == bad[begins]


@lru_cache(2)
def _codec(vocabulary: Vocabulary) -> Codec:
    return Codec(vocabulary)


def stretches(text: str, cut: int = CUT) -> Iterator[int]:
    """Ends of the stretches of a text, each the first safe place after ``cut`` characters."""
    at = 0
    while len(text) - at > cut and (found := _SAFE.search(text, at + cut)):
        at = found.start()
        yield at
    yield len(text)


def _lists(values: list[np.ndarray], valid: np.ndarray) -> pa.ListArray:
    sizes = np.zeros(len(valid), np.int64)
    sizes[valid] = [len(v) for v in values]
    offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *values]), pa.int32()), mask=pa.array(~valid))


def decoded(codec: Codec, tokens: pa.ListArray) -> pa.BinaryArray:
    """The bytes of lists of tokens."""
    ends = tokens.offsets.to_numpy()[1:] - tokens.offsets[0].as_py()
    flat = tokens.flatten() if not tokens.null_count else tokens.values.slice(tokens.offsets[0].as_py(), int(ends[-1]) if len(ends) else 0)
    data, stops, known = codec.decode_all(flat.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), ends.astype(np.int64))
    known &= tokens.is_valid().to_numpy(zero_copy_only=False)
    whole = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.r_[0, stops].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    if not known.all():
        whole = pa.compute.if_else(pa.array(known), whole, pa.scalar(None, pa.large_binary()))
    return whole.cast(pa.binary())


def tokenize(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", cut: int = CUT) -> DataFrame:
    """``docs`` with the columns tokens, n_tokens and exact: whether the decoded tokens are the text's bytes."""
    workers_find_package(docs.sparkSession)
    added = ["tokens", "n_tokens", "exact"]
    names = [c for c in docs.columns if c.lower() not in added or c == text]
    rows = docs.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text}`").cast("string"))
    rows = rows.toDF(*(f"c{k}" for k in range(len(names))), "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = vocabulary.codec()
        for batch in batches:
            for part in _bytes.parts(batch, "text"):
                texts = part.column(len(names))
                valid = texts.is_valid().to_numpy(zero_copy_only=False)
                tokens = _lists([codec.encode(t, cut) for t in texts.to_pylist() if t is not None], valid)
                count = pa.array(np.diff(tokens.offsets.to_numpy()).astype(np.int32), mask=~valid)
                exact = pa.compute.equal(decoded(codec, tokens), texts.cast(pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], tokens, count, exact], [*part.schema.names[:-1], *added])

    fields = ", ".join(f"c{k} {t.simpleString()}" for k, t in enumerate(f.dataType for f in rows.schema.fields[:-1]))
    out = rows.mapInArrow(encode, f"{fields}, tokens array<int>, n_tokens int, exact boolean")
    return out.toDF(*names, *added)


def decode(tokens: Column, vocabulary: Vocabulary) -> Column:
    """The raw bytes (binary) of a column of token lists."""

    @F.arrow_udf("binary")
    def run(lists: pa.Array) -> pa.Array:
        return decoded(vocabulary.codec(), lists.cast(pa.list_(pa.int32())))

    return run(tokens.cast("array<int>"))
