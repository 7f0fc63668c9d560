"""Secret scans by sliding-window entropy (operator 3).

Candidates are maximal runs of at least ``MIN_RUN`` characters [A-Za-z0-9+/_=-].  For each
character class (``CLASSES``) the maximal runs of that class within a candidate are swept by a
window of the class's width.  Counts of every character run along the sweep; a window's counts
are those at its end less those at its start, so moving it by one is one character in and one
out, and give its Shannon entropy.  Windows that reach the class's threshold, and hold
the kinds of characters it asks for, are joined to spans.  A span is suppressed if nothing
of it would be found without the candidate's allowed parts (UUIDs, placeholders, labelled
digests, counting runs, paths of words), if it is a hexadecimal number of a digest's length and
what stands before it says that it is one ("commit 04db...", "sha256: ..."), or if it is matched whole by one of the caller's own patterns.

Defined results: null and empty texts have no finding; runs shorter than the least length have none; where classes overlap the longest
span counts, then the earlier class of the list; rows that repeat a doc_id are scanned apart; a
null doc_id is reported as null; ``redact`` changes text, and n_chars (if it is a number, and only where
the text was changed); other columns pass unchanged.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import clashless, workers_find_package

MIN_RUN = 20
_CHARS = "[A-Za-z0-9+/_=-]"
MASK = "<SECRET>"
#: Lengths of hexadecimal digests, and what says before a number that it is one.
DIGESTS = (32, 40, 64, 96, 128)
_HEX = re.compile("[0-9a-f]+|[0-9A-F]+")
_LABEL = re.compile(r"(?i)\b(?:commit|revision|checksum|digest|etag|md5|sha-?(?:1|224|256|384|512)(?:sum)?)[\"'\s:=(]{1,4}$")


@dataclass(frozen=True)
class CharClass:
    """A class of characters: windows of ``width`` with at least ``bits`` of entropy a character, and ``kinds`` of characters in them."""

    name: str
    chars: str
    width: int
    bits: float
    kinds: tuple[str, ...]


_LOW, _UP, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
CLASSES = (
    CharClass("hex", _DIGIT + "abcdefABCDEF", 24, 2.8, (_DIGIT, "abcdefABCDEF")),
    CharClass("base32", _UP + _DIGIT, 20, 3.4, (_UP, _DIGIT)),
    CharClass("alphanumeric", _LOW + _UP + _DIGIT, 20, 3.6, (_LOW + _UP, _DIGIT)),
    CharClass("base64", _LOW + _UP + _DIGIT + "+/_-=", 24, 3.8, (_LOW, _UP, _DIGIT)),
)

_HUMPS = r"(?:[A-Z]?[a-z]{2,}|[A-Z]{2,})(?:[A-Z][a-z]{2,})*[0-9]{0,3}"
_PART = rf"(?:{_HUMPS}|[0-9]{{1,4}}|[a-z])"
_SEGMENT = rf"{_PART}(?:[_-]{_PART})*"

#: Parts of a candidate that look random and aren't secret. None has a quantifier within an
#: ambiguous other one, so matching takes linear time.
ALLOWED = (
    r"(?i)(?<![0-9a-z])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-z])",
    r"(?i)example(?:key)?|placeholder|your[_-]?(?:api|key|token|secret)|changeme|dummy|redacted|x{5,}",
    r"(?i)(?<![0-9a-z])(?:md5[-=_/][0-9a-f]{32}|(?:sha1|commit)[-=_/][0-9a-f]{40}|sha256[-=_/][0-9a-f]{64}|sha384[-=_/][0-9a-f]{96}|sha512[-=_/][0-9a-f]{128})(?![0-9a-z])",
    r"(?i)(?<![0-9a-z])(?:sha1-[0-9a-z+/]{27}=|sha256-[0-9a-z+/]{43}=|sha384-[0-9a-z+/]{64}|sha512-[0-9a-z+/]{86}==)(?![0-9a-z+/=])",
    r"(?i)0123456789(?:abcdef)?|abcdefghijklm(?:nopqrstuvwxyz)?",
    rf"(?<![A-Za-z0-9+/_-])/?{_SEGMENT}(?:/{_SEGMENT}){{2,}}/?(?![A-Za-z0-9+/_-])",
)


@dataclass(frozen=True)
class Finding:
    start: int
    end: int
    kind: str
    entropy: float
    suppressed: bool


_CLOG = np.array([0.0, *(c * math.log2(c) for c in range(1, 4097))])
#: Window ends that one numpy step handles.
_STEP = 1 << 14


def _codes(chars: str) -> np.ndarray:
    table = np.full(256, -1, np.int16)
    table[np.frombuffer(chars.encode(), np.uint8)] = np.arange(len(chars))
    return table


_TABLE = {c.name: _codes(c.chars) for c in CLASSES}
_KINDS = {c.name: [np.isin(list(c.chars), list(kind)) for kind in c.kinds] for c in CLASSES}


def _windows(codes: np.ndarray, own: CharClass) -> tuple[np.ndarray, np.ndarray]:
    """(where windows that are found begin, their entropy) within a run of one class."""
    starts, bits = [], []
    for at in range(0, len(codes) - own.width + 1, _STEP):
        part = codes[at : at + _STEP + own.width - 1]
        running = np.zeros((len(part) + 1, len(own.chars)), np.int32)
        running[np.arange(1, len(part) + 1), part] = 1
        np.cumsum(running, axis=0, out=running)
        counts = running[own.width :] - running[: -own.width]
        entropy = math.log2(own.width) - _CLOG[counts].sum(1) / own.width
        good = entropy >= own.bits
        for kind in _KINDS[own.name]:
            good &= counts[:, kind].any(1)
        hit = np.flatnonzero(good)
        starts.append(hit + at)
        bits.append(entropy[hit])
    return np.concatenate(starts), np.concatenate(bits)


def _spans(run: str, own: CharClass) -> list[tuple[int, int, float]]:
    """(start, end, highest entropy) of joined windows of one class within a candidate."""
    out: list[tuple[int, int, float]] = []
    codes = _TABLE[own.name][np.frombuffer(run.encode(), np.uint8)]
    edges = np.flatnonzero(np.diff(np.r_[False, codes >= 0, False]))
    for at, stop in edges.reshape(-1, 2):
        if stop - at < own.width:
            continue
        starts, bits = _windows(codes[at:stop], own)
        if not len(starts):
            continue
        first = np.flatnonzero(np.r_[True, np.diff(starts) > own.width])
        last = np.r_[first[1:] - 1, len(starts) - 1]
        for f, e, h in zip(starts[first] + at, starts[last] + at + own.width, np.maximum.reduceat(bits, first)):
            out.append((int(f), int(e), float(h)))
    return out


def _joined(run: str) -> list[tuple[int, int, float, str]]:
    """(start, end, entropy, class) of the findings of a run, none of which overlap."""
    got = sorted((-(e - s), k, s, e, h, c.name) for k, c in enumerate(CLASSES) for s, e, h in _spans(run, c))
    out: list[tuple[int, int, float, str]] = []
    for _, _, s, e, h, name in got:
        if all(e <= a or b <= s for a, b, *_ in out):
            out.append((s, e, h, name))
    return out


class Scanner:
    """The scan of one text; ``allowed``: patterns for whole spans besides those of ``ALLOWED``; ``least``: characters of a candidate."""

    def __init__(self, allowed: Sequence[str] = (), least: int = MIN_RUN) -> None:
        self.runs = re.compile(f"{_CHARS}{{{least},}}")
        self.parts = [re.compile(p) for p in ALLOWED]
        self.allowed = [re.compile(p) for p in allowed]

    def _open(self, run: str) -> list[tuple[int, int]]:
        """Spans that a candidate still has once its allowed parts are cut out."""
        cuts = sorted(m.span() for p in self.parts for m in p.finditer(run))
        if not cuts:
            return [(0, len(run))]
        out: list[tuple[int, int]] = []
        at = 0
        for start, end in [*cuts, (len(run), len(run))]:
            if start > at:
                out += [(at + s, at + e) for s, e, *_ in _joined(run[at:start])]
            at = max(at, end)
        return out

    def scan(self, text: str | None) -> list[Finding]:
        out: list[Finding] = []
        for match in self.runs.finditer(text or ""):
            run = match.group()
            got = _joined(run)
            if not got:
                continue
            left = self._open(run)
            for s, e, h, name in got:
                quiet = not any(a < e and s < b for a, b in left) or any(p.fullmatch(run[s:e]) for p in self.allowed)
                if not quiet and e - s == len(run) and len(run) in DIGESTS and _HEX.fullmatch(run):
                    quiet = bool(_LABEL.search(text[max(match.start() - 24, 0) : match.start()]))
                out.append(Finding(match.start() + s, match.start() + e, name, round(h, 6), quiet))
        return sorted(out, key=lambda f: f.start)

    def redact(self, text: str) -> str:
        for f in reversed(self.scan(text)):
            if not f.suppressed:
                text = text[: f.start] + MASK + text[f.end :]
        return text


def _candidates(docs: DataFrame, least: int) -> Column:
    return F.col("text").cast("string").rlike(f"{_CHARS}{{{least},}}")


def findings(docs: DataFrame, allowed: Sequence[str] = (), least: int = MIN_RUN) -> DataFrame:
    """(doc_id, start, end, kind, entropy, suppressed) of every finding; only texts with a candidate leave the JVM."""
    workers_find_package(docs.sparkSession)
    scanner = Scanner(allowed, least)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "end", "kind", "entropy", "suppressed"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_()]
        for batch in batches:
            rows = [(d, *vars(f).values()) for d, t in zip(batch.column(0).to_pylist(), batch.column(1)) for f in scanner.scan(t.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    rows = docs.filter(_candidates(docs, least)).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(scan, "doc_id long, start int, end int, kind string, entropy double, suppressed boolean")


def redact(docs: DataFrame, allowed: Sequence[str] = (), least: int = MIN_RUN) -> DataFrame:
    """``docs`` with every finding that isn't suppressed replaced by a mask, and n_chars (if there) counted anew for the texts that changed."""
    workers_find_package(docs.sparkSession)
    scanner = Scanner(allowed, least)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else scanner.redact(t) for t in texts.to_pylist()], pa.string())

    made = clashless(docs, "redacted_text")
    out = docs.withColumn(made, clean(F.when(_candidates(docs, least), F.col("text").cast("string"))))
    changed = F.col(made).isNotNull() & (F.col(made) != F.col("text"))
    kinds = dict(docs.dtypes)
    if kinds.get("n_chars") in ("int", "bigint"):
        out = out.withColumn("n_chars", F.when(changed, F.length(made).cast(kinds["n_chars"])).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.coalesce(made, "text")).select(*docs.columns)
