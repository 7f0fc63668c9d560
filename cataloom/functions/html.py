"""Lyrics of a page (Arrow UDF: nested elements are beyond regular expressions)."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import ship

SHORTEST = 20
#: Pages that a worker holds as Python strings at once; a batch may be 10,000.
AT_ONCE = 64
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Containers(HTMLParser):
    """Texts of the outermost divs that are marked as lyrics, and of those whose class says so."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []
        self.marked: list[list[str]] = []
        self.named: list[list[str]] = []
        self.into: list[tuple[int, list[str]]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self._put("\n")
        if tag in _VOID:
            return
        self.open.append((tag, len(self.open)))
        own = dict(attrs)
        if tag == "div":
            for hit, found in ((own.get("data-lyrics-container") == "true", self.marked), ("Lyrics__Container" in (own.get("class") or ""), self.named)):
                if hit:
                    found.append([])
                    self.into.append((len(self.open), found[-1]))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                self.into = [x for x in self.into if x[0] <= len(self.open)]
                break

    def handle_data(self, data: str) -> None:
        self._put(data)

    def _put(self, data: str) -> None:
        for _, texts in self.into:
            texts.append(data)


def lyrics_of(page: str | None) -> str | None:
    """Texts of the marked containers, or where there are none of the named ones, a blank line between them; null if shorter than 20 characters."""
    if not page:
        return None
    parser = _Containers()
    parser.feed(page)
    parts = parser.marked or parser.named
    text = "\n\n".join("\n".join(x for x in "".join(p).strip().split("\n")) for p in parts).strip()
    return text if len(text) >= SHORTEST else None


@F.arrow_udf(StringType())
def _extract(pages: pa.Array) -> pa.Array:
    parts = [pa.array(map(lyrics_of, pages.slice(k, AT_ONCE).to_pylist()), pa.string()) for k in range(0, len(pages), AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def extract_lyrics(page: Column) -> Column:
    """``lyrics_of`` a column of pages; only pages with a container leave the JVM."""
    ship()
    held = F.contains(page, F.lit("data-lyrics-container")) | F.contains(page, F.lit("Lyrics__Container"))
    return F.when(held, _extract(F.when(held, page)))
