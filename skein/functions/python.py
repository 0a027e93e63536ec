"""Functions that column expressions cannot say: Arrow-batched, one value in, one out."""

from __future__ import annotations

import html
import json
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Texts that are Python strings at one time; the rest of a batch stays in Arrow, whatever the batch holds.
SLICE = 256


def _each(change: Callable[[str], str], c: Column | str) -> Column:
    """change of each text of a column; null stays null."""

    def changed(texts: pa.Array) -> pa.Array:
        parts = [pa.array([None if t is None else change(t) for t in texts.slice(at, SLICE).to_pylist()], pa.string()) for at in range(0, len(texts), SLICE)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return map(changed, batches)  # holds no batch while its result is written and the next one is read

    return F.arrow_udf(run, StringType())(c)


def unescape_html(c: Column | str) -> Column:
    return _each(html.unescape, c)


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skipped = 0

    def handle_starttag(self, tag, attrs):
        self.skipped += tag in ("script", "style")
        if tag == "li":
            self.parts.append(" - ")
        elif tag in ("p", "div", "br"):
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.skipped -= tag in ("script", "style") and self.skipped > 0
        if tag in ("p", "div", "li"):
            self.parts.append(" ")

    def handle_data(self, data):
        if not self.skipped:
            self.parts.append(data)


def dom_text(page: str) -> str:
    parser = _Text()
    parser.feed(page)
    parser.close()
    return " ".join("".join(parser.parts).split())


def html_text_dom(c: Column | str) -> Column:
    """Text of the element tree: items marked with a dash, blocks apart, white space collapsed."""
    return _each(dom_text, c)


def canonical(text: str) -> str:
    """JSON with keys sorted ignoring case; anything else trimmed."""

    def order(x):
        if isinstance(x, dict):
            return {k: order(x[k]) for k in sorted(x, key=lambda k: (k.lower(), k))}
        return [order(v) for v in x] if isinstance(x, list) else x

    try:
        return json.dumps(order(json.loads(text)), separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        return text.strip()


def canonical_json(c: Column | str) -> Column:
    return _each(canonical, c)


def clean(text: str, dropped: frozenset[str] = frozenset({"auditHistory"})) -> str:
    """JSON whose string properties that hold HTML are text, without the dropped fields."""

    def walk(x):
        if isinstance(x, dict):
            return {k: walk(v) for k, v in x.items() if k not in dropped}
        if isinstance(x, list):
            return [walk(v) for v in x]
        return dom_text(x) if isinstance(x, str) and "<" in x and ">" in x else x

    try:
        return json.dumps(walk(json.loads(text)), ensure_ascii=False)
    except ValueError:
        return text


def clean_json(c: Column | str) -> Column:
    return _each(clean, c)
