"""The one place that needs Python: HTML to a flat outline.

The helper only tokenises. It gives, per page, the visible text and one entry
per element of interest; an entry knows where its descendants end and which
pieces of the text are its own. Everything else (finding sections, pairing
samples, picking submissions) is done by Spark on these arrays.

Open tags are closed by the matching end tag or by the end tag of an ancestor;
unknown end tags are ignored. An unclosed ``p`` therefore holds what follows it, and
text that many of them hold is theirs all: ``size`` tells how many bytes an element's
text has before anything is joined.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ship the helper itself to the executors; they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTLINE = (
    "struct<pieces:array<string>, error:string, elements:array<struct<"
    "idx:int, last:int, parent:int, tag:string, id:string, "
    "classes:array<string>, href:string, lo:int, hi:int, size:bigint>>>"
)
_ELEMENT = pa.struct(
    [
        ("idx", pa.int32()),
        ("last", pa.int32()),
        ("parent", pa.int32()),
        ("tag", pa.string()),
        ("id", pa.string()),
        ("classes", pa.list_(pa.string())),
        ("href", pa.string()),
        ("lo", pa.int32()),
        ("hi", pa.int32()),
        ("size", pa.int64()),
    ]
)
_OUTLINE = pa.struct(
    [("pieces", pa.list_(pa.string())), ("error", pa.string()), ("elements", pa.list_(_ELEMENT))]
)

# Elements kept, elements without content, elements whose text is
# not part of the page text, elements that keep blank text as it is.
KEPT = frozenset("div span section h3 p pre tr th td a".split())
VOID = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source "
    "track wbr basefont bgsound command frame image isindex nextid spacer".split()
)
SILENT = frozenset("script style template rt rp".split())
PREFORMATTED = frozenset(("pre", "textarea"))
ASCII_BLANKS = " \n\t\f\r"

#: Pages of about so many bytes are outlines, as Python objects, at a time.
SLICE_BYTES = 1 << 20


class _Outline(HTMLParser):
    def __init__(self, kept=KEPT):
        super().__init__(convert_charrefs=True)
        self.kept = kept
        self.open: list[tuple[str, dict | None, int]] = []
        self.depth: Counter[str] = Counter()
        self.elements: list[dict] = []
        self.pieces: list[str] = []
        self.pending: list[str] = []
        self.serial = 0
        self.bytes = 0

    def within(self, tags) -> bool:
        return any(self.depth[tag] for tag in tags)

    def flush(self):
        data, self.pending = "".join(self.pending), []
        if not data or self.within(SILENT):
            return
        if not data.strip(ASCII_BLANKS) and not self.within(PREFORMATTED):
            data = "\n" if "\n" in data else " "
        self.pieces.append(data)
        self.bytes += len(data.encode())

    def handle_data(self, data):
        self.pending.append(data)

    def handle_starttag(self, tag, attrs):
        self.flush()
        self.serial += 1
        entry = None
        if tag in self.kept:
            values = {k: v or "" for k, v in attrs}
            entry = {
                "idx": len(self.elements),
                "parent": self.open[-1][2] if self.open else 0,
                "tag": tag,
                "id": values.get("id"),
                "classes": values.get("class", "").split(),
                "href": values.get("href"),
                "lo": len(self.pieces),
                "size": -self.bytes,
            }
            self.elements.append(entry)
        if tag not in VOID:
            self.open.append((tag, entry, self.serial))
            self.depth[tag] += 1

    def handle_endtag(self, tag):
        self.flush()
        if self.depth[tag]:
            while self.close_top() != tag:
                pass

    def close_top(self):
        tag, entry, _ = self.open.pop()
        self.depth[tag] -= 1
        if entry is not None:
            entry["last"], entry["hi"] = len(self.elements) - 1, len(self.pieces)
            entry["size"] += self.bytes
        return tag

    def unknown_decl(self, data):
        self.flush()
        if data.upper().startswith("CDATA["):
            self.pending.append(data[6:])
            self.flush()

    def handle_comment(self, data):
        self.flush()

    handle_decl = handle_pi = handle_comment

    def finish(self) -> dict:
        self.flush()
        while self.open:
            self.close_top()
        return {"pieces": self.pieces, "error": None, "elements": self.elements}


def failed(reason: str) -> dict:
    return {"pieces": [], "error": reason, "elements": []}


def outline(html: str | None, kept=KEPT) -> dict | None:
    """Outline of one page, with the elements of the tags ``kept``."""
    if html is None:
        return None
    parser = _Outline(kept)
    try:
        parser.feed(html)
        parser.close()
    except AssertionError as error:  # the tokeniser's way to reject markup
        return failed(f"markup rejected: {error}")
    return parser.finish()


def _slices(pages: pa.Array) -> Iterator[pa.Array]:
    """Whole pages of about ``SLICE_BYTES`` together, or one that is longer."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(pages), 0).to_numpy(), dtype=np.int64)
    lo = 0
    while lo < len(pages):
        before = ends[lo - 1] if lo else 0
        hi = max(int(np.searchsorted(ends, before + SLICE_BYTES, "right")), lo + 1)
        yield pages.slice(lo, hi - lo)
        lo = hi


def outlines(pages: pa.Array, kept=KEPT) -> Iterator[pa.Array]:
    """Outlines of a batch's pages, in order, a slice of the pages at a time."""
    for part in _slices(pages):
        yield pa.array([outline(p, kept) for p in part.to_pylist()], type=_OUTLINE)


def page_outline(html: Column, tags: Iterable[str] = KEPT) -> Column:
    """Outline of a page as a struct column, see ``OUTLINE``, with the elements of the
    ``tags`` asked for. Only the HTML goes through Python, one Arrow batch at a time;
    outlines go back in slices, so that a task holds a batch of pages and one slice."""
    kept = frozenset(tags)

    def sliced(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield from outlines(pages, kept)

    # Declared non-deterministic so that a filter on the result is not pushed
    # below it, which would parse every page twice.
    udf = F.arrow_udf(sliced, OUTLINE).asNondeterministic()
    return udf(html)
