"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Places on either side that the smoothing takes in, with the spread of its bell.
RADIUS, SPREAD = 2, 1.0
#: A path is content if its fused ratio reaches this share of the spread of the fused ratios of the page's text places.
LAMBDA = 0.5
#: Most elements of a tag path.
DEPTH = 512
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never seen, and those that end at their own closing tag whatever stands between.
UNSEEN = frozenset("script style noscript template".split())
RAW = UNSEEN | {"textarea", "title"}
#: What an opening tag closes if it is open, and what that stops at.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIGNS = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_BLANK = re.compile(r"\s+")


class Open:
    """The elements that are open, and the place in the tree of tag paths where they stand. Every step takes the same time at any depth."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.nodes = [0]
        self.spots: dict[str, list[int]] = {}
        self.tree: dict[tuple[int, str], int] = {}
        self.parents: list[tuple[int, str]] = [(-1, "")]

    def child(self, name: str) -> int:
        """The node of a path one element longer; DEPTH elements are the most that a path has."""
        at = self.nodes[-1]
        if len(self.names) >= DEPTH:
            return at
        if (at, name) not in self.tree:
            self.tree[at, name] = len(self.parents)
            self.parents.append((at, name))
        return self.tree[at, name]

    def push(self, name: str) -> None:
        node = self.child(name)
        self.spots.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.nodes.append(node)

    def last(self, names: set[str]) -> int:
        """Place of the innermost of these names, or -1."""
        return max((self.spots[n][-1] for n in names if self.spots.get(n)), default=-1)

    def cut(self, at: int) -> None:
        """Closes the element at that place and all within it."""
        while len(self.names) > at:
            self.spots[self.names.pop()].pop()
            self.nodes.pop()

    def path(self, node: int) -> str:
        out = []
        while node:
            node, name = self.parents[node]
            out.append(name)
        return "/".join(reversed(out))


def places(page: str) -> tuple[list[int], list[str], Open]:
    """Node and text of each place of text that isn't blank, in order, in one pass; what is never closed runs on to the end."""
    where: list[int] = []
    texts: list[str] = []
    open_ = Open()
    held: list[str] = []

    def give(node: int, raw: str) -> None:
        text = _BLANK.sub(" ", html.unescape(raw)).strip()
        if text:
            where.append(node)
            texts.append(text)

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            held.append(page[at:lt])
        m = _NAME.match(page, lt)
        if lt < n and m is None and not page.startswith(("<!", "<?", "</"), lt):
            held.append("<")  # a sign of its own
            at = lt + 1
            continue
        if held:
            give(open_.nodes[-1], "".join(held))
            held.clear()
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        end = page.find(">", lt if m is None else m.end())
        at = n if end < 0 else end + 1
        if m is None:
            continue
        closing, name = m.group(1), m.group(2).lower()
        if closing:
            if open_.spots.get(name):
                open_.cut(open_.spots[name][-1])
            continue
        if name in VOID or page[end - 1] == "/" and name not in BLOCKS:
            continue
        if name in RAW:
            close = re.compile(f"</{name}\\b", re.I).search(page, at)
            stop = close.start() if close else n
            if name not in UNSEEN:
                give(open_.child(name), page[at:stop])
            end = page.find(">", stop)
            at = n if end < 0 else end + 1
            continue
        if name in CLOSES:
            shut, wall = CLOSES[name]
            spot = open_.last(shut)
            if spot > open_.last(wall):
                open_.cut(spot)
        elif name in BLOCKS:
            spot = open_.last({"p"})
            if spot >= 0:
                open_.cut(spot)
        open_.push(name)
    if held:
        give(open_.nodes[-1], "".join(held))
    return where, texts, open_


def text_nodes(page: str) -> list[tuple[str, str]]:
    """(tag path, text) of each place of text."""
    where, texts, open_ = places(page)
    return [(open_.path(p), t) for p, t in zip(where, texts)]


def smooth(x: np.ndarray) -> np.ndarray:
    """A weighted mean of each place and those around it, by a bell; at the ends, of those that there are."""
    bell = np.exp(-(np.arange(-RADIUS, RADIUS + 1) ** 2) / (2 * SPREAD**2))
    return np.convolve(x, bell)[RADIUS:-RADIUS] / np.convolve(np.ones(len(x)), bell)[RADIUS:-RADIUS]


def content_nodes(where: list[int], texts: list[str]) -> set[int]:
    """The paths, by node, that are content.

    A path's text ratio is its letters and signs over its places, its punctuation ratio its signs of punctuation over its places. Each place
    takes its path's two ratios; both sequences are smoothed and multiplied; a path's fused ratio is the mean over its places. A path is
    content if that reaches LAMBDA times the standard deviation over all places, and is not 0.
    """
    nodes, which = np.unique(np.array(where), return_inverse=True)
    size = np.array([len(t) - t.count(" ") for t in texts], float)
    signs = np.array([len(SIGNS.findall(t)) for t in texts], float)
    count = np.bincount(which)
    text = (np.bincount(which, size) / count)[which]
    punctuation = (np.bincount(which, signs) / count)[which]
    fused = smooth(text) * smooth(punctuation)
    mean = np.bincount(which, fused) / count
    return set(nodes[(mean >= LAMBDA * fused.std()) & (mean > 0)].tolist())


def extract_one(page: str) -> tuple[str, int, int, list[str]]:
    """Content text (a line a place), places of content, places in all, content paths."""
    where, texts, open_ = places(page)
    if not texts:
        return "", 0, 0, []
    good = content_nodes(where, texts)
    kept = [t for p, t in zip(where, texts) if p in good]
    return "\n".join(kept), len(kept), len(texts), sorted({open_.path(p) for p in good})


def extracted(pages: DataFrame, *, markup: str = "html", key: str = "page_id") -> DataFrame:
    """(page_id, content, content_nodes, nodes, paths) of each row.

    `content` is the text of the places whose tag path is content, in order, one a line; empty where a page has no text or none with
    punctuation, and for empty or null markup (0 nodes). Elements deeper than DEPTH count as their ancestor at that depth, as in browsers,
    and lose no text. Repeated rows get a row each, a null key stays null and the key keeps its type; other columns play no part. The time
    grows with the length of a page, however deep it is and however much is never closed.
    """
    src = pages.select(F.col(key).alias("page_id"), F.col(markup).cast("string").alias("html"))
    kinds = [("content", T.StringType()), ("content_nodes", T.IntegerType()), ("nodes", T.IntegerType()), ("paths", T.ArrayType(T.StringType()))]
    out = T.StructType([src.schema["page_id"], *[T.StructField(*k) for k in kinds]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [extract_one(p or "") for p in batch.column(1).to_pylist()]
            cols = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string())))]
            yield pa.record_batch([batch.column(0), *cols], out.names)

    return src.mapInArrow(run, out)
