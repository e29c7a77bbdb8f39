import time
from html.parser import HTMLParser

import numpy as np
import pytest

from cueweave.llm import html_paths as H


def brute(page):
    """The content by the definition, place by place, without arrays."""
    nodes = H.text_nodes(page)
    by = {}
    for p, t in nodes:
        by.setdefault(p, []).append(t)
    text = {p: sum(len(t.replace(" ", "")) for t in ts) / len(ts) for p, ts in by.items()}
    signs = {p: sum(len(H.SIGNS.findall(t)) for t in ts) / len(ts) for p, ts in by.items()}

    def smooth(of):
        out = []
        for i in range(len(nodes)):
            near = [(np.exp(-((j - i) ** 2) / 2), of[nodes[j][0]]) for j in range(max(0, i - 2), min(len(nodes), i + 3))]
            out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
        return out

    fused = [a * b for a, b in zip(smooth(text), smooth(signs))]
    mean = {p: np.mean([f for f, (q, _) in zip(fused, nodes) if q == p]) for p in by}
    good = {p for p, m in mean.items() if m > 0 and m >= 0.5 * np.std(fused)}
    return "\n".join(t for p, t in nodes if p in good)


def test_driver_pages_against_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = H.extracted(pages).collect()
    assert len(got) == len(html)
    assert all(r.content == brute(html[r.page_id]) for r in got)
    navs = sum("nav" in p.split("/") for r in got for p in r.paths)
    articles = sum(any(p.startswith("html/body/article") for p in r.paths) for r in got)
    assert navs == 0 and articles >= 0.95 * len(got)


@pytest.mark.parametrize(
    "page,want",
    [
        ("", []),
        ("no tags", [("", "no tags")]),
        ("<p>a<p>b<br>c", [("p", "a"), ("p", "b"), ("p", "c")]),
        ("<div><p>a<b>x<p>b</div>c", [("div/p", "a"), ("div/p/b", "x"), ("div/p", "b"), ("", "c")]),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", [("ul/li", "a"), ("ul/li/ul/li", "b"), ("ul/li", "c")]),
        ("<script>x < y</script>t<!-- <p>q -->u<style>p{}", [("", "t"), ("", "u")]),
        ("<title>A &amp; B</title></x></p>", [("title", "A & B")]),
        ("a <", [("", "a <")]),
        ("<p>a < b & c</p>", [("p", "a < b & c")]),
        ("<!-- never shut <p>x", []),
        ("<p class=a", []),
        ("<table><tr><td>1<td>2<tr><td>3</table>", [("table/tr/td", "1"), ("table/tr/td", "2"), ("table/tr/td", "3")]),
    ],
)
def test_text_nodes(page, want):
    assert H.text_nodes(page) == want


class Plain(HTMLParser):
    """Places of text of a page, by another parser; of what may be left open, it knows of p and of what an outer element's end closes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.out, self.held = [], [], ""

    def flush(self):
        text = " ".join(self.held.split())
        if text and not set(self.open) & H.UNSEEN:
            self.out.append(("/".join(self.open), text))
        self.held = ""

    def handle_starttag(self, tag, attrs):
        self.flush()
        if tag in ("p", "div", "ul", "article", "nav", "footer", "h1", "table") and "p" in self.open:
            while self.open.pop() != "p":
                pass
        if tag not in H.VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        self.flush()
        while tag in self.open and self.open.pop() != tag:
            pass

    def handle_comment(self, data):
        self.flush()

    def handle_data(self, data):
        self.held += data


def test_places_against_another_parser(spark):
    seen = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        p = Plain()
        p.feed(r.html)
        p.close()
        p.flush()
        assert H.text_nodes(r.html) == p.out
        seen += 1
    assert seen > 100


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "text. more." + "</div>" * 100_000, "<b>a," * 100_000, "<ul>" + "<b>" * 50_000 + "<li></li>" * 50_000 + "end. here.", "<p>" * 100_000 + "x.", "<" * 200_000, "<i>x</b>" * 50_000])
def test_time_grows_with_length(page):
    began = time.process_time()
    content, kept, nodes, paths = H.extract_one(page)
    assert time.process_time() - began < 2
    assert len(content) >= 0 and all(p.count("/") < H.DEPTH for p in paths)
    if page.startswith("<b>a,"):
        assert kept == nodes == 100_000


def test_edges(spark):
    deep = "<div>" * 3000 + "text. more." + "</div>" * 3000
    long = "<article>" + "<p>A sentence, and more.</p>" * 20000 + "</article><nav>" + "<a>x</a>" * 50 + "</nav>"
    d = [(1, None, 1), (2, "", 1), (None, "<p>Hi, there.</p>", 1), (4, deep, None), (5, long, 2), (5, long, 2), (6, "<" * 50000, 1)]
    got = H.extracted(spark.createDataFrame(d, "page_id bigint, html string, content int")).collect()
    assert len(got) == 7
    by = {r.page_id: r for r in got}
    assert by[1].content == by[2].content == "" and by[1].nodes == 0
    assert by[4].content == "text. more." and by[5].content_nodes == 20000 and by[None].content == "Hi, there."
    assert H.extracted(spark.createDataFrame([], "page_id bigint, html string")).count() == 0
