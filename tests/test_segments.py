"""Segmentation against worked cases and a plain model."""

import html
import re
from html.entities import html5

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueweave.config import Segmentation
from cueweave.functions import text as T
from cueweave.operators import captions as C
from cueweave.operators import segments as S

DDL = "item_id string, cue bigint, position bigint, word string, start double, end double, probability double, timing_source string, segment_confidence double"


def words(spark, rows):
    return spark.createDataFrame([(r[0], 0, i, *r[1:], *[None] * (7 - len(r))) for i, r in enumerate(rows)], DDL)


def even(n, name):
    return [("v", f"{name}{i}", i / 2, i / 2 + 0.4, 0.9) for i in range(n)]


def cut_at(spark, *times):
    return spark.createDataFrame([("v", t) for t in times], "item_id string, time double")


def test_long_runs_are_split(spark):
    got = S.make(words(spark, even(40, "kelime")), cfg=Segmentation(min_duration=1.0, max_duration=5.0)).collect()
    assert len(got) >= 3 and all(r.duration <= 5.3 for r in got)


@pytest.mark.parametrize("on", [True, False])
def test_cuts(spark, on):
    cfg = Segmentation(min_duration=1.0, max_duration=30.0, split_on_scene_cut=on)
    got = S.make(words(spark, even(20, "k")), cut_at(spark, 5.0), cfg).collect()
    assert len(got) >= 2 and not any(r.start < 5.0 < r.end for r in got) if on else len(got) == 1


def test_caption_words_are_padded_more(spark):
    said = "Herkese merhaba. Güncel Türkçe'ye tekrar hoş geldin."
    rows = [("v", w, 4.06 + i * 2.68 / 7, 4.06 + (i + 1) * 2.68 / 7, 1.0, "subtitle") for i, w in enumerate(said.split())]
    (got,) = S.make(words(spark, rows)).collect()
    assert got.text == said and got.end == 7.34


def test_strict_ends_at_each_sentence(spark):
    at = [0.0, 0.3, 0.8, 1.1, 1.6, 2.0, 2.4, 3.0, 3.4]
    to = [0.3, 0.7, 1.1, 1.5, 2.0, 2.4, 3.0, 3.4, 3.8]
    said = "Alper merhaba. Merhaba İlker. Bugünkü konumuz bağımlılık normal midir?".split()
    w = words(spark, [("v", *x, 0.9) for x in zip(said, at, to)])
    assert S.make(w).count() == 1
    assert [r.text for r in S.make(w, strict=True).collect()] == [" ".join(said[4:])]


def model(ws, cuts, cfg, strict):
    """The same in plain Python, group by group."""
    spans, begin = [], 0
    inside = lambda a, b: any(a <= c <= b for c in cuts)
    for i in range(1, len(ws)):
        before, w, first = ws[i - 1], ws[i], ws[begin]
        so_far, ended = before[2] - first[1], bool(re.search(r"[.!?]$", before[0]))
        split = (cfg.split_on_scene_cut and inside(before[2], w[2])) or w[2] - first[1] > cfg.max_duration or (strict and ended)
        if split or (so_far >= cfg.min_duration and (ended or w[1] - before[2] > cfg.max_gap_seconds)):
            spans.append((begin, i))
            begin = i
    spans.append((begin, len(ws)))
    joined = []
    for a, b in spans:
        short = ws[b - 1][2] - ws[a][1] < cfg.min_duration or b - a < cfg.min_words
        if joined and short and not strict:
            x, y = joined[-1]
            if ws[b - 1][2] - ws[x][1] <= cfg.max_duration and not (cfg.split_on_scene_cut and inside(ws[y - 1][2], ws[a][1])):
                joined[-1] = (x, b)
                continue
        joined.append((a, b))
    out = []
    for n, (a, b) in enumerate(joined):
        if b - a < cfg.min_words:
            continue
        s, e = ws[a][1], ws[b - 1][2]
        lo = max([0.0, s - cfg.pad_seconds, *[c for c in cuts if c <= s]])
        hi = min([e + cfg.pad_seconds, *[c for c in cuts if c >= e]])
        if cfg.min_duration <= hi - lo <= cfg.max_duration + 2 * cfg.pad_seconds:
            out.append((f"{n:06d}", round(lo, 3), round(hi, 3), b - a))
    return out


@pytest.mark.parametrize("strict", [False, True])
def test_random_against_model(spark, strict):
    rng = np.random.default_rng(8)
    rows, cuts, items = [], [], {}
    for v in range(120):
        t, mine = 0.0, []
        for i in range(int(rng.integers(0, 70))):
            t += float(rng.choice([0.03, 0.2, 0.9]))
            end = t + float(rng.uniform(0.1, 0.8))
            mine.append((f"w{i}" + str(rng.choice(["", "", "", ".", "?"])), t, end))
            t = end
        cs = sorted(float(c) for c in rng.uniform(0, t + 1, int(rng.integers(0, 4))))
        items[str(v)] = (mine, cs)
        rows += [(str(v), *w, 0.9) for w in mine]
        cuts += [(str(v), c) for c in cs]
    cfg = Segmentation(min_duration=1.5, max_duration=9.0)
    got = S.make(words(spark, rows), spark.createDataFrame(cuts, "item_id string, time double"), cfg, strict=strict).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.segment_id):
        by.setdefault(r.item_id, []).append((r.segment_id, r.start, r.end, r.word_count))
    for v, (mine, cs) in items.items():
        want = model(mine, cs, cfg, strict) if mine else []
        assert [(x[0], x[3]) for x in by.get(v, [])] == [(x[0], x[3]) for x in want]
        assert np.allclose([x[1:3] for x in by.get(v, [])], [x[1:3] for x in want], atol=1.1e-3)


def test_intro_is_left_out_and_ids_are_dense(spark):
    made = spark.createDataFrame([("a", "000000", 3.0), ("a", "000002", 15.0), ("a", "000005", 99.0)], "item_id string, segment_id string, start double")
    assert [(r.segment_id, r.start) for r in S.cut_intro(made).orderBy("segment_id").collect()] == [("000000", 15.0), ("000001", 99.0)]


def test_rolling_captions(spark):
    said = ["Deniz bugün çok dalgalı", "Deniz bugün çok dalgalı", "Deniz bugün çok dalgalı ama kayıklar", "ama kayıklar döner mi?", " "]
    df = spark.createDataFrame([("a", i, float(i), i + 1.0, t) for i, t in enumerate(said)], "item_id string, ordinal int, start double, end double, text string")
    got = [r.text for r in C.drop_overlap(df).orderBy("ordinal").collect()]
    assert got == ["Deniz bugün çok dalgalı", "ama kayıklar", "döner mi?"]


VTT = """WEBVTT

NOTE nothing

00:00:01.000 --> 00:00:02,500 align:start
<c>one</c> two
 three

7
01:00:00.000 --> 01:00:01.000

05:01.250 --> 05:02.000
>>> Tom &amp; &gt;&gt;
00:00:09.000 --> 00:00:10.000
swallowed

bad --> worse
x"""


def test_parse(spark):
    df = spark.createDataFrame([("a", VTT), ("b", VTT.replace("\n", "\r\n")), ("c", None), ("d", "")], "item_id string, body string")
    got = C.parse(df, strict=False).orderBy("item_id", "start").collect()
    want = [(1.0, 2.5, "one two three"), (301.25, 302.0, "Tom & >> 00:00:09.000 --> 00:00:10.000 swallowed")]
    assert [(r.item_id, r.start, r.end, r.text) for r in got] == [(i, *w) for i in "ab" for w in want]
    with pytest.raises(Exception, match="no time in"):
        C.parse(df.limit(1)).collect()
    assert [(r.item_id, r.line) for r in C.unread(df).orderBy("item_id").collect()] == [("a", "bad --> worse"), ("b", "bad --> worse")]
    strict = C.parse(spark.createDataFrame([("e", "00:00:01.000 --> 00:00:02.000\nx"), ("f", "00:01.000 --> 00:02.000\ny")], "item_id string, body string"))
    assert strict.filter("item_id = 'e'").count() == 1
    with pytest.raises(Exception, match="no time in"):
        strict.collect()


def test_text(spark):
    cases = {
        "Kayıklar döner mi? Kayıklar döner mi? Evet dönerler.": "Kayıklar döner mi? Evet dönerler.",
        "a.b!!c": "a. b! c",
        "..a": "a",
        "one . one": "one.",
        "x y. X  Y!": "x y.",
        "STRASSE. straße! x": "STRASSE. x",
        "Hello... World": "Hello. World",
        "...": "...",
        " a   b , c ": "a b, c",
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    for r in df.select("want", T.drop_repeated_sentences(F.col("t")).alias("got")).collect():
        assert r.got == r.want
    one = spark.createDataFrame([("İbrahim K!", " ..a b/c.. ", "&lt;b&gt; <i>x</i> >> y &eacute;")], "a string, b string, c string")
    r = one.select(T.slug(F.col("a")), T.safe_id(F.col("b")), T.clean_markup(F.col("c"))).first()
    assert tuple(r) == ("i-brahim-k", "a_b_c", "<b> x y é")
    long = spark.createDataFrame([("x" * 300, "çğ")], "a string, b string").select(T.safe_id(F.col("a")).alias("a"), T.safe_id(F.col("b")).alias("b")).first()
    assert len(long.a) == 100 and re.fullmatch("[0-9a-f]{16}", long.b)


def test_scene_times(spark):
    df = spark.createDataFrame([("x pts_time:4.50049 y\npts_time:1.2 pts_time:1.2",), ("none",)], "log string")
    assert [r[0] for r in df.select(S.scene_times(F.col("log"))).collect()] == [[1.2, 4.5], []]


def test_references_and_case_against_python(spark):
    rng = np.random.default_rng(3)
    some = [n for n in html5 if rng.random() < 0.15]
    texts = [f"a&{n} b&{n[:-1]}x &{n};;" for n in some] + [f"&#{i};&#x{i:x} &#{i:07d};" for i in [*range(0, 300), 0xD800, 0xFDD0, 0xFFFF, 0x1F600, 0x10FFFF, 0x110000, 10**12]] + ["&", "&&amp;&", "&#x;", "&#; & x", "no", "&amp;#33;", "&ampamp;", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", T.references(F.col("t")).alias("got")).collect():
        assert r.got == (None if r.t is None else html.unescape(r.t)), r
    words = ["".join(chr(int(c)) for c in rng.integers(33, 0x2FF, 6)) for _ in range(200)] + [chr(c) + "X" for c in range(0x1E00, 0x2000)] + ["ΣΑΣ σς", "ıIİi", "ﬃ ﬄ ŉ ẞß", "Ꭰꭰ"]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    for r in df.select("t", T.casefold(F.col("t")).alias("got")).collect():
        assert r.got == r.t.casefold(), r


def plain_sentences(text):
    """The definition, sentence by sentence."""
    flat = re.sub(r"\s+", " ", text)
    norm = lambda s: re.sub(r"\s+([,.!?;:])", r"\1", re.sub(r"\s+", " ", s).strip())
    out, last = [], None
    for s in re.findall(r"[^!?.]+[!?.]?", flat):
        key = norm(s.strip().casefold()).strip(".!?")
        if not key or key != last:
            out.append(s.strip())
        last = key
    return norm(" ".join(out)) if re.search(r"[^!?.]", flat) else norm(text)


def test_repeated_sentences_against_plain_version(spark):
    rng = np.random.default_rng(4)
    bits = ["ab", "AB", "a", " ", "  ", ".", "!", "?", "..", " .", ",", " ,", "c d", "ß", "ss", "\n"]
    texts = ["".join(rng.choice(bits, int(rng.integers(0, 14)))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", T.drop_repeated_sentences(F.col("t")).alias("got")).collect():
        assert r.got == plain_sentences(r.t), r


def test_repeated_sentences_hold_few_texts_at_a_time(spark):
    """Not an Arrow batch of 10,000, however long they are; nulls, and signs that JSON and pickle tell apart, come through."""
    texts = [None, "", "a\x00b. A\x00B! c", "\U0001f600 x. \U0001F600 X. y", "\ud7ff. z"]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.drop_repeated_sentences(F.col("t")).alias("got"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert [r.got for r in out.collect()] == [None if t is None else plain_sentences(t) for t in texts]
