"""Queries that read back what sinks wrote, and that run kernels and stages, over the driver's tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from ..operators import captions, frames, segments, tracks
from ..sources import kernels, lists, manifest, state
from ..sources.shared import shared_dir
from . import queries as Q
from .queries import query, t


def folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query
def caption_files(spark, d):
    """Caption files, one an item, read and parsed; references of all kinds, hours and both marks before the thousandths."""
    c = t(spark, d, "conversations")
    stamp = lambda s, mark: F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, s * 11 % 1000)
    flat = F.regexp_replace("text", r"\s+", " ")
    block = F.concat(stamp(F.col("turn") * 700, "."), F.lit(" --> "), stamp(F.col("turn") * 700 + 90, ","), F.lit("\r\n&eacute;&#8217;&#x27;&notit; "), flat, F.lit("\r\n"))
    body = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("bs"))
    at = folder(spark, "captions")
    captions.write(body.select("conv_id", F.concat(F.lit("﻿WEBVTT\r\n\r\n"), F.array_join(F.transform("bs", lambda b: b["b"]), "\r\n")).alias("body")), at, item="conv_id")
    files = captions.read(spark, f"{at}/*", item=F.regexp_extract("path", r"(-?\d+)\.vtt$", 1).cast("bigint"))
    return captions.parse(files).drop("ordinal")


@query
def markup_references(spark, d):
    p = t(spark, d, "part")
    k = F.col("p_partkey")
    ref = F.element_at(F.array(*map(F.lit, ["&eacute;", "&amp;lt;", "&notit;", "&copy", "&nosuch;", "&#169;", "&#xA9;", "&#128;", "&#0;", "&#x110000;", "&CounterClockwiseContourIntegral;", "& x", "&#;", "&ampx"])), (k % 14 + 1).cast("int"))
    return p.select("p_partkey", T.references(F.concat("p_name", ref, F.lit("&#"), k + 200, F.lit(";"), F.lit("&#x"), F.hex(k + 8000), F.lit(" end"))).alias("text"))


@query
def casefold_text(spark, d):
    p = t(spark, d, "part")
    extra = F.element_at(F.array(*map(F.lit, ["Straße", "ŒUVRE", "ﬁN", "ΣΟΦΟΣ", "İI", "ſ", "ẞ"])), (F.col("p_partkey") % 7 + 1).cast("int"))
    return p.select("p_partkey", T.casefold(F.concat(F.upper("p_name"), F.lit(" "), extra)).alias("text"))


def sounds(spark, d):
    """Sound of each embedding: its numbers as samples, of one or two channels, for one frame more than they last."""
    e = t(spark, d, "embeddings")
    x = F.transform("embedding", lambda v: F.round(v.cast("double") * 1000).cast("int"))
    x = F.when(F.col("vec_id") % 6 == 0, F.transform("embedding", lambda v: F.lit(0))).otherwise(x)
    two = F.col("vec_id") % 2 == 1
    return e.select(F.col("vec_id").alias("item_id"), F.lit("000000").alias("segment_id"), x.alias("samples"), F.lit(210).alias("rate"), F.when(two, 2).otherwise(1).alias("channels"), F.when(two, 5).otherwise(9).alias("frames"), F.when(F.col("vec_id") % 10 == 9, 1).otherwise(2).alias("sample_bytes"))


@query
def audio_rms(spark, d):
    return frames.loudness(sounds(spark, d)).select("item_id", "frame_idx", F.round("energy", 6).alias("energy"))


@query
def audio_joined(spark, d):
    """Sound beside the frames of the same clip and place; the frames go on where the sound has ended."""
    spine = t(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.lit("000000").alias("segment_id"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("frame_idx"))
    out = frames.with_audio(spine, frames.heard(sounds(spark, d)))
    return out.select("item_id", "frame_idx", "audio_active", F.round("audio_energy", 6).alias("audio_energy"))


@query
def clip_sharpness(spark, d):
    v = Q.vectors(spark, d).withColumn("p", F.transform("v", lambda x: F.round(x * 100)))
    return frames.clip_sharpness(v, "p", 8).select("item_id", "sharpness")


def lips(spark, d):
    """Four points of a mouth from each embedding, now and then one missing or not a number."""
    e = t(spark, d, "embeddings")
    v = lambda i: F.get("embedding", F.lit(i)).cast("double")
    x = lambda i: F.when((F.col("vec_id") % 23 == 0) & F.lit(i == 2), float("nan")).when((F.col("vec_id") % 29 == 0) & F.lit(i == 1), None).otherwise(40 + v(i) * 90)
    return e.select("vec_id", F.array(*[F.struct(x(i).alias("x"), (30 + v(i + 4) * 60).alias("y")) for i in range(4)]).alias("points"))


@query
def mouth_geometry(spark, d):
    g = lips(spark, d).withColumn("g", frames.geometry(F.col("points"), F.lit(80), F.lit(60)))
    return g.select("vec_id", *[F.round(F.get("g", F.lit(i)), 7).alias(f"g{i}") for i in range(4)])


@query
def mouth_shape(spark, d):
    rows = lips(spark, d).filter("vec_id % 23 <> 0 and vec_id % 29 <> 0")
    p = F.col("points")
    return rows.select("vec_id", F.round(frames.opening(p[0], p[1], p), 7).alias("opening"), *[F.round(F.get(frames.shape(p), F.lit(i))[c], 7).alias(f"{c}{i}") for i in (0, 3) for c in ("x", "y")])


@query
def detection_boxes(spark, d):
    e = t(spark, d, "embeddings")
    v = lambda i: F.get("embedding", F.lit(i)).cast("double")
    one = lambda i: F.struct((v(i) * 2).alias("x"), v(i + 1).alias("y"), F.abs(v(i + 2)).alias("w"), (v(i + 3) * 3).alias("h"))
    wide = F.when(F.col("vec_id") % 2 == 0, 1920).otherwise(320)
    rows = e.select("vec_id", F.slice(tracks.boxes(F.array(*[one(i) for i in range(0, 32, 4)]), wide, F.lit(240)), 1, 3).alias("b"))
    return rows.select("vec_id", F.posexplode("b").alias("place", "r")).select("vec_id", "place", "r.x1", "r.y1", "r.x2", "r.y2")


@query
def landmark_frames(spark, d):
    """Landmarks of a video cut to its clips, null past its end."""
    marks = t(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 40).alias("item_id"), (F.col("vec_id") % 40).alias("frame_idx"), F.slice("embedding", 1, 2).alias("points"))
    clips = marks.select("item_id").distinct().select("item_id", F.explode(F.array(*[F.struct(F.lit(s).alias("segment_id"), F.lit(a).alias("start"), F.lit(n).alias("frames")) for s, a, n in (("000000", 0.0, 5), ("000001", 0.5, 20), ("000002", 1.1, 25))])).alias("c")).select("item_id", "c.*")
    out = frames.landmark_slice(clips, marks)
    return out.select("item_id", "segment_id", "frame_idx", F.round(F.get("points", F.lit(0)).cast("double"), 7).alias("x"))


@query
def single_face(spark, d):
    e = t(spark, d, "embeddings")
    n = F.when(F.col("vec_id") % 7 == 0, None).otherwise(F.when(F.floor(F.col("vec_id") / 20) % 3 == 0, F.col("vec_id") % 2).otherwise(F.col("label") % 3))
    boxes = F.when(n.isNotNull(), F.slice(F.array(*[F.struct(F.lit(i).alias("x1")) for i in range(3)]), 1, n.cast("int")))
    return tracks.single_face(e.select(F.floor(F.col("vec_id") / 20).alias("clip"), boxes.alias("boxes")))


@query
def carried_box(spark, d):
    e = t(spark, d, "embeddings")
    v = lambda i: (F.abs(F.get("embedding", F.lit(i)).cast("double")) * 200).cast("int")
    box = F.when(F.col("vec_id") % 4 == 1, F.struct(v(0).alias("x1"), v(1).alias("y1"), (v(0) + v(2) + 10).alias("x2"), (v(1) + v(3) + 10).alias("y2")))
    out = tracks.carried_box(e.select(F.floor(F.col("vec_id") / 20).alias("clip"), F.col("vec_id").alias("frame_idx"), box.alias("box"), F.lit(150).alias("width"), F.lit(120).alias("height")))
    return out.select("clip", "frame_idx", "window.x1", "window.y1", "window.x2", "window.y2")


@query
def scene_log_times(spark, d):
    e = t(spark, d, "events")
    line = F.concat(F.lit("[showinfo] n: 1 pts_time:"), F.round(F.col("value"), 4).cast("decimal(20,4)").cast("string"), F.lit(" x\n"))
    log = e.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "").alias("log"))
    return log.select("user_id", F.explode(segments.scene_times(F.col("log"))).alias("time"))


@query
def source_file(spark, d):
    """A list written as a text file and read again, beside one that is not there."""
    at = folder(spark, "list")
    Q.source_lines(spark, d).coalesce(1).sortWithinPartitions("file", "line_no").select("raw").write.text(at)
    got = lists.parsed(lists.require_some(lists.read(spark, f"{at}/*.txt"))).unionByName(lists.parsed(lists.read(spark, f"{at}/none.txt", missing_ok=True)))
    return got.select("line_no", "mode", "url", "playlist")


@query
def playlist_entries(spark, d):
    o = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("item_id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    return lists.entries(o.select("item_id", F.transform("k", lambda x: F.when(x % 3 != 0, x.cast("string"))).alias("entries")), head=4)


@query
def local_files(spark, d):
    return lists.local_items(spark, f"{d}/*.parquet").filter("size > 0").select("item_id", "title")


@query
def record_files(spark, d):
    """Records written as JSON, a folder a contributor, and read again with their types."""
    at = folder(spark, "records")
    manifest.write_json(Q.clip_records(spark, d).withColumn("batch", F.crc32("item_id") % 3), at, by=["batch"])
    back = manifest.read_records(spark, at, lines=True)
    return manifest.flat(back).select(*Q.MANIFEST)


@query
def published_lines(spark, d):
    at = folder(spark, "published")
    manifest.publish(Q.clip_records(spark, d), at)
    return manifest.flat(manifest.read_records(spark, f"{at}/all.jsonl", lines=True)).select(*Q.MANIFEST)


@query
def published_table(spark, d):
    """The CSV of all records read again; text where it was text, and what was null or empty is null."""
    at = folder(spark, "published")
    manifest.publish(Q.clip_records(spark, d), at)
    rows = manifest.read_csv(spark, f"{at}/all.csv")
    kinds = {"start": "double", "mouth_visible_ratio": "double", "scene_cut_ratio": "double"}
    return rows.select(*[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in Q.MANIFEST])


@query
def shared_pull(spark, d):
    """Two contributors' records pushed to a shared table, and what one pulls of it."""
    at = folder(spark, "shared")
    rows = Q.clip_records(spark, d)
    manifest.push(rows, at, "Ada L.", ["review", "rejected"])
    manifest.push(rows, at, "bob", ["rejected"])
    return manifest.pull(spark, at, "Ada L.").groupBy("contributor", "quality_status").agg(F.count("*").alias("n"))


def _number(row):
    if row["k"] % 5 == 0:
        raise ValueError(f"bad {row['k']}")
    return kernels.flatten_scores({"a": [row["v"], [True, "text", None]], "b": (1, {"c": row["v"] * 2})})


def scored(spark, d):
    kernels.register("speaker_scores", lambda: _number)
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("k"), F.round(F.get("embedding", F.lit(0)).cast("double"), 3).alias("v"))
    return kernels.run(e, "speaker_scores", keys=["k"], inputs=["k", "v"])


@query
def kernel_rows(spark, d):
    return scored(spark, d).select("k", "ok", "error", F.size("result").alias("n"), F.round(F.aggregate("result", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query
def kernel_retry(spark, d):
    """Of two tries at a row the first that went well, else both errors."""
    one = scored(spark, d).select("k", F.struct("ok", "error", F.element_at("result", 1).alias("result")).alias("a"))
    kind = F.when(F.col("k") % 3 != 0, F.struct(F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"), F.lit(-1.0).alias("result"))).otherwise(F.struct(F.lit(False).alias("ok"), F.lit("none").alias("error"), F.lit(None).cast("double").alias("result")))
    r = kernels.first_success(F.col("a"), kind)
    return one.select("k", r["ok"].alias("ok"), F.when(~r["ok"], r["error"]).alias("error"), F.when(r["ok"] & (r["result"] < 0), r["result"]).alias("second"))


@query
def fetched_items(spark, d):
    """Playlists fanned out to items and their stored names; null entries are none, failed ones give none."""
    o = t(spark, d, "orders")
    entry = F.when(F.col("o_orderkey") % 4 != 0, F.struct(F.col("o_orderkey").cast("string").alias("item_id"), F.concat(F.lit("tmp/x"), F.col("o_orderkey"), F.lit(".MP4")).alias("path")))
    by = o.groupBy(F.col("o_custkey").cast("string").alias("url")).agg(F.collect_list(F.struct(entry.alias("e"))).alias("es"))
    got = by.select("url", (F.col("url").cast("int") % 9 != 0).alias("ok"), F.transform("es", lambda x: x["e"]).alias("result"))
    return kernels.fetched(got).select("url", "item_id", "stored")


@query
def clip_intervals(spark, d):
    s = segments.make(Q.words(spark, d), None, Q.CFG)
    short = s.withColumn("end", F.when(F.col("item_id") % 5 == 0, F.col("start")).otherwise(F.col("end")))
    items = s.select("item_id").distinct().withColumn("normalized", F.concat(F.lit("n/"), "item_id", F.lit(".mp4")))
    return kernels.clip_jobs(short, items, "clips").select("item_id", "segment_id", "source", "start", "duration", "video_path")


@query
def rejected_files(spark, d):
    return kernels.left_behind(Q.verdict.gated(Q.judged(spark, d, "no_voiceover")), "clips")


@query
def landmark_kernel(spark, d):
    """A detector that finds no frame gives nulls; one that breaks otherwise is an error."""

    def factory():
        def detect(frames_):
            if frames_[0] % 3 == 0:
                raise AssertionError("Cannot detect any frames in the video")
            if frames_[0] % 3 == 1:
                raise AssertionError("broken")
            return [{"frame_idx": f, "points": [{"x": float(f), "y": 0.0}]} for f in frames_]

        return lambda row: [m or {"frame_idx": -1, "points": None} for m in kernels.landmarks_or_null(detect, [row["k"], row["k"] + 1])]

    kernels.register("landmarks", factory)
    r = kernels.run(t(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), "landmarks", keys=["k"], inputs=["k"])
    return r.select("k", "ok", "error", F.element_at("result", 1)["frame_idx"].alias("first"), F.element_at("result", 2)["points"][0]["x"].alias("x"))


def _stage_items(spark, d):
    return t(spark, d, "nation").select(F.col("n_name").alias("item_id"), F.col("n_nationkey").cast("int").alias("k"))


def _stage_runs(spark, d, at):
    """A stage run three times: all but every fourth fail the first time, then only every fifth, and nothing is left for the third but those."""
    items = _stage_items(spark, d)
    rows = lambda todo, bad, n: todo.select("item_id", (F.col("k") % bad != 0).alias("ok"), F.when(F.col("k") % bad == 0, F.concat(F.lit("no "), "k")).alias("error"), F.lit(n).alias("run"))
    for n, bad in ((1, 2), (2, 5), (3, 5)):
        out = state.staged(items, "work", lambda todo, n=n, bad=bad: rows(todo, bad, n), at)
    return out


@query
def stage_rows(spark, d):
    return _stage_runs(spark, d, folder(spark, "stages"))


@query
def stage_statuses(spark, d):
    at = folder(spark, "stages")
    _stage_runs(spark, d, at)
    return state.latest(state.read(spark, f"{at}/state")).select("item_id", "stage", "status", F.when(F.col("status") == "failed", F.col("detail")).alias("error"))


@query
def failure_summary(spark, d):
    """Sources of two lists put together, those that failed counted and named."""
    n = t(spark, d, "nation").select(F.col("n_name").alias("item_id"), (F.col("n_nationkey") % 6 != 0).alias("ok"), F.lit("lost").alias("error"))
    r = t(spark, d, "region").select(F.col("r_name").alias("item_id"), (F.col("r_regionkey") != 2).alias("ok"), F.lit(None).cast("string").alias("error"))
    good, bad = state.isolated(n.unionByName(r))
    return state.failures(good.unionByName(bad)).withColumn("good", F.lit(good.count()))


@query
def settings_flat(spark, d):
    """Settings of a file that extends another, by dotted names."""
    with tempfile.TemporaryDirectory() as at:
        for name, body in (("base.yaml", "language: en\nsegmentation:\n  min_words: 4\n  max_duration: 9\ncaptions:\n  languages: [en, de]\n"), ("own.yaml", "extends: base.yaml\nsegmentation:\n  max_duration: 12\nunknown: 1\nquality:\n  min_sharpness: 5\n")):
            with open(os.path.join(at, name), "w") as f:
                f.write(body)
        flat = config.flat(config.load(os.path.join(at, "own.yaml")))
    rows = [(k, ",".join(v) if isinstance(v, tuple) else str(v)) for k, v in flat.items() if k.split(".")[0] in ("language", "segmentation", "captions", "quality")]
    return spark.createDataFrame(rows, "name string, value string")


@query
def settings_choices(spark, d):
    """What argument, environment and file choose; devices; selectors without repeats; profiles."""
    rows = [("first_of", config.first_of(None, "", "kept")), ("device", config.device("auto", mps=True)), ("device_named", config.device("cpu", cuda=True)), ("selectors", ",".join(kernels.selectors("b", "a", "b"))), ("voiceover", str(config.verifies_lip_sync("voiceover"))), ("no_voiceover", str(config.verifies_lip_sync("no_voiceover"))), ("statuses", ",".join(spark.range(1).select(T.wanted_statuses("rejected, odd, accepted").alias("s")).first().s))]
    return spark.createDataFrame(rows, "name string, value string")


@query
def transcript_route(spark, d):
    """Words of captions where an item has them, else recognised ones, and what the segments are said to come from."""
    from . import curation

    w = Q.words(spark, d)
    items = w.select("item_id").distinct()
    caps = w.filter("item_id % 3 = 0").drop("segment_confidence")
    asr = w.filter("item_id % 3 <> 1 or item_id % 2 = 0").drop("timing_source")
    routed = curation.route(items, caps, asr)
    made = segments.make(routed, None, Q.CFG)
    return made.groupBy("transcript_source").agg(F.count_distinct("item_id").alias("items"), F.count("*").alias("segments"), F.sum("word_count").alias("words"))
