"""Queries over the driver's tables that stand in for words, cues, frames and records, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Gate, Segmentation, Speaker, Visual
from ..functions import text as T
from ..operators import captions, frames, segments, tracks, verdict
from ..sources import lists, manifest, state

CFG = Segmentation(min_duration=12.0, max_duration=72.0, max_gap_seconds=6.0)
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cues(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("item_id"), F.col("turn").alias("ordinal"), (F.col("turn") * 4).cast("double").alias("start"), (F.col("turn") * 4 + 4).cast("double").alias("end"), "text")


def hours(ts) -> object:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(3.6e9) - F.lit(473352.0)


def events(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select("event_id", "user_id", "event_type", "value", "ts", hours(F.col("ts")).alias("h"))


def words(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    end = F.when(F.col("event_id") % 4 == 0, ".").when(F.col("event_id") % 9 == 0, "?").otherwise("")
    return e.select(
        F.col("user_id").alias("item_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("cue"), F.col("event_id").alias("position"), F.concat("event_type", end).alias("word"),
        F.col("h").alias("start"), (F.col("h") + 0.5).alias("end"), (F.col("value") / 491.7).alias("probability"), F.when(F.col("user_id") % 3 == 0, "subtitle").alias("timing_source"),
        F.when(F.col("event_id") % 2 == 0, F.col("value") / 403.3).alias("segment_confidence"),
    )


def cuts(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).filter("event_type = 'error'").select(F.col("user_id").alias("item_id"), (F.col("h") + 0.25).alias("time"))


def frame_rows(spark: SparkSession, d: str) -> DataFrame:
    """Frames from events: a user is a clip, the place of an event its frame."""
    e = events(spark, d)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("item_id"), F.lit("000000").alias("segment_id"), (F.row_number().over(w) - 1).alias("frame_idx"), (F.col("value") > 12).alias("visible"),
        (F.col("event_type") == "error").alias("cut"), (F.col("event_type") == "signup").alias("unstable"), (F.col("value") / 2000).alias("mouth_motion"), (F.col("value") / 20000).alias("mouth_shape_motion"),
        (F.col("event_id") % 100 / 20000.0).alias("mouth_opening_motion"), F.when(F.col("event_id") % 7 == 0, 0.0).otherwise(F.col("value")).alias("energy"),
    )


def full_frames(spark: SparkSession, d: str) -> DataFrame:
    held = frames.sampled(frame_rows(spark, d), ["visible", "unstable", "mouth_motion", "mouth_shape_motion", "mouth_opening_motion"])
    return frames.audio_activity(held)


@query
def caption_dedup(spark, d):
    return captions.drop_overlap(cues(spark, d)).select("item_id", "ordinal", "text")


@query
def cue_words(spark, d):
    return captions.words(cues(spark, d), captions.confidence(F.col("item_id") % 2 == 0))


@query
def vtt_parse(spark, d):
    stamp = lambda s: F.format_string("%02d:%02d:%02d.%03d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, s * 7 % 1000)
    c = t(spark, d, "conversations")
    flat = F.regexp_replace("text", r"\s+", " ")
    block = F.concat(stamp(F.col("turn") * 400), F.lit(" --> "), stamp(F.col("turn") * 400 + 300), F.lit(" align:start\n<v "), F.col("role"), F.lit(">>> "), flat, F.lit("</v>\n&amp; more"))
    body = c.groupBy(F.col("conv_id").alias("item_id")).agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("bs"))
    body = body.select("item_id", F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("bs", lambda b: b["b"]), "\n\n")).alias("body"))
    return captions.parse(body)


@query
def normalize_text(spark, d):
    return t(spark, d, "documents").select("doc_id", T.normalize(F.col("text")).alias("text"))


@query
def sentence_dedup(spark, d):
    return t(spark, d, "documents").select("doc_id", T.drop_repeated_sentences(F.col("text")).alias("text"))


@query
def markup_clean(spark, d):
    return t(spark, d, "pages").select("page_id", T.clean_markup(F.col("html")).alias("text"))


@query
def safe_id(spark, d):
    return t(spark, d, "pages").select("page_id", T.safe_id(F.col("url")).alias("id")).unionByName(t(spark, d, "part").select(F.col("p_partkey").alias("page_id"), T.safe_id(F.concat(F.lit("--"), F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_name")), F.lit("__"))).alias("id")))


@query
def slug(spark, d):
    a = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), T.slug(F.concat(F.lit(" "), "c_name", F.lit("  "), "c_mktsegment", F.lit("-_"))).alias("slug"))
    return a.unionByName(t(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), T.slug(F.when(F.col("n_nationkey") % 6 == 0, "?!").otherwise(F.col("n_name"))).alias("slug")))


def source_lines(spark, d):
    p = t(spark, d, "pages")
    lead = F.when(F.col("page_id") % 4 == 0, "video ").when(F.col("page_id") % 4 == 1, "Playlist  ").when(F.col("page_id") % 4 == 2, "# ").otherwise("")
    tail = F.when(F.col("page_id") % 8 == 3, "?list=1 ").otherwise(" ")
    return p.select(F.concat(F.lit("list"), F.col("page_id") % 2).alias("file"), F.col("page_id").cast("int").alias("line_no"), F.concat(F.lit(" "), lead, "url", tail).alias("raw"))


@query
def source_modes(spark, d):
    return lists.parsed(source_lines(spark, d))


def two_lists(spark, d):
    p = t(spark, d, "pages")
    row = lambda m: F.concat(F.when(F.col("page_id") % 3 == 0, "video ").otherwise(""), F.regexp_replace("url", r"\?.*|#.*", "")).alias("raw")
    a = p.filter("page_id % 2 = 0").select(F.lit("a").alias("file"), F.col("page_id").cast("int").alias("line_no"), row(0))
    b = p.filter("page_id % 10 = 0 or page_id % 2 = 1").select(F.lit("b").alias("file"), F.col("page_id").cast("int").alias("line_no"), row(1))
    return a, b


@query
def source_anti_dedup(spark, d):
    return lists.without(*two_lists(spark, d))


@query
def source_skipped(spark, d):
    return lists.skipped(*two_lists(spark, d))


@query
def segments_greedy(spark, d):
    return segments.make(words(spark, d), None, Segmentation(min_duration=0.0, max_duration=72.0, max_gap_seconds=6.0, min_words=1))


@query
def segments_merged(spark, d):
    return segments.make(words(spark, d), None, CFG)


@query
def segments_strict(spark, d):
    return segments.make(words(spark, d), cuts(spark, d), CFG, strict=True)


@query
def segments_cut(spark, d):
    return segments.make(words(spark, d), cuts(spark, d), CFG)


@query
def segments_intro_reindex(spark, d):
    return segments.cut_intro(segments.make(words(spark, d), cuts(spark, d), CFG), 200.0)


@query
def asr_confidence(spark, d):
    e = t(spark, d, "events")
    one = F.struct(F.col("event_type").alias("word"), F.col("value").alias("start"), F.when(F.col("event_id") % 11 != 0, F.col("value") + 1).alias("end"), (F.col("value") / 500).alias("probability"))
    segs = e.select(F.col("user_id").cast("string").alias("item_id"), F.col("event_id").alias("ordinal"), F.when(F.col("event_id") % 13 == 0, 0.0).when(F.col("event_id") % 17 != 0, -F.col("value") / 100).alias("avg_logprob"), (F.col("value") / 200).alias("no_speech_probability"), F.array(one).alias("words"))
    known, w = captions.asr_words(segs)
    per = w.groupBy("item_id").agg(F.count("*").alias("words"), F.round(F.avg(F.least(F.coalesce("probability", F.lit(0.0)), F.coalesce("segment_confidence", F.lit(1.0)))), 8).alias("asr_confidence"))
    return known.groupBy("item_id").agg(F.count("*").alias("segments"), F.round(F.avg("confidence"), 8).alias("confidence")).join(per, "item_id", "left")


@query
def frame_sampled_metrics(spark, d):
    m = frames.metrics(full_frames(spark, d))
    return m.select("item_id", *[F.round(c, 7).alias(c) for c in m.columns[2:]])


@query
def missing_run(spark, d):
    return frames.longest_missing(frame_rows(spark, d)).select("item_id", "longest")


@query
def audio_activity(spark, d):
    return frames.audio_activity(frame_rows(spark, d)).select("item_id", "frame_idx", "audio_active", F.round("audio_energy", 8).alias("audio_energy"))


@query
def lip_sync_corr(spark, d):
    li = t(spark, d, "lineitem")
    same = F.when(F.col("l_suppkey") % 10 == 0, 1.0).otherwise(F.col("l_discount"))
    return li.groupBy("l_suppkey").agg(F.round(frames.correlation(F.col("l_quantity"), same), 6).alias("r"), F.round(frames.correlation(F.col("l_extendedprice"), F.col("l_quantity")), 6).alias("rp"))


def vectors(spark, d):
    """Embeddings in clips of 20."""
    e = t(spark, d, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 20).alias("item_id"), F.lit("0").alias("segment_id"), F.col("vec_id").alias("frame_idx"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")


@query
def scene_cut_flags(spark, d):
    v = vectors(spark, d).withColumn("histogram", F.transform("v", lambda x: F.greatest(x, F.lit(0.0))))
    return frames.scene_cuts(v, threshold=0.7).select("item_id", "frame_idx", "cut")


@query
def hist_distance(spark, d):
    v = vectors(spark, d).withColumn("h", F.transform("v", lambda x: F.abs(x)))
    w = Window.partitionBy("item_id").orderBy("frame_idx")
    return v.select("frame_idx", F.round(frames.histogram_distance(F.lag("h").over(w), F.col("h")), 7).alias("distance"))


@query
def landmark_jump(spark, d):
    v = vectors(spark, d).withColumns({"geometry": F.when(F.col("frame_idx") % 15 != 0, F.slice("v", 1, 4)), "roi_ok": F.col("frame_idx") % 25 != 0, "opening": F.col("v")[5], "gray": F.transform(F.slice("v", 7, 8), lambda x: F.floor(x * 100)), "shape": F.transform(F.sequence(F.lit(16), F.lit(19)), lambda i: F.struct(F.get("v", i).alias("x"), F.get("v", i + 4).alias("y")))})
    m = frames.motion(v, Visual(landmark_jump_threshold=0.3))
    return m.select("item_id", "frame_idx", "visible", "unstable", *[F.round(c, 8).alias(c) for c in ("mouth_motion", "mouth_shape_motion", "mouth_opening_motion")])


@query
def laplacian_sharpness(spark, d):
    return vectors(spark, d).select("frame_idx", F.round(frames.sharpness(F.transform("v", lambda x: x * 100), 8), 5).alias("sharpness"))


@query
def speaker_scores(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 19 == 0, F.slice("embedding", 1, 0)).when(F.col("vec_id") % 2 == 0, F.transform("embedding", lambda x: x.cast("double") * 12 + 1)).otherwise(F.transform("embedding", lambda x: F.abs(x).cast("double") * 1.5)).alias("scores"))
    out = verdict.speaker_verdict(e.withColumn("scores", F.col("scores").cast("array<double>")))
    return out.select("vec_id", "speaking_ratio", "mean_probability", "max_probability", "speaker_status", "speaker_reason")


def face_frames(spark, d):
    """Boxes of two faces from each embedding; the one has moved a little, the other jumps with the label."""
    v = vectors(spark, d)
    at = lambda i, s, o: (F.col("v")[i] * s + o).cast("int")
    box = lambda x, y: F.struct(x.alias("x1"), y.alias("y1"), (x + 100).alias("x2"), (y + 120).alias("y2"))
    two = F.array(box(at(0, 60, 300), at(1, 60, 200)), box(at(2, 60, 50) + F.col("label").cast("int") * 90, at(3, 60, 90)))
    return v.select(F.col("item_id").alias("clip"), (F.col("frame_idx") % 20).alias("frame_idx"), two.alias("boxes"), F.col("v")[8].alias("m"))


@query
def iou_pairs(spark, d):
    f = face_frames(spark, d)
    w = Window.partitionBy("clip").orderBy("frame_idx")
    pair = f.withColumn("p", F.lag("boxes").over(w)).filter("p is not null")
    return pair.select("clip", "frame_idx", F.round(tracks.iou(F.col("p")[0], F.col("boxes")[0]), 8).alias("same"), F.round(tracks.iou(F.col("p")[0], F.col("boxes")[1]), 8).alias("other"))


@query
def face_tracks(spark, d):
    f = face_frames(spark, d)
    out = tracks.tracked(f, Speaker(sample_every_n_frames=1))
    return out.select("clip", "track", "frame_idx", "box.x1", "box.y1", "box.x2", "box.y2")


@query
def track_select(spark, d):
    e = t(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("clip"), F.col("label").alias("track"), F.when(F.col("vec_id") % 5 != 0, F.abs(F.col("embedding")[0]).cast("double")).alias("motion"))
    n = e.groupBy("clip").agg(F.count("*").alias("frames"))
    return tracks.best_track(tracks.track_scores(e, n))


def clip_rows(spark, d):
    """Clips with metrics: of users from their frames; every ninth user has none."""
    m = frames.metrics(full_frames(spark, d)).filter("item_id % 9 != 0")
    e = t(spark, d, "events").groupBy(F.col("user_id").alias("item_id")).agg(F.count("*").alias("n"), F.max("value").alias("top"))
    c = e.select("item_id", F.lit("000000").alias("segment_id"), (F.col("n") % 40).cast("double").alias("start"), (F.col("n") % 40 + 5).cast("double").alias("end"), (0.6 + F.col("n") % 30 / 60).alias("asr_confidence"), F.lit(1.0).alias("active_speaker_score"), F.when(F.col("item_id") % 20 == 7, 0.5).otherwise(1.0).alias("face_coverage"), (F.col("top") / 5).alias("sharpness"), (F.col("item_id") % 13 != 0).alias("face_found"), F.concat(F.lit("clips/"), F.col("item_id"), F.lit("/source.mp4")).alias("video_path"))
    return c, m


LOOSE = {"mouth_visible_ratio": "mouth_visible_ratio + 0.3", "scene_cut_ratio": "scene_cut_ratio / 30", "max_missing_run_seconds": "max_missing_run_seconds", "unstable_landmark_ratio": "unstable_landmark_ratio / 4", "static_speech_ratio": "static_speech_ratio / 4", "speech_mouth_motion_ratio": "speech_mouth_motion_ratio", "lip_sync_correlation": "lip_sync_correlation - 0.9"}


def judged(spark, d, profile):
    c, m = clip_rows(spark, d)
    m = m.selectExpr("item_id", "segment_id", *[f"round({LOOSE.get(x, x)}, 7) as {x}" for x in m.columns[2:]])
    return verdict.judged(c, m, profile)


SHOWN = ["mouth_visible_ratio", "scene_cut_ratio", "static_speech_ratio"]


@query
def verdict_status(spark, d):
    return judged(spark, d, "no_voiceover").select("item_id", "visual_status", *SHOWN)


@query
def verdict_reasons(spark, d):
    return judged(spark, d, "voiceover").select("item_id", "visual_status", F.array_join("reasons", "|").alias("reasons"))


@query
def final_gate(spark, d):
    return verdict.gated(judged(spark, d, "no_voiceover"), Gate()).select("item_id", "quality_status", "accepted", F.array_join("reasons", "|").alias("reasons"), F.round("sharpness", 6).alias("sharpness"), "video_path")


def clip_records(spark, d):
    from . import curation

    g = verdict.gated(judged(spark, d, "no_voiceover")).withColumn("item_id", F.col("item_id").cast("string"))
    items = t(spark, d, "pages").select(F.col("page_id").cast("string").alias("item_id"), F.col("url").alias("source_url"), T.safe_id(F.col("url")).alias("title"), F.lit(None).cast("string").alias("channel"))
    return curation.records(g, items)


MANIFEST = ["item_id", "segment_id", "video_path", "mouth_path", "start", "source_url", "title", "quality_status", "talknet_status", "mouth_visible_ratio", "scene_cut_ratio", "visual_quality_reasons", "accepted"]


@query
def manifest_flat(spark, d):
    return manifest.flat(clip_records(spark, d)).select(*MANIFEST)


@query
def manifest_accepted(spark, d):
    return manifest.split(manifest.flat(clip_records(spark, d)))["accepted"].select(*MANIFEST)


@query
def manifest_review(spark, d):
    return manifest.split(manifest.flat(clip_records(spark, d)))["review"].select(*MANIFEST)


@query
def manifest_rejected(spark, d):
    return manifest.split(manifest.flat(clip_records(spark, d)))["rejected"].select(*MANIFEST)


@query
def inspect_head(spark, d):
    rows = manifest.flat(clip_records(spark, d)).withColumn("text", F.concat(F.lit("text of "), F.repeat(F.col("source_url"), 2)))
    return manifest.head(rows, 12)


@query
def push_selection(spark, d):
    return manifest.selection(clip_records(spark, d), ["accepted", "review", "nonsense"], audio=True)


@query
def pull_contributor(spark, d):
    o = t(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "review").otherwise("rejected"))
    n = t(spark, d, "nation").join(t(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", T.slug(F.col("n_name")).alias("contributor"))
    rows = o.join(n, F.col("o_custkey") == F.col("c_custkey")).filter(F.array_contains(T.wanted_statuses(" accepted, review,,odd"), F.col("status")))
    return rows.groupBy("contributor", "status").agg(F.count("*").alias("n"))


def stage_log(spark, d):
    e = t(spark, d, "events")
    return e.select(F.col("user_id").cast("string").alias("item_id"), "event_type", F.when(F.col("event_id") % 3 == 0, "running").when(F.col("event_id") % 5 == 0, "failed").otherwise("done").alias("status"), F.col("event_id").cast("string").alias("detail"), F.col("ts").cast("timestamp").alias("updated_at")).withColumnRenamed("event_type", "stage")


@query
def stage_latest(spark, d):
    return state.latest(stage_log(spark, d)).select("item_id", "stage", "status", "detail")


@query
def stage_pending(spark, d):
    log = stage_log(spark, d)
    items = log.select("item_id").distinct()
    gone = items.select("item_id", (F.col("item_id").cast("int") % 8 != 0).alias("exists"))
    return state.pending(items, log, "click", outputs=gone)


@query
def caption_choice(spark, d):
    x = t(spark, d, "documents")
    entry = F.struct(F.when(F.col("n_chars") % 3 == 0, "srt").when(F.col("n_chars") % 3 == 1, "vtt").otherwise("ttml").alias("ext"), F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("u"), F.col("doc_id"))).alias("url"))
    by = x.groupBy(F.floor(F.col("doc_id") / 3).alias("item_id"), (F.col("source") < "src3").alias("auto"), "lang").agg(F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("e")))).alias("es"))
    by = by.withColumn("es", F.transform("es", lambda v: v["e"]))
    pack = lambda cond: F.map_from_entries(F.array_sort(F.collect_list(F.when(cond, F.struct("lang", "es")))))
    return captions.choose(by.groupBy("item_id").agg(pack(~F.col("auto")).alias("subtitles"), pack(F.col("auto")).alias("automatic_captions")), ["de", "fr", "en"])


@query
def file_pick(spark, d):
    x = t(spark, d, "documents")
    ext = F.element_at(F.array(*map(F.lit, ["mp4", "mkv", "mp4.part", "webm", "txt"])), (F.col("doc_id") % 5 + 1).cast("int"))
    return lists.pick_file(x.select(F.col("source").alias("item_id"), F.concat(F.lit("f"), "doc_id", F.lit("."), ext).alias("path"), F.col("n_chars").alias("size")))
