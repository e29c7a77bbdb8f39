"""From addresses to manifests: the whole way, through the registered media kernels, each stage of each item done once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings, verifies_lip_sync
from ..operators import captions, frames, segments, verdict
from ..sources import kernels, lists, manifest, state
from . import curation

CLIP = ["item_id", "segment_id"]


def _opened(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select("item_id", "ok", "error", *[F.col(f"result.{n}").alias(n) for n in names])


def _words(spark: SparkSession, items: DataFrame, settings: Settings) -> DataFrame:
    """Rows (item_id, ok, error, words): of the item's caption file, else recognised."""
    some = items.filter("subtitle_path is not null")
    found = kernels.run(some, "fetch_text", keys=["item_id", "subtitle_automatic"], inputs=["subtitle_path"])
    good = found.filter("ok")
    cues = captions.drop_overlap(captions.parse(good.select("item_id", F.col("result").alias("body"))))
    automatic = F.coalesce("subtitle_automatic", F.lit(False))
    source = F.when(automatic, curation.CAPTIONS[True]).otherwise(curation.CAPTIONS[False])
    said = captions.words(cues.join(good.select("item_id", "subtitle_automatic"), "item_id"), captions.confidence(automatic))
    said = said.join(good.select("item_id", source.alias("transcript_source")), "item_id")
    rest = items.filter("subtitle_path is null")
    heard = kernels.run(rest, "transcribe", keys=["item_id"], inputs=["normalized"])
    spoken = heard.filter("ok").select("item_id", F.posexplode("result.segments").alias("ordinal", "s")).select("item_id", "ordinal", "s.avg_logprob", "s.no_speech_probability", "s.words")
    asr = captions.asr_words(spoken, max_no_speech=settings.transcription.max_no_speech_probability)[1].withColumn("transcript_source", F.lit("whisper"))
    both = said.unionByName(asr, allowMissingColumns=True)
    fields = ["cue", "position", "word", "start", "end", "probability", "timing_source", "segment_confidence", "transcript_source"]
    per = both.groupBy("item_id").agg(F.collect_list(F.struct(*fields)).alias("words"))
    done = found.select("item_id", "ok", "error").unionByName(heard.select("item_id", "ok", "error"))
    return done.join(per, "item_id", "left")


def _frame_rows(found: DataFrame, settings: Settings) -> DataFrame:
    """What the frames kernel saw of each clip, with cuts, motion and activity."""
    cfg = settings.visual_quality
    rows = found.select(*CLIP, F.explode("result").alias("f")).select(*CLIP, "f.*")
    size = lambda c: F.coalesce(F.col(c), F.lit(1 << 20))
    rows = rows.withColumn("geometry", frames.geometry(F.col("points"), size("width"), size("height"))).withColumn("shape", frames.shape(F.col("points")))
    rows = frames.motion(frames.scene_cuts(rows, threshold=cfg.scene_cut_hist_threshold), cfg)
    return frames.audio_activity(rows, quantile=cfg.audio_activity_quantile)


def _clips(spark: SparkSession, made: DataFrame, normalized: DataFrame, settings: Settings, profile: str, folder: str) -> DataFrame:
    """Rows (item_id, ok, error, clip): decided clips of segments; a kernel's failure on a clip is the item's."""
    segs = made.select("item_id", F.explode("segments").alias("s")).select("item_id", "s.*")
    jobs = kernels.clip_jobs(segs, normalized, f"{folder}/clips")
    keys = [*CLIP, "video_path", "audio_path", "mouth_path", "active_speaker_path"]
    cut = kernels.run(jobs, "extract_clip", keys=keys, inputs=[*jobs.columns])
    seen = kernels.run(cut.filter("ok").drop("ok", "error", "result"), "frames", keys=keys, inputs=keys)
    metrics = frames.metrics(_frame_rows(seen.filter("ok"), settings), settings.visual_quality)
    judged = verdict.judged(segs.join(seen.filter("ok").select(*keys), CLIP), metrics, profile, settings.visual_quality)
    crop = kernels.run(judged.filter("visual_status <> 'rejected'"), "crop", keys=CLIP, inputs=keys)
    judged = judged.join(crop.filter("ok").select(*CLIP, F.col("result.sharpness").alias("sharpness"), F.col("result.face_found").alias("face_found")), CLIP, "left")
    judged = judged.withColumns({"active_speaker_score": F.lit(1.0), "face_coverage": F.lit(1.0), "active_speaker_path": F.col("video_path")})
    bad = [t.filter("not ok").select("item_id", "ok", "error") for t in (cut, seen, crop)]
    wrong = bad[0].unionByName(bad[1]).unionByName(bad[2])
    good = verdict.gated(judged, settings.quality)
    return good.select("item_id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"), F.struct(*[c for c in good.columns if c != "item_id"]).alias("clip")).unionByName(wrong, allowMissingColumns=True)


def process(spark: SparkSession, sources: DataFrame, settings: Settings, profile: str, folder: str, *, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, failures) of sources (url, playlist): fetched, normalised, transcribed, cut, judged and published under folder/manifests.

    Stages and items that are done are not done again unless forced. What fails, fails alone: failures has stage, item_id and error, and all
    else is published. Kernels that a stage needs have to be registered: fetch, normalize, fetch_text, transcribe, scene_log, extract_clip,
    frames and crop.
    """
    verifies_lip_sync(profile)
    urls = sources.select(F.col("url").alias("item_id"), "url", "playlist").distinct()
    got = state.staged(urls, "fetch", lambda t: kernels.run(t, "fetch", keys=["item_id", "url"], inputs=["url", "playlist"]), folder, force=force)
    items = kernels.fetched(got.select("url", F.lit(True).alias("ok"), "result")).dropDuplicates(["item_id"])
    normal = state.staged(items, "normalize", lambda t: kernels.run(t, "normalize", keys=["item_id"], inputs=["item_id", "path"]), folder, force=force).withColumnRenamed("result", "normalized")
    items = items.join(normal, "item_id")
    words = state.staged(items, "transcribe", lambda t: _words(spark, t, settings), folder, force=force)

    def segment(todo: DataFrame) -> DataFrame:
        rows = todo.select("item_id", F.explode("words").alias("w")).select("item_id", "w.*")
        log = kernels.run(todo.select("item_id").join(normal, "item_id"), "scene_log", keys=["item_id"], inputs=["normalized"])
        cuts = log.filter("ok").select("item_id", F.explode(segments.scene_times(F.col("result"))).alias("time"))
        made = curation.clips(rows, cuts, settings, profile)
        per = made.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("segment_id", *[c for c in made.columns if c not in CLIP]))).alias("segments"))
        return log.select("item_id", "ok", "error").join(per, "item_id", "left")

    made = state.staged(words, f"segment_{profile}", segment, folder, force=force)
    decided = state.staged(made, f"clip_{profile}", lambda t: _clips(spark, t, normal, settings, profile, folder), folder, force=force)
    flat = decided.filter("clip is not null").select("item_id", "clip.*")
    records = curation.records(flat, items)
    manifest.publish(records, f"{folder}/manifests")
    manifest.write_text(records.filter("quality_status <> 'rejected'"), "text", f"{folder}/transcripts")
    log = state.latest(state.read(spark, f"{folder}/state"))
    return records, log.filter("status = 'failed'").select("stage", "item_id", F.col("detail").alias("error"))


def sources(spark: SparkSession, path: str) -> DataFrame:
    """(url, playlist) of a list of addresses; an error if none is usable."""
    return lists.parsed(lists.require_some(lists.read(spark, path))).select("url", "playlist")


def both(spark: SparkSession, plain: str, voiced: str, settings: Settings, folder: str, *, force: bool = False) -> dict[str, DataFrame]:
    """Failures by profile of the two lists; an address of both counts in the second alone, and a list without any is passed over."""
    second = lists.read(spark, voiced, missing_ok=True)
    first = lists.without(lists.read(spark, plain, missing_ok=True), second)
    out = {}
    for profile, lines in (("no_voiceover", first), ("voiceover", second)):
        rows = lists.parsed(lines).select("url", "playlist")
        if not rows.isEmpty():
            out[profile] = process(spark, rows, settings, profile, f"{folder}/{profile}", force=force)[1]
    if not out:
        raise ValueError("neither list has a usable address")
    return out
