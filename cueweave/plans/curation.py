"""The whole way from captions to a manifest, as one plan of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings, verifies_lip_sync
from ..operators import captions, frames, segments, verdict


#: What words of captions are said to come from, by whether a machine made them.
CAPTIONS = {False: "youtube_manual_subtitles", True: "youtube_auto_captions"}


def transcript(cues: DataFrame, *, automatic: bool = False) -> DataFrame:
    """Words of cues, rolling repeats removed."""
    return captions.words(captions.drop_overlap(cues), float(0.82 if automatic else 1.0))


def route(items: DataFrame, caption_words: DataFrame, asr: DataFrame, *, use_asr: bool = True) -> DataFrame:
    """Words of each item: of its caption where it has one, else recognised ones; without either an error names the item."""
    cap = caption_words.select("item_id").distinct().withColumn("_cap", F.lit(True))
    kind = items.select("item_id").join(cap, "item_id", "left")
    cols = ["item_id", "cue", "position", "word", "start", "end", "probability", "timing_source", "segment_confidence", "transcript_source"]
    a = caption_words if "transcript_source" in caption_words.columns else caption_words.withColumn("transcript_source", F.lit(CAPTIONS[False]))
    b = asr.join(kind.filter("_cap is null").select("item_id"), "item_id", "left_semi").withColumn("transcript_source", F.lit("whisper")) if use_asr else None
    whole = a if b is None else a.unionByName(b, allowMissingColumns=True)
    for c, t in (("timing_source", "string"), ("segment_confidence", "double")):
        if c not in whole.columns:
            whole = whole.withColumn(c, F.lit(None).cast(t))
    lost = kind.filter("_cap is null")
    lost = lost if b is None else lost.join(b.select("item_id").distinct(), "item_id", "left_anti")
    bad = lost.select(F.raise_error(F.concat(F.lit("no words for item "), "item_id")).cast("string").alias("item_id"))
    return whole.select(*cols).unionByName(bad, allowMissingColumns=True) if not use_asr else whole.select(*cols)


def clips(words: DataFrame, cuts: DataFrame | None, settings: Settings, profile: str) -> DataFrame:
    """Segments as the profile has them: outside voices are cut at every sentence, and their intro is left out."""
    strict = verifies_lip_sync(profile)
    made = segments.make(words, cuts, settings.segmentation, strict=strict)
    return segments.cut_intro(made, settings.visual_quality.reject_voiceover_segments_before_seconds) if strict else made


def decided(clips: DataFrame, frame_rows: DataFrame, settings: Settings, profile: str) -> DataFrame:
    """Clips with metrics of their frames, visual status, reasons and the last gate's status."""
    m = frames.metrics(frame_rows, settings.visual_quality)
    return verdict.gated(verdict.judged(clips, m, profile, settings.visual_quality), settings.quality)


def records(decided: DataFrame, items: DataFrame) -> DataFrame:
    """Clip records: decided clips with their item's metadata (item_id, source_url, title, channel)."""
    meta = items.select("item_id", "source_url", "title", "channel")
    rows = decided.join(meta, "item_id", "left")
    visual = F.struct(F.col("visual_status").alias("status"), *verdict.METRICS, "reasons").alias("visual_quality")
    drop = ["visual_status", *verdict.METRICS, "reasons"]
    return rows.select(*[c for c in rows.columns if c not in drop], visual)
