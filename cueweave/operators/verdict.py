"""Decisions on clips, with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CHECKS, Gate, Speaker, Visual, verifies_lip_sync

METRICS = [c[0] for c in CHECKS[:4]] + ["lip_sync_correlation", "mouth_opening_correlation", "max_missing_run_seconds", "unstable_landmark_ratio"]
#: What a clip without frames is given.
EMPTY = dict(zip(METRICS, (0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 999.0, 1.0)))


def _passes(metric: str, better: str, bound: float) -> Column:
    value = F.nanvl(F.col(metric).cast("double"), F.lit(None).cast("double"))
    return F.coalesce(value >= bound if better == "high" else value <= bound, F.lit(False))


def status(verify: bool) -> Column:
    """accepted if all accept bounds hold, else review if all review bounds do, else rejected; a null or NaN metric holds none."""
    checks = [c for c in CHECKS if verify or not c[5]]

    def every(at: int) -> Column:
        out = F.lit(True)
        for c in checks:
            out = out & _passes(c[0], c[1], c[at])
        return out

    return F.when(every(2), "accepted").when(every(3), "review").otherwise("rejected")


def reasons(verify: bool) -> Column:
    """The accept bounds that don't hold, in fixed order."""
    found = F.array(*[F.when(~_passes(c[0], c[1], c[2]), F.lit(c[4])) for c in CHECKS if verify or not c[5]])
    return F.filter(found, lambda r: r.isNotNull())


def judged(clips: DataFrame, metrics: DataFrame, profile: str, cfg: Visual | None = None, *, key: tuple[str, ...] = ("item_id", "segment_id")) -> DataFrame:
    """`clips` (with `start`) and their rounded metrics, status and reasons.

    A clip without metrics is rejected as empty_video. Where lip sync is verified, what starts in the intro window is rejected, and else what
    would be reviewed.
    """
    cfg = cfg or Visual()
    verify = verifies_lip_sync(profile)
    rows = clips.join(metrics.withColumn("_some", F.lit(True)), list(key), "left")
    rows = rows.withColumns({"_st": F.when(F.col("_some"), status(verify)).otherwise("rejected"), "_re": F.when(F.col("_some"), reasons(verify)).otherwise(F.array(F.lit("empty_video")))})
    if verify:
        intro = F.col("start") < cfg.reject_voiceover_segments_before_seconds
        doubt = (F.col("_st") == "review") & F.lit(cfg.reject_voiceover_review_segments)
        why = F.when(intro, "voiceover_intro_window").when(doubt, "voiceover_review_rejected")
        rows = rows.withColumn("_why", why).withColumns({"_st": F.when(F.col("_why").isNotNull(), "rejected").otherwise(F.col("_st")), "_re": F.when(F.col("_why").isNotNull(), F.array_append("_re", F.col("_why"))).otherwise(F.col("_re"))})
    known = {m: F.round(F.coalesce(F.col(m), F.lit(EMPTY[m])), 3 if m.endswith("seconds") else 5) for m in METRICS}
    return rows.withColumns(known).withColumns({"visual_status": F.col("_st"), "reasons": F.col("_re"), "source_profile": F.lit(profile)}).drop("_some", "_st", "_re", "_why")


def gated(clips: DataFrame, cfg: Gate | None = None) -> DataFrame:
    """Adds quality_status and accepted; what is rejected loses its paths.

    `clips` has asr_confidence (1 if null), active_speaker_score, face_coverage, sharpness, visual_status and, if any, face_found (false where
    the cropper saw no face, which rejects with the reason auto_avsr_no_face) and the four paths. A clip that the visual verdict rejects has
    no sharpness.
    """
    cfg = cfg or Gate()
    rows = clips
    if "face_found" in rows.columns:
        lost = (F.col("visual_status") != "rejected") & ~F.coalesce("face_found", F.lit(True))
        rows = rows.withColumn("_lost", lost).withColumns({"reasons": F.when(F.col("_lost"), F.array_append("reasons", F.lit("auto_avsr_no_face"))).otherwise(F.col("reasons")), "visual_status": F.when(F.col("_lost"), "rejected").otherwise(F.col("visual_status"))}).drop("_lost")
    rows = rows.withColumn("sharpness", F.when(F.col("visual_status") == "rejected", 0.0).otherwise(F.coalesce(F.col("sharpness").cast("double"), F.lit(0.0))))
    base = (F.coalesce("asr_confidence", F.lit(1.0)) >= cfg.min_asr_confidence) & (F.col("active_speaker_score") >= cfg.min_active_speaker_score) & (F.col("face_coverage") >= cfg.min_face_coverage)
    bad = ~F.coalesce(base, F.lit(False)) | (F.col("visual_status") == "rejected") | (F.col("sharpness") < cfg.min_sharpness)
    rows = rows.withColumn("quality_status", F.when(bad, "rejected").when(F.col("visual_status") == "review", "review").otherwise("accepted"))
    rows = rows.withColumn("accepted", F.col("quality_status") == "accepted")
    paths = [c for c in ("video_path", "active_speaker_path", "mouth_path", "audio_path") if c in rows.columns]
    return rows.withColumns({c: F.when(F.col("quality_status") == "rejected", "").otherwise(F.col(c)) for c in paths}) if paths else rows


def speaker_scores(scores: Column) -> Column:
    """Scores as probabilities: where any is outside 0 to 1, all go through the logistic function, cut off at 30."""
    x = F.transform(scores, lambda s: s.cast("double"))
    outside = F.exists(x, lambda s: (s < 0) | (s > 1))
    return F.when(outside, F.transform(x, lambda s: 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), s)))))).otherwise(x)


def speaker_verdict(rows: DataFrame, scores: str = "scores", cfg: Speaker | None = None) -> DataFrame:
    """Adds speaking_ratio, mean_probability, max_probability, speaker_status and speaker_reason; empty or null scores are rejected."""
    cfg = cfg or Speaker()
    rows = rows.withColumn("_p", speaker_scores(F.col(scores)))
    n = F.size(F.coalesce("_p", F.array().cast("array<double>")))
    share = F.when(n > 0, F.size(F.filter("_p", lambda p: p >= cfg.min_speaking_probability)) / n).otherwise(0.0)
    mean = F.when(n > 0, F.aggregate("_p", F.lit(0.0), lambda s, p: s + p) / n).otherwise(0.0)
    rows = rows.withColumns({"_r": share, "_m": mean, "_x": F.coalesce(F.array_max("_p"), F.lit(0.0)), "_n": n})
    st = F.when(F.col("_n") == 0, "rejected").when(F.col("_r") >= cfg.accept_min_speaking_ratio, "accepted").when(F.col("_r") >= cfg.review_min_speaking_ratio, "review").otherwise("rejected")
    rows = rows.withColumns({"speaking_ratio": F.round("_r", 5), "mean_probability": F.round("_m", 5), "max_probability": F.round("_x", 5), "speaker_status": st})
    why = F.when(F.col("speaker_status") == "review", "borderline_on_screen_speaker").when(F.col("speaker_status") == "rejected", "no_on_screen_active_speaker")
    return rows.withColumn("speaker_reason", why).drop("_p", "_r", "_m", "_x", "_n")
