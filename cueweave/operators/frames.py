"""Frames of a clip to its metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Visual
from ..functions.core import let

KEY = ("item_id", "segment_id")


def audio_activity(frames: DataFrame, *, key: tuple[str, ...] = KEY, energy: str = "energy", quantile: float = 0.55) -> DataFrame:
    """Adds audio_active and audio_energy (0 to 1) to frames with an energy.

    Quantiles are over the clip's frames above 0, exact; a clip without any has none active. A frame is active from the quantile on; the
    energy is over the 0.95 quantile.
    """
    w = Window.partitionBy(*key)
    e = F.col(energy).cast("double")
    some = F.when(e > 0, e)
    low, scale = F.percentile(some, quantile).over(w), F.nullif(F.percentile(some, 0.95).over(w), F.lit(0.0))
    rows = frames.withColumns({"_low": low, "_scale": scale})
    over = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(e, F.col("_scale"))))
    return rows.withColumns({"audio_active": F.coalesce(e >= F.col("_low"), F.lit(False)), "audio_energy": F.when(F.col("_scale").isNull() | e.isNull(), 0.0).otherwise(over)}).drop("_low", "_scale")


def loudness(audio: DataFrame, *, fps: float = 25.0, key: tuple[str, ...] = KEY) -> DataFrame:
    """(key, frame_idx, energy): root mean square of the samples that go with each frame, channels being averaged first.

    `audio` has samples (array, channels interleaved), rate, channels and frames, how many the clip has. Frames past the last sample have 0;
    digital silence has a little more, so that it counts as sound.
    """
    per = F.greatest(F.lit(1), F.floor(F.col("rate") / fps).cast("int")) * F.col("channels")
    rows = audio.withColumns({"_per": per, "frame_idx": F.explode(F.sequence(F.lit(0), F.col("frames") - 1))})
    part = F.slice("samples", F.col("frame_idx") * F.col("_per") + 1, F.col("_per"))

    def rms(x: Column) -> Column:
        n = F.ceil(F.size(x) / F.col("channels")).cast("int")
        one = lambda i: F.aggregate(F.slice(x, i * F.col("channels") + 1, F.col("channels")), F.lit(0.0), lambda s, v: s + v) / F.col("channels")
        total = F.when(F.col("channels") == 1, F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v)).otherwise(F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), one), F.lit(0.0), lambda s, v: s + v * v))
        return F.when(F.size(x) > 0, F.sqrt(total / n + 1e-8)).otherwise(0.0)

    return rows.select(*key, "frame_idx", let(part, rms).alias("energy"))


def heard(audio: DataFrame, *, fps: float = 25.0, quantile: float = 0.55, key: tuple[str, ...] = KEY) -> DataFrame:
    """(key, frame_idx, audio_active, audio_energy) of the frames of clips of sound; where sample_bytes isn't 2, all is active at 1."""
    known = audio_activity(loudness(audio.filter("sample_bytes = 2"), fps=fps, key=key), key=key, quantile=quantile).drop("energy")
    other = audio.filter("sample_bytes <> 2").select(*key, F.explode(F.sequence(F.lit(0), F.col("frames") - 1)).alias("frame_idx"), F.lit(True).alias("audio_active"), F.lit(1.0).alias("audio_energy"))
    return known.unionByName(other)


def with_audio(frames: DataFrame, sound: DataFrame, *, key: tuple[str, ...] = KEY, index: str = "frame_idx") -> DataFrame:
    """Frames with audio_active and audio_energy of the sound at the same place; silent where there is none."""
    out = frames.join(sound.select(*key, F.col("frame_idx").alias(index), "audio_active", "audio_energy"), [*key, index], "left")
    return out.withColumns({"audio_active": F.coalesce("audio_active", F.lit(False)), "audio_energy": F.coalesce("audio_energy", F.lit(0.0))})


def sampled(frames: DataFrame, columns: list[str], *, stride: int = 5, key: tuple[str, ...] = KEY, index: str = "frame_idx") -> DataFrame:
    """The frames with `columns` as they are at the last frame whose index is a multiple of the stride; one window, no join."""
    w = Window.partitionBy(*key, F.floor(F.col(index) / max(1, stride))).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    on = F.col(index) % max(1, stride) == 0
    return frames.withColumns({c: F.first(F.when(on, F.col(c)), ignorenulls=True).over(w) for c in columns})


def _norm(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def geometry(points: Column, width: Column, height: Column) -> Column:
    """(x, y, w, h) of the mouth relative to the frame; null unless every point is finite and inside and the mouth is at least 8 by 3.

    `points` is an array of (x, y) in pixels.
    """
    xs, ys = F.transform(points, lambda p: p["x"].cast("double")), F.transform(points, lambda p: p["y"].cast("double"))
    finite = F.forall(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"].cast("double")) & ~F.isnan(p["y"].cast("double")))
    lx, hx, ly, hy = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    ok = finite & (F.size(points) > 0) & (lx >= 0) & (ly >= 0) & (hx < width) & (hy < height) & (hx - lx >= 8) & (hy - ly >= 3)
    w, h = F.greatest(width, F.lit(1)), F.greatest(height, F.lit(1))
    return F.when(ok, F.array(mean(xs) / w, mean(ys) / h, (hx - lx) / w, (hy - ly) / h))


def shape(points: Column) -> Column:
    """The points about their centre, over the mouth's width (at least 1)."""
    xs, ys = F.transform(points, lambda p: p["x"].cast("double")), F.transform(points, lambda p: p["y"].cast("double"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    width = F.greatest(F.array_max(xs) - F.array_min(xs), F.lit(1.0))
    return F.transform(points, lambda p: F.struct(((p["x"] - mean(xs)) / width).alias("x"), ((p["y"] - mean(ys)) / width).alias("y")))


def opening(upper: Column, lower: Column, points: Column) -> Column:
    """Distance in height of the inner lips' points, over the mouth's width (at least 1)."""
    xs = F.transform(points, lambda p: p["x"].cast("double"))
    return F.abs(lower["y"] - upper["y"]) / F.greatest(F.array_max(xs) - F.array_min(xs), F.lit(1.0))


def shape_motion(a: Column, b: Column) -> Column:
    """Mean distance of the points of two shapes."""
    d = F.zip_with(a, b, lambda p, q: F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(d)


def motion(frames: DataFrame, cfg: Visual | None = None, *, key: tuple[str, ...] = KEY, index: str = "frame_idx") -> DataFrame:
    """Motion columns from one sampled frame to the next, carried over the frames between.

    `frames` has geometry (array of 4, null if unusable), shape, opening, gray (arrays or null) and roi_ok. mouth_motion (mean absolute
    difference of gray over 255), mouth_shape_motion and mouth_opening_motion are 0 unless this sampled frame and the one before both have
    a region; unstable is a geometry jump above the bound, and looks back past a frame whose region was empty.
    """
    cfg = cfg or Visual()
    n = max(1, cfg.sample_every_n_frames)
    w = Window.partitionBy(*key).orderBy(index)
    s = frames.filter(F.col(index) % n == 0)
    ok = F.col("geometry").isNotNull() & F.coalesce("roi_ok", F.lit(True))
    s = s.withColumns({"_ok": ok}).withColumns({"_pok": F.coalesce(F.lag("_ok").over(w), F.lit(False)), **{f"_p{c}": F.lag(c).over(w) for c in ("geometry", "shape", "opening", "gray")}})
    both = F.col("_ok") & F.col("_pok")
    mad = F.aggregate(F.zip_with("gray", "_pgray", lambda a, b: F.abs(a.cast("double") - b)), F.lit(0.0), lambda t, x: t + x) / F.size("gray") / 255.0
    s = s.select(
        *key,
        F.col(index).alias("_at"),
        F.col("_ok").alias("visible"),
        F.when(both, mad).otherwise(0.0).alias("mouth_motion"),
        F.when(both, shape_motion(F.col("shape"), F.col("_pshape"))).otherwise(0.0).alias("mouth_shape_motion"),
        F.when(both, F.abs(F.col("opening") - F.col("_popening"))).otherwise(0.0).alias("mouth_opening_motion"),
        F.coalesce(_norm(F.col("geometry"), F.col("_pgeometry")) > cfg.landmark_jump_threshold, F.lit(False)).alias("unstable"),
    )
    return frames.withColumn("_at", F.col(index) - F.col(index) % n).join(s, [*key, "_at"], "left").drop("_at")


def histogram_distance(a: Column, b: Column) -> Column:
    """Bhattacharyya's distance of two histograms, as arrays; null if either is null or empty of counts."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda s, x: s + x)
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.sqrt(x.cast("double") * y)), F.lit(0.0), lambda s, x: s + x)
    same = F.try_divide(both, F.sqrt(total(a) * total(b)))
    return F.when(same.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), 1 - same)))


def scene_cuts(frames: DataFrame, *, threshold: float = 0.58, key: tuple[str, ...] = KEY, index: str = "frame_idx", histogram: str = "histogram") -> DataFrame:
    """Adds `cut`: the histogram is far from the frame before; false for the first."""
    w = Window.partitionBy(*key).orderBy(index)
    far = histogram_distance(F.lag(histogram).over(w), F.col(histogram)) >= threshold
    return frames.withColumn("cut", F.coalesce(far, F.lit(False)))


def longest_missing(frames: DataFrame, *, key: tuple[str, ...] = KEY, index: str = "frame_idx", flag: str = "visible") -> DataFrame:
    """(key, longest): frames of the longest run in which the flag is false or null."""
    w = Window.partitionBy(*key).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    on = F.coalesce(F.col(flag), F.lit(False))
    runs = frames.select(*key, on.alias("_on"), F.sum(on.cast("int")).over(w).alias("_run"))
    return runs.groupBy(*key, "_run").agg(F.count_if(~F.col("_on")).alias("n")).groupBy(*key).agg(F.max("n").alias("longest"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r over the rows where both are given; 0 with less than 3 rows or next to no spread."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    sx, sy = F.stddev_pop(a), F.stddev_pop(b)
    spread = (F.count(a) >= 3) & (sx > 1e-6) & (sy > 1e-6)
    return F.when(spread, F.try_divide(F.covar_pop(a, b), sx * sy)).otherwise(0.0)


def ratio(part: Column, of: Column, none: float) -> Column:
    """Share of rows with `of` that have `part` too; `none` where no row has `of`."""
    return F.coalesce(F.try_divide(F.count_if(part & of).cast("double"), F.count_if(of)), F.lit(none))


def metrics(frames: DataFrame, cfg: Visual | None = None, *, fps: float = 25.0, key: tuple[str, ...] = KEY, index: str = "frame_idx") -> DataFrame:
    """The eight metrics of each clip of frames with visible, cut, unstable, the motions, audio_active and audio_energy; not rounded.

    The missing run's window and the aggregation go by the clip, so that one shuffle does for both.
    """
    cfg = cfg or Visual()
    w = Window.partitionBy(*key).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    visible = flag("visible")
    rows = frames.withColumn("_run", F.sum(visible.cast("int")).over(w))
    wr = Window.partitionBy(*key, "_run")
    rows = rows.withColumn("_missing", F.count_if(~visible).over(wr))
    speech = flag("audio_active") & visible
    still = F.col("mouth_motion") < cfg.mouth_motion_floor
    moves = (F.col("mouth_shape_motion") >= cfg.mouth_shape_motion_floor) | (F.col("mouth_opening_motion") >= cfg.mouth_opening_motion_floor)
    heard = visible & (F.col("audio_energy") > 0)
    at = lambda c: F.when(heard, F.col(c).cast("double"))
    return rows.groupBy(*key).agg(
        F.avg(visible.cast("int")).alias("mouth_visible_ratio"),
        F.avg(flag("cut").cast("int")).alias("scene_cut_ratio"),
        ratio(still, speech, 1.0).alias("static_speech_ratio"),
        ratio(moves, speech, 0.0).alias("speech_mouth_motion_ratio"),
        correlation(at("audio_energy"), at("mouth_shape_motion")).alias("lip_sync_correlation"),
        correlation(at("audio_energy"), at("mouth_opening_motion")).alias("mouth_opening_correlation"),
        (F.max("_missing") / fps).alias("max_missing_run_seconds"),
        ratio(flag("unstable"), visible, 1.0).alias("unstable_landmark_ratio"),
    )


def sharpness(pixels: Column, width: int) -> Column:
    """Variance of the Laplacian of a gray picture, given as rows in one array; the border is mirrored without its edge."""
    up = lambda v, n: F.when(v < 0, -v).when(v >= n, 2 * n - 2 - v).otherwise(v)

    def laplacian(p: Column) -> Column:
        h = F.floor(F.size(p) / width)
        at = lambda r, c: F.get(p, (r * width + c).cast("int"))

        def place(i: Column) -> Column:
            r, c = F.floor(i / width), i % width
            return at(up(r - 1, h), c) + at(up(r + 1, h), c) + at(r, up(c - 1, F.lit(width))) + at(r, up(c + 1, F.lit(width))) - 4 * at(r, c)

        return F.transform(F.sequence(F.lit(0), F.size(p) - 1), place)

    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    spread = lambda a: let(total(a) / F.size(a), lambda m: F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a))
    return let(F.transform(pixels, lambda x: x.cast("double")), lambda p: let(laplacian(p), spread))


def clip_sharpness(frames: DataFrame, pixels: str, width: int, *, key: tuple[str, ...] = KEY) -> DataFrame:
    """(key, sharpness): mean over a clip's frames, to three places; 0 where none has a picture."""
    return frames.groupBy(*key).agg(F.round(F.coalesce(F.avg(sharpness(F.col(pixels), width)), F.lit(0.0)), 3).alias("sharpness"))


def landmark_slice(segments: DataFrame, landmarks: DataFrame, *, fps: float = 25.0) -> DataFrame:
    """(item_id, segment_id, frame_idx, points): each clip's landmarks out of its video's, from frame round(start * fps) on, null past the end.

    `segments` has item_id, segment_id, start and frames (how many the clip has).
    """
    spine = segments.select("item_id", "segment_id", F.rint(F.col("start") * fps).cast("bigint").alias("_o"), F.explode(F.sequence(F.lit(0), F.col("frames") - 1)).alias("frame_idx"))
    spine = spine.withColumn("_at", F.col("_o") + F.col("frame_idx"))
    marks = landmarks.select("item_id", F.col("frame_idx").cast("bigint").alias("_at"), "points")
    return spine.join(marks, ["item_id", "_at"], "left").select("item_id", "segment_id", "frame_idx", "points")
