"""Face boxes to tracks to the one who speaks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Speaker


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2), the union being 1 at least."""
    side = lambda lo, hi: F.greatest(F.lit(0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    inter = side("x1", "x2") * side("y1", "y2")
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    return inter / F.greatest(F.lit(1), area(a) + area(b) - inter)


def boxes(found: Column, width: Column, height: Column, *, analysis_width: int = 480) -> Column:
    """Relative detections (x, y, w, h) to whole pixels of the full frame: cut off at its edges, empty ones dropped.

    Worked out on a frame no wider than `analysis_width`, as detectors see it, and scaled back.
    """
    scale = F.when(width <= analysis_width, F.lit(1.0)).otherwise(analysis_width / width)
    w = F.least(width, F.lit(analysis_width)).cast("int")
    h = (height * scale).cast("int")
    one = lambda d: F.struct(
        F.greatest(F.lit(0), (d["x"] * w).cast("int")).alias("x1"),
        F.greatest(F.lit(0), (d["y"] * h).cast("int")).alias("y1"),
        F.least(w, ((d["x"] + d["w"]) * w).cast("int")).alias("x2"),
        F.least(h, ((d["y"] + d["h"]) * h).cast("int")).alias("y2"),
    )
    kept = F.filter(F.transform(found, one), lambda b: (b["x2"] > b["x1"]) & (b["y2"] > b["y1"]))
    up = lambda v: (v * (1.0 / scale)).cast("int")
    return F.transform(kept, lambda b: F.struct(up(b["x1"]).alias("x1"), up(b["y1"]).alias("y1"), up(b["x2"]).alias("x2"), up(b["y2"]).alias("y2")))


def follow(frames: list[tuple[int, list[tuple[int, int, int, int]]]], threshold: float) -> list[list[tuple[int, int]]]:
    """Tracks, as lists of (frame index, box number). In the order they began, each takes the free box that overlaps its last one most, if by the threshold; of equals, the later box. The boxes left over begin tracks, which never end."""

    def area(box: tuple) -> int:
        left, top, right, bottom = box
        return (right - left) * (bottom - top)

    def overlap(p: tuple, q: tuple) -> float:
        corner, far = [max(u, v) for u, v in zip(p[:2], q[:2])], [min(u, v) for u, v in zip(p[2:], q[2:])]
        common = area((*corner, *far)) if all(lo < hi for lo, hi in zip(corner, far)) else 0
        return common / max(1, area(p) + area(q) - common)

    tracks: list[list[tuple[int, int]]] = []
    last: list[tuple] = []
    for at, found in frames:
        free = dict(enumerate(found))
        for t, where in enumerate(last):
            if free:
                best = max(free, key=lambda i: (overlap(where, free[i]), i))
                if overlap(where, free[best]) >= threshold:
                    last[t] = free.pop(best)
                    tracks[t].append((at, best))
        for i, box in free.items():
            tracks.append([(at, i)])
            last.append(box)
    return tracks


def tracked(frames: DataFrame, cfg: Speaker | None = None, *, clip: str = "clip") -> DataFrame:
    """(clip, track, frame_idx, box): boxes of sampled frames (clip, frame_idx, boxes) put into tracks; at most `max_faces` a frame, in their order.

    The tracks of a clip depend on one another from frame to frame, so a clip is one task's work; clips are spread over tasks and read one
    after the other, and only one is held at a time.
    """
    cfg = cfg or Speaker()
    threshold = cfg.track_iou_threshold
    src = frames.filter(F.col("frame_idx") % max(1, cfg.sample_every_n_frames) == 0)
    src = src.select(F.col(clip).alias("clip"), F.col("frame_idx").cast("bigint").alias("frame_idx"), F.slice(F.transform("boxes", lambda b: F.array(b["x1"], b["y1"], b["x2"], b["y2"])), 1, cfg.max_faces).alias("boxes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        name = None

        def give() -> pd.DataFrame:
            by = {i: b for i, b in held}
            rows = [(name, t, at, *by[at][box]) for t, track in enumerate(follow(held, threshold)) for at, box in track]
            return pd.DataFrame(rows, columns=["clip", "track", "frame_idx", "x1", "y1", "x2", "y2"])

        for pdf in batches:
            for c, at, found in zip(pdf["clip"], pdf["frame_idx"], pdf["boxes"]):
                if c != name and held:
                    yield give()
                    held = []
                name = c
                held.append((int(at), [tuple(int(v) for v in b) for b in (found if found is not None else [])]))
        if held:
            yield give()

    kind = src.schema["clip"].dataType.simpleString()
    out = src.repartition("clip").sortWithinPartitions("clip", "frame_idx").mapInPandas(run, f"clip {kind}, track int, frame_idx bigint, x1 int, y1 int, x2 int, y2 int")
    return out.select(F.col("clip").alias(clip), "track", "frame_idx", F.struct("x1", "y1", "x2", "y2").alias("box"))


def track_scores(tracks: DataFrame, sampled: DataFrame, cfg: Speaker | None = None, *, clip: str = "clip") -> DataFrame:
    """(clip, track, score, coverage): mean motion of a track's boxes (column motion, null for its first) times its coverage over the least one.

    `sampled` has clip and frames, how many were sampled.
    """
    cfg = cfg or Speaker()
    per = tracks.groupBy(clip, "track").agg(F.avg("motion").alias("_m"), F.count("*").alias("_n")).join(sampled, clip)
    coverage = F.col("_n") / F.col("frames")
    score = F.coalesce("_m", F.lit(0.0)) * F.least(F.lit(1.0), coverage / max(cfg.min_track_coverage, 1e-6))
    return per.select(clip, "track", score.alias("score"), coverage.alias("coverage"))


def best_track(scores: DataFrame, *, clip: str = "clip") -> DataFrame:
    """The track of each clip with the highest score, then coverage, then lowest number; rounded."""
    w = Window.partitionBy(clip).orderBy(F.desc("score"), F.desc("coverage"), "track")
    top = scores.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    return top.select(clip, "track", F.round("score", 5).alias("score"), F.round("coverage", 5).alias("coverage"))


def single_face(frames: DataFrame, *, clip: str = "clip") -> DataFrame:
    """(clip, single): some frame was looked at and none has more than one box."""
    n = F.size(F.coalesce("boxes", F.array().cast(frames.schema["boxes"].dataType)))
    return frames.groupBy(clip).agg((F.max(n) <= 1).alias("single"))


def carried_box(frames: DataFrame, *, clip: str = "clip", pad: float = 0.18) -> DataFrame:
    """Adds `window`: the last known `box` up to each frame, wider by `pad` of its size and cut off at the frame (width, height)."""
    w = Window.partitionBy(clip).orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = frames.withColumn("_b", F.last("box", ignorenulls=True).over(w))
    px, py = ((F.col("_b.x2") - F.col("_b.x1")) * pad).cast("int"), ((F.col("_b.y2") - F.col("_b.y1")) * pad).cast("int")
    box = F.struct(
        F.greatest(F.lit(0), F.col("_b.x1") - px).alias("x1"), F.greatest(F.lit(0), F.col("_b.y1") - py).alias("y1"), F.least(F.col("width"), F.col("_b.x2") + px).alias("x2"), F.least(F.col("height"), F.col("_b.y2") + py).alias("y2")
    )
    return rows.withColumn("window", F.when(F.col("_b").isNotNull(), box)).drop("_b")
