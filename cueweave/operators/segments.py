"""Words to segments of bounded length that hold no scene cut: two folds over each item's words, all within the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Segmentation
from ..functions.text import drop_repeated_sentences, normalize


def gathered(words: DataFrame, cuts: DataFrame | None, *, item: str, order: list[str]) -> DataFrame:
    """(item, ws, cuts): each item's words in order, and its cuts, sorted and distinct."""
    opt = lambda c, t: F.col(c) if c in words.columns else F.lit(None).cast(t)
    one = F.struct(
        F.array(*[F.col(c).cast("bigint") for c in order]).alias("o"),
        F.col("word"),
        F.col("start").cast("double").alias("start"),
        F.col("end").cast("double").alias("end"),
        opt("probability", "double").cast("double").alias("probability"),
        opt("timing_source", "string").alias("timing_source"),
        opt("segment_confidence", "double").cast("double").alias("segment_confidence"),
        opt("transcript_source", "string").alias("transcript_source"),
    )
    ws = words.groupBy(item).agg(F.array_sort(F.collect_list(one)).alias("ws"))
    none = F.array().cast("array<double>")
    if cuts is None:
        return ws.withColumn("cuts", none)
    at = cuts.filter(F.col("time").isNotNull()).groupBy(item).agg(F.array_sort(F.collect_set(F.col("time").cast("double"))).alias("cuts"))
    return ws.join(at, item, "left").withColumn("cuts", F.coalesce("cuts", none))


def _groups(cfg: Segmentation, strict: bool) -> str:
    """SQL of the first fold: the places where a new group begins.

    Carried along: the word's place, the group's start, the end of the word before and whether that ended a sentence.
    """
    cut = "exists(cuts, c -> a.e <= c and c <= w.end)" if cfg.split_on_scene_cut else "false"
    long_enough = f"a.e - a.g >= {cfg.min_duration}D"
    close = f"""a.n = 0 or {cut} or w.end - a.g > {cfg.max_duration}D or ({str(strict).lower()} and a.s)
        or ((a.s or w.start - a.e > {cfg.max_gap_seconds}D) and {long_enough})"""
    return f"""aggregate(ws, named_struct('n', 0, 'g', 0D, 'e', 0D, 's', false, 'b', cast(array() as array<int>)),
      (a, w) -> transform(array({close}), x -> named_struct('n', a.n + 1, 'g', if(x, w.start, a.g), 'e', w.end,
        's', coalesce(w.word rlike '[.!?]$', false), 'b', if(x, concat(a.b, array(a.n)), a.b)))[0], a -> a.b)"""


def _merged(cfg: Segmentation, strict: bool) -> str:
    """SQL of the second fold: short groups join the one before where the whole is not too long and no cut lies between."""
    cut = "exists(cuts, c -> ws[m[size(m) - 1].z].end <= c and c <= ws[g.a].start)" if cfg.split_on_scene_cut else "false"
    join = f"""size(m) > 0 and (ws[g.z].end - ws[g.a].start < {cfg.min_duration}D or g.z - g.a + 1 < {cfg.min_words})
        and ws[g.z].end - ws[m[size(m) - 1].a].start <= {cfg.max_duration}D and not {cut}"""
    if strict:
        return "gs"
    return f"""aggregate(gs, cast(array() as array<struct<a:int,z:int>>), (m, g) -> if({join},
      concat(slice(m, 1, size(m) - 1), array(named_struct('a', m[size(m) - 1].a, 'z', g.z))), concat(m, array(g))))"""


def make(words: DataFrame, cuts: DataFrame | None = None, cfg: Segmentation | None = None, *, strict: bool = False, item: str = "item_id", order: tuple[str, ...] = ("cue", "position")) -> DataFrame:
    """(item, segment_id, start, end, duration, text, word_count, asr_confidence) of each segment, and transcript_source if the words have it.

    Words are taken in their order and never sorted by time. A group closes before a word if a cut lies between the word before and the
    word's end, if the word would make it too long, or if it is long enough and a sentence ended or the gap is wide (strict: wherever a
    sentence ended). Short groups then join the one before, unless strict. Segments are padded, the padding stops at cuts, and those too
    short, too long or of too few words are left out; their ids stay unused.

    One shuffle, by item; an item's words are one row.
    """
    cfg = cfg or Segmentation()
    rows = gathered(words, cuts, item=item, order=list(order)).withColumn("bs", F.expr(_groups(cfg, strict)))
    rows = rows.withColumn("gs", F.expr("transform(bs, (b, i) -> named_struct('a', b, 'z', if(i + 1 < size(bs), bs[i + 1], size(ws)) - 1))"))
    rows = rows.withColumn("ms", F.expr(_merged(cfg, strict)))
    rows = rows.select(item, "cuts", F.posexplode(F.expr("transform(ms, m -> slice(ws, m.a + 1, m.z - m.a + 1))")).alias("i", "g"))
    rows = rows.filter(F.size("g") >= cfg.min_words)
    first, last = F.expr("g[0].start"), F.expr("g[size(g) - 1].end")
    pad = F.when(F.expr("exists(g, w -> w.timing_source = 'subtitle')"), max(cfg.pad_seconds, cfg.subtitle_end_pad_seconds)).otherwise(cfg.pad_seconds)
    rows = rows.withColumns({"_a": first, "_z": last, "_pad": pad})
    start = F.greatest(F.lit(0.0), F.col("_a") - cfg.pad_seconds, F.expr("array_max(filter(cuts, c -> c <= _a))"))
    end = F.least(F.col("_z") + F.col("_pad"), F.expr("array_min(filter(cuts, c -> c >= _z))"))
    rows = rows.withColumns({"_s": start, "_e": end}).withColumn("_d", F.col("_e") - F.col("_s"))
    rows = rows.filter((F.col("_d") >= cfg.min_duration) & (F.col("_d") <= cfg.max_duration + cfg.pad_seconds + F.col("_pad")))
    trust = F.expr("aggregate(g, 0D, (s, w) -> s + least(coalesce(w.probability, 0D), coalesce(w.segment_confidence, 1D))) / size(g)")
    text = drop_repeated_sentences(normalize(F.expr("array_join(transform(g, w -> w.word), ' ')")))
    source = [F.expr("g[0].transcript_source").alias("transcript_source")] if "transcript_source" in words.columns else []
    return rows.select(
        item,
        F.format_string("%06d", "i").alias("segment_id"),
        F.round("_s", 3).alias("start"),
        F.round("_e", 3).alias("end"),
        F.round("_d", 3).alias("duration"),
        text.alias("text"),
        F.size("g").alias("word_count"),
        F.round(trust, 5).alias("asr_confidence"),
        *source,
    )


def cut_intro(segments: DataFrame, seconds: float = 15.0, *, item: str = "item_id") -> DataFrame:
    """Segments from `seconds` on, numbered anew without gaps."""
    w = Window.partitionBy(item).orderBy("segment_id")
    kept = segments.filter(F.col("start") >= seconds)
    return kept.withColumn("segment_id", F.format_string("%06d", F.row_number().over(w) - 1))


def scene_times(log: Column) -> Column:
    """The times of a scene filter's log, to the millisecond, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(log, F.lit(r"pts_time:([0-9.]+)"), F.lit(1)), lambda t: F.round(t.cast("double"), 3))))
