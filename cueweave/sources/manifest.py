"""Clip records, manifests of them, and what of them is shared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import slug

VISUAL = "status string, mouth_visible_ratio double, scene_cut_ratio double, static_speech_ratio double, speech_mouth_motion_ratio double, lip_sync_correlation double, mouth_opening_correlation double, max_missing_run_seconds double, unstable_landmark_ratio double, reasons array<string>"
_TEXT = "item_id segment_id video_path active_speaker_path mouth_path audio_path text".split()
_TYPES = {c: "string" for c in _TEXT} | {c: "double" for c in ("start", "end", "duration")} | {c: "string" for c in ("source_url", "title", "channel", "transcript_source")} | {c: "double" for c in ("asr_confidence", "active_speaker_score", "face_coverage", "sharpness")} | {"source_profile": "string", "quality_status": "string", "accepted": "boolean"}
RECORD = ", ".join(f"`{c}` {k}" for c, k in _TYPES.items()) + f", visual_quality struct<{VISUAL.replace(', ', ',').replace(' ', ':')}>, talknet struct<status:string,speaking_ratio:double,reason:string>"
_PLAIN = [c for c in _TYPES if c != "accepted"]
_VISUAL = [c.split()[0] for c in VISUAL.split(", ")][1:-1]
STATUSES = ("accepted", "review", "rejected")


def read_records(spark: SparkSession, glob: str, *, strict: bool = True, lines: bool = False) -> DataFrame:
    """Records of JSON files, one each or one a line; one that can't be read is an error, or is left out if not strict."""
    read = spark.read.schema(RECORD).option("multiLine", not lines)
    if strict:
        return read.option("mode", "FAILFAST").json(glob)
    return read.option("mode", "DROPMALFORMED").json(glob).filter("item_id is not null")


def flat(records: DataFrame) -> DataFrame:
    """The manifest's 33 columns: nested ones by name, reasons joined by a bar; what is missing is null."""
    have = {f.name: f.dataType for f in records.schema.fields}

    def inner(struct: str, name: str, kind: str) -> Column:
        if struct in have and isinstance(have[struct], T.StructType) and name in have[struct].fieldNames():
            return F.col(f"{struct}.{name}")
        return F.lit(None).cast(kind)

    plain = lambda c: F.col(c) if c in have else F.lit(None).cast(_TYPES[c])
    reasons = inner("visual_quality", "reasons", "array<string>")
    return records.select(
        *[plain(c).alias(c) for c in _PLAIN],
        inner("talknet", "status", "string").alias("talknet_status"),
        inner("talknet", "speaking_ratio", "double").alias("talknet_speaking_ratio"),
        inner("talknet", "reason", "string").alias("talknet_reason"),
        *[inner("visual_quality", c, "double").alias(c) for c in _VISUAL],
        F.concat_ws("|", F.coalesce(reasons, F.array().cast("array<string>"))).alias("visual_quality_reasons"),
        plain("accepted").alias("accepted"),
    )


def split(rows: DataFrame) -> dict[str, DataFrame]:
    """The rows as all, accepted, review and rejected; those without a status are in all alone."""
    return {"all": rows} | {s: rows.filter(F.col("quality_status") == s) for s in STATUSES}


def _csv(rows: DataFrame) -> DataFrame:
    """Booleans as True and False, as readers of the manifests expect."""
    return rows.withColumns({f.name: F.initcap(F.col(f.name).cast("string")) for f in rows.schema.fields if isinstance(f.dataType, T.BooleanType)})


def publish(records: DataFrame, folder: str) -> None:
    """Writes all as JSON lines and the four CSVs, each a folder, ordered by item and segment; what was there is replaced."""
    ordered = records.repartitionByRange("item_id", "segment_id").sortWithinPartitions("item_id", "segment_id").persist()
    try:
        ordered.write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/all.jsonl")
        for name, rows in split(flat(ordered)).items():
            _csv(rows).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").option("lineSep", "\r\n").csv(f"{folder}/{name}.csv")
    finally:
        ordered.unpersist()


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A manifest's rows, all columns as text."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def write_json(rows: DataFrame, folder: str, *, by: list[str] | None = None) -> None:
    """Writes rows as JSON, nulls and all; with `by`, those of each value in files of its own."""
    out = rows.repartition(*by) if by else rows
    writer = out.write.mode("overwrite").option("ignoreNullFields", False)
    (writer.partitionBy(*by) if by else writer).json(folder)


def write_text(rows: DataFrame, column: str, folder: str) -> None:
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(folder)


def head(rows: DataFrame, n: int) -> DataFrame:
    """(verdict, item_id, segment_id, start, end, text) of the first n by item and segment; anything not accepted is a REJECT."""
    ok = F.lower(F.col("accepted").cast("string")) == "true"
    return rows.orderBy("item_id", "segment_id").limit(n).select(F.when(ok, "ACCEPT").otherwise("REJECT").alias("verdict"), "item_id", "segment_id", "start", "end", F.substring("text", 1, 70).alias("text"))


FILES = ("metadata.json", "transcript.txt", "source.mp4", "audio.wav", "active_speaker.mp4", "mouth.mp4")


def selection(records: DataFrame, statuses: list[str], *, source: bool = False, audio: bool = False) -> DataFrame:
    """(path) of what is shared: the manifests and the chosen clips' folders without what is left out; an error if no status is valid."""
    good = [s for s in statuses if s in STATUSES]
    if not good:
        raise ValueError(f"statuses must be of {STATUSES}")
    out = ["active_speaker.mp4", *([] if source else ["source.mp4"]), *([] if audio else ["audio.wav"])]
    names = [f for f in FILES if f not in out]
    clips = records.filter(F.col("quality_status").isin(*good)).withColumn("_f", F.explode(F.array(*map(F.lit, names)))).select(F.concat_ws("/", F.lit("clips"), "item_id", "segment_id", "_f").alias("path"))
    return records.sparkSession.createDataFrame([("manifests/**",)], "path string").unionByName(clips)


def push(records: DataFrame, root: str, contributor: str, statuses: list[str]) -> None:
    """Appends the chosen records under the contributor's folder of a shared table; an error if there is none."""
    good = [s for s in statuses if s in STATUSES]
    rows = records.filter(F.col("quality_status").isin(*good)) if good else None
    if rows is None or rows.isEmpty():
        raise ValueError(f"nothing of status {statuses} to push")
    rows.withColumn("contributor", slug(F.lit(contributor))).write.mode("append").partitionBy("contributor").parquet(root)


def pull(spark: SparkSession, root: str, contributor: str | None = None) -> DataFrame:
    """The shared table, or one contributor's part of it, of which alone the folder is read."""
    rows = spark.read.parquet(root)
    return rows if contributor is None else rows.filter(F.col("contributor") == slug(F.lit(contributor)))  # a constant by the time the folders are listed
