"""Media kernels: what turns pixels and sound into rows. Each is registered by name and runs over Arrow batches of paths; results carry errors as rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kernel names and the type of their result; none is built in, as they need media libraries.
KINDS = {
    "transcribe": "struct<language:string,language_probability:double,segments:array<struct<start:double,end:double,avg_logprob:double,no_speech_probability:double,words:array<struct<word:string,start:double,end:double,probability:double>>>>>",
    "scene_log": "string",
    "frames": "array<struct<frame_idx:int,width:int,height:int,histogram:array<float>,points:array<struct<x:double,y:double>>,opening:double,gray:array<int>,roi_ok:boolean,energy:double>>",
    "faces": "array<struct<frame_idx:int,boxes:array<struct<x:double,y:double,w:double,h:double>>>>",
    "landmarks": "array<struct<frame_idx:int,points:array<struct<x:double,y:double>>>>",
    "speaker_scores": "array<double>",
    "normalize": "string",
    "extract_clip": "string",
    "crop": "struct<path:string,sharpness:double,face_found:boolean>",
    "fetch": "array<struct<item_id:string,path:string,source_url:string,title:string,channel:string,subtitle_path:string,subtitle_automatic:boolean>>",
    "fetch_text": "string",
    "mask_speaker": "string",
}

_kernels: dict[str, Callable[[], Callable[[dict[str, Any]], Any]]] = {}


def register(name: str, factory: Callable[[], Callable[[dict[str, Any]], Any]]) -> None:
    """`factory` is called once a task and gives the function of a row; it is where a model is loaded."""
    if name not in KINDS:
        raise ValueError(f"no such kernel: {name}")
    _kernels[name] = factory


def run(rows: DataFrame, name: str, *, keys: list[str], inputs: list[str]) -> DataFrame:
    """(keys, ok, error, result): the kernel's result for each row, or what went wrong; a row never fails the job."""
    if name not in _kernels:
        raise LookupError(f"kernel {name} is not registered")
    factory = _kernels[name]
    spark = rows.sparkSession
    src = rows.select(*keys, F.to_json(F.struct(*inputs)).alias("_in"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kernel = factory()
        for pdf in batches:
            out = []
            for text in pdf["_in"]:
                try:
                    out.append((True, None, json.dumps(kernel(json.loads(text)))))
                except Exception as e:  # the row says so
                    out.append((False, f"{type(e).__name__}: {e}"[:2000], None))
            pdf = pdf.drop(columns="_in")
            yield pdf.assign(ok=[o[0] for o in out], error=[o[1] for o in out], _out=[o[2] for o in out])

    kept = ", ".join(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keys)
    made = src.mapInPandas(work, f"{kept}, ok boolean, error string, _out string")
    kind = KINDS[name]
    parsed = F.from_json(F.concat(F.lit('{"v":'), F.col("_out"), F.lit("}")), f"struct<v:{kind}>")["v"]
    assert spark is made.sparkSession
    return made.select(*keys, "ok", "error", parsed.alias("result"))


def first_success(*tries: Column) -> Column:
    """Of several tries at (ok, error, result) the first that is ok, else the last with all errors joined."""
    good = F.coalesce(*[F.when(t["ok"], t) for t in tries])
    errors = F.concat_ws(" | ", *[t["error"] for t in tries])
    return F.coalesce(good, F.struct(F.lit(False).alias("ok"), errors.alias("error"), tries[-1]["result"].alias("result")))


def selectors(*names: str) -> list[str]:
    """The names in order, each once."""
    return list(dict.fromkeys(names))


def flatten_scores(value: Any) -> list[float]:
    """All numbers of nested lists, tuples and dicts, depth first; booleans count as 0 and 1."""
    out: list[float] = []
    stack: list[Iterator[Any]] = [iter((value,))]
    while stack:
        for v in stack[-1]:
            if isinstance(v, dict):
                stack.append(iter(v.values()))
                break
            if isinstance(v, (bool, int, float)):
                out.append(float(v))
            elif hasattr(v, "tolist"):
                stack.append(iter((v.tolist(),)))
                break
            elif isinstance(v, Iterable) and not isinstance(v, (str, bytes)):
                stack.append(iter(v))
                break
        else:
            stack.pop()
    return out


def landmarks_or_null(detect: Callable[[list[Any]], list[Any]], frames: list[Any]) -> list[Any]:
    """What the detector finds; nulls if it says that no frame has any; its other failures stand."""
    try:
        return detect(frames)
    except AssertionError as e:
        if "Cannot detect any frames" not in str(e):
            raise
        return [None] * len(frames)


def fetched(results: DataFrame) -> DataFrame:
    """(url, item_id, path, ...) of what a fetch (url, ok, result) brought: an entry of a playlist is an item, null entries are none.

    What is kept of an item stands as source.<its extension> in its folder.
    """
    one = results.filter("ok").select("url", F.explode(F.filter("result", lambda e: e.isNotNull())).alias("e")).select("url", "e.*")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return one.withColumn("stored", F.concat_ws("/", F.lit("raw"), "item_id", F.concat(F.lit("source."), ext)))


def clip_jobs(segments: DataFrame, sources: DataFrame, folder: str) -> DataFrame:
    """What extract_clip is given for each segment: source, from when and for how long (0.01 s at least), and the files to write.

    `sources` has item_id and normalized, the path of its normalized video.
    """
    at = lambda name: F.concat_ws("/", F.lit(folder), "item_id", "segment_id", F.lit(name))
    length = F.greatest(F.lit(0.01), F.col("end") - F.col("start"))
    rows = segments.join(sources.select("item_id", F.col("normalized").alias("source")), "item_id")
    return rows.select(
        "item_id", "segment_id", "source", F.format_string("%.3f", F.col("start").cast("double")).alias("start"), F.format_string("%.3f", length).alias("duration"),
        at("source.mp4").alias("video_path"), at("audio.wav").alias("audio_path"), at("mouth.mp4").alias("mouth_path"), at("active_speaker.mp4").alias("active_speaker_path"),
    )


def left_behind(decided: DataFrame, folder: str) -> DataFrame:
    """(path) of the files of rejected clips, which are to be deleted."""
    names = ("source.mp4", "audio.wav", "active_speaker.mp4", "mouth.mp4", "transcript.txt")
    rows = decided.filter("quality_status = 'rejected'").select("item_id", "segment_id", F.explode(F.array(*map(F.lit, names))).alias("f"))
    return rows.select(F.concat_ws("/", F.lit(folder), "item_id", "segment_id", "f").alias("path"))


def delete(paths: DataFrame) -> DataFrame:
    """(path, deleted): deletes local or shared files, in the executors; one that isn't there is passed over."""
    import pyarrow as pa
    import pyarrow.fs as pafs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = []
            for p in batch.column(0).to_pylist():
                fs, at = pafs.FileSystem.from_uri(p if "://" in p else f"file://{p}")
                there = fs.get_file_info(at).type == pafs.FileType.File
                if there:
                    fs.delete_file(at)
                gone.append(there)
            yield pa.record_batch([batch.column(0), pa.array(gone)], ["path", "deleted"])

    return paths.select("path").mapInArrow(run, "path string, deleted boolean")
