import json
import os

import pytest
from pyspark.sql import functions as F

from cueweave import config
from cueweave.operators import frames, tracks
from cueweave.plans import curation
from cueweave.plans import queries as Q
from cueweave.sources import kernels as K
from cueweave.sources import lists as L
from cueweave.sources import manifest as M
from cueweave.sources import state

SF = "/root/testdata/sf0.001"


def test_lists(spark, tmp_path):
    p = tmp_path / "sources.txt"
    p.write_text("# c\n\n  video https://a/1 \nPLAYLIST http://b/2\nhttps://c/playlist?x\nvideo\n", encoding="utf-8")
    lines = L.read(spark, str(p))
    assert lines.count() == 6 and L.usable(lines).count() == 4
    got = [(r.line_no, r.mode, r.url, r.playlist) for r in L.parsed(lines.filter("line_no < 6")).collect()]
    assert got == [(3, "video", "https://a/1", False), (4, "playlist", "http://b/2", True), (5, "auto", "https://c/playlist?x", True)]
    with pytest.raises(Exception, match="line 6"):
        L.parsed(lines).collect()
    with pytest.raises(FileNotFoundError):
        L.read(spark, str(tmp_path / "none"))
    none = L.read(spark, str(tmp_path / "none"), missing_ok=True)
    assert none.isEmpty() and L.without(lines, none).count() == 4
    with pytest.raises(ValueError):
        L.require_some(none)


def test_entries_and_local_files(spark, tmp_path):
    df = spark.createDataFrame([("p", ["a", None, "b", "c"])], "item_id string, entries array<string>")
    assert [r.entry for r in L.entries(df, head=3).collect()] == ["a", "b"] and L.entries(df, head=0).count() == 3
    (tmp_path / "My clip (1).mp4").write_bytes(b"abc")
    (r,) = L.local_items(spark, str(tmp_path)).collect()
    assert (r.item_id, r.title, r.size, r.channel) == ("My_clip_1", "My clip (1)", 3, None) and r.source_url.startswith("file:")


def test_local_items_kept_as_folders(spark, tmp_path):
    (tmp_path / "v1.mp4").mkdir()
    at = tmp_path / "v1.mp4"
    (at / "one.mp4").write_bytes(b"abc")
    (at / "two.mp4" / "k=1").mkdir(parents=True)
    for name, body in (("part-0", b"ab"), ("part-1", b"cde"), ("_SUCCESS", b""), ("k=1/part-2", b"fg")):
        (at / "two.mp4" / name).write_bytes(body)
    (at / "none.mp4").mkdir()
    found = lambda glob: sorted((r.item_id, r.title, r.size, r.path.rsplit("/", 1)[1]) for r in L.local_items(spark, glob).collect())
    want = [("one", "one", 3, "one.mp4"), ("two", "two", 7, "two.mp4")]
    assert found(f"{at}/*.mp4") == found(f"file://{at}/*.mp4") == found(f"{tmp_path}/*/{{one,two}}.mp4") == want
    (at / "folder").mkdir()
    (at / "folder" / "a.mp4").write_bytes(b"x")
    assert [r[0] for r in found(f"{at}/fold*")] == [r[0] for r in found(str(at / "folder"))] == ["a"]


def test_local_files_of_tables_in_parts(spark, tmp_path):
    import shutil

    import __spark_entry__ as e

    shutil.copytree(SF, tmp_path / "sf")
    (tmp_path / "whole").write_bytes((tmp_path / "sf" / "documents.parquet").read_bytes())
    os.remove(tmp_path / "sf" / "documents.parquet")
    spark.read.parquet(str(tmp_path / "whole")).repartition(3).write.parquet(f"{tmp_path}/sf/documents.parquet")
    got, plain = e.queries()["local_files"], lambda rows: sorted(map(tuple, rows.collect()))
    assert plain(got(spark, f"{tmp_path}/sf")) == plain(got(spark, SF)) and len(plain(got(spark, SF))) == 14


def test_records_manifests_and_sharing(spark, tmp_path):
    for i, s in enumerate(["accepted", "review", "rejected", None]):
        d = tmp_path / "clips" / "it" / f"{i:06d}"
        os.makedirs(d)
        rec = {"item_id": "it", "segment_id": f"{i:06d}", "text": 'say "hi", ü', "start": 1e-05, "quality_status": s, "accepted": s == "accepted", "visual_quality": {"mouth_visible_ratio": 0.5, "reasons": ["a", "b"]} if i else None, "extra": 1}
        (d / "metadata.json").write_text(json.dumps(rec, indent=1))
    glob = f"{tmp_path}/clips/*/*/metadata.json"
    records = M.read_records(spark, glob)
    assert records.count() == 4
    M.publish(records, f"{tmp_path}/m")
    back = M.read_csv(spark, f"{tmp_path}/m/all.csv").orderBy("segment_id").collect()
    assert len(back[0]) == 33 and [r.accepted for r in back] == ["True", "False", "False", "False"]
    assert back[0].text == 'say "hi", ü' and back[1].visual_quality_reasons == "a|b" and float(back[0].start) == 1e-05 and back[0].title is None
    assert {n: M.read_csv(spark, f"{tmp_path}/m/{n}.csv").count() for n in ("accepted", "review", "rejected")} == {"accepted": 1, "review": 1, "rejected": 1}
    assert spark.read.json(f"{tmp_path}/m/all.jsonl").filter("text like '%ü%'").count() == 4
    root = f"{tmp_path}/shared"
    M.push(records, root, "Ann B.", ["accepted"])
    M.push(records, root, "bob", ["rejected", "odd"])
    assert M.pull(spark, root, "ann b").count() == 1 and M.pull(spark, root).count() == 2
    plan = M.pull(spark, root, "bob")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(contributor" in plan
    for bad in ([], ["odd"], ["review"]):
        with pytest.raises(ValueError):
            M.push(records.filter("quality_status = 'accepted'"), root, "x", bad)
    (tmp_path / "clips" / "it" / "000001" / "metadata.json").write_text("{broken")
    with pytest.raises(Exception):
        M.read_records(spark, glob).collect()
    assert M.read_records(spark, glob, strict=False).count() == 3


def test_state(spark, tmp_path):
    log = f"{tmp_path}/log"
    assert state.read(spark, log).isEmpty()
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "item_id string")
    for status, who in (("running", "abc"), ("done", "ab"), ("failed", "b")):
        state.record(items.filter(F.col("item_id").isin(*who)).select("item_id", F.lit("clip").alias("stage"), F.lit(status).alias("status"), F.lit(None).cast("string").alias("detail")), log)
    now = {r.item_id: r.status for r in state.latest(state.read(spark, log)).collect()}
    assert now == {"a": "done", "b": "failed", "c": "running"}
    rest = lambda **k: sorted(r.item_id for r in state.pending(items, state.read(spark, log), "clip", **k).collect())
    assert rest() == ["b", "c"] and rest(force=True) == ["a", "b", "c"]
    assert rest(outputs=spark.createDataFrame([("a", False)], "item_id string, exists boolean")) == ["a", "b", "c"]


def test_kernels(spark):
    loads = spark.sparkContext.accumulator(0)

    def factory():
        loads.add(1)

        def kernel(row):
            if row["path"] == "bad":
                raise RuntimeError("no face")
            return [len(row["path"]), 0.5]

        return kernel

    K.register("speaker_scores", factory)
    df = spark.createDataFrame([(i, "bad" if i == 3 else "p" * i) for i in range(6)], "id int, path string").coalesce(1)
    got = {r.id: r for r in K.run(df, "speaker_scores", keys=["id"], inputs=["path"]).collect()}
    assert got[2].result == [2.0, 0.5] and got[2].ok and not got[3].ok and "no face" in got[3].error and got[3].result is None
    assert loads.value == 1
    with pytest.raises(LookupError):
        K.run(df, "crop", keys=["id"], inputs=["path"])
    with pytest.raises(ValueError):
        K.register("nonsense", factory)
    assert K.flatten_scores({"a": [1, (True, [2.5])], "b": {"c": 3}}) == [1.0, 1.0, 2.5, 3.0]
    one = spark.createDataFrame([((False, "x", None), (True, None, "r"), (True, None, "s")), ((False, "x", None), (False, "y", None), (False, "z", None))], ", ".join(f"t{i} struct<ok:boolean,error:string,result:string>" for i in range(3)))
    r = [x[0] for x in one.select(K.first_success(F.col("t0"), F.col("t1"), F.col("t2"))).collect()]
    assert r[0].result == "r" and not r[1].ok and r[1].error == "x | y | z"
    assert K.selectors("a", "b", "a") == ["a", "b"]

    def lost(_):
        raise AssertionError("Cannot detect any frames in the video")

    def broken(_):
        raise AssertionError("something else")

    assert K.landmarks_or_null(lost, [1, 2, 3]) == [None] * 3
    with pytest.raises(AssertionError, match="something else"):
        K.landmarks_or_null(broken, [1])


def test_config(tmp_path):
    (tmp_path / "base.yaml").write_text("language: tr\nsegmentation: {min_words: 4, max_duration: 9}\n")
    (tmp_path / "own.yaml").write_text("extends: base.yaml\nsegmentation: {max_duration: 12}\nunknown: 1\n")
    s = config.load(str(tmp_path / "own.yaml"))
    assert s.language == "tr" and s.segmentation.min_words == 4 and s.segmentation.max_duration == 12.0 and s.quality.min_sharpness == 18.0
    assert config.load() == config.Settings() and config.flat(s)["segmentation.max_duration"] == 12.0
    assert config.overlay({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"c": 4}, "d": {"e": 5}, "f": 6}) == {"a": {"b": 1, "c": 4}, "d": {"e": 5}, "f": 6}
    with pytest.raises(ValueError):
        config.verifies_lip_sync("other")
    assert config.first_of(None, "", "x") == "x" and config.device("auto", mps=True) == "mps"


def test_tracks_against_plain_walk(spark):
    got = {(r.clip, r.track, r.frame_idx): (r.x1, r.y1, r.x2, r.y2) for r in Q.face_tracks(spark, SF).collect()}
    clips = {}
    for r in Q.face_frames(spark, SF).collect():
        clips.setdefault(r.clip, []).append((r.frame_idx, [tuple(b) for b in r.boxes]))
    want = {}
    for c, rows in clips.items():
        ends = []
        for at, boxes in sorted(rows):
            used = set()
            for n, e in enumerate(ends):
                best = (0.25, -1)
                for i, b in enumerate(boxes):
                    if i not in used:
                        w, h = max(0, min(e[2], b[2]) - max(e[0], b[0])), max(0, min(e[3], b[3]) - max(e[1], b[1]))
                        best = max(best, (w * h / max(1, 24000 - w * h), i))
                if best[1] >= 0:
                    ends[n] = boxes[best[1]]
                    used.add(best[1])
                    want[c, n, at] = ends[n]
            for i, b in enumerate(boxes):
                if i not in used:
                    want[c, len(ends), at] = b
                    ends.append(b)
    assert got == want and len({k[1] for k in got}) > 2


def test_boxes_and_windows(spark):
    df = spark.createDataFrame([("c", 0, 960, 540, [(0.1, 0.1, 0.5, 0.5), (0.9, 0.9, 0.0, 0.1)])], "clip string, frame_idx int, width int, height int, found array<struct<x:double,y:double,w:double,h:double>>")
    (b,) = df.select(tracks.boxes(F.col("found"), F.col("width"), F.col("height"))).first()
    assert [tuple(x) for x in b] == [(96, 54, 576, 324)]
    rows = spark.createDataFrame([("c", i, 200, 100, (10, 10, 110, 60) if i == 1 else None) for i in range(3)], "clip string, frame_idx int, width int, height int, box struct<x1:int,y1:int,x2:int,y2:int>")
    got = [r.window and tuple(r.window) for r in tracks.carried_box(rows).orderBy("frame_idx").collect()]
    assert got == [None, (0, 1, 128, 69), (0, 1, 128, 69)]
    f = spark.createDataFrame([("a", [(1, 1, 2, 2)]), ("a", None), ("b", [(1, 1, 2, 2), (3, 3, 4, 4)])], "clip string, boxes array<struct<x1:int,y1:int,x2:int,y2:int>>")
    assert {r.clip: r.single for r in tracks.single_face(f).collect()} == {"a": True, "b": False}


def test_frames(spark):
    df = spark.createDataFrame([("v", "0", 1.02, 4)], "item_id string, segment_id string, start double, frames int")
    marks = spark.createDataFrame([("v", i, [(float(i), 0.0)]) for i in range(28)], "item_id string, frame_idx int, points array<struct<x:double,y:double>>")
    got = frames.landmark_slice(df, marks).orderBy("frame_idx").collect()
    assert [r.points and r.points[0].x for r in got] == [26.0, 27.0, None, None]
    silent = spark.createDataFrame([("a", "0", i, 0.0 if i < 3 else 1e-4) for i in range(6)] + [("b", "0", 0, 0.0)], "item_id string, segment_id string, frame_idx int, energy double")
    got = [(r.audio_active, r.audio_energy) for r in frames.audio_activity(silent).orderBy("item_id", "frame_idx").collect()]
    assert got == [(False, 0.0)] * 3 + [(True, 1.0)] * 3 + [(False, 0.0)]
    pts = spark.createDataFrame([([(10.0, 10.0), (30.0, 20.0)],), ([(10.0, 10.0), (12.0, 20.0)],), ([(float("nan"), 1.0), (30.0, 20.0)],)], "p array<struct<x:double,y:double>>")
    got = [r[0] for r in pts.select(frames.geometry(F.col("p"), F.lit(100), F.lit(50))).collect()]
    assert got == [[0.2, 0.3, 0.2, 0.2], None, None]


def test_routing(spark):
    items = spark.createDataFrame([("a",), ("b",)], "item_id string")
    w = "item_id string, cue int, position int, word string, start double, end double, probability double"
    cap = spark.createDataFrame([("a", 0, 0, "x", 0.0, 1.0, 1.0)], w)
    asr = spark.createDataFrame([("a", 0, 0, "y", 0.0, 1.0, 0.5), ("b", 0, 0, "z", 0.0, 1.0, 0.5)], w)
    assert {(r.item_id, r.word, r.transcript_source) for r in curation.route(items, cap, asr).collect()} == {("a", "x", "youtube_manual_subtitles"), ("b", "z", "whisper")}
    with pytest.raises(Exception, match="no words for item b"):
        curation.route(items, cap, asr, use_asr=False).collect()


def test_caption_files_with_malformed_bytes(spark, tmp_path):
    from cueweave.operators import captions

    (tmp_path / "my talk.tr.vtt").write_bytes(b"\xef\xbb\xbfWEBVTT\r\r00:00:01.000 --> 00:00:02.000\rcaf\xe9 \xc3\xa9&eacute;\r\r")
    files = captions.read(spark, str(tmp_path))
    assert [(r.item_id, r.start, r.text) for r in captions.parse(files).collect()] == [("my talk.tr", 1.0, "caf\ufffd éé")]


def test_caption_files_written_and_listed_by_folders(spark, tmp_path):
    """No folder, no commit and no listing task an item: 300 files come in the folders of a fixed number."""
    from cueweave.operators import captions

    bodies = spark.range(300).select(F.concat(F.lit("talk "), "id").alias("item_id"), F.concat(F.lit("WEBVTT\n\n00:00:01.000 --> 00:00:02.000\né &amp; "), "id", F.lit("\n")).alias("body"))
    bodies = bodies.unionByName(spark.createDataFrame([("empty", None)], "item_id string, body string"))
    for _ in range(2):  # again over what is there
        captions.write(bodies, f"file://{tmp_path}/c")
    assert len(os.listdir(tmp_path / "c")) <= captions.FOLDERS and sum(len(f) for _, _, f in os.walk(tmp_path / "c")) == 301
    files = captions.read(spark, f"{tmp_path}/c/*")
    assert files.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism
    assert files.count() == 300 and len(files.inputFiles()) == 301  # Spark passes over what is empty
    assert {(r.item_id, r.start, r.text) for r in captions.parse(files).collect()} == {(f"talk {i}", 1.0, f"é & {i}") for i in range(300)}
    for bad in (None, "a/b", "", "_a"):
        with pytest.raises(Exception, match="no name for a caption file"):
            captions.write(spark.createDataFrame([(bad, "x")], "item_id string, body string"), f"{tmp_path}/d")


def test_caption_files_query_has_no_folder_an_item(spark, tmp_path, monkeypatch):
    import __spark_entry__ as e
    from cueweave.operators import captions
    from cueweave.plans import io_queries

    monkeypatch.setattr(io_queries, "shared_dir", lambda _: f"file://{tmp_path}")
    rows = e.queries()["caption_files"](spark, SF)
    files = [os.path.join(at, f) for at, _, names in os.walk(tmp_path) for f in names]
    assert len({os.path.dirname(f) for f in files}) <= captions.FOLDERS
    assert len(files) == rows.select("item_id").distinct().count() == Q.t(spark, SF, "conversations").select("conv_id").distinct().count()


def test_cues_are_worked_out_once(spark):
    from cueweave.operators import captions

    files = spark.createDataFrame([(1, "00:00:01.000 --> 00:00:02.000\na &amp; b\n")], "item_id int, body string").repartition(1)
    plan = captions.parse(files)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<[^>]+>") == 1, plan


def test_delete_and_json(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    df = spark.createDataFrame([(f"{tmp_path}/a",), (f"file://{tmp_path}/b",)], "path string")
    assert {r.path.rsplit("/", 1)[1]: r.deleted for r in K.delete(df).collect()} == {"a": True, "b": False} and not (tmp_path / "a").exists()
    M.write_json(spark.createDataFrame([(1, None), (2, "é")], "k int, v string"), f"{tmp_path}/j", by=["k"])
    assert {(r.k, r.v) for r in spark.read.json(f"{tmp_path}/j").collect()} == {(1, None), (2, "é")} and os.path.isdir(tmp_path / "j" / "k=1")


def test_a_broken_off_run_never_shows(spark, tmp_path):
    items = spark.createDataFrame([("a",), ("b",)], "item_id string")
    row = lambda todo, v: todo.select("item_id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"), F.lit(v).alias("v"))
    state.staged(items, "s", lambda t: row(t, 1), str(tmp_path))

    def broken(todo):
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        state.staged(items, "s", broken, str(tmp_path), force=True)
    row(items, 9).withColumn("_run", F.lit("lost")).write.mode("append").parquet(f"{tmp_path}/s")
    assert state.latest(state.read(spark, f"{tmp_path}/state")).filter("status = 'running'").count() == 2
    assert {(r.item_id, r.v) for r in state.staged(items, "s", lambda t: row(t, 2), str(tmp_path)).collect()} == {("a", 2), ("b", 2)}


def test_shared_folder(spark):
    from types import SimpleNamespace

    from cueweave.sources.shared import shared_dir

    def session(master, conf=None, checkpoint=None):
        known = SimpleNamespace(isDefined=lambda: checkpoint is not None, get=lambda: checkpoint)
        inner = SimpleNamespace(getCheckpointDir=lambda: known)
        sc = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k: None), _jsc=SimpleNamespace(sc=lambda: inner))
        return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: conf))

    assert shared_dir(session("yarn", conf="hdfs://a/b/")) == "hdfs://a/b" and shared_dir(session("spark://h:1", checkpoint="s3a://c")) == "s3a://c"
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1024]", "k8s://https://h"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session(master))
    own = session("local[4]")
    assert shared_dir(own).startswith("file:///") and shared_dir(own) == shared_dir(own)
