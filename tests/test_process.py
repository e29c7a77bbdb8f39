"""The whole way with kernels that stand in for media: two videos of a playlist, one with captions and one without, and an address that fails."""

import json

import pytest

from cueweave import cli
from cueweave.config import Settings
from cueweave.plans import process as P
from cueweave.sources import kernels as K
from cueweave.sources import manifest as M

CALLS = "calls.txt"
VTT = "WEBVTT\n\n" + "\n\n".join(f"00:00:{20 + 4 * i:02d}.000 --> 00:00:{23 + 4 * i:02d}.000\n&quot;cue&quot; number {i} is said here." for i in range(6))


def stand_ins(folder):
    def called(name, f):
        def factory():
            def kernel(row):
                with open(f"{folder}/{CALLS}", "a") as out:
                    out.write(json.dumps([name, row.get("item_id") or row.get("url")]) + "\n")
                return f(row)

            return kernel

        K.register(name, factory)

    def fetch(row):
        if "bad" in row["url"]:
            raise OSError("not found")
        one = lambda i, s: {"item_id": i, "path": f"tmp/{i}.WEBM", "source_url": row["url"], "title": i, "channel": "c", "subtitle_path": s, "subtitle_automatic": True if s else None}
        return [one("v1", "subs"), None, one("v2", None)]

    words = [{"word": f" w{i}{'.' if i % 4 == 3 else ''}", "start": 16.0 + i * 0.6, "end": 16.5 + i * 0.6, "probability": 0.9} for i in range(12)]

    def frames(row):
        return [
            {"frame_idx": i, "width": 100, "height": 80, "histogram": [1.0, 2.0], "points": [{"x": 20.0, "y": 30.0}, {"x": 60.0, "y": 30.0 + (i // 5 % 2) * 6 + 4}], "opening": 0.1 + 0.1 * (i // 5 % 2), "gray": [(i // 5 % 2) * 90] * 4, "roi_ok": True, "energy": 1000.0 * (1 + i // 5 % 2)}
            for i in range(50)
        ]

    called("fetch", fetch)
    called("normalize", lambda r: f"normalized/{r['item_id']}.mp4")
    called("fetch_text", lambda r: VTT)
    called("transcribe", lambda r: {"segments": [{"avg_logprob": -0.2, "no_speech_probability": 0.1, "words": words}]})
    called("scene_log", lambda r: "x pts_time:27.5 y")
    called("extract_clip", lambda r: r["video_path"])
    called("frames", frames)
    called("crop", lambda r: {"path": r["mouth_path"], "sharpness": 40.0, "face_found": "v2/000000" not in r["mouth_path"]})


def calls(folder):
    with open(f"{folder}/{CALLS}") as f:
        return [json.loads(x)[0] for x in f]


def test_end_to_end(spark, tmp_path):
    stand_ins(tmp_path)
    sources = spark.createDataFrame([("https://list", True), ("https://bad", False)], "url string, playlist boolean")
    records, failed = P.process(spark, sources, Settings(), "no_voiceover", f"{tmp_path}/w")
    assert [(r.stage, r.item_id, r.error) for r in failed.collect()] == [("fetch", "https://bad", "OSError: not found")]
    rows = {(r.item_id, r.segment_id): r for r in M.read_csv(spark, f"{tmp_path}/w/manifests/all.csv").collect()}
    assert {k[0] for k in rows} == {"v1", "v2"} and records.count() == len(rows) > 3
    for (item, _), r in rows.items():
        assert r.transcript_source == ("youtube_auto_captions" if item == "v1" else "whisper") and r.source_url == "https://list" and r.title == item
        assert not (float(r.start) < 27.5 < float(r.end))  # no scene cut inside
    assert '"cue" number 0' in rows["v1", "000000"].text
    assert rows["v2", "000000"].quality_status == "rejected" and "auto_avsr_no_face" in rows["v2", "000000"].visual_quality_reasons and rows["v2", "000000"].video_path is None
    good = [r for r in rows.values() if r.quality_status == "accepted"]
    assert good and all(r.video_path.endswith("/source.mp4") and float(r.sharpness) == 40.0 for r in good)
    before = len(calls(tmp_path))
    again, failed = P.process(spark, sources, Settings(), "no_voiceover", f"{tmp_path}/w")
    assert again.count() == len(rows) and calls(tmp_path)[before:] == ["fetch"]  # only what failed is tried again
    with pytest.raises(ValueError):
        P.process(spark, sources, Settings(), "nonsense", f"{tmp_path}/w")


def test_shell(spark, tmp_path, capsys):
    stand_ins(tmp_path)
    (tmp_path / "own.yaml").write_text(f"workspace: {tmp_path}/w\n")
    (tmp_path / "plain.txt").write_text("https://list\nhttps://other\n")
    (tmp_path / "voiced.txt").write_text("playlist https://other\n")
    run = lambda *a: cli.main([*a, "-c", str(tmp_path / "own.yaml")], spark)
    assert run("process-both-sources", "--plain", str(tmp_path / "plain.txt"), "--voiced", str(tmp_path / "none.txt")) == 0
    (tmp_path / "own.yaml").write_text(f"workspace: {tmp_path}/w/no_voiceover\n")
    assert run("inspect", "-n", "2") == 0
    shown = capsys.readouterr().out.splitlines()
    assert len([x for x in shown if x.startswith(("[ACCEPT]", "[REJECT]"))]) == 2
    assert run("manifest") == 0 and "records" in capsys.readouterr().out
    shared = str(tmp_path / "shared")
    assert run("push-data", "--repo", shared, "--contributor", "Ada L.") == 0
    assert run("pull-data", "--repo", shared, "--contributor", "ada l", "--dest", str(tmp_path / "got")) == 0
    assert spark.read.parquet(str(tmp_path / "got")).count() > 0
    assert run("check-downloader", "https://bad") == 1 and run("check-downloader", "https://x") == 0
    with pytest.raises(ValueError):
        run("process-both-sources", "--plain", str(tmp_path / "none.txt"), "--voiced", str(tmp_path / "none.txt"))
