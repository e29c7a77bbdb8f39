import hashlib
import io
import os
import tarfile

import numpy as np

from cueweave.llm import media as M
from cueweave.llm._state import shared_dir


def test_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/a"
    vec = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    payloads = M.rendered(vec)
    body = {r.vec_id: bytes(r.payload) for r in payloads.collect()}
    rows = M.media_columns(payloads, folder, shard_bytes=100_000).collect()
    assert len(rows) == len(body) and len({r["shard"] for r in rows}) > 2
    kinds = set()
    for r in rows:
        b = M.payload_at(folder, r["shard"], r["offset"], r["length"])
        assert b == body[r.vec_id] and hashlib.sha256(b).hexdigest() == r.digest
        kinds.add(r.mime)
        want = (None, None, 1, 16, 8000, 64) if r.mime == "audio/wav" else (8, 8, 3 if r.mime == "image/bmp" else 1, 8, None, None)
        assert (r.width, r.height, r.channels, r.bit_depth, r.sample_rate, r.samples) == want
    assert kinds == {"image/png", "image/bmp", "audio/wav"}
    members = 0
    for f in os.listdir(tmp_path / "a"):
        if f.endswith(".tar"):
            with tarfile.open(tmp_path / "a" / f) as t:
                for m in t:
                    assert hashlib.sha256(t.extractfile(m).read()).hexdigest() == m.name
                    members += 1
    assert members == len(set(body.values()))
    before = sorted(os.listdir(tmp_path / "a"))
    again = sorted(map(tuple, M.media_columns(payloads, folder, shard_bytes=100_000).collect()))
    assert again == sorted(map(tuple, rows)) and sorted(os.listdir(tmp_path / "a")) == before


def test_sniff_and_tar_header():
    assert M.sniff(b"GIF89a" + bytes([5, 0, 7, 0, 0xF7]))[:5] == ("image/gif", 5, 7, 1, 8)
    assert M.sniff(b"") == (None,) * 7 and M.sniff(b"\x89PNG\r\n\x1a\n") == (None,) * 7
    with tarfile.open(fileobj=io.BytesIO(M.tar_header("x" * 64, 3) + b"abc".ljust(512, b"\0") + b"\0" * 1024)) as t:
        assert [(m.name, m.size) for m in t] == [("x" * 64, 3)]


def test_edges(spark):
    folder = shared_dir(spark) + "/media-edges"
    big = np.random.default_rng(1).bytes(3_000_000)
    d = [(1, None, 5), (2, b"", 5), (None, b"abc", 5), (3, b"abc", 5), (3, b"abc", 5), (4, big, None)]
    df = spark.createDataFrame(d, "vec_id bigint, payload binary, offset int")
    rows = M.media_columns(df, folder).collect()
    assert len(rows) == 6
    by = {r.vec_id: r for r in rows}
    assert by[1].digest is None and by[1]["shard"] is None and by[2]["length"] == 0 and by[2].mime is None
    assert by[3]["offset"] == by[None]["offset"]
    assert M.payload_at(folder, by[4]["shard"], by[4]["offset"], by[4]["length"]) == big
    assert M.media_columns(df.limit(0), folder).count() == 0
    assert [r.payload for r in M.rendered(spark.createDataFrame([(1, None), (2, [])], "vec_id bigint, embedding array<float>")).collect()] == [None, None]


def chunk(kind, body):
    return kind + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)


def riff(form, *chunks):
    body = form + b"".join(chunks)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def box(kind, body):
    return (8 + len(body)).to_bytes(4, "big") + kind + body


FMT = bytes.fromhex("0100" "0200" "44ac0000" "10b10200" "0400" "1000")  # 2 channels of 16 bits, 44,100 a second
PAYLOADS = [
    # written by hand from the formats' descriptions
    (b"BM" + bytes(12) + bytes.fromhex("0c000000" "0a00" "1800" "0100" "1800") + bytes(720), ("image/bmp", 10, 24, 3, 8, None, None)),
    (b"BM" + bytes(12) + bytes.fromhex("28000000" "03000000" "fbffffff" "0100" "1000") + bytes(64), ("image/bmp", 3, 5, 3, 5, None, None)),
    (b"BM" + bytes(12) + bytes.fromhex("6c000000" "03000000" "05000000" "0100" "0800") + bytes(64), ("image/bmp", 3, 5, 1, 8, None, None)),
    (b"BM" + bytes(3), (None,) * 7),
    (riff(b"WAVE", chunk(b"fmt ", FMT + b"\0\0"), chunk(b"LIST", b"INFOabc"), chunk(b"data", bytes(400))), ("audio/wav", None, None, 2, 16, 44100, 100)),
    (riff(b"WAVE", chunk(b"LIST", bytes(5001)), chunk(b"fmt ", FMT), chunk(b"data", bytes(8))), ("audio/wav", None, None, 2, 16, 44100, 2)),
    (b"\xff\xd8" + b"\xff\xe1\xea\x62" + bytes(60000) + b"\xff\xff\xdb\x00\x04ab" + bytes.fromhex("ffc2" "0011" "08" "0140" "01e0" "03") + bytes(20), ("image/jpeg", 480, 320, 3, 8, None, None)),
    (b"\xff\xd8\xff\xd9", ("image/jpeg",) + (None,) * 6),
    (riff(b"WEBP", chunk(b"VP8X", bytes.fromhex("10000000" "1f0300" "570200"))), ("image/webp", 800, 600, 4, 8, None, None)),
    (riff(b"WEBP", chunk(b"VP8 ", bytes.fromhex("300100" "9d012a" "4001" "f000") + bytes(20))), ("image/webp", 320, 240, 3, 8, None, None)),
    (riff(b"WEBP", chunk(b"VP8L", bytes.fromhex("2f" "3f014f00") + bytes(9))), ("image/webp", 320, 317, 3, 8, None, None)),
    (b"fLaC" + bytes.fromhex("00000022" "1000" "1000" "000000" "000000" "0ac442f0" "00001388") + bytes(16), ("audio/flac", None, None, 2, 16, 44100, 5000)),
    (box(b"ftyp", b"isom0000") + box(b"mdat", bytes(9000)) + box(b"moov", box(b"mvhd", bytes(100)) + box(b"trak", box(b"tkhd", bytes(84))) + box(b"trak", box(b"tkhd", bytes(76) + bytes.fromhex("02800000" "01680000")))), ("video/mp4", 640, 360, None, None, None, None)),
    (b"GIF89a" + bytes([5, 0, 7, 0, 0xF1, 0, 0]), ("image/gif", 5, 7, 1, 2, None, None)),
]


def test_formats_by_range_reads(spark, tmp_path):
    folder = f"file://{tmp_path}"
    df = spark.createDataFrame([(f"k{i}", p) for i, (p, _) in enumerate(PAYLOADS)] + [("none", None)], "vec_id string, payload binary")
    rows = {r.vec_id: r for r in M.media_columns(df, folder).collect()}
    assert len(rows) == len(PAYLOADS) + 1
    for i, (p, want) in enumerate(PAYLOADS):
        assert tuple(rows[f"k{i}"])[5:] == want == M.sniff(p), i
        assert M.payload_at(folder, rows[f"k{i}"]["shard"], rows[f"k{i}"]["offset"], rows[f"k{i}"]["length"]) == p
    assert not [f for f in os.listdir(tmp_path) if f.startswith(".") and not f.endswith(".crc")]


def test_what_failed_tasks_leave_is_deleted(spark, tmp_path):
    folder = f"file://{tmp_path}"
    (tmp_path / ".other-run").write_bytes(b"x")
    df = spark.createDataFrame([(i, bytes([i])) for i in range(20)], "vec_id int, payload binary")
    assert len({(r["shard"], r["offset"]) for r in M.media_columns(df, folder, shard_bytes=2000).collect()}) == 20
    assert [f for f in os.listdir(tmp_path) if not f.endswith(".tar")] == [".other-run"]
