"""Media columns: content-addressed payloads in tar shards, and metadata from range reads of their headers."""

from __future__ import annotations

import hashlib
import math
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._state import written

#: Bytes of payload that a shard holds, more or less; a shard ends with the payload that passes it.
SHARD_BYTES = 256 << 20
#: First bytes of a payload that are read for its metadata; formats whose headers go on ask for further ranges.
HEADER_BYTES = 64
BLOCK = 512
META = [("mime", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("bit_depth", pa.int32()), ("sample_rate", pa.int32()), ("samples", pa.int64())]
META_DDL = "mime string, width int, height int, channels int, bit_depth int, sample_rate int, samples bigint"


def tar_header(name: str, size: int) -> bytes:
    """A ustar member header that depends on nothing but the name and size."""
    h = bytearray(BLOCK)
    h[0 : len(name)] = name.encode()
    h[100:108], h[108:116], h[116:124] = b"0000644\0", b"0000000\0", b"0000000\0"
    if size < 8**11:
        h[124:136] = b"%011o\0" % size
    else:
        h[124:136] = b"\x80" + size.to_bytes(11, "big")
    h[136:148], h[156:157], h[257:265] = b"00000000000\0", b"0", b"ustar\x0000"
    h[148:156] = b" " * 8
    h[148:156] = b"%06o\0 " % sum(h)
    return bytes(h)


Read = Callable[[int, int], bytes]
NOTHING = (None,) * len(META)


def _jpeg(read: Read) -> tuple:
    """Goes from segment to segment by their lengths, up to the one that has the size."""
    at = 2
    while len(seg := read(at, 10)) >= 4 and seg[0] == 0xFF:
        kind = seg[1]
        if kind == 0xFF or kind == 1 or 0xD0 <= kind <= 0xD7:
            at += 1 if kind == 0xFF else 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            if len(seg) < 10:
                break
            depth, h, w, channels = struct.unpack(">BHHB", seg[4:10])
            return "image/jpeg", w, h, channels, depth, None, None
        elif kind in (0xD9, 0xDA):
            break
        else:
            at += 2 + struct.unpack(">H", seg[2:4])[0]
    return ("image/jpeg", *NOTHING[1:])


def _wav(read: Read) -> tuple:
    """Goes from chunk to chunk; the samples are those of the data chunk."""
    at, form = 12, None
    while len(head := read(at, 8)) == 8:
        kind, size = head[:4], struct.unpack("<I", head[4:])[0]
        if kind == b"fmt " and len(body := read(at + 8, 16)) == 16:
            form = struct.unpack("<HHIIHH", body)
        elif kind == b"data" and form:
            return "audio/wav", None, None, form[1], form[5], form[2], size // form[4] if form[4] else None
        at += 8 + size + (size & 1)
    return ("audio/wav", None, None, form[1], form[5], form[2], None) if form else ("audio/wav", *NOTHING[1:])


def _webp(read: Read) -> tuple:
    b = read(12, 18)
    if b[:4] == b"VP8 " and len(b) == 18:
        w, h = struct.unpack("<HH", b[14:18])
        return "image/webp", w & 0x3FFF, h & 0x3FFF, 3, 8, None, None
    if b[:4] == b"VP8L" and len(b) >= 13:
        bits = struct.unpack("<I", b[9:13])[0]
        return "image/webp", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, 4 if bits >> 28 & 1 else 3, 8, None, None
    if b[:4] == b"VP8X" and len(b) == 18:
        return "image/webp", int.from_bytes(b[12:15], "little") + 1, int.from_bytes(b[15:18], "little") + 1, 4 if b[8] & 16 else 3, 8, None, None
    return ("image/webp", *NOTHING[1:])


def _bmp(read: Read) -> tuple:
    b = read(14, 16)
    if len(b) < 12:
        return NOTHING
    old = struct.unpack("<I", b[:4])[0] == 12
    if not old and len(b) < 16:
        return NOTHING
    w, h, _, bits = struct.unpack("<HHHH", b[4:12]) if old else struct.unpack("<iiHH", b[4:16])
    channels, depth = {16: (3, 5), 24: (3, 8), 32: (4, 8)}.get(bits, (1, bits))
    return "image/bmp", w, abs(h), channels, depth, None, None


def _mp4(read: Read) -> tuple:
    """Goes from box to box into the tracks; the size is that of the first track that has one."""
    stack = [(0, 1 << 62)]
    while stack:
        at, end = stack.pop()
        head = read(at, 16) if at < end else b""
        if len(head) < 8:
            continue
        size, kind, skip = struct.unpack(">I", head[:4])[0], head[4:8], 8
        if size == 1 and len(head) == 16:
            size, skip = struct.unpack(">Q", head[8:])[0], 16
        if size < skip:
            continue
        stack.append((at + size, end))
        if kind in (b"moov", b"trak"):
            stack.append((at + skip, at + size))
        elif kind == b"tkhd" and len(body := read(at + size - 8, 8)) == 8:
            w, h = (x >> 16 for x in struct.unpack(">II", body))
            if w and h:
                return "video/mp4", w, h, *NOTHING[3:]
    return ("video/mp4", *NOTHING[1:])


def sniff(head: bytes, read: Read | None = None) -> tuple:
    """(mime, width, height, channels, bit_depth, sample_rate, samples) of a payload; nulls where its header doesn't tell.

    `head` is its first bytes, and `read` gives it (place, number) of others, as few as the format asks for. Of a picture with a palette the
    one channel is the palette's index.
    """
    read = read or (lambda at, n: head[at : at + n])
    if head[:8] == b"\x89PNG\r\n\x1a\n" and head[12:16] == b"IHDR" and len(head) >= 26:
        w, h, depth, colour = struct.unpack(">IIBB", head[16:26])
        return "image/png", w, h, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour), depth, None, None
    if head[:6] in (b"GIF87a", b"GIF89a") and len(head) >= 11:
        w, h, flags = struct.unpack("<HHB", head[6:11])
        return "image/gif", w, h, 1, (flags & 7) + 1, None, None
    if head[:2] == b"BM":
        return _bmp(read)
    if head[:3] == b"\xff\xd8\xff":
        return _jpeg(read)
    if head[:4] == b"RIFF" and head[8:12] == b"WAVE":
        return _wav(read)
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        return _webp(read)
    if head[:4] == b"fLaC" and len(head) >= 26:
        bits = int.from_bytes(head[18:26], "big")
        return "audio/flac", None, None, (bits >> 41 & 7) + 1, (bits >> 36 & 31) + 1, bits >> 44, bits & ((1 << 36) - 1) or None
    if head[4:8] == b"ftyp":
        return _mp4(read)
    return NOTHING


def png(pixels: np.ndarray) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    h, w = pixels.shape
    rows = b"".join(b"\0" + r.tobytes() for r in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def bmp(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape
    body = np.zeros((h, (w * 3 + 3) // 4 * 4), np.uint8)
    body[:, : w * 3] = np.repeat(pixels, 3, axis=1)[::-1]
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + body.size, 0, 0, 54, 40, w, h, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def wav(samples: np.ndarray, rate: int = 8000) -> bytes:
    body = samples.astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


def rendered(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, payload): each vector as a square grey PNG, a BMP or a WAV by what its length and first number are; null for a null or empty vector."""
    src = vectors.select(F.col(key).alias("vec_id"), F.col(vector).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1):
                x = np.array(v.as_py() or [], np.float64)
                x = np.nan_to_num(x)
                if not len(x):
                    out.append(None)
                    continue
                kind = int(abs(x[0]) * 1000) % 3
                side = math.isqrt(len(x))
                grey = np.clip((x[: side * side].reshape(side, side) + 1) * 127.5, 0, 255).astype(np.uint8)
                out.append(png(grey) if kind == 0 else bmp(grey) if kind == 1 else wav(np.clip(x, -1, 1) * 32767))
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "payload"])

    return src.mapInArrow(run, T.StructType([src.schema["vec_id"], T.StructField("payload", T.BinaryType())]))


def stored(payloads: DataFrame, folder: str, *, shard_bytes: int = SHARD_BYTES, key: str = "vec_id", payload: str = "payload") -> DataFrame:
    """(vec_id, digest, shard, offset, length) of each row: writes each payload once, by its SHA-256, into tar shards under `folder`.

    The payloads are made and digested once, and go by one shuffle to where those of their digest are; the rows come back with their places,
    so nothing is joined. Shards are sorted by digest and cut by size, so a task that runs again writes the same bytes; a shard is written
    under a name of its own and renamed when whole, and what failed tasks leave is deleted. Its name tells its members' digests, so another
    run with the same payloads leaves the same files. Null payloads are not stored; empty ones are.
    """
    one = payloads.select(F.col(key).alias("vec_id"), F.sha2(F.col(payload), 256).alias("digest"), F.col(payload).alias("payload"))
    out = T.StructType([one.schema["vec_id"], T.StructField("digest", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])
    run_id = uuid.uuid4().hex[:12]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        keys: list[pa.Array] = []
        rows: list[tuple[str, int, int]] = []
        state: dict = {}

        def open_() -> None:
            state["temp"] = f"{base}/.{run_id}-{uuid.uuid4().hex}"
            state["file"], state["at"], state["name"] = fs.open_output_stream(state["temp"]), 0, hashlib.sha256()

        def close() -> pa.RecordBatch:
            state["file"].write(b"\0" * (2 * BLOCK))
            state["file"].close()
            shard = f"{state['name'].hexdigest()[:32]}.tar"
            fs.move(state["temp"], f"{base}/{shard}")
            cols = [pa.concat_arrays(keys), pa.array([r[0] for r in rows]), pa.array([shard] * len(rows)), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())]
            rows.clear()
            keys.clear()
            state.clear()
            return pa.record_batch(cols, out.names)

        last = None
        for batch in batches:
            first = batch.column(1).null_count  # nulls come first
            if first:
                yield pa.record_batch([batch.column(0).slice(0, first), *[pa.nulls(first, t) for t in (pa.string(), pa.string(), pa.int64(), pa.int64())]], out.names)
                batch, first = batch.slice(first), 0
            for i, digest in enumerate(batch.column(1).to_pylist()):
                if digest == last:
                    rows.append(rows[-1])
                    continue
                if state and state["at"] >= shard_bytes:
                    keys.append(batch.column(0).slice(first, i - first))
                    first = i
                    yield close()
                last = digest
                if not state:
                    open_()
                body = batch.column(2)[i].as_buffer()
                state["file"].write(tar_header(digest, body.size))
                state["file"].write(body)
                state["file"].write(b"\0" * (-body.size % BLOCK))
                rows.append((digest, state["at"] + BLOCK, body.size))
                state["at"] += BLOCK + body.size + -body.size % BLOCK
                state["name"].update(digest.encode())
            keys.append(batch.column(0).slice(first))
        if state:
            yield close()

    spread = F.coalesce("digest", F.xxhash64("vec_id").cast("string"))
    index = written(one.repartition(spread).sortWithinPartitions("digest").mapInArrow(run, out), "media-index")
    fs, base = pafs.FileSystem.from_uri(folder)
    for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
        if f.base_name.startswith(f".{run_id}-"):
            fs.delete_file(f.path)
    return index


def described(index: DataFrame, folder: str, *, header_bytes: int = HEADER_BYTES) -> DataFrame:
    """The index with metadata columns, from the first `header_bytes` of each payload and what further ranges its format asks for.

    A shard is opened once a partition and read in order; rows of one payload are read once.
    """
    out = T.StructType([*index.schema.fields, *T._parse_datatype_string(META_DDL).fields])
    at = [index.columns.index(c) for c in ("shard", "offset", "length")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        name = file = last = None
        for batch in batches:
            got = []
            for shard, offset, length in zip(*(batch.column(i).to_pylist() for i in at)):
                if shard is None:
                    got.append(NOTHING)
                    continue
                if shard != name:
                    if file is not None:
                        file.close()
                    name, file = shard, fs.open_input_file(f"{base}/{shard}")
                if (shard, offset) != last:
                    last = shard, offset
                    read = lambda p, n, f=file, o=offset, m=length: f.read_at(max(0, min(n, m - p)), o + p) if p < m else b""
                    head = read(0, header_bytes)
                    seen = sniff(head, lambda p, n, head=head, read=read: head[p : p + n] if p + n <= len(head) else read(p, n))
                got.append(seen)
            cols = [pa.array([g[i] for g in got], t) for i, (_, t) in enumerate(META)]
            yield pa.record_batch([*batch.columns, *cols], out.names)
        if file is not None:
            file.close()

    return index.repartition(F.coalesce("shard", F.xxhash64("vec_id").cast("string"))).sortWithinPartitions("shard", "offset").mapInArrow(run, out)


def media_columns(payloads: DataFrame, folder: str, *, shard_bytes: int = SHARD_BYTES, key: str = "vec_id", payload: str = "payload") -> DataFrame:
    """(vec_id, digest, shard, offset, length, mime, width, height, channels, bit_depth, sample_rate, samples) of each row.

    `shard` is a name under `folder`; the payload is `length` bytes from `offset` on. Equal payloads share a place. A null payload has null
    in all columns but the key; a payload of no known kind, or cut short, has null metadata where its header doesn't tell. Repeated rows get
    a row each and the key keeps its type; other columns play no part.
    """
    return described(stored(payloads, folder, shard_bytes=shard_bytes, key=key, payload=payload), folder)


def payload_at(folder: str, shard: str, offset: int, length: int) -> bytes:
    """One payload, by a range read."""
    fs, base = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{base}/{shard}") as f:
        return f.read_at(length, offset)
