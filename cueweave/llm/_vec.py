"""Whole-text hashing over flat byte buffers, a chunk of documents at a time, without a Python object per token.

A token is a maximal run of characters that are no white space (ASCII white space and control characters, and Unicode's spaces), but for those
of scripts that are written without spaces (SCRIPTS): each of them is a token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer document makes a chunk of its own.
CHUNK = 1 << 20
#: Texts worked on at once.
CHUNK_TEXTS = 2048
U = np.uint64
#: Code points beyond ASCII that are white space, and those of scripts written without spaces, with the same as parts of a regular expression.
SPACES = ((0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
SCRIPTS = ((0xE00, 0x109F), (0x1780, 0x17FF), (0x3040, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FFFF))
SPACE_CLASS, SCRIPT_CLASS = ("".join(rf"\x{{{a:04X}}}-\x{{{b:04X}}}" for a, b in of) for of in (SPACES, SCRIPTS))
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def chunks(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch, with the bytes of their texts and each text's offsets; a null text is empty."""
    col = batch.column(batch.schema.get_field_index(text))
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(col):
        b = min(a + CHUNK_TEXTS, max(a + 1, int(np.searchsorted(off, off[a] + CHUNK, side="right")) - 1), len(col))
        yield batch.slice(a, b - a), data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def powers(n: int, base: int = BASE) -> np.ndarray:
    p = np.full(n + 1, base, U)
    p[:1] = 1
    return np.cumprod(p, dtype=U)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Powers:
    """Powers of the base and of its inverse, kept for the length of a task."""

    def __init__(self) -> None:
        self.p = self.q = np.zeros(0, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.p) <= n:
            n = max(n, CHUNK + 1)
            self.p, self.q = powers(n), powers(n, INVERSE)
        return self.p, self.q


def _within(code: np.ndarray, ranges: tuple[tuple[int, int], ...]) -> np.ndarray:
    return np.logical_or.reduce([(code >= a) & (code <= b) for a, b in ranges])


def token_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each token, and the offsets of each text's tokens; the texts are UTF-8."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    word = np.zeros(n + 2, bool)
    word[1:-1] = data > 32
    inner = word[1:-1]
    two = np.flatnonzero(data[:-1] == 0xC2)
    two = two[_within(data[two + 1], SPACES[:2])]
    inner[two] = inner[two + 1] = False
    for lead, size in ((data[:-2] & 0xF0) == 0xE0, 3), ((data[:-3] & 0xF8) == 0xF0, 4):
        at = np.flatnonzero(lead)
        if not len(at):
            continue
        code = data[at].astype(np.int64) & (0xFF >> (size + 1))
        for i in range(1, size):
            code = code << 6 | (data[at + i] & 0x3F)
        blank, alone = at[_within(code, SPACES)], at[_within(code, SCRIPTS)]
        for i in range(size):
            inner[blank + i] = False
        edge[alone] = edge[alone + size] = True
    starts = np.flatnonzero(inner & (~word[:-2] | edge[:-1]))
    ends = np.flatnonzero(inner & (~word[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, pw: Powers) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    p, q = pw.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * p[: len(data)], out=total[1:], dtype=U)
    return mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(U))


def window_hash(h: np.ndarray, k: int, pw: Powers) -> np.ndarray:
    """Hash of the k items from each place on; there are len(h) - k + 1 of them."""
    if len(h) < k:
        return np.zeros(0, U)
    p, q = pw.upto(len(h) + 1)
    total = np.zeros(len(h) + 1, U)
    np.cumsum(h * p[: len(h)], out=total[1:], dtype=U)
    return mix((total[k:] - total[:-k]) * q[: len(h) - k + 1] + U(k))


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the least (leftmost, if several) of the w items from each place on."""
    at = np.arange(len(h), dtype=np.int64)
    low, width = h, 1
    while width < w:
        step = min(width, w - width)
        a, b = low[:-step], low[step:]
        less = b < a
        low, at = np.where(less, b, a), np.where(less, at[step:], at[:-step])
        width += step
    return at
