"""Benchmark decontamination by templates: typed placeholders for what a question can vary, and a check that slots vary consistently."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._state import written
from ._vec import Powers, U, chunks, mix, span_hash, token_bounds, window_hash

#: Words of a window; an item of fewer words is one window. An item of fewer than LEAST is found only where it is the whole document.
WINDOW = 13
LEAST = 5
#: Share of plain words from which on a window's template counts by itself, and from which on it counts beside others: on a line of SEVERAL
#: windows, or of as many as the item has.
FIRM, WEAK, SEVERAL = 0.6, 0.3, 3
#: Most window hashes of the benchmark that are broadcast as they are to thin out the documents' windows before the join; of more, bits are.
BROADCAST_HASHES = 2_000_000
#: Bits of that filter, at most; past that it lets more through and leaves more to the join.
FILTER_BITS = 1 << 29
UNITS = tuple("kg g mg lb lbs oz km m cm mm mi mile miles ft feet foot inch inches yd yards l ml litre litres liter liters gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent dollar dollars euro euros pound pounds cent cents usd eur gbp degree degrees c f mph kmh w kw kwh v hz gb mb kb".split())
NUMBER, UNIT, NAME, QUANTITY = 1, 2, 3, 4


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    punct = np.zeros(256, bool)
    for a, b in ((33, 48), (58, 65), (91, 97), (123, 127)):
        punct[a:b] = True
    digit = np.zeros(256, bool)
    digit[48:58] = True
    numeric = digit.copy()
    numeric[[ord(c) for c in ".,:/-"]] = True
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = letter[128:] = True
    return punct, digit, numeric, letter


def words(data: np.ndarray, off: np.ndarray, pw: Powers, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, kind (0 for a plain word) and text of each word, and the offsets of each text's words.

    A word is a token without ASCII signs at its ends, in lower case (ASCII and Latin-1); tokens of signs alone are none. A number has only
    digits and . , : / - ; a quantity is a number with letters on its end; a unit is one of UNITS after a number; a name begins with a
    capital (ASCII or Latin-1), be it for the start of a sentence.
    """
    punct, digit, numeric, letter = _tables()
    n = len(data)
    starts, ends, tok = token_bounds(data, off)
    solid = np.flatnonzero((data > 32) & ~punct[data])
    a = np.searchsorted(solid, starts)
    b = np.searchsorted(solid, ends)
    some = b > a
    starts, ends = solid[a[some]], solid[b[some] - 1] + 1
    tok = np.r_[0, np.cumsum(some)][tok]
    low = data.copy()
    upper = (data >= 65) & (data <= 90)
    low[upper] += 32
    latin = np.zeros(n, bool)
    if n:
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[latin] += 32
    h = span_hash(low, starts, ends, pw)
    count = lambda m: np.diff(np.r_[0, np.cumsum(m)][np.stack([starts, ends])], axis=0)[0]
    size = ends - starts
    has_digit = count(digit[data]) > 0
    number = has_digit & (count(numeric[data]) == size)
    lead = digit[data[starts]] if len(starts) else np.zeros(0, bool)
    tail = letter[data[ends - 1]] if len(starts) else np.zeros(0, bool)
    quantity = lead & tail & (count(numeric[data]) + count(letter[data]) == size)
    capital = np.zeros(len(starts), bool)
    if len(starts):
        capital = upper[starts] | ((size > 1) & np.r_[latin[1:], False][starts])
    kind = np.where(number, NUMBER, np.where(quantity, QUANTITY, np.where(capital, NAME, 0)))
    after = np.zeros(len(starts), bool)
    after[1:] = number[:-1]
    first = tok[:-1][tok[:-1] < len(starts)]
    after[first] = False
    kind = np.where(after & np.isin(h, units) & ~number & ~quantity, UNIT, kind)
    return h, kind, np.repeat(np.arange(len(off) - 1), np.diff(tok)), tok


def unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    starts, ends, _ = token_bounds(data, np.array([0, len(data)]))
    return np.sort(span_hash(data, starts, ends, Powers()))


def window_hashes(h: np.ndarray, kind: np.ndarray, n: int, pw: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the n words from each place on: the hash of the words, that of their template, and how many are plain."""
    literal = mix((window_hash(h, n, pw) ^ U(0xD6E8FEB86659FD93)) + U(n))
    template = mix(window_hash(np.where(kind > 0, U(0x51ED270B9F652295) * kind.astype(U), h), n, pw) + U(n))
    plain = np.r_[0, np.cumsum(kind == 0)]
    return literal, template, plain[n:] - plain[:-n] if len(h) >= n else plain[:0]


SLOTS = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("v", T.LongType())]))
SLOT_TYPE = pa.list_(pa.struct([("at", pa.int32()), ("v", pa.int64())]))


class Filter:
    """Which hashes may be among the benchmark's: exactly, while these are few, else by one bit each."""

    def __init__(self, hashes: np.ndarray | None, bits: np.ndarray) -> None:
        self.hashes, self.bits = hashes, bits

    def among(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that pass."""
        at = h & U(64 * len(self.bits) - 1)
        p = np.flatnonzero(self.bits[(at >> U(6)).astype(np.int64)] >> (at & U(63)) & U(1))
        if self.hashes is None:
            return p
        return p[self.hashes[np.minimum(np.searchsorted(self.hashes, h[p]), len(self.hashes) - 1)] == h[p]] if len(self.hashes) else p[:0]


def benchmark_filter(bench: DataFrame) -> Filter:
    """The filter of the hashes of a table of windows. Its bits are put together in the executors."""
    h = bench.select("h").distinct()
    n = h.count()
    size = max(1 << 16, min(FILTER_BITS, 1 << (64 * n).bit_length()))
    words = h.select(F.shiftright(F.col("h").bitwiseAND(F.lit(size - 1)), 6).alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bits = np.zeros(size // 64, U)
    bits[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(U)
    return Filter(np.sort(h.toPandas()["h"].to_numpy(np.int64).view(U)) if n <= BROADCAST_HASHES else None, bits)


def _rows(ids: pa.Array, p: np.ndarray, at: np.ndarray, n: int, of: np.ndarray, literal: bool, weak: np.ndarray, hashes: np.ndarray, h: np.ndarray, kind: np.ndarray) -> list[pa.Array]:
    """id, at, n, of, literal, weak, h, slots of the windows from the places p on; slots hold where in the window, and the word."""
    if literal:
        slots = pa.nulls(len(p), SLOT_TYPE)
    else:
        k = kind[p[:, None] + np.arange(n)] > 0
        row, col = np.nonzero(k)
        flat = pa.StructArray.from_arrays([pa.array(col.astype(np.int32)), pa.array(h[p[row] + col].view(np.int64))], fields=list(SLOT_TYPE.value_type))
        slots = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(k.sum(1))].astype(np.int32)), flat)
    return [ids, pa.array(at.astype(np.int32)), pa.array(np.full(len(p), n, np.int32)), pa.array(of.astype(np.int32)), pa.array(np.full(len(p), literal)), pa.array(weak), pa.array(hashes[p].view(np.int64)), slots]


def _windows(table: DataFrame, key: str, text: str, lengths: list[int] | None, hits) -> DataFrame:
    """Windows (id, at, n, of, literal, weak, h, slots) of a table: of the given lengths, those that pass the filter; without lengths, of each
    text's own length or WINDOW. `of` is how many windows the text has. Each window stands as its words and, if slots are in it and enough
    plain words, as its template."""
    units = unit_hashes()
    src = table.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    kinds = [("at", T.IntegerType()), ("n", T.IntegerType()), ("of", T.IntegerType()), ("literal", T.BooleanType()), ("weak", T.BooleanType()), ("h", T.LongType()), ("slots", SLOTS)]
    out = T.StructType([src.schema["id"], *[T.StructField(*k) for k in kinds]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pw = Powers()
        for batch in batches:
            for part, data, off in chunks(batch, "text"):
                h, kind, doc, tok = words(data, off, pw, units)
                size = np.diff(tok)
                for n in lengths if lengths is not None else np.unique(np.minimum(size[size > 0], WINDOW)).tolist():
                    literal, template, plain = window_hashes(h, kind, n, pw)
                    for hashes, fit in (literal, None), (template, (plain < n) & (plain >= WEAK * n)):
                        p = hits.value.among(hashes) if hits is not None else np.arange(len(hashes))
                        p = p[(p + n <= tok[1:][doc[p]]) & (fit is None or fit[p])]
                        if lengths is None:
                            p = p[np.minimum(size, WINDOW)[doc[p]] == n]
                        if n < LEAST:
                            p = p[(size[doc[p]] == n) & (fit is None)]
                        for a in range(0, len(p), 1 << 15):
                            q = p[a : a + (1 << 15)]
                            cols = _rows(part.column(0).take(pa.array(doc[q])), q, q - tok[doc[q]], n, size[doc[q]] - n + 1, fit is None, plain[q] < FIRM * n, hashes, h, kind)
                            yield pa.record_batch(cols, out.names)

    return src.mapInArrow(run, out)


def matches(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, windows, exact) of each document that holds a window of a benchmark item, numbers, names and units aside.

    A window is held as its words, whatever their case, or as its template. Windows that lie on one line (the same distance from the item's
    start) count together if their slots are consistent: what stands in a slot of the item always goes with one thing in the document, and
    the other way round; of a line that isn't consistent, the windows that are equal word for word count. A template with few plain words
    (under FIRM, from WEAK on) counts where SEVERAL windows of the line are found, or all that the item has; one with fewer counts only word
    for word. `windows` is how many; `exact` is whether some line has every slot as in the item.

    An item of fewer than LEAST words matches the documents that are nothing else, word for word. Rows with a null key and texts without a
    word match nothing; repeated rows count once. Keys keep their types, other columns play no part.
    """
    bench = written(_windows(benchmark, item, item_text, None, None), "benchmark-windows")
    lengths = sorted(r[0] for r in bench.select("n").distinct().collect())
    hits = docs.sparkSession.sparkContext.broadcast(benchmark_filter(bench))
    found = _windows(docs, key, text, lengths, hits).select(F.col("id").alias("doc_id"), F.col("at").alias("p"), "n", "literal", "weak", "h", F.col("slots").alias("ds"))
    both = found.join(bench.select(F.col("id").alias("item_id"), F.col("at").alias("q"), "n", "of", "literal", "h", F.col("slots").alias("bs")), ["h", "n", "literal"])
    pair = F.zip_with("ds", "bs", lambda d, b: F.struct(b["v"].alias("b"), d["v"].alias("d")))
    lines = both.groupBy("doc_id", "item_id", (F.col("p") - F.col("q")).alias("line")).agg(
        F.count_distinct("p").alias("all"),
        F.count_distinct(F.when(F.col("literal") | ~F.col("weak"), F.col("p"))).alias("firm"),
        F.count_distinct(F.when(F.col("literal"), F.col("p"))).alias("same"),
        F.min(F.least("of", F.lit(SEVERAL))).alias("need"),
        F.array_distinct(F.flatten(F.collect_set(pair))).alias("s"),
    )
    one = F.size("s")
    consistent = (F.size(F.array_distinct("s.b")) == one) & (F.size(F.array_distinct("s.d")) == one)
    n = F.when(~consistent, F.col("same")).when(F.col("all") >= F.col("need"), F.col("all")).otherwise(F.col("firm"))
    lines = lines.withColumn("n", n).filter("n > 0")
    return lines.groupBy("doc_id", "item_id").agg(F.sum("n").alias("windows"), F.max(F.forall("s", lambda x: x["b"] == x["d"])).alias("exact"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """The rows of `docs` that match no item, with all their columns; rows with a null key stay."""
    bad = matches(docs, benchmark, text=text, key=key, **how).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs[key] == bad["_bad"], "left_anti")
