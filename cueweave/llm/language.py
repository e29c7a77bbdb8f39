"""Language identification in two steps: the language's family, then one-versus-one linear SVMs within the family."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._state import map_rows
from ._vec import chunks

Pair = tuple[np.ndarray, np.ndarray]
#: Buckets for the pairs and again for the triples of bytes.
BUCKETS = 4096
#: Families of closely related languages; a language that isn't named is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
}


def family_of(lang: str) -> str:
    return next((f for f, of in FAMILIES.items() if lang in of), lang)


def _fold() -> np.ndarray:
    """Bytes of letters stay, in lower case if ASCII; all else is a space."""
    t = np.full(256, 32, np.uint8)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each text's pairs and triples of bytes, a space on either side, runs of spaces as one; offsets of the pairs by text, and letters in it.

    The triple at a place starts with the pair there; the last pair of a text has none and gets bucket 2 * BUCKETS, which weighs nothing.
    """
    n = len(off) - 1
    body = np.full(len(data) + 2 * n, 32, np.uint8)
    shift = off + 2 * np.arange(n + 1)
    body[np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, np.diff(off))] = _fold()[data]
    first = np.zeros(len(body) + 1, bool)
    first[shift] = True
    keep = (body != 32) | first[:-1]
    keep[1:] |= body[:-1] != 32
    body = body[keep]
    to = np.r_[0, np.cumsum(keep)][shift]
    letters = np.add.reduceat(np.r_[body != 32, False].astype(np.int64), to[:-1]) if n else np.zeros(0, np.int64)
    wide = body.astype(np.uint32)
    two = np.zeros(len(body), np.uint32)
    two[:-1] = wide[:-1] * 256 + wide[1:]
    three = np.zeros(len(body), np.uint32)
    three[:-2] = two[:-2] * 256 + wide[2:]
    pair = ((two * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
    triple = ((three * np.uint32(2246822519)) >> np.uint32(20)).astype(np.int64) + BUCKETS
    last = to[1:] - 1
    pair[last] = triple[last] = 2 * BUCKETS  # no gram goes over a text's end
    two_before = last - 1
    triple[two_before[two_before >= to[:-1]]] = 2 * BUCKETS
    return pair, triple, to, letters


def profiles(data: np.ndarray, off: np.ndarray) -> Pair:
    """Relative frequencies of the grams of each text (dense), and its letters."""
    pair, triple, to, letters = grams(data, off)
    out = np.zeros((len(off) - 1, 2 * BUCKETS + 1), np.float32)
    for i in range(len(out)):
        both = np.bincount(np.r_[pair[to[i] : to[i + 1]], triple[to[i] : to[i + 1]]], minlength=2 * BUCKETS + 1)
        out[i] = both / max(1, 2 * (to[i + 1] - to[i]) - 2)
    return out[:, :-1], letters


@dataclass
class Svm:
    """A linear machine: positive for `yes`, else `no`."""

    yes: str
    no: str
    weights: np.ndarray
    bias: float


@dataclass
class Model:
    families: dict[str, list[str]] = field(default_factory=dict)
    between: list[Svm] = field(default_factory=list)
    within: dict[str, list[Svm]] = field(default_factory=dict)


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 50.0, rounds: int = 120) -> tuple[np.ndarray, float]:
    """Weights and bias of least squared hinge loss with an L2 penalty, by accelerated gradient steps; y is 1 or -1, classes weigh alike."""
    scale = 1 / np.sqrt(x.mean(0) + 1e-5)
    z = np.ones((len(x), x.shape[1] + 1), np.float32)
    np.multiply(x, scale.astype(np.float32), out=z[:, :-1])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    v = np.ones(z.shape[1], np.float32)
    for _ in range(12):
        v = z.T @ (weight * (z @ v))
        top = float(np.linalg.norm(v))
        v /= max(top, 1e-12)
    step = 1 / (2 * c * top + 1)
    w = old = np.zeros(z.shape[1], np.float32)
    for t in range(rounds):
        ahead = w + (t / (t + 3)) * (w - old)
        slack = np.maximum(0, 1 - y * (z @ ahead))
        grad = ahead - 2 * c * (z.T @ (weight * y * slack))
        old, w = w, (ahead - step * grad).astype(np.float32)
    return w[:-1] * scale, float(w[-1])


def fit_arrays(x: np.ndarray, langs: list[str]) -> Model:
    """The model for profiles with known languages."""
    lang = np.array(langs, dtype=object)
    family = np.array([family_of(v) for v in langs], dtype=object)
    m = Model({str(f): sorted(set(lang[family == f])) for f in sorted(set(family))})

    def pairs(names: list[str], of: np.ndarray) -> list[Svm]:
        out = []
        for a, b in combinations(names, 2):
            rows = (of == a) | (of == b)
            some = x if rows.all() else x[rows]
            out.append(Svm(a, b, *train_svm(some, np.where(of[rows] == a, 1, -1).astype(np.float32))))
        return out

    m.between = pairs(sorted(m.families), family)
    m.within = {f: pairs(names, lang) for f, names in m.families.items()}
    return m


def lowest(labelled: DataFrame, sample: int) -> DataFrame:
    """The `sample` least different h of each lang of (lang, h). Each task sends on no more than that of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            lang, h = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
            code = lang.indices.to_numpy()
            for i, name in enumerate(lang.dictionary.to_pylist()):
                held[name] = np.unique(np.r_[held.get(name, np.zeros(0, np.int64)), h[code == i]])[:sample]
        for name, h in held.items():
            yield pa.record_batch([pa.array([name] * len(h), pa.string()), pa.array(h)], ["lang", "h"])

    few = labelled.select("lang", "h").mapInArrow(run, "lang string, h bigint").distinct()
    return few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("n") <= sample).drop("n")


def fit(docs: DataFrame, *, sample: int = 400, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Trains on at most `sample` labelled rows of each language, those whose key and text hash lowest; rows that repeat both are one.

    Rows with a null text or language, or without a letter or sign, are no examples; those with a null key are. Featurized in the executors;
    the driver gets one sparse profile a row, so what it holds is bounded by `sample` and the number of languages.
    """
    body = F.col(text).cast("string")
    labelled = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.length(F.trim(body)) > 0))
    labelled = labelled.select(body.alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(key), body, F.lit(8)).alias("h"))
    chosen = docs.sparkSession.createDataFrame(lowest(labelled, sample).collect(), "lang string, h bigint")  # of bounded length
    rows = labelled.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("text", "lang", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in chunks(batch, "text"):
                x, _ = profiles(data, off)
                at = [np.flatnonzero(r) for r in x]
                packed = [pa.array([f(r, i) for r, i in zip(x, at)], pa.binary()) for f in (lambda r, i: i.astype(np.uint16).tobytes(), lambda r, i: r[i].tobytes())]
                yield pa.record_batch([part.column(1), part.column(2), *packed], ["lang", "h", "at", "x"])

    got = sorted(rows.mapInArrow(run, "lang string, h bigint, at binary, x binary").collect(), key=lambda r: (r.lang, r.h))
    x = np.zeros((len(got), 2 * BUCKETS), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r.at, np.uint16)] = np.frombuffer(r.x, np.float32)
    langs = [r.lang for r in got]
    del got
    return fit_arrays(x, langs) if langs else Model()


OUT = [T.StructField("family", T.StringType()), T.StructField("language", T.StringType()), T.StructField("margin", T.DoubleType()), T.StructField("accepted", T.BooleanType())]


def predictor(model: Model, least: float):
    """A function from (bytes, offsets) to family, language, margin and verdict of each text."""
    svms = [*model.between, *[s for f in sorted(model.within) for s in model.within[f]]]
    table = np.zeros((2 * BUCKETS + 1, len(svms)), np.float32)
    for i, s in enumerate(svms):
        table[:-1, i] = s.weights
    bias = np.array([s.bias for s in svms])

    def vote(names: list[str], ms: list[Svm], z: np.ndarray) -> Pair:
        """Most votes, then the largest sum of margins; the margin is the least one by which the winner won."""
        if len(names) == 1:
            return np.zeros(len(z), np.int64), np.full(len(z), np.inf)
        votes, total = np.zeros((len(z), len(names))), np.zeros((len(z), len(names)))
        for i, s in enumerate(ms):
            a, b = names.index(s.yes), names.index(s.no)
            votes[:, a] += z[:, i] > 0
            votes[:, b] += z[:, i] <= 0
            total[:, a] += z[:, i]
            total[:, b] -= z[:, i]
        won = np.argmax(votes + total / (1e-9 + 2.01 * np.abs(total).max(1, keepdims=True)), axis=1)
        low = np.full(len(z), np.inf)
        for i, s in enumerate(ms):
            a, b = names.index(s.yes), names.index(s.no)
            low = np.where(won == a, np.minimum(low, z[:, i]), np.where(won == b, np.minimum(low, -z[:, i]), low))
        return won, low

    def predict(data: np.ndarray, off: np.ndarray):
        n = len(off) - 1
        pair, triple, to, letters = grams(data, off)
        z = np.zeros((n, len(svms)))
        for i in range(len(svms)):
            col = np.ascontiguousarray(table[:, i])
            both = col[pair]
            both += col[triple]
            z[:, i] = np.add.reduceat(both, to[:-1], dtype=np.float64)
        z = z / np.maximum(1, 2 * np.diff(to) - 2)[:, None] + bias
        family, language, margin = np.full(n, None, object), np.full(n, None, object), np.zeros(n)
        names = sorted(model.families)
        if names:
            won, low = vote(names, model.between, z)
            at = len(model.between)
            for f, name in enumerate(names):
                ms, rows = model.within[name], won == f
                inner, low2 = vote(model.families[name], ms, z[rows][:, at : at + len(ms)])
                family[rows] = name
                language[rows] = np.array(model.families[name], object)[inner]
                margin[rows] = np.minimum(low[rows], low2)
                at += len(ms)
        none = letters == 0
        family[none] = language[none] = None
        margin[none] = 0
        margin = np.where(np.isfinite(margin), margin, 1.0)
        return family, language, margin, ~none & (family != None) & (margin >= least)  # noqa: E711

    return predict


def identify(docs: DataFrame, model: Model | None = None, *, least: float = 0.0, sample: int = 400, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """(doc_id, family, language, margin, accepted) of each row.

    `margin` is the least by which the chosen family and language won (1 where nothing competes). A text is rejected if it has no letter
    (null, empty or all digits and signs: family and language are null), if its margin is below `least`, or if there was no labelled row to
    learn from. Repeated rows get a row each, a null key stays null, the key keeps its type, and other columns play no part. Texts count whole. A language that FAMILIES doesn't name is a
    family of its own, so labels want cleaning first where they are many: machines between families grow with their pairs.
    """
    model = fit(docs, sample=sample, text=text, lang=lang, key=key) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor(shared.value, least)
        for batch in batches:
            for part, data, off in chunks(batch, "text"):
                family, language, margin, ok = predict(data, off)
                yield pa.record_batch([part.column(0), pa.array(family, pa.string()), pa.array(language, pa.string()), pa.array(margin), pa.array(ok.astype(bool))], ["doc_id", "family", "language", "margin", "accepted"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *OUT]))


def keep_accepted(docs: DataFrame, model: Model | None = None, *, least: float = 0.0, sample: int = 400, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """The rows that `identify` accepts, with all their columns, in one pass over the table."""
    model = fit(docs, sample=sample, text=text, lang=lang, key=key) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor(shared.value, least)
        for batch in batches:
            only = pa.record_batch([batch.column(at)], ["text"])
            ok = [predict(data, off)[3].astype(bool) for _, data, off in chunks(only, "text")]
            yield batch.filter(pa.array(np.concatenate(ok))) if ok else batch

    return map_rows(docs, run, docs.schema)
