"""Quality classifier by co-training: one view reads the text, the other the metadata, and each teaches the other what it is sure of."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._state import drop, written
from ._vec import Powers, U, chunks, mix, span_hash, token_bounds

#: Labelled rows that the models learn from, those whose keys hash lowest.
LABELLED = 4000
ROUNDS = 5
#: Share of all unlabelled documents that a view gives the other as pseudo-labels, more by as much in each round, of each class by its share;
#: the least surety of one; and what all of them weigh at the end, as times the labelled rows.
GIVEN, SURE, WEIGHT = 0.01, 0.95, 1.0
#: Newton steps of a round, from weights of 0.
STEPS = 5
#: Width of the steps of log odds in which documents are counted by surety, and their number.
GRAIN, GRAINS = 0.02, 2000
#: Partial sums that the driver gets of a pass over the documents.
FAN = 16
BUCKETS = 256
STATS = 24
NAMES, LANGS, SIZES = 64, 16, 20


def _classes() -> np.ndarray:
    """(256, 8): upper, lower, digit, space, newline, sentence sign, symbol, beyond ASCII."""
    t = np.zeros((256, 8), np.float32)
    b = np.arange(256)
    t[65:91, 0] = t[97:123, 1] = t[48:58, 2] = 1
    t[b <= 32, 3] = t[10, 4] = 1
    for c in b".,;:!?'\"()-":
        t[c, 5] = 1
    for c in b"#$%&*@/\\|<>=+~^_`{}[]":
        t[c, 6] = 1
    t[128:, 7] = 1
    return t


def text_features(data: np.ndarray, off: np.ndarray, pw: Powers) -> np.ndarray:
    """(n, STATS + BUCKETS): shares of kinds of bytes, lengths, repetition of words and lines, and hashed words by relative frequency."""
    n = len(off) - 1
    out = np.zeros((n, STATS + BUCKETS), np.float32)
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    counts = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256).astype(np.float32)
    out[:, :8] = counts @ _classes() / np.maximum(size, 1)[:, None]
    starts, ends, tok = token_bounds(data, off)
    owner = np.repeat(np.arange(n), np.diff(tok))
    words = np.diff(tok)
    many = np.maximum(words, 1)
    length = (ends - starts).astype(np.float32)
    mean = np.bincount(owner, length, n) / many
    out[:, 8] = np.log1p(size)
    out[:, 9] = np.log1p(words)
    out[:, 10] = mean / 10
    out[:, 11] = np.sqrt(np.maximum(0, np.bincount(owner, length**2, n) / many - mean**2)) / 10
    h = span_hash(data, starts, ends, pw)
    out[:, 12] = _distinct(h, owner, n) / many
    last = data[ends - 1] if len(ends) else data[:0]
    first = data[starts] if len(starts) else data[:0]
    kinds = _classes()
    out[:, 13] = np.bincount(owner, kinds[last, 6], n) / many
    out[:, 14] = np.bincount(owner, kinds[last, 5], n) / many
    out[:, 15] = np.bincount(owner, kinds[first, 0], n) / many
    out[:, 16] = np.bincount(owner, length == 1, n) / many
    out[:, 17] = np.bincount(owner, length > 20, n) / many
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.r_[off[:-1][size > 0], breaks + 1])
    line_start = line_start[line_start < len(data)]
    line_end = np.r_[line_start[1:], len(data)]
    lines_of = np.searchsorted(off, line_start, side="right") - 1
    line_end = np.minimum(line_end, off[1:][lines_of])
    lines = np.bincount(lines_of, minlength=n)
    out[:, 18] = np.log1p(lines)
    out[:, 19] = _distinct(span_hash(data, line_start, line_end, pw), lines_of, n) / np.maximum(lines, 1)
    run = np.r_[False, h[1:] == h[:-1]] if len(h) else np.zeros(0, bool)
    out[:, 20] = np.bincount(owner, run, n) / many
    pair = h[1:] * U(3) + h[:-1] if len(h) else h
    inside = owner[1:] == owner[:-1] if len(h) else np.zeros(0, bool)
    out[:, 21] = _distinct(pair[inside], owner[1:][inside], n) / many
    out[:, 22] = size == 0
    out[:, 23] = words == 1
    bucket = (mix(h) >> U(56)).astype(np.int64)
    out[:, STATS:] = np.bincount(owner * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS) / many[:, None]
    return out


def _distinct(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each owner has."""
    key = np.sort((owner.astype(U) << U(48)) | (h >> U(16)))
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    return np.bincount((key[new] >> U(48)).astype(np.int64), minlength=n)


def meta_columns(source: str, lang: str, length: str, names: list[str]) -> list:
    """Places of the metadata's one-hot features: hashed source, hashed language, length by powers of two; a null has a place of its own."""
    spot = lambda c, k: F.when(F.col(c).isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(k - 1))).cast("int") if c in names else F.lit(0)
    size = F.when(F.col(length).isNull() | (F.col(length) < 1), 0).otherwise(F.least(F.lit(SIZES - 1), 1 + F.floor(F.log2(F.col(length).cast("double"))))).cast("int") if length in names else F.lit(0)
    return [spot(source, NAMES).alias("m0"), spot(lang, LANGS).alias("m1"), size.alias("m2")]


def meta_features(m: list[np.ndarray]) -> np.ndarray:
    n = len(m[0])
    out = np.zeros((n, NAMES + LANGS + SIZES), np.float32)
    for col, at in zip(m, (0, NAMES, NAMES + LANGS)):
        out[np.arange(n), at + col] = 1
    return out


@dataclass
class View:
    """A logistic model on standardised features, with the slope and shift of its calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        w = self.scale * self.weights
        return x @ w + (self.bias - self.mean @ w)

    def standard(self, x: np.ndarray) -> np.ndarray:
        """The standardised features with a column of ones."""
        return np.hstack([(x - self.mean) * self.scale, np.ones((len(x), 1))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.shift


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


PENALTY = 3.0


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 12) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton steps with an L2 penalty on the weights; rows whose y is nan are left out."""
    x, y = x[~np.isnan(y)], y[~np.isnan(y)]
    z = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-3
    for _ in range(steps):
        g, curve = newton_sums(z, y, np.ones(len(y)), w)
        step = np.linalg.solve(curve + np.diag(ridge), g + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w[:-1], float(w[-1])


Arrays = list[np.ndarray]
#: Runs a function of (text features, metadata features) on all unlabelled documents, in pieces, and adds up what it gives.
Total = Callable[[Callable[[np.ndarray, np.ndarray], Arrays]], Arrays]


@dataclass
class Model:
    text: View | None
    meta: View | None
    prior: float

    def score(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability by text, by metadata and by both: log odds add up over what the prior gives, the views being taken as independent given the class."""
        if self.text is None or self.meta is None:
            p = np.full(len(xt), float(sigmoid(np.array(self.prior))))
            return p, p, p
        a, b = self.text.logit(xt), self.meta.logit(xm)
        return sigmoid(a), sigmoid(b), sigmoid(a + b - self.prior)


EDGE = float(np.log(SURE / (1 - SURE)))


def surety(z: np.ndarray) -> np.ndarray:
    """How many log odds are at least as sure as SURE, by steps of surety: first for class 1, then for class 0."""
    place = np.floor((np.abs(z) - EDGE) / GRAIN)
    ok = place >= 0
    at = np.minimum(place[ok], GRAINS - 1).astype(np.int64) + GRAINS * (z[ok] < 0)
    return np.bincount(at, minlength=2 * GRAINS).astype(float)


def bound(counts: np.ndarray, quota: float) -> float:
    """The least step of log odds at and above which there are no more than the quota, or else the surest that there is."""
    above = np.cumsum(counts[::-1])[::-1]
    some = np.flatnonzero(counts)
    if not len(some):
        return np.inf
    within = np.flatnonzero(above <= max(quota, above[some[-1]]))
    return EDGE + GRAIN * int(within[0])


def newton_sums(z: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> Arrays:
    """Gradient and curvature of the weighted logistic loss at the weights w; z has a column of ones."""
    p = sigmoid(z @ w)
    return [z.T @ (weight * (p - y)), (z * (weight * p * (1 - p))[:, None]).T @ z]


def calibrate(view: View, x: np.ndarray, y: np.ndarray) -> None:
    """Slope and shift that make the view's log odds true of these rows, where they are of two classes."""
    if len(set(y)) == 2:
        w, b = fit_logistic(view.raw(x)[:, None], y, penalty=0.1)
        view.slope, view.shift = max(float(w[0]), 0.0), b


def learn(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, total: Total, rounds: int = ROUNDS) -> Model:
    """Co-training on labelled rows (two views and classes) and all unlabelled documents; every third labelled row is kept for the calibration.

    In a round each view's calibrated log odds of all unlabelled documents are counted by surety, its surest ones of each class become
    pseudo-labels of the other view, and that is fitted anew to them and the labelled rows. A view that can be sure of nothing gives nothing.
    Only counts and sums come back from the documents.
    """
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    held = np.arange(len(y)) % 3 == 2
    if len(set(y[~held])) < 2:
        return Model(None, None, prior)
    known = {"text": xt.astype(np.float64), "meta": xm.astype(np.float64)}
    with np.errstate(over="ignore"):
        sums = total(lambda t, m: [np.array([float(len(t))]), *[f(x.astype(np.float64)) for x in (t, m) for f in (lambda x: x.sum(0), lambda x: (x**2).sum(0))]])
    n = sums[0][0]
    views: dict[str, View] = {}
    for v, (one, two) in zip(known, (sums[1:3], sums[3:5])):
        x = known[v]
        mean = (one + x.sum(0)) / (n + len(x))
        std = np.sqrt(np.maximum(0, (two + (x**2).sum(0)) / (n + len(x)) - mean**2))
        scale = np.where(std > 1e-7, 1 / np.maximum(std, 1e-7), 0)
        views[v] = View(mean, scale, *fit_logistic((x - mean) * scale, np.where(held, np.nan, y)))
        calibrate(views[v], x[held], y[held])
    share = float(y.mean())
    train = int((~held).sum())
    for r in range(rounds if n else 0):
        a, b = views["text"], views["meta"]
        counts = total(lambda t, m, a=a, b=b: [surety(a.logit(t)), surety(b.logit(m))])
        quota = GIVEN * (r + 1) * n
        cut = {v: (bound(c[:GRAINS], quota * share), bound(c[GRAINS:], quota * (1 - share))) for v, c in zip(("text", "meta"), counts)}
        new = {v: View(w.mean, w.scale, np.zeros_like(w.weights), 0.0) for v, w in views.items()}
        for _ in range(STEPS):

            def sums_of(t: np.ndarray, m: np.ndarray, a=a, b=b, new=dict(new), cut=cut) -> Arrays:
                out: Arrays = []
                for x, pupil, taught, (yes, no) in ((t, new["text"], b.logit(m), cut["meta"]), (m, new["meta"], a.logit(t), cut["text"])):
                    at = np.flatnonzero((taught >= yes - 1e-9) | (taught <= -no + 1e-9))
                    out += [np.array([float(len(at))]), *newton_sums(pupil.standard(x[at]), (taught[at] > 0).astype(float), np.ones(len(at)), np.r_[pupil.weights, pupil.bias])]
                return out

            got = total(sums_of)
            for v, (count, grad, curve) in zip(("text", "meta"), (got[:3], got[3:])):
                view = new[v]
                w = np.r_[view.weights, view.bias]
                each = WEIGHT * (r + 1) / rounds * train / count[0] if count[0] else 0.0
                own = newton_sums(view.standard(known[v][~held]), y[~held], np.ones(train), w)
                ridge = np.r_[np.full(len(w) - 1, PENALTY), 1e-3]
                w = w - np.linalg.solve(own[1] + each * curve + np.diag(ridge), own[0] + each * grad + ridge * w)
                new[v] = View(view.mean, view.scale, w[:-1], float(w[-1]))
        views = new
        for v in views:
            calibrate(views[v], known[v][held], y[held])
    return Model(views["text"], views["meta"], prior)


def co_train(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, pt: np.ndarray, pm: np.ndarray, rounds: int = ROUNDS) -> Model:
    """`learn` on arrays: labelled rows, and the unlabelled ones pt and pm."""
    return learn(xt, xm, y, lambda f: f(pt, pm), rounds)


def _featured(rows: DataFrame) -> DataFrame:
    """The rows with x, the features of their column text as bytes, in its place; text comes first."""
    out = T.StructType([*rows.schema.fields[1:], T.StructField("x", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pw = Powers()
        for batch in batches:
            for part, data, off in chunks(batch, "text"):
                x = text_features(data, off, pw)
                yield pa.record_batch([*part.columns[1:], pa.array([r.tobytes() for r in x], pa.binary())], out.names)

    return rows.mapInArrow(run, out)


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Text features and metadata features of a batch of columns m0, m1, m2 and x."""
    x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(batch.num_rows, STATS + BUCKETS)
    return x, meta_features([batch.column(f"m{i}").to_numpy() for i in range(3)])


def table_total(rows: DataFrame) -> Total:
    """`Total` over a table of columns m0, m1, m2 and x: each task adds up its own, FAN tasks add up those, and the driver the rest."""
    rows = rows.select("m0", "m1", "m2", "x")

    def total(f: Callable[[np.ndarray, np.ndarray], Arrays]) -> Arrays:
        empty = f(np.zeros((0, STATS + BUCKETS), np.float32), np.zeros((0, NAMES + LANGS + SIZES), np.float32))
        shapes = [e.shape for e in empty]
        edges = np.cumsum([0, *[e.size for e in empty]])

        def flat(arrays: Arrays) -> np.ndarray:
            return np.concatenate([a.ravel() for a in arrays]).astype(np.float64)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            out = np.zeros(edges[-1])
            for batch in batches:
                for a in range(0, batch.num_rows, 8192):
                    out += flat(f(*_unpacked(batch.slice(a, 8192))))
            yield pa.record_batch([pa.array([TaskContext.get().partitionId() % FAN]), pa.array([out.tobytes()], pa.binary())], ["k", "v"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(edges[-1])
            for batch in batches:
                for v in batch.column(1):
                    out += np.frombuffer(v.as_buffer(), np.float64)
            yield pa.record_batch([pa.array([out.tobytes()], pa.binary())], ["v"])

        got = rows.mapInArrow(each, "k bigint, v binary").repartition(FAN, "k").mapInArrow(add, "v binary").collect()
        out = np.sum([np.frombuffer(r.v, np.float64) for r in got], axis=0)
        return [out[a:b].reshape(s) for a, b, s in zip(edges, edges[1:], shapes)]

    return total


def _rows(docs: DataFrame, text: str, key: str, source: str, lang: str, length: str) -> DataFrame:
    return docs.select(F.col(text).cast("string").alias("text"), F.col(key).alias("doc_id"), *meta_columns(source, lang, length, docs.columns))


def featurized(docs: DataFrame, labels: DataFrame, *, labelled: int = LABELLED, text: str = "text", key: str = "doc_id", source: str = "source", lang: str = "lang", length: str = "n_chars", label: str = "quality") -> DataFrame:
    """(doc_id, m0, m1, m2, y, x) of each row of `docs`, written; y is the class of at most `labelled` labelled documents, null for all others."""
    order = F.xxhash64(F.col("_id"), F.lit(9))
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_id")).agg((F.max(F.col(label)) > 0).cast("double").alias("y"))
    some = known.orderBy(order, "_id").limit(labelled).collect()  # of bounded length
    kind = T.StructType([T.StructField("_id", labels.schema[key].dataType), T.StructField("y", T.DoubleType())])
    chosen = docs.sparkSession.createDataFrame([tuple(r) for r in some], kind)
    rows = _rows(docs, text, key, source, lang, length)
    rows = rows.join(F.broadcast(chosen), rows["doc_id"] == chosen["_id"], "left").select(*[rows[c] for c in rows.columns], "y")
    return written(_featured(rows), "features")


def fit_table(table: DataFrame, rounds: int = ROUNDS) -> Model:
    """Learns from what `featurized` gives. A labelled document with several rows is one example, that whose features are least as bytes."""
    got = table.filter("y is not null").groupBy("doc_id").agg(F.min(F.struct("x", "m0", "m1", "m2", "y")).alias("r")).select("r.*", F.xxhash64("doc_id").alias("h")).collect()
    if not got:
        return Model(None, None, 0.0)
    got = sorted(got, key=lambda r: (r.h, bytes(r.x)))
    xt = np.frombuffer(b"".join(bytes(r.x) for r in got), np.float32).reshape(len(got), -1)
    xm = meta_features([np.array([r[f"m{i}"] for r in got]) for i in range(3)])
    return learn(xt, xm, np.array([r.y for r in got]), table_total(table.filter("y is null")), rounds)


def fit(docs: DataFrame, labels: DataFrame, *, rounds: int = ROUNDS, **how) -> Model:
    """Learns from at most `labelled` labelled documents and from all others."""
    table = featurized(docs, labels, **how)
    model = fit_table(table, rounds)
    drop(table)
    return model


def scored(
    docs: DataFrame, labels: DataFrame, model: Model | None = None, *, least: float = 0.5, rounds: int = ROUNDS, labelled: int = LABELLED, text: str = "text", key: str = "doc_id", source: str = "source", lang: str = "lang", length: str = "n_chars", label: str = "quality"
) -> DataFrame:
    """(doc_id, p_text, p_meta, score, accepted) of each row; accepted is a score of at least `least`.

    A null text counts as empty, null or missing metadata as a value of its own. Where the labels are of one class or none, all scores are
    the labels' share of good ones (one half without any). A document with several labels has the largest, one with several rows is one
    example. Repeated rows get a row each, a null key stays null and the key keeps its type; other columns play no part. Texts count whole,
    and all documents that are not among the labelled ones are unlabelled examples.
    """
    if model is None:
        table = featurized(docs, labels, labelled=labelled, text=text, key=key, source=source, lang=lang, length=length, label=label)
        model = fit_table(table, rounds)
    else:
        table = _featured(_rows(docs, text, key, source, lang, length))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    table = table.select("doc_id", "m0", "m1", "m2", "x")
    kinds = [("p_text", T.DoubleType()), ("p_meta", T.DoubleType()), ("score", T.DoubleType()), ("accepted", T.BooleanType())]
    out = T.StructType([table.schema["doc_id"], *[T.StructField(*k) for k in kinds]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                a, b, both = shared.value.score(*_unpacked(part))
                yield pa.record_batch([part.column(0), pa.array(a), pa.array(b), pa.array(both), pa.array(both >= least)], out.names)

    return table.mapInArrow(run, out)
