import numpy as np

from cueweave.llm import quality as Q
from cueweave.llm._vec import Powers


def auc(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    n = y.sum()
    return (rank[y > 0].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = Q.scored(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").toPandas()
    y = got.quality.to_numpy()
    assert auc(y, got.score.to_numpy()) > 0.9
    assert ((got.score >= 0.5) == (y == 1)).mean() > 0.9
    assert abs(got.score.mean() - y.mean()) < 0.05  # calibrated


def test_co_training_helps_the_weak_view():
    rng = np.random.default_rng(1)
    y = (rng.random(6000) < 0.5).astype(float)
    a = (y[:, None] * 2 - 1) * 1.5 + rng.normal(size=(6000, 3))
    b = (y[:, None] * 2 - 1) * 0.15 + rng.normal(size=(6000, 60))
    few, test = slice(0, 45), slice(3000, None)
    alone = Q.co_train(a[few], b[few], y[few], a[:0], b[:0])
    both = Q.co_train(a[few], b[few], y[few], a[45:3000], b[45:3000])
    acc = lambda m: ((m.score(a[test], b[test])[1] > 0.5) == (y[test] > 0)).mean()
    assert acc(both) > acc(alone) + 0.01
    assert ((both.score(a[test], b[test])[2] > 0.5) == (y[test] > 0)).mean() > 0.97


def test_features_of_one_text():
    t = "Ab cd cd.\nAb cd cd.\nx 12 é#"
    data = np.frombuffer(t.encode(), np.uint8)
    f = Q.text_features(data, np.array([0, len(data)]), Powers())[0]
    w = t.split()
    assert np.isclose(f[0], 2 / len(data)) and np.isclose(f[2], 2 / len(data)) and np.isclose(f[6], 1 / len(data))
    assert np.isclose(f[12], len(set(w)) / len(w)) and np.isclose(f[19], 2 / 3) and np.isclose(f[18], np.log1p(3))
    assert np.isclose(f[Q.STATS :].sum(), 1)


def test_edges(spark):
    d = [(i, ("good words here. " if i % 2 else "### $$$ ") * (1 + i % 5), "en", "s", i, 1) for i in range(60)]
    d += [(None, "good words here.", None, None, None, None), (100, None, "en", "s", 0, 1), (101, "", None, "s", -3, 1), (102, "good words " * 100000, "en", None, 9, 1), (3, d[3][1], "en", "s", 3, 1)]
    docs = spark.createDataFrame(d, "doc_id bigint, text string, lang string, source string, n_chars bigint, score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (5, None), (5, 0)], "doc_id bigint, quality int")
    got = Q.scored(docs, labels).collect()
    assert len(got) == 65 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[i].accepted == (i % 2 == 1) for i in range(40, 60))
    assert by[None].accepted and by[102].accepted
    one = Q.scored(docs, labels.filter("quality = 1")).collect()
    assert len({round(r.score, 9) for r in one}) == 1
    assert {r.score for r in Q.scored(docs, labels.limit(0)).collect()} == {0.5}
    assert Q.scored(docs.limit(0), labels).count() == 0
    bare = Q.scored(docs.select("doc_id", "text"), labels).collect()
    assert len(bare) == 65


def plain_fit(x, y, weight, penalty, steps, stop=0.0):
    """Newton's method for one row after another."""
    z = np.c_[x, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    ridge = np.diag([penalty] * (len(w) - 1) + [1e-3])
    for _ in range(steps):
        g, h = ridge @ w, ridge.copy()
        for row, label, u in zip(z, y, weight):
            p = 1 / (1 + np.exp(-np.clip(row @ w, -40, 40)))
            g += u * (p - label) * row
            h += u * p * (1 - p) * np.outer(row, row)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < stop:
            break
    return w


def plain_co_training(x, y, pool, rounds):
    """The scores of (labelled, pool) by the definition; x and pool have two views each."""
    held = np.arange(len(y)) % 3 == 2
    share, prior = y.mean(), np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    every = [np.vstack(p).astype(float) for p in zip(x, pool)]
    spread = [e.std(0) for e in every]
    std = [lambda v, m=e.mean(0), s=s: np.where(s > 1e-7, (v - m) / np.maximum(s, 1e-7), 0) for e, s in zip(every, spread)]
    x, pool = [f(v) for f, v in zip(std, x)], [f(v) for f, v in zip(std, pool)]

    def calibrated(w, v):
        raw = lambda u: u @ w[:-1] + w[-1]
        if len(set(y[held])) < 2:
            return raw
        slope, shift = plain_fit(raw(v[held])[:, None], y[held], np.ones(held.sum()), 0.1, 12, 1e-5)
        return lambda u: max(slope, 0) * raw(u) + shift

    view = [calibrated(plain_fit(v[~held], y[~held], np.ones((~held).sum()), 3.0, 12, 1e-5), v) for v in x]
    n = len(pool[0])
    for r in range(rounds):
        given = []
        for v in (0, 1):
            z = view[v](pool[v])
            labels = np.full(n, np.nan)
            for label, sign, part in ((1.0, 1, share), (0.0, -1, 1 - share)):
                at = [i for i in range(n) if sign * z[i] >= Q.EDGE]
                quota = Q.GIVEN * (r + 1) * n * part
                place = {i: int((sign * z[i] - Q.EDGE) // Q.GRAIN) for i in at}
                for k in sorted(set(place.values()), reverse=True):
                    if sum(p >= k for p in place.values()) <= quota or k == max(place.values()):
                        labels[[i for i in at if place[i] == k]] = label
            given.append(labels)
        new = []
        for v in (0, 1):
            taught = given[1 - v]
            at = np.flatnonzero(~np.isnan(taught))
            u = Q.WEIGHT * (r + 1) / rounds * (~held).sum() / max(1, len(at))
            w = plain_fit(np.vstack([x[v][~held], pool[v][at]]), np.r_[y[~held], taught[at]], np.r_[np.ones((~held).sum()), np.full(len(at), u)], 3.0, Q.STEPS)
            new.append(calibrated(w, x[v]))
        view = new
    a, b = (np.r_[view[v](x[v]), view[v](pool[v])] for v in (0, 1))
    return [1 / (1 + np.exp(-np.clip(s, -40, 40))) for s in (a, b, a + b - prior)]


def test_arrays_against_brute_force(monkeypatch):
    monkeypatch.setattr(Q, "GIVEN", 0.04)
    rng = np.random.default_rng(7)
    y = (rng.random(700) < 0.6).astype(float)
    a = (y[:, None] * 2 - 1) * 1.5 + rng.normal(size=(700, 3))
    b = (y[:, None] * 2 - 1) * 1.0 + rng.normal(size=(700, 5))
    m = Q.co_train(a[:90], b[:90], y[:90], a[90:], b[90:], rounds=3)
    want = plain_co_training((a[:90], b[:90]), y[:90], (a[90:], b[90:]), 3)
    for got, w in zip(m.score(a, b), want):
        assert np.allclose(got, w, atol=1e-6)


def test_tables_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(Q, "GIVEN", 0.03)
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    table = Q.featurized(docs.repartition(5), labels, labelled=60)
    rows = table.selectExpr("*", "xxhash64(doc_id) h").collect()
    rows = sorted((r for r in rows if r.y is not None), key=lambda r: r.h) + [r for r in rows if r.y is None]
    known = sum(r.y is not None for r in rows)
    assert known and len(rows) == docs.count()  # every other document is an unlabelled example
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows])
    m = Q.meta_features([np.array([r[f"m{i}"] for r in rows]) for i in range(3)])
    want = plain_co_training((x[:known], m[:known]), np.array([r.y for r in rows[:known]]), (x[known:], m[known:]), 2)
    got = {r.doc_id: r for r in Q.scored(docs, labels, labelled=60, rounds=2).collect()}
    for i, r in enumerate(rows):
        assert np.allclose([got[r.doc_id].p_text, got[r.doc_id].p_meta, got[r.doc_id].score], [w[i] for w in want], atol=1e-4)


def test_rows_that_repeat_a_labelled_key(spark):
    docs = spark.createDataFrame([(f"d{i}", ("fine words. " if i % 2 else "## $$ ") * (1 + i % 4)) for i in range(40)] + [("d1", "fine words. ")] * 300, "doc_id string, text string")
    got = Q.scored(docs, spark.createDataFrame([(f"d{i}", i % 2) for i in range(30)], "doc_id string, quality int")).collect()
    assert len(got) == 340 and all(r.accepted == (int(r.doc_id[1:]) % 2 == 1) for r in got)
