import numpy as np
import pyarrow as pa

from cueweave.llm import language as L


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    train, test = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    got = L.identify(test, L.fit(train)).toPandas().merge(test.toPandas(), on="doc_id")
    assert (got.language == got.lang).mean() > 0.99
    assert got.accepted.mean() > 0.99
    assert set(zip(got.language, got.family)) == {("en", "germanic"), ("de", "germanic"), ("fr", "romance"), ("es", "romance")}


def test_profiles_against_plain_counting():
    texts = ["Ab  c1d", "", "é", "xyz " * 500, "--"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    got, letters = L.profiles(data, off)
    for t, row, n in zip(texts, got, letters):
        body = "".join(chr(c) if chr(c).isalpha() or c > 127 else " " for c in t.encode("utf-8").lower())
        body = " " + " ".join(body.encode("latin-1").decode("latin-1").split(" ")) + " "
        while "  " in body:
            body = body.replace("  ", " ")
        b = body.encode("latin-1")
        want = np.zeros(2 * L.BUCKETS)
        for i in range(len(b) - 1):
            want[((b[i] * 256 + b[i + 1]) * 2654435761 % 2**32) >> 20] += 1
        for i in range(len(b) - 2):
            want[(((b[i] * 256 + b[i + 1]) * 256 + b[i + 2]) * 2246822519 % 2**32 >> 20) + L.BUCKETS] += 1
        if b.strip():
            assert np.allclose(row, want / (2 * len(b) - 2), atol=1e-6), t
        assert n == sum(x != 32 for x in b)


def test_edges(spark):
    d = [(1, "the cat and the dog were there", "en", 1), (2, None, "en", 1), (3, "", None, 1), (4, "12 -- 34", "en", 1), (None, "der hund und die katze", "de", 1), (6, "der hund und die maus", "de", 1), (6, "der hund und die maus", "de", 1), (7, "die katze " * 40000, "de", None)]
    df = spark.createDataFrame(d, "doc_id bigint, text string, lang string, margin int")
    got = L.identify(df).collect()
    assert len(got) == 8
    by = {r.doc_id: r for r in got}
    assert by[1].language == "en" and by[7].language == "de" and by[None].language == "de" and by[6].accepted
    assert not any(by[i].accepted for i in (2, 3, 4)) and by[3].language is None
    kept = L.keep_accepted(df)
    assert kept.columns == df.columns and kept.count() == 5
    assert L.identify(df.limit(0)).count() == 0
    assert not any(r.accepted for r in L.identify(df.select("doc_id", "text").selectExpr("*", "cast(null as string) lang")).collect())
    one = L.identify(df.filter("lang = 'de'")).collect()
    assert all(r.language == "de" for r in one)


def decide(model, x):
    """Family, language and margin by the definition: every machine votes, ties go by the sum of margins."""

    def contest(names, machines):
        if len(names) == 1:
            return names[0], np.inf
        value = {(m.yes, m.no): float(x @ m.weights) + m.bias for m in machines}
        votes = {n: sum((v > 0) if n == a else (v <= 0) for (a, b), v in value.items() if n in (a, b)) for n in names}
        total = {n: sum(v if n == a else -v for (a, b), v in value.items() if n in (a, b)) for n in names}
        best = max(names, key=lambda n: (votes[n], total[n]))
        return best, min(v if best == a else -v for (a, b), v in value.items() if best in (a, b))

    family, low = contest(sorted(model.families), model.between)
    lang, low2 = contest(model.families[family], model.within[family])
    margin = min(low, low2)
    return family, lang, margin if np.isfinite(margin) else 1.0


def test_decisions_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = L.fit(docs, sample=60)
    assert set(model.families) == {"germanic", "romance"} and len(model.between) == 1
    got = {r.doc_id: r for r in L.identify(docs, model, least=0.05).collect()}
    for d, t in [(r.doc_id, r.text) for r in docs.collect()]:
        x, letters = L.profiles(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        if not letters[0]:
            assert got[d].language is None and not got[d].accepted
            continue
        family, lang, margin = decide(model, x[0].astype(float))
        assert np.isclose(got[d].margin, margin, atol=1e-4), d
        if margin > 1e-4:
            assert (got[d].family, got[d].language) == (family, lang)
        if abs(margin - 0.05) > 1e-4:
            assert got[d].accepted == (margin >= 0.05)


def test_machines_reach_the_least_loss():
    rng = np.random.default_rng(2)
    x = np.abs(rng.normal(size=(80, 30))).astype(np.float32) / 30
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=80) / 30 > x[:, 1], 1, -1).astype(np.float32)
    w, b = L.train_svm(x, y, rounds=2000)
    scale = 1 / np.sqrt(x.mean(0) + 1e-5)
    z = np.c_[x * scale, np.ones(80)].astype(float)
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    loss = lambda v: 0.5 * v @ v + 50.0 * (weight * np.maximum(0, 1 - y * (z @ v)) ** 2).sum()
    plain = np.zeros(31)
    for _ in range(40000):
        plain -= 2e-4 * (plain - 100.0 * z.T @ (weight * y * np.maximum(0, 1 - y * (z @ plain))))
    assert loss(np.r_[w / scale, b]) <= 1.01 * loss(plain)


def test_rows_that_repeat_or_have_no_key_are_learnt_from(spark):
    en, de = "the cat and the dog were there with the others", "der hund und die katze waren auch noch da"
    d = [(None, f"{en} {i}", "en") for i in range(700)] + [("k", de, "de")] * 700 + [(f"d{i}", f"{de} {i}", "de") for i in range(5)]
    df = spark.createDataFrame(d, "doc_id string, text string, lang string")
    low = L.lowest(df.selectExpr("lang", "xxhash64(doc_id, text, 8) h"), 50).groupBy("lang").count().collect()
    assert {(r.lang, r["count"]) for r in low} == {("en", 50), ("de", 6)}
    got = L.identify(df, sample=50).collect()
    assert all(r.language == ("en" if r.doc_id is None else "de") for r in got)
