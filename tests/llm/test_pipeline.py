"""Each stage, on all that its predecessor kept, against a brute-force version."""

import duckdb
import numpy as np
import pytest

import corpus_pipeline as P
from cueweave.llm import language, near_copies
from cueweave.llm._state import written
from cueweave.llm._vec import Powers
from cueweave.llm.sql import SQL_op1_mixing, SQL_op10_contamination

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def outputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas()]
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, SF), name.replace(" ", "-"))
        out.append(docs.toPandas())
    return out


def test_names():
    assert [n for n, _ in P.STAGES] == ["language", "near copies", "suffix repeats", "contamination", "mixing"]


def test_columns(outputs):
    assert all(list(o.columns) == COLUMNS for o in outputs[:-1]) and list(outputs[-1].columns) == [*COLUMNS, "copy"]


def test_language(spark, outputs):
    judged = language.identify(spark.read.parquet(f"{SF}/documents.parquet"), least=P.LANGUAGE_MARGIN, sample=P.LANGUAGE_SAMPLE).toPandas()
    assert set(outputs[1].doc_id) == set(judged.doc_id[judged.accepted])
    assert len(outputs[1]) > 0.995 * len(outputs[0])


def test_near_copies(outputs):
    before, after = outputs[1].sort_values("doc_id"), outputs[2]
    texts = [t.encode() for t in before.text]
    fp, some = near_copies.fingerprints(np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])], Powers())
    group = list(range(len(fp)))
    for a in range(len(fp)):
        for b in np.flatnonzero((np.bitwise_count(fp[:a] ^ fp[a]).sum(1) <= near_copies.DISTANCE) & some[:a] & some[a]):
            x, y = group[a], group[b]
            if x != y:
                group = [min(x, y) if g in (x, y) else g for g in group]
    ids = before.doc_id.to_numpy()
    want = {int(ids[g]) for g in group}
    got = set(after.doc_id)
    assert want <= got
    assert len(got - want) <= 0.1 * (len(before) - len(want))  # recall of what has to go
    assert before[before.doc_id.isin(got)].reset_index(drop=True).equals(after.sort_values("doc_id").reset_index(drop=True))


def test_suffix_repeats(outputs):
    before, after = outputs[2].sort_values("doc_id"), outputs[3].set_index("doc_id")
    first, k = {}, 50
    for d, t in zip(before.doc_id, before.text):
        w = t.split()
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - k + 1):
            if first.setdefault(tuple(w[i : i + k]), (d, i)) != (d, i):
                gone[i : i + k] = True
        left = [x for x, g in zip(w, gone) if not g]
        if left:
            assert after.text[d].split() == left
            assert after.text[d] == t if not gone.any() else after.n_chars[d] == len(after.text[d])
        else:
            assert d not in after.index
    assert len(after) < len(before) or (after.n_chars.sum() < before.n_chars.sum())


def on(frame, sql):
    con = duckdb.connect()
    con.register("documents", frame)
    con.sql(f"create view benchmark as select * from '{SF}/benchmark.parquet'")
    return con.sql(sql).df()


def test_contamination(outputs):
    bad = set(on(outputs[3], SQL_op10_contamination).doc_id)
    assert bad and set(outputs[4].doc_id) == set(outputs[3].doc_id) - bad


def test_mixing(outputs):
    want = on(outputs[4], SQL_op1_mixing)
    rows = lambda f: sorted(zip(f.doc_id, f.copy_, f.text, f.source))
    assert rows(outputs[5].rename(columns={"copy": "copy_"})) == rows(want.rename(columns={"copy": "copy_"}))


def test_run(spark, outputs):
    got = P.run(spark, SF).toPandas()
    assert sorted(zip(got.doc_id, got["copy"])) == sorted(zip(outputs[-1].doc_id, outputs[-1]["copy"]))
