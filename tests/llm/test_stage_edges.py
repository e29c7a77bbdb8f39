"""Every stage over awkward documents."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"
EXTRA = ["_gone", "_bad", "_spans", "_doc", "_sub", "_rate", "_source", "_n", "h", "place", "component", "group_id", "run", "id", "a.b", "slots"]


@pytest.fixture(scope="module")
def awkward(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    passage = " ".join(f"passage{i}" for i in range(60))
    rows = [
        (1, "The quick brown fox and the lazy dog were there.", "en", "s", 48),
        (1, "The quick brown fox and the lazy dog were there.", "en", "s", 48),
        (2, None, "en", "s", 0),
        (3, "", "en", "s", 0),
        (None, "Ein kleiner Hund und eine große Katze.", "de", "s", 38),
        (4, "Ein kleiner Hund und eine große Katze.", None, None, None),
        (5, "12345 --- 678", "en", "s", 13),
        (6, "word " * 200000, "en", "s", 1000000),
        (7, "before " + passage + " after the fox", "en", "t", 0),
        (8, "other words come first here, then " + passage, "en", "t", 0),
        (9, "Something and " + item + " and more", "en", "t", 0),
        (10, "the the the", "en", "t", 11),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(EXTRA)])


def kept(stage, spark, docs):
    out = stage(spark, docs, SF)
    return out, sorted((r.doc_id or 0) for r in out.collect())


def test_stages(spark, awkward):
    want = {
        "language": [0, 1, 1, 4, 6, 7, 8, 9, 10],
        "near copies": [0, 1, 2, 3, 4, 5, 6, 7, 9, 10],  # 7 and 8 share nearly all
        "suffix repeats": [0, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10],
        "contamination": [0, 1, 1, 2, 3, 4, 5, 6, 7, 8, 10],
    }
    for name, stage in P.STAGES[:-1]:
        out, ids = kept(stage, spark, awkward)
        assert out.columns == awkward.columns, name
        assert ids == want[name], name
        assert out.select(*[F.sum(f"`{c}`") for c in EXTRA]).first()[3] == 3 * len(ids)


def test_passage_stays_once(spark, awkward):
    out = P.drop_suffix_repeats(spark, awkward, SF).filter("doc_id in (7, 8)").orderBy("doc_id").collect()
    assert "passage59" in out[0].text and out[1].text == "other words come first here, then" and out[1].n_chars == len(out[1].text)


def test_mixing(spark, awkward):
    out = P.mix_sources(spark, awkward, SF)
    assert out.columns == [*awkward.columns, "copy"] and out.filter("source is null").count() > 0


def test_empty(spark, awkward):
    for name, stage in P.STAGES:
        assert stage(spark, awkward.limit(0), SF).count() == 0, name
