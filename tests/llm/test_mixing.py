from oracle import same

from cueweave.llm import mixing as M


def test_sql(spark):
    assert same(spark, "op1_mixing") > 0


def test_target_shares(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    w = {"src0": 5.0, "src1": 0.0}
    out = M.mixed(docs, w, epochs=2.0).groupBy("source").agg({"n_chars": "sum"}).toPandas().set_index("source")["sum(n_chars)"]
    assert "src1" not in out.index
    share = out / out.sum()
    assert abs(share["src0"] - 5 / 23) < 0.02
    assert all(abs(share[f"src{i}"] - 1 / 23) < 0.015 for i in range(2, 20))


def test_floor_and_coin(spark):
    df = spark.createDataFrame([(i, "a b c", "x" if i < 90 else "y") for i in range(100)], "doc_id bigint, text string, source string")
    out = M.mixed(df, {"x": 1.0, "y": 1.0}).groupBy("doc_id").count().collect()
    n = {r.doc_id: r["count"] for r in out}
    assert all(n[i] == 5 for i in range(90, 100))
    assert 35 <= sum(i in n for i in range(90)) <= 65
    assert M.mixed(df, {"x": 1.0, "y": 1.0}).exceptAll(M.mixed(df.repartition(7), {"x": 1.0, "y": 1.0})).count() == 0


def test_many_sources_are_joined(spark, monkeypatch):
    df = spark.createDataFrame([(i, "a b", f"s{i % 9}") for i in range(50)], "doc_id bigint, text string, source string")
    want = sorted(map(tuple, M.mixed(df, {"s1": 4.0}).collect()))
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 3)
    assert sorted(map(tuple, M.mixed(df, {"s1": 4.0}).collect())) == want


def test_edges(spark):
    d = [(1, "a b", None, 5), (2, None, "x", 5), (3, "", "z", 5), (None, "long " * 90000, "x", 5), (4, "t", "x", 5), (4, "t", "x", 5)]
    df = spark.createDataFrame(d, "doc_id bigint, text string, source string, copy int")
    out = M.mixed(df, {})
    assert out.columns == ["doc_id", "text", "source", "copy"]
    n = {}
    for r in out.collect():
        n[r.doc_id, r.source] = n.get((r.doc_id, r.source), 0) + 1
    assert n[1, None] > 10000 and (3, "z") not in n
    assert M.mixed(df.limit(0), {}).count() == 0
    assert M.mixed(df.filter("source = 'z'"), {}).count() == 0


def test_tiny_source_repeats_in_many_tasks(spark, monkeypatch):
    df = spark.createDataFrame([(i, "w " * 50, "big") for i in range(400)] + [("tiny", "one", "small")], "doc_id string, text string, source string")
    plan = M.mixed(df, {})
    n = plan.groupBy("source").count().collect()
    assert {r.source: r["count"] for r in n}["small"] in (10000, 10001)
    copies = plan.filter("source = 'small'").select("copy").toPandas()["copy"]
    assert sorted(copies) == list(range(1, len(copies) + 1)) and dict(plan.dtypes)["copy"] == "bigint"
    assert M.mixed(df, {}, most=2.0).filter("source = 'small'").count() == 2
    huge = M.rates(df, {"small": 1e12}, other=1.0, epochs=1e12, text="text", source="source")
    assert huge.filter("_source = 'small'").first()["_rate"] > 1e15
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, M.mixed(df, {}).collect())) == sorted(map(tuple, plan.collect()))


def test_tokens_of_scripts_without_spaces(spark):
    df = spark.createDataFrame([("中文 abc，x", 3), ("one\u00a0two\u3000three", 3), (None, 0), (" \u2028", 0)], "t string, n int")
    from pyspark.sql import functions as F

    assert all(r[0] == r[1] for r in df.select(M.tokens(F.col("t")), "n").collect())
