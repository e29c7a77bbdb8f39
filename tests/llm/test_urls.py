from oracle import same
from pyspark.sql import functions as F

from cueweave.llm import urls as L


def test_sql(spark):
    assert same(spark, "op3_urls") > 0


def test_canonical(spark):
    pairs = {
        "HTTP://User@WWW.Example.com:80/A/b/?b=2&utm_source=x&a=1&ref=q#top": "http://example.com/A/b?a=1&b=2",
        "https://m.example.com:443": "http://example.com",
        "https://example.com:8443/": "http://example.com:8443",
        "ftp://example.com:80/x": "ftp://example.com:80/x",
        "example.com/x": None,
        "": None,
        None: None,
        "http://:80/x": None,
    }
    got = spark.createDataFrame([(k,) for k in pairs], "u string").select("u", L.canonical(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in got} == pairs


def test_filter_passes_all_listed_and_few_others(spark):
    listed = spark.range(5000).select(F.concat(F.lit("http://x.org/"), F.col("id")).alias("key"))
    rows = spark.range(60000).select(F.concat(F.lit("http://x.org/"), F.col("id")).alias("key"))
    got = {r.key for r in L.passing(rows, listed, L.block_count(5000)).collect()}
    assert {f"http://x.org/{i}" for i in range(5000)} <= got
    assert len(got) - 5000 < 0.01 * 55000


def test_edges(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x", 1), (1, "http://a.com/x", 1), (None, "https://www.a.com/x/", 1), (2, None, 1), (3, "", 1), (4, "nohost", 1), (5, "http://b.com/" + "p" * 100000, None)], "page_id bigint, url string, key int")
    listed = spark.createDataFrame([("http://a.com/x#f",), ("http://a.com/x",), (None,), ("nohost",), ("http://b.com/" + "p" * 100000,)], "url string")
    got = sorted((r.page_id or 0, len(r.canonical_url)) for r in L.listed_pages(pages, listed).collect())
    assert got == [(0, 14), (1, 14), (1, 14), (5, 100013)]
    assert L.listed_pages(pages, listed.limit(0)).count() == 0 and L.listed_pages(pages.limit(0), listed).count() == 0
