from oracle import same

from cueweave.llm import revisits as R

DDL = "record_id string, type string, uri string, ts bigint, status int, headers map<string,string>, payload_digest string, refers_to int"


def test_sql(spark):
    assert same(spark, "op5_revisits") > 0


def test_edges(spark):
    d = [
        ("a", "response", "http://x.com/", 10, 200, {"etag": '"1"', "date": "d1", "content-type": "t"}, "p1", 0),
        ("b", "response", "http://www.x.com", 20, 200, {"etag": '"2"', "last-modified": "m"}, "p2", 0),
        ("b2", "response", "http://x.com", 20, 500, {"etag": '"2"'}, "p9", 0),
        ("r1", "revisit", "https://x.com", 15, 304, {"etag": 'W/"1"', "date": "d2", "content-type": "u"}, None, 0),
        ("r2", "revisit", "http://x.com", 20, 304, {"etag": '"1"'}, "p1", 0),
        ("r3", "revisit", "http://x.com", 30, 304, {"etag": '"1"'}, None, 0),
        ("r4", "revisit", "http://x.com", 31, 304, {"last-modified": "m"}, None, 0),
        ("r5", "revisit", "http://x.com", 32, 304, None, "p2", 0),
        ("r6", "revisit", "http://x.com", 33, 304, {"etag": '"2"'}, "other", 0),
        ("r7", "revisit", "http://x.com", 5, 304, {"etag": '"1"'}, None, 0),
        ("r8", "revisit", None, 40, 304, {"etag": '"2"'}, None, None),
        ("r9", "revisit", "http://x.com", None, 304, {"etag": '"2"'}, None, None),
        ("r9", "revisit", "http://x.com", None, 304, {"etag": '"2"'}, None, None),
        ("c", "response", None, 1, 200, None, None, None),
        (None, "response", "http://y.com/" + "z" * 50000, 1, 200, {"etag": "e"}, "q", 1),
        (None, "revisit", "http://y.com/" + "z" * 50000, 2, 304, {"etag": "e"}, None, 1),
    ]
    rows = R.resolved(spark.createDataFrame(d, DDL)).collect()
    assert len(rows) == 11
    by = {r.record_id: r for r in rows}
    assert {k: (r.refers_to, r.matched) for k, r in by.items()} == {
        "r1": ("a", True), "r2": ("a", True), "r3": ("b", False), "r4": ("b", True), "r5": ("b", True), "r6": ("b", False),
        "r7": (None, False), "r8": (None, False), "r9": (None, False), None: (None, True),
    }
    assert by["r1"].headers == {"etag": 'W/"1"', "date": "d2", "content-type": "t"} and by["r1"].payload_digest == "p1"
    assert by["r3"].headers is None and by["r5"].headers == {"etag": '"2"', "last-modified": "m"}
    assert R.resolved(spark.createDataFrame([], DDL)).count() == 0


def test_responses_of_one_time_and_revisits_that_are_no_304(spark):
    d = [
        ("a", "response", "http://x.com/", 10, 200, {"etag": "1", "content-type": "t"}, "p1", 0),
        ("b", "response", "http://x.com/", 10, 200, {"etag": "2", "content-type": "u"}, "p2", 0),
        ("r1", "revisit", "http://x.com/", 11, 304, {"etag": "2"}, None, 0),
        ("r2", "revisit", "http://x.com/", 12, 200, {"etag": "2", "content-type": "v"}, "p2", 0),
        ("r3", "revisit", "http://x.com/", 13, 200, {"etag": "2"}, None, 0),
        ("r4", "revisit", "http://x.com/", 14, None, {"etag": "2"}, None, 0),
    ]
    by = {r.record_id: r for r in R.resolved(spark.createDataFrame(d, DDL)).collect()}
    assert {k: (r.refers_to, r.matched) for k, r in by.items()} == {"r1": ("b", True), "r2": ("b", True), "r3": ("b", False), "r4": ("b", True)}
    assert by["r2"].headers == {"etag": "2", "content-type": "v"} and by["r2"].payload_digest == "p2"
    assert by["r1"].headers == by["r4"].headers == {"etag": "2", "content-type": "u"}
