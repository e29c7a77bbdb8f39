"""Revisits of an unchanged page, resolved to the response that they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .urls import canonical

#: Header fields that a not-modified reply may bring up to date in the stored response (RFC 9110, 15.4.5, and RFC 9111, 3.2).
PERMITTED = ("date", "expires", "cache-control", "vary", "content-location", "etag", "last-modified", "age", "warning")


def resolved(records: DataFrame, *, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """(record_id, uri, ts, refers_to, matched, headers, payload_digest) of each revisit.

    `records` has record_id, type (response or revisit), uri, ts, status, headers (map of lower-case names) and payload_digest. A revisit
    refers to the latest full response (type response, status 200) of the same canonical URL before its time; of those of one time, to that
    of the largest record_id. It is matched if the validators that both have are equal (etag, weak marks aside; else last-modified) and,
    where the revisit carries a payload digest, that too; with no validator and no digest in common it is not. `headers` are the response's
    with the permitted ones of the revisit over them, and payload_digest is the response's; both are null unless matched. Only a revisit of
    status 304 or none is a not-modified reply: another one (the payload came again, and was the same) is matched by its digest alone, and
    its own headers stand. A response at the
    very time of the revisit is not before it. A null or hostless URL, or a null time, has no earlier response. Repeated revisits get a row
    each; other columns play no part.

    One shuffle by canonical URL and one sort: the as-of join is a running last() over responses and revisits together, so a URL of any
    number of captures is streamed and not paired.
    """
    url = canonical(F.col("uri"))
    full = (F.col("type") == "response") & (F.col("status") == 200) & url.isNotNull() & F.col("ts").isNotNull()
    rows = records.select("record_id", "type", "uri", "ts", "status", "headers", "payload_digest", F.coalesce(full, F.lit(False)).alias("full"), F.coalesce(url, F.concat(F.lit("\x00"), F.col("record_id").cast("string"))).alias("key")).filter("full or type = 'revisit'")
    # at one time revisits come before responses, so that no response of that time is before them
    w = Window.partitionBy("key").orderBy("ts", F.col("full").cast("int"), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("full"), F.struct("record_id", "headers", "payload_digest")), ignorenulls=True).over(w)
    rev = rows.withColumn("r", last).filter("type = 'revisit'").withColumn("r", F.when(F.col("ts").isNotNull(), F.col("r")))
    h, g = F.col("headers"), F.col("r.headers")
    etag = lambda m: F.regexp_replace(F.element_at(m, "etag"), "^W/", "")
    by_etag, by_date = etag(h) == etag(g), F.element_at(h, "last-modified") == F.element_at(g, "last-modified")
    by_digest = F.col("payload_digest") == F.col("r.payload_digest")
    validators = F.coalesce(by_etag, by_date)
    unmodified = F.coalesce(F.col("status") == 304, F.lit(True))
    matched = F.col("r").isNotNull() & F.when(unmodified, F.coalesce(validators, by_digest, F.lit(False)) & F.coalesce(by_digest, F.lit(True))).otherwise(F.coalesce(by_digest, F.lit(False)))
    fresh = F.map_filter(F.coalesce(h, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*permitted) & v.isNotNull())
    kept = F.map_filter(F.coalesce(g, F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(fresh), k))
    merged = F.when(unmodified, F.map_concat(kept, fresh)).otherwise(h)
    return rev.withColumn("matched", matched).select(
        "record_id",
        "uri",
        "ts",
        F.col("r.record_id").alias("refers_to"),
        "matched",
        F.when(F.col("matched"), merged).alias("headers"),
        F.when(F.col("matched"), F.col("r.payload_digest")).alias("payload_digest"),
    )


def records_of(pages: DataFrame) -> DataFrame:
    """Captures that a crawl of the pages could have made: of each page a response and two revisits, at times set by its id.

    The second revisit of every fifth page brings another etag; every seventh response has status 404 and every eleventh no validator.
    """
    i = F.col("page_id")
    etag = lambda n: F.concat(F.lit('"'), F.substring(F.md5(F.concat(F.coalesce("html", F.lit("")), F.lit(n)).cast("binary")), 1, 12), F.lit('"'))
    record = lambda kind, ts, status, tag, media, n: F.struct(F.lit(kind).alias("type"), ts.alias("ts"), status.alias("status"), tag.alias("etag"), F.lit(media).alias("kind"), F.lit(n).alias("n"))
    both = F.array(
        record("response", i * 10, F.when(i % 7 == 0, 404).otherwise(200), F.when(i % 11 != 0, etag("")), "text/html", "1"),
        record("revisit", i * 10 + 5, F.lit(304), F.concat(F.lit("W/"), etag("")), "text/plain", "2"),
        record("revisit", i * 10 + 4000, F.lit(304), F.when(i % 5 == 0, etag("x")).otherwise(etag("")), "text/plain", "3"),
    )
    c = pages.select("page_id", "url", "html", F.explode(both).alias("c"))
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    entries = F.filter(F.array(entry("etag", F.col("c.etag")), entry("content-type", F.col("c.kind")), entry("date", F.col("c.ts").cast("string"))), lambda e: e["value"].isNotNull())
    return c.select(
        F.concat(F.col("page_id").cast("string"), F.lit("-"), F.col("c.n")).alias("record_id"),
        "c.type",
        F.col("url").alias("uri"),
        "c.ts",
        "c.status",
        F.map_from_entries(entries).alias("headers"),
        F.when(F.col("c.type") == "response", F.md5(F.coalesce("html", F.lit("")).cast("binary"))).alias("payload_digest"),
    )
