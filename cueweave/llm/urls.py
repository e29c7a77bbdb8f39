"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact join of what passes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._state import written

#: Bits of filter a listed URL, and bits set a URL. A block has 512 bits, so that a URL touches one row of the filter.
BITS_PER_URL = 16
PROBES = 6
WORDS = 8
#: Parameters that say where a visitor came from.
TRACKING = ("ref", "fbclid", "gclid", "msclkid", "igshid", "mc_cid", "mc_eid")


def canonical(url: Column) -> Column:
    """Lower-case scheme and host without user, www., m. or the scheme's own port, path without trailing slashes, parameters sorted and without
    tracking ones, no fragment. http and https are one. Null where there is no host."""
    u = F.regexp_replace(F.btrim(url), "#.*$", "")
    part = lambda i: F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)\??(.*)$", i)
    scheme = F.lower(part(1))
    port = F.when(scheme == "http", ":80").when(scheme == "https", ":443").otherwise(":")
    host = F.regexp_replace(F.lower(part(2)), "^.*@", "")
    host = F.when(host.endswith(port), F.substring(host, F.lit(1), F.length(host) - F.length(port))).otherwise(host)
    host = F.regexp_replace(host, r"^(www|m)\.", "")
    path = F.regexp_replace(part(3), "/+$", "")
    pairs = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING) & ~F.lower(p).startswith("utm_"))
    query = F.array_join(F.array_sort(pairs), "&")
    whole = F.concat(F.when(scheme.isin("http", "https"), "http").otherwise(scheme), F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host != "", whole)


def _probes(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key and its bits in the block."""
    h, g = F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2))
    return F.pmod(h, F.lit(blocks)), [F.pmod(F.shiftright(g, 10 * i), F.lit(64 * WORDS)).cast("int") for i in range(PROBES)]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7) of the blocks that hold a listed key; column `key`. Made by aggregation, so it may be of any size."""
    block, bits = _probes(F.col("key"), blocks)
    one = listed.select(block.alias("block"), F.explode(F.array(*bits)).alias("bit"))
    word = lambda w: F.bit_or(F.when(F.shiftright("bit", 6) == w, F.expr("shiftleft(1L, bit & 63)")).otherwise(F.lit(0).cast("bigint")))
    return one.groupBy("block").agg(*[word(w).alias(f"w{w}") for w in range(WORDS)])


def block_count(urls: int) -> int:
    return max(1, math.ceil(urls * BITS_PER_URL / (64 * WORDS)))


def passing(rows: DataFrame, listed: DataFrame, blocks: int) -> DataFrame:
    """The rows whose `key` passes the filter of the listed keys: all that are listed, and a few others."""
    block, bits = _probes(F.col("key"), blocks)
    words = F.array(*[F.col(f"w{w}") for w in range(WORDS)])
    hit = None
    for i in range(PROBES):
        ok = F.expr(f"(element_at(_words, shiftright(_b{i}, 6) + 1) & shiftleft(1L, _b{i} & 63)) != 0")
        hit = ok if hit is None else hit & ok
    probed = rows.withColumns({"block": block, **{f"_b{i}": b for i, b in enumerate(bits)}})
    return probed.join(bloom(listed, blocks), "block").withColumn("_words", words).filter(hit).select(*rows.columns)


def listed_pages(pages: DataFrame, urls: DataFrame, *, url: str = "url", key: str = "page_id", listed_url: str = "url") -> DataFrame:
    """(page_id, url, canonical_url) of each row of `pages` whose canonical URL is that of a row of `urls`.

    The filter has as many blocks as the count of listed URLs asks for. The planner broadcasts it, or the list, only where its size on
    finding it is below its threshold; else both joins shuffle URLs alone, and the exact one hashes the list. The list is made canonical once. Nulls, empty URLs and URLs without a host are never listed;
    repeated rows of pages stay, those of the list count once. Other columns play no part.
    """
    known = written(urls.select(canonical(F.col(listed_url)).alias("key")).filter("key is not null").distinct(), "listed-urls")
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), canonical(F.col(url)).alias("key")).filter("key is not null")
    blocks = block_count(known.count())
    return passing(rows, known, blocks).join(known.hint("shuffle_hash"), "key", "left_semi").select("page_id", "url", F.col("key").alias("canonical_url"))
