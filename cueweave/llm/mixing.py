"""Mixing sources to target weights: whole repeats of each document, and one more by a seeded coin."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._vec import SCRIPT_CLASS, SPACE_CLASS

BLANK = " \t\n\r\f\x0b"
#: A token: a sign of a script without spaces, or a maximal run of what is neither that nor white space.
TOKEN = rf"[{SCRIPT_CLASS}]|[^ \t\n\r\f\x0b{SPACE_CLASS}{SCRIPT_CLASS}]+"
#: Most sources whose rates are broadcast; more are joined by shuffle, with each source in SALTS partitions.
BROADCAST_SOURCES, SALTS = 100_000, 16
#: Copies of a row that one task makes; more are spread over tasks.
SPREAD = 1000


def tokens(text: Column) -> Column:
    """How many tokens a text has; none of a null.

    Texts without a character from Thai on upwards, nor either of the two spaces below it, are split at blanks, which comes to the same in less time.
    """
    bare = F.btrim(text, F.lit(BLANK))
    split = F.when(bare == "", 0).otherwise(F.size(F.split(bare, f"[{BLANK}]+")))
    any_ = F.when(text.rlike(r"[\x85\xA0\x{E00}-\x{10FFFF}]"), F.regexp_count(text, F.lit(TOKEN))).otherwise(split)
    return F.when(text.isNull(), 0).otherwise(any_)


def coin(key: Column, seed: int) -> Column:
    """A number in [0, 1) that only the key and the seed decide."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def rates(docs: DataFrame, weights: dict[str, float], *, other: float, epochs: float, text: str, source: str) -> DataFrame:
    """(_source, _rate): a source's share of `epochs` times all tokens, by weight, over its own tokens; a source without a token has rate 0."""
    per = docs.groupBy(F.col(source).alias("_source")).agg(F.sum(tokens(F.col(text))).alias("n"))
    named = F.create_map(*[F.lit(x) for k, v in sorted(weights.items()) for x in (k, float(v))]) if weights else F.create_map().cast("map<string,double>")
    per = per.withColumn("w", F.when(F.col("n") > 0, F.coalesce(F.when(F.col("_source").isNotNull(), F.element_at(named, F.coalesce(F.col("_source").cast("string"), F.lit("")))), F.lit(float(other)))).otherwise(0.0))
    total = per.agg(F.sum("n").alias("all"), F.sum("w").alias("weight"))
    share = F.lit(float(epochs)) * F.col("all") * F.col("w") / F.col("weight") / F.col("n")
    return per.crossJoin(total).select("_source", F.when((F.col("n") > 0) & (F.col("weight") > 0), share).otherwise(0.0).alias("_rate"))


def mixed(
    docs: DataFrame, weights: dict[str, float], *, other: float = 1.0, epochs: float = 1.0, most: float = math.inf, seed: int = 1, text: str = "text", source: str = "source", key: str = "doc_id", copy: str = "copy"
) -> DataFrame:
    """Each row floor(rate) times, and once more with a chance of the fraction, with a column `copy` that counts from 1.

    A source's rate makes its expected tokens its weight's share of `epochs` times all tokens, but is `most` at most (no bound unless
    given); sources that `weights` doesn't name weigh `other`. The coin is a hash of the key and the seed, so repeated rows fare alike, as
    do rows with a null key. Rows with a null source are a source of their own; rows without a token (null or empty texts) count 0 tokens
    and go at their source's rate. A weight of 0 leaves a source out. An input column named like `copy` is replaced. A source that is tiny
    for its weight repeats as often as that asks, if millions of times; the copies of such a row are made in many tasks.
    """
    table = rates(docs, weights, other=other, epochs=epochs, text=text, source=source).withColumn("_rate", F.least("_rate", F.lit(float(most))))
    few = table.limit(BROADCAST_SOURCES + 1).collect()
    out = docs.drop(copy)
    on = F.lit(True)
    if len(few) <= BROADCAST_SOURCES:
        top = max([r["_rate"] for r in few], default=0.0)
        table = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in few], table.schema))
    else:
        top = table.agg(F.max("_rate")).first()[0]
        table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = F.pmod(F.xxhash64(out[f"`{key}`"]), F.lit(SALTS)) == table["_salt"]
    rate = table["_rate"]
    n = F.floor(rate) + (coin(out[f"`{key}`"], seed) < rate - F.floor(rate)).cast("bigint")
    joined = out.join(table, out[f"`{source}`"].eqNullSafe(table["_source"]) & on)
    columns = [out[f"`{c}`"] for c in out.columns]
    one = joined.filter((n > 0) & (n <= SPREAD)).select(*columns, F.explode(F.sequence(F.lit(1).cast("bigint"), n)).alias(copy))
    if top <= SPREAD - 1:
        return one
    spot = next(f"_n{i}" for i in range(len(docs.columns) + 1) if f"_n{i}" not in docs.columns)
    first = F.explode(F.sequence(F.lit(1).cast("bigint"), n, F.lit(SPREAD).cast("bigint")))
    blocks = joined.filter(n > SPREAD).select(*columns, n.alias(spot), first.alias(copy)).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    last = F.least(F.col(f"`{copy}`") + (SPREAD - 1), F.col(f"`{spot}`"))
    return one.union(blocks.select(*[F.col(f"`{c}`") for c in out.columns], F.explode(F.sequence(F.col(f"`{copy}`"), last)).alias(copy)))
