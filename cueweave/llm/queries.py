"""Queries over the driver's tables, one for each operator of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contamination, html_paths, language, media, mixing, near_copies, quality, revisits, suffix_repeats, urls
from ._state import shared_dir

#: Least margin of a language decision.
LANGUAGE_MARGIN = 0.01
#: Labelled rows a language that the language model learns from.
LANGUAGE_SAMPLE = 400


#: Weights of sources in the mixture; the others weigh 1.
MIX_WEIGHTS = {"src0": 3.0, "src1": 2.0, "src2": 0.5}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), MIX_WEIGHTS)


def op2_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats.repeats(table(spark, sf_dir, "documents"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages at a listed address; the list is the pages of one spam host and every fifth page."""
    pages = table(spark, sf_dir, "pages")
    return urls.listed_pages(pages, pages.filter("url like '%cheap-pills%' or page_id % 5 = 0").select("url"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as pictures and sounds in tar shards of the shared folder."""
    return media.media_columns(media.rendered(table(spark, sf_dir, "embeddings")), f"{shared_dir(spark)}/media")


def op5_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits of the captures made of the pages; headers as sorted text."""
    out = revisits.resolved(revisits.records_of(table(spark, sf_dir, "pages")))
    entries = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return out.withColumn("headers", F.when(F.col("headers").isNotNull(), F.array_join(entries, ";")))


def op6_html_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_paths.extracted(table(spark, sf_dir, "pages"))


def op7_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"), least=LANGUAGE_MARGIN, sample=LANGUAGE_SAMPLE)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    from . import sql

    return {k[4:]: v for k, v in vars(sql).items() if k.startswith("SQL_")}
