"""Documents to a training mixture, a stage at a time; each stage's result is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import contamination, language, mixing, near_copies, suffix_repeats
from ._state import drop, scope, written
from .queries import LANGUAGE_MARGIN, LANGUAGE_SAMPLE, MIX_WEIGHTS, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told."""
    return language.keep_accepted(docs, least=LANGUAGE_MARGIN, sample=LANGUAGE_SAMPLE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_copies.drop_copies(docs)


def drop_suffix_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document, or an earlier place of the same one, has."""
    return suffix_repeats.drop_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark question, re-parameterised or not."""
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' weights ask, with a column copy."""
    return mixing.mixed(docs, MIX_WEIGHTS)


STAGES = [
    ("language", identify_language),
    ("near copies", drop_near_copies),
    ("suffix repeats", drop_suffix_repeats),
    ("contamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Linear machines and suffix sorting have no SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another. What a stage read and what it wrote on its way is deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    over: list[DataFrame] = []
    for name, stage in STAGES:
        with scope() as made:
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop(*over, *[t for t in made if t is not docs])
        over = [docs]
    return docs
