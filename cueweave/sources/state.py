"""State of stages as an append-only log: the latest row of an (item, stage) counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "item_id string, stage string, status string, detail string, updated_at timestamp"


def latest(log: DataFrame, *, key: tuple[str, ...] = ("item_id", "stage")) -> DataFrame:
    """One row for each key, by updated_at; of equal times the largest status."""
    rest = [c for c in log.columns if c not in (*key, "updated_at")]
    best = F.max(F.struct("updated_at", *rest)).alias("_b")
    return log.groupBy(*key).agg(best).select(*key, *[F.col(f"_b.{c}").alias(c) for c in log.columns if c not in key])


def pending(items: DataFrame, log: DataFrame, stage: str, *, outputs: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Items (item_id) whose stage is to run: not done yet, or done with an output of theirs gone, or all if forced.

    `outputs` has item_id and exists for each file that the stage leaves; without it, done is enough.
    """
    if force:
        return items
    done = latest(log).filter((F.col("stage") == stage) & (F.col("status") == "done")).select("item_id")
    if outputs is not None:
        gone = outputs.filter(~F.coalesce("exists", F.lit(False))).select("item_id").distinct()
        done = done.join(gone, "item_id", "left_anti")
    return items.join(done, "item_id", "left_anti")


def record(rows: DataFrame, path: str) -> None:
    """Appends (item_id, stage, status, detail) to the log, stamped with the time."""
    rows.select("item_id", "stage", "status", "detail", F.current_timestamp().alias("updated_at")).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The log, empty where there is none yet."""
    from .lists import _exists

    return spark.read.schema(LOG).parquet(path) if _exists(spark, path) else spark.createDataFrame([], LOG)


def isolated(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results (ok, error, ...) as those that went well and those that failed."""
    return results.filter("ok"), results.filter("not ok")


def failures(results: DataFrame, name: str = "item_id") -> DataFrame:
    """(failed, details): how many rows of (name, ok, error) failed, and a line for each; one row, of 0 and an empty text where none did."""
    bad = results.filter("not ok").select(F.concat(F.lit("- "), F.col(name).cast("string"), F.lit(": "), F.coalesce("error", F.lit(""))).alias("line"))
    return bad.agg(F.count("*").alias("failed"), F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("details"))


def staged(items: DataFrame, stage: str, work: Callable[[DataFrame], DataFrame], folder: str, *, outputs: DataFrame | None = None, force: bool = False) -> DataFrame:
    """The stage's rows of all `items`: `work` is done for those that are pending, and the others' rows are read again.

    `work` takes items and gives rows with item_id, ok and error. They are appended to folder/<stage>, and what became of each item to
    folder/state: running first, then done, or failed with its errors. An item none of whose rows failed is done, if it has no row too. Rows
    count only of the run that the log names as the item's last done one, so what a broken-off run left behind never shows.
    """
    spark = items.sparkSession
    log = f"{folder}/state"
    todo = pending(items, read(spark, log), stage, outputs=outputs, force=force)
    run = uuid.uuid4().hex
    entry = lambda rows, status, detail: record(rows.select("item_id", F.lit(stage).alias("stage"), F.lit(status).alias("status"), detail.cast("string").alias("detail")), log)
    names = [r[0] for r in todo.select("item_id").limit(1).collect()]
    table = f"{folder}/{stage}"
    if names:
        begun = f"{folder}/todo-{run}"
        todo.write.parquet(begun)  # fixed, as the log that it comes from grows
        todo = spark.read.schema(todo.schema).parquet(begun)
        entry(todo, "running", F.lit(run))
        work(todo).withColumn("_run", F.lit(run)).write.mode("append").parquet(table)
        made = spark.read.parquet(table).filter(F.col("_run") == run)
        bad = made.filter(~F.coalesce("ok", F.lit(False))).groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("error")), " | ").alias("_e"))
        both = todo.select("item_id").join(bad, "item_id", "left")
        entry(both.filter("_e is null"), "done", F.lit(run))
        entry(both.filter("_e is not null"), "failed", F.col("_e"))
    last = latest(read(spark, log)).filter((F.col("stage") == stage) & (F.col("status") == "done")).select("item_id", F.col("detail").alias("_run"))
    rows = spark.read.parquet(table)
    return rows.join(last, ["item_id", "_run"], "left_semi").join(items.select("item_id"), "item_id", "left_semi").drop("_run", "ok", "error")
