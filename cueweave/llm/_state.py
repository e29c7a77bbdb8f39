"""Written tables in the shared folder of the cluster, which cut lineage and outlive executors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..sources.shared import shared_dir


#: Shuffle files go when the job that made them is over: what `written` gives is read from its table and not made again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scopes: list[list[DataFrame]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read again from a table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._cueweave_path = path
    for scope in _scopes[-1:]:
        scope.append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._cueweave_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """The tables that are written within it, to be dropped once what was made from them is written too."""
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.remove(made)


def map_rows(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    """mapInArrow for tables with columns of any name, dots and all: `run` sees and gives batches whose columns go by place."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    out = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])
    return plain.mapInArrow(run, out).toDF(*schema.names)
