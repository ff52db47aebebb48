"""Tables that cut lineage, written to the folder that driver and executors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from siftstone.sources.shared import remove, scratch_path

_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end_with_the_write(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of a query that ends in here at once, not when its driver collects garbage."""
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_CLEANUP)
        else:
            spark.conf.set(_SHUFFLE_CLEANUP, before)


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The result no longer depends on earlier shuffles, so a lost executor costs
    one task of a re-read, and those shuffles' files are deleted.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_end_with_the_write(spark):
        df.write.parquet(path, compression=compression)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table of ``materialise`` that nothing reads any more."""
    remove(table.sparkSession, table.scratch_path)
