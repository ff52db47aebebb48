"""Reports over checked payloads: rates by file and category, first rows, grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grade(rate: Column) -> Column:
    """A band for a rate in per cent."""
    return F.when(rate >= 95, "excellent").when(rate >= 90, "good").when(rate >= 80, "fair").otherwise("poor")


def category_report(results: DataFrame) -> DataFrame:
    """tests, matches, mismatches, rate and grade by (category, file), by category, and in all.

    ``results`` has category, file and a boolean match; a null match is a
    mismatch.  ``level`` is file, category or total; of a level the columns
    above it are null, as are categories and files that are null themselves.
    """
    rolled = results.rollup("category", "file").agg(
        F.count("*").alias("tests"), F.count_if(F.coalesce("match", F.lit(False))).alias("matches"), F.grouping_id().alias("grouping")
    )
    level = F.when(F.col("grouping") == 0, "file").when(F.col("grouping") == 1, "category").otherwise("total")
    rate = F.round(100.0 * F.col("matches") / F.col("tests"), 2)
    return rolled.where("tests > 0").select(
        level.alias("level"), "category", "file", "tests", "matches", (F.col("tests") - F.col("matches")).alias("mismatches"), rate.alias("rate"), grade(rate).alias("grade")
    )


def mismatched_files(results: DataFrame) -> DataFrame:
    """For each category the files with a mismatch, sorted; the files of a category are few beside its rows."""
    return (
        results.where(~F.coalesce("match", F.lit(False))).select("category", "file").distinct()
        .groupBy("category").agg(F.sort_array(F.collect_list("file")).alias("files"))
    )


def first_of_each(rows: DataFrame, group: list[str], order: list[str], count: int) -> DataFrame:
    """The first ``count`` rows of each group, with their place."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= count)


def passed(results: DataFrame) -> DataFrame:
    """One row: passed, failed and total."""
    ok = F.coalesce("match", F.lit(False))
    return results.agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.count("*").alias("total"))
