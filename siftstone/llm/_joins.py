"""Joins whose frequent keys can be split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt_anew(left: DataFrame, right: DataFrame, key: str, how: str = "inner", right_key: str | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, both shuffled for this join alone; ``right_key`` is the key's other name in ``right``.

    A side that was just grouped by the key is joined as it lies, and then a
    frequent key's rows all stay in one task.  A second key, a hash of the
    first, makes Spark shuffle both sides for the join, and adaptive execution
    can split what is uneven.  Right keys should be few beside the left rows.
    """
    other = right.withColumnRenamed(right_key or key, "__key")
    same = (F.col(key) == F.col("__key")) & (F.xxhash64(key) == F.xxhash64("__key"))
    return left.join(other, same, how).drop("__key")
