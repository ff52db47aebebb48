"""Folds by id and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves remainder ``fold``; a row without an id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(True))


def balanced(rows: DataFrame, label: str, id_col: str, total: int, max_labels: int = 256) -> DataFrame:
    """About ``total`` rows at most, as many of each value of ``label`` as there are or as their share allows.

    Chosen by a hash of the id, so the choice doesn't depend on partitions.  Of
    more than ``max_labels`` values the most frequent are learned.
    """
    counts = rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(max_labels).collect()
    if not counts:
        return rows.limit(0)
    share = max(1, total // len(counts))
    limit = F.lit(None).cast("double")
    for value, count in ((r[0], r[1]) for r in counts):
        limit = F.when(F.col(label) == value, F.lit(min(1.0, share / count))).otherwise(limit)
    spot = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(spot < limit)
