"""Two engines' results side by side, and two token lists position by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(engine: DataFrame, oracle: DataFrame, key: str = "input") -> DataFrame:
    """Results (key, is_injection, fingerprint) of both, paired by input.

    ``match_result`` compares verdicts; fingerprints are compared only where
    both are positive, and ``match_fingerprint`` is null elsewhere.  ``differs``
    is true where verdict or fingerprint differ in any way, null being a value.
    Neither side is broadcast or sent to the driver.
    """
    side = lambda df, name: df.select(key, F.struct("is_injection", "fingerprint").alias(name))
    # merged, as both sides have a row for each input: by the bytes of files, millions of rows pass for few enough to broadcast
    both = side(engine, "engine").hint("merge").join(side(oracle, "oracle"), key)
    positive = F.col("engine.is_injection") & F.col("oracle.is_injection")
    same = lambda f: F.col(f"engine.{f}").eqNullSafe(F.col(f"oracle.{f}"))
    return both.select(
        key,
        "engine",
        "oracle",
        same("is_injection").alias("match_result"),
        F.when(positive, same("fingerprint")).alias("match_fingerprint"),
        (~(same("is_injection") & same("fingerprint"))).alias("differs"),
    )


def token_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows (key, index, left, right, same) of two token tables (key, index, token); the side that ends first reads MISSING."""
    a = left.select(key, "index", F.col("token").alias("left"))
    b = right.select(key, "index", F.col("token").alias("right"))
    paired = a.join(b, [key, "index"], "full")
    filled = paired.select(key, "index", *(F.coalesce(c, F.lit("MISSING")).alias(c) for c in ("left", "right")))
    return filled.withColumn("same", F.col("left") == F.col("right"))


def array_diff(rows: DataFrame, left: str, right: str) -> DataFrame:
    """``rows`` with ``diff``: array<struct<index,left,right,same>> of two string arrays, without a join; a null array is empty."""
    own = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    value = lambda c, i: F.coalesce(F.try_element_at(own(c), i + 1), F.lit("MISSING"))
    longest = F.greatest(F.size(own(left)), F.size(own(right)))
    places = F.when(longest > 0, F.sequence(F.lit(0), longest - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda i: F.struct(
        i.alias("index"), value(left, i).alias("left"), value(right, i).alias("right"), (value(left, i) == value(right, i)).alias("same")
    )
    return rows.withColumn("diff", F.transform(places, pair))
