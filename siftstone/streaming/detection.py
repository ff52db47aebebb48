"""Detection over streams; the scanners keep no state, so batch and stream agree row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.functions import columns
from siftstone.functions.lexicon import Dictionary


def detected(events: DataFrame, payload: str = "payload", dictionary: Dictionary | None = None) -> DataFrame:
    """``events`` with ``sqli`` and ``xss`` verdicts; works on a stream and on a table."""
    data = F.col(payload)
    return events.withColumn("sqli", columns.detect_sqli(data, 0, dictionary)).withColumn("xss", columns.detect_xss(data, dictionary))


def window_counts(verdicts: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "1 hour", keys: tuple[str, ...] = ()) -> DataFrame:
    """Payloads and injections in each tumbling window; rows later than ``late`` are dropped by a stream."""
    positive = F.col("sqli.is_injection") | F.col("xss.is_injection")
    return (
        verdicts.withWatermark(ts, late)
        .groupBy(F.window(ts, width), *keys)
        .agg(F.count("*").alias("payloads"), F.count_if(F.coalesce(positive, F.lit(False))).alias("injections"))
        .select(F.col("window.start").alias("window_start"), *keys, "payloads", "injections")
    )


def start(counts: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Write windows as Parquet as they close."""
    return counts.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
