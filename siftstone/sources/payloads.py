"""Where payloads come from: lines, files, encoded text, golden cases.

Every source gives a binary column ``payload``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_TRIMMED = r"^\s+|\s+$"


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, _TRIMMED, "")


def payload(text: Column) -> Column:
    """The bytes of a string."""
    return text.cast("binary").alias("payload")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """One payload a line, trimmed; blank lines are dropped."""
    return spark.read.text(path).select(payload(_trim(F.col("value")))).where("octet_length(payload) > 0")


def single(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(bytearray(text.encode()),)], "payload binary")


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Each whole file is a payload; ``glob`` filters names; sorted by path."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", F.col("content").alias("payload")).orderBy("path")


def from_hex(text: Column) -> Column:
    """Bytes of hexadecimal digits; blanks and 0x are left out, anything else gives null."""
    return F.unhex(F.regexp_replace(text, "0x| ", "")).alias("payload")


def from_base64(text: Column) -> Column:
    return F.try_to_binary(text, F.lit("base64")).alias("payload")


def url_decoded(text: Column) -> Column:
    """Per-cent escapes decoded, a plus kept; text that can't be decoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def batch(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, payload) of files of lines; blank ones and those that begin with # are skipped, but counted.

    A large file is read in pieces: a line's number is its place in its piece,
    after the lines of the pieces before.  Rows come in no order; the payload isn't
    trimmed.
    """
    read = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"\r$", "").alias("line")
    )
    pieces = read.groupBy("path", "piece").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("piece")) - F.col("n")
    filled = read.where((_trim(F.col("line")) != "") & ~F.col("line").startswith("#"))
    number = (F.col("at") - F.col("first") + F.col("before") + 1).cast("int").alias("line_no")
    return filled.join(pieces.select("path", "piece", "first", before.alias("before")), ["path", "piece"]).select("path", number, payload(F.col("line")))


def corpus(spark: SparkSession, path: str, category: str, expect_injection: bool) -> DataFrame:
    """An attack corpus: lines trimmed, # and blank ones skipped, decoded from URLs."""
    raw = batch(spark, path).withColumn("raw", _trim(F.col("payload").cast("string"))).where(~F.col("raw").startswith("#"))
    return raw.select(
        F.lit(category).alias("category"), F.col("path").alias("file"), "line_no", "raw", payload(url_decoded(F.col("raw"))), F.lit(expect_injection).alias("expect_injection")
    )


CASE = "suite string, file string, name string, input binary, expected array<string>"


def golden_cases(spark: SparkSession, path: str, suite: str) -> DataFrame:
    """Files of --TEST--, --INPUT-- and --EXPECTED-- sections.

    Token cases keep the input but for its last newline; folding cases take the
    first line that isn't blank, trimmed; html5 cases lose leading blank lines.
    Blank expected lines are dropped.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    part = lambda name, until: F.regexp_extract("value", rf"(?s)--{name}--\r?\n(.*?)(?:--{until}--|\z)", 1)
    raw = F.regexp_replace(part("INPUT", "EXPECTED"), r"\r?\n\z", "")
    filled = F.filter(F.split(raw, r"\r?\n"), lambda line: _trim(line) != "")
    given = {"tokens": raw, "folding": F.coalesce(_trim(F.try_element_at(filled, F.lit(1))), F.lit("")), "html5": F.regexp_replace(raw, r"\A(\r?\n)+", "")}
    expected = F.filter(F.transform(F.split(part("EXPECTED", "TEST"), r"\r?\n"), lambda line: F.rtrim(line)), lambda line: line != "")
    return whole.select(
        F.lit(suite).alias("suite"), "file", _trim(part("TEST", "INPUT")).alias("name"), given[suite].cast("binary").alias("input"), expected.alias("expected")
    )


def distinct_payloads(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(sha1, payload), one of each; empty and null payloads are dropped."""
    return payloads.where(F.octet_length(column) > 0).select(F.sha1(column).alias("sha1"), F.col(column).cast("binary").alias("payload")).dropDuplicates(["sha1"])


def short_and_clean(payloads: DataFrame, column: str = "payload", below: int = 1000) -> DataFrame:
    """Payloads without NUL and under ``below`` bytes."""
    data = F.col(column).cast("binary")
    return payloads.where((F.octet_length(data) < below) & ~F.contains(data, F.lit(b"\0")))


#: Rows of a task that scans payloads, where they are dealt: 4 KB pages take over a millisecond each, and so a task about a minute.
TASK_ROWS = 50_000


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly to all cores, and to more tasks where one would have over TASK_ROWS rows.

    Scanning a payload costs far more than moving it.  How rows lie is counted,
    as partitions don't tell: those of a file with one row group are empty but
    for one.  Rows that already lie in partitions of at most twice an even share
    aren't shuffled.  A stream is always dealt, to the cores alone, as the files
    of its batches aren't known beforehand.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.isStreaming:
        return rows.repartition(cores)
    lying = rows.groupBy(F.spark_partition_id().alias("__part")).agg(F.count("*").alias("n"))  # of Parquet, this reads footers alone
    total, largest = lying.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    tasks = max(cores, -(-total // TASK_ROWS))
    return rows.repartition(tasks) if largest > 2 * -(-total // tasks) else rows
