"""The verdict's stages as relations: contexts, dictionary look-ups, whitelist.

These give what the one-call functions give, from tables that a plan shows: a
row for each payload and context, an anti or semi join with the fingerprints,
and one CASE for what is common in plain text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions import columns, sqlscan
from siftstone.functions.lexicon import Dictionary, load
from siftstone.sources import payloads as sources

#: Dimension tables are broadcast up to this many rows; beyond it Spark chooses the join by size.
BROADCAST_ROWS = 20_000


def bounded(dimension: DataFrame, rows: int) -> DataFrame:
    """``dimension`` with a broadcast hint if its known size ``rows`` is within the bound."""
    return F.broadcast(dimension) if rows <= BROADCAST_ROWS else dimension


def word_table(spark: SparkSession, dictionary: Dictionary | None = None) -> DataFrame:
    """(word, type) of the lexicon's SQL words."""
    return spark.createDataFrame(load(dictionary).rows(), "word string, type string")


def context_table(spark: SparkSession) -> DataFrame:
    """The five passes: step, flags, the quote that a payload needs, and whether a pass only follows a hint of another dialect."""
    q = sqlscan
    rows = [
        (1, q.QUOTE_NONE | q.ANSI, None, False),
        (2, q.QUOTE_NONE | q.MYSQL, None, True),
        (3, q.QUOTE_SINGLE | q.ANSI, "'", False),
        (4, q.QUOTE_SINGLE | q.MYSQL, "'", True),
        (5, q.QUOTE_DOUBLE | q.MYSQL, '"', False),
    ]
    return spark.createDataFrame(rows, "step int, flags int, quote string, after_hint boolean")


def eligible_passes(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """``payloads`` with a row for each pass that the payload's bytes allow; an empty payload has none."""
    contexts = F.broadcast(context_table(payloads.sparkSession))  # five rows
    text = F.col(payload).cast("binary")
    allowed = F.col("quote").isNull() | F.contains(text, F.col("quote").cast("binary"))
    return payloads.where(F.octet_length(text) > 0).join(contexts, allowed)


def quote_context(flags: Column) -> Column:
    """The simulated quote of a pass; empty for none, and single before double."""
    return F.when(flags.bitwiseAND(sqlscan.QUOTE_SINGLE) != 0, "'").when(flags.bitwiseAND(sqlscan.QUOTE_DOUBLE) != 0, '"').otherwise("")


def default_flags(flags: Column) -> Column:
    return F.when(flags == 0, F.lit(sqlscan.QUOTE_NONE | sqlscan.ANSI)).otherwise(flags)


def reparse(stats: Column) -> Column:
    """Whether the pass has seen what another dialect would read otherwise."""
    return (stats["comment_ddx"] != 0) | (stats["comment_hash"] != 0)


def dictionary_key(fingerprint: Column) -> Column:
    """A fingerprint as it stands in a dictionary of words."""
    return F.concat(F.lit("0"), F.upper(fingerprint))


def fingerprint_of(tokens: Column) -> Column:
    kinds = F.array_join(F.transform(tokens, lambda t: t["type"]), "")
    return F.when(F.contains(kinds, F.lit("X")), "X").otherwise(kinds)


def blacklisted(rows: DataFrame, fingerprints: DataFrame, column: str = "fingerprint") -> DataFrame:
    """Rows whose fingerprint is in ``fingerprints`` (fingerprint in any case)."""
    keys = fingerprints.select(dictionary_key(F.col("fingerprint")).alias("__key")).distinct()
    return rows.join(keys, dictionary_key(F.col(column)) == F.col("__key"), "left_semi")


def not_blacklisted(rows: DataFrame, fingerprints: DataFrame, column: str = "fingerprint") -> DataFrame:
    """The other rows; one without a fingerprint is here."""
    keys = fingerprints.select(dictionary_key(F.col("fingerprint")).alias("__key")).distinct()
    return rows.join(keys, dictionary_key(F.col(column)) == F.col("__key"), "left_anti")


def _valid_utf8(data: Column) -> Column:
    return F.is_valid_utf8(data.cast("string"))


def whitelist(fingerprint: Column, tokens: Column, pulled: Column, payload: Column) -> Column:
    """Whether a blacklisted fingerprint stands; the scanner's rules as one CASE.

    ``tokens`` are folded tokens, ``pulled`` counts the raw ones, ``payload`` is binary.
    """
    size = F.length(fingerprint)
    token = lambda i: F.try_element_at(tokens, F.lit(i + 1))
    lead = lambda i, n: F.upper(F.hex(F.substring(token(i)["val"], 1, n)))
    second = lead(1, 1)
    rest = F.substring(F.hex(payload), 2 * token(0)["len"] + 1, 4)
    byte = F.conv(F.substring(rest, 1, 2), 16, 10).cast("int")
    spaced = (byte <= 32) | (byte >= 128) | rest.isin("2F2A", "2D2D")
    hidden = F.contains(F.lower(payload.cast("string")), F.lit("sp_password")) & _valid_utf8(payload)
    yes, no = F.lit(True), F.lit(False)
    two = (
        F.when(F.size(tokens) < 2, yes)
        .when(F.substring(fingerprint, 2, 1) == "U", pulled != 2)
        .when(second == "23", no)
        .when((fingerprint == "nc") & (second != "2F"), no)
        .when((fingerprint == "1c") & ((second == "2F") | (pulled > 2)), yes)
        .when(fingerprint == "1c", F.coalesce(spaced, no))
        .when((token(1)["len"] > 2) & (second == "2D"), no)
        .otherwise(yes)
    )
    into = F.hex(F.substring(token(1)["val"], 1, 4)) == F.hex(F.lit("INTO"))
    three = (
        F.when(F.size(tokens) < 3, yes)
        .when(
            fingerprint.isin("sos", "s&s"),
            (token(0)["str_open"] == "") & (token(2)["str_close"] == "") & (token(0)["str_close"] == token(2)["str_open"]),
        )
        .when(fingerprint.isin("s&n", "n&1", "1&1", "1&v", "1&s") & (pulled == 3), no)
        .when((token(1)["type"] == "k") & ((token(1)["len"] < 5) | ~into), no)
        .otherwise(yes)
    )
    return (
        F.when((size > 1) & fingerprint.endswith("c") & hidden, yes).when(size == 2, two).when(size == 3, three).otherwise(yes)
    )


def scan_once(payloads: DataFrame, look, payload: str = "payload") -> DataFrame:
    """``payloads`` with ``result``, what ``look`` (a function of a payload column) gives, each distinct payload looked at once.

    Distinct payloads are shuffled and joined back.  Where more than half of
    the payloads are distinct, as estimated, each is looked at where it is.  A
    null payload gives null.
    """
    spark = payloads.sparkSession
    kinds, rows = payloads.agg(F.approx_count_distinct(payload), F.count(payload)).first()
    if 2 * kinds > rows:
        return payloads.withColumn("result", look(F.col(payload).cast("binary")))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-kinds // sources.TASK_ROWS))
    distinct = payloads.select(F.col(payload).cast("binary").alias("__payload")).where("__payload is not null").distinct()
    # dealt by the key of the join, and to as many tasks as there are, or more where one would be long: payloads are few bytes and much work
    dealt = distinct.select(F.sha2("__payload", 256).alias("__key"), "__payload").repartition(tasks, "__key")
    found = dealt.select("__key", look(F.col("__payload")).alias("result"))
    keyed = payloads.withColumn("__key", F.sha2(F.col(payload).cast("binary"), 256))
    return keyed.join(found, "__key", "left").drop("__key")


def relational_sqli(payloads: DataFrame, key: str, payload: str = "payload", dictionary: Dictionary | None = None) -> DataFrame:
    """Verdicts through the stages: passes, folding, look-up, CASE, first hit.

    One row per row of ``payloads`` (``key`` must be unique): key, is_injection,
    and fingerprint and flags of the last pass that the schedule tries.
    """
    lexicon = load(dictionary)
    passes = payloads.select(key, F.col(payload).cast("binary").alias("payload"))
    tried = passes.select(key, "payload", F.posexplode(columns.sqli_passes("payload", 0, dictionary)).alias("step", "tried"))
    folded = tried.select(key, "payload", "step", "tried.*")  # with the tokens: a second function would scan each pass again, in workers of its own
    rows = [(f,) for f in sorted(lexicon.fingerprints)]
    listed = payloads.sparkSession.createDataFrame(rows, "__listed string")
    known = folded.join(bounded(listed, len(rows)), F.upper("fingerprint") == F.col("__listed"), "left").withColumn("listed", F.col("__listed").isNotNull())
    judged = known.withColumn("hit", F.col("listed") & whitelist(F.col("fingerprint"), F.col("tokens"), F.col("stats")["tokens"], F.col("payload")))
    last = judged.groupBy(key).agg(F.max("hit").alias("is_injection"), F.max_by(F.struct("fingerprint", "flags"), "step").alias("last"))
    return payloads.select(key).join(last, key, "left").select(
        key, F.coalesce("is_injection", F.lit(False)).alias("is_injection"), F.coalesce("last.fingerprint", F.lit("")).alias("fingerprint"), "last.flags"
    )
