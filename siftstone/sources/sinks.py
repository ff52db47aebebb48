"""Where results go: JSON, CSV and text, and what a payload looks like in them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions import htmlscan

TOKEN_COLUMNS = ("token_index", "token_type", "value", "position", "length", "str_open", "str_close")


def as_json(rows: DataFrame) -> DataFrame:
    """One column ``json`` with each row as pretty JSON."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"pretty": "true"}).alias("json"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


def token_rows(payloads: DataFrame, tokens: str = "tokens") -> DataFrame:
    """A row for each token, under the columns of the CSV export."""
    each = payloads.select(F.posexplode(tokens).alias("token_index", "t"))
    return each.select(
        "token_index", F.col("t.type").alias("token_type"), printable(F.col("t.val")).alias("value"), F.col("t.pos").alias("position"), F.col("t.len").alias("length"), "t.str_open", "t.str_close"
    )


def write_csv(rows: DataFrame, path: str) -> None:
    """With a header; values with a comma, a quote or a newline are quoted, and quotes doubled."""
    rows.write.mode("errorifexists").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def printable(data: Column) -> Column:
    """A string of the bytes, with what isn't UTF-8 replaced."""
    return F.make_valid_utf8(data.cast("string"))


def input_info(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """``payloads`` with text, hex and length of the payload."""
    data = F.col(column).cast("binary")
    return payloads.withColumns({"text": printable(data), "hex": F.lower(F.hex(data)), "length": F.octet_length(data)})


def token_text(token: Column) -> Column:
    """Type and value; strings get their quotes back, quoted variables their @ and quotes."""
    value = printable(token["val"])
    quoted = F.concat(token["str_open"], value, token["str_close"])
    variable = F.when(token["str_open"] != "", F.concat(F.repeat(F.lit("@"), token["count"]), quoted)).otherwise(value)
    shown = F.when(token["type"] == "s", quoted).when(token["type"] == "v", variable).otherwise(value)
    return F.rtrim(F.concat_ws(" ", token["type"], shown))


def first_tokens(tokens: Column, count: int) -> Column:
    return F.slice(tokens, 1, count)


# What the first byte of a token means to the SQL lexer.
_CLASSES = {
    "white": [*range(0x21), 0x7F, 0xA0], "bang": b"!", "string": b"\"'", "hash": b"#", "money": b"$", "op1": b"%^", "op2": b"&*:<=>|", "unary": b"+~",
    "left_parens": b"(", "right_parens": b")", "comma": b",", "dash": b"-", "number": b".0123456789", "slash": b"/", "semicolon": b";", "variable": b"@",
    "bstring": b"Bb", "estring": b"Ee", "nqstring": b"Nn", "qstring": b"Qq", "ustring": b"Uu", "xstring": b"Xx", "bword": b"[", "backslash": b"\\",
    "tick": b"`", "left_brace": b"{", "right_brace": b"}", "other": b"?]",
}


def byte_class(byte: Column) -> Column:
    """The class of a byte, as a two-digit hexadecimal string in capitals."""
    found = F.lit("word")
    for name, members in _CLASSES.items():
        found = F.when(byte.isin(*(f"{b:02X}" for b in members)), name).otherwise(found)
    return found


#: Bytes counted at once: numpy takes eight bytes of memory for each.
_PIECE = 1 << 20


def count_bytes(data: np.ndarray) -> np.ndarray:
    """How often each of the 256 values occurs, counted piece by piece."""
    found = np.zeros(256, np.int64)
    for at in range(0, len(data), _PIECE):
        found += np.bincount(data[at : at + _PIECE], minlength=256)
    return found


def byte_counts(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(byte, n): how often each byte occurs in all payloads, bytes as in ``byte_class``; counted batch by batch, without a row for each byte."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(0).cast(pa.large_binary()).drop_null()
            _, offsets, values = data.buffers()
            ends = np.frombuffer(offsets, np.int64)[data.offset : data.offset + len(data) + 1] if len(data) else [0, 0]
            found = count_bytes(np.frombuffer(values, np.uint8)[ends[0] : ends[-1]] if values is not None else np.zeros(0, np.uint8))
            some = np.flatnonzero(found)
            yield pa.record_batch([pa.array([f"{b:02X}" for b in some]), pa.array(found[some].astype(np.int64))], names=["byte", "n"])

    return payloads.select(F.col(column).cast("binary")).mapInArrow(count, "byte string, n long").groupBy("byte").agg(F.sum("n").alias("n"))


#: Distinct names that a task holds before it passes their counts on.
_NAMES = 50_000


def count_names(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Names in the HTML tokens of type ``kind`` of the first column, and counts; a name that comes after _NAMES others may come again."""
    found: Counter = Counter()
    out = lambda: pa.record_batch([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["name", "n"])
    for batch in batches:
        for data in batch.column(0):
            if data.is_valid:
                found.update(t.val for t in htmlscan.Scanner(data.as_py()) if t.type == kind)
                if len(found) >= _NAMES:
                    yield out()
                    found.clear()
    yield out()


def html_names(payloads: DataFrame, kind: str, column: str = "payload") -> DataFrame:
    """(name, n): how often each name occurs in the HTML tokens of type ``kind`` of all payloads, in small letters.

    Counted as the tokens come: a task holds a batch of payloads (Spark's 64 MB
    at most), its names up to _NAMES and one payload's, and neither lists nor
    rows of tokens.
    """
    counted = payloads.select(F.col(column).cast("binary")).mapInArrow(lambda batches: count_names(batches, kind), "name binary, n long")
    return counted.groupBy(F.lower(F.col("name").cast("string")).alias("name")).agg(F.sum("n").alias("n"))


def byte_rows(payloads: DataFrame, key: str, column: str = "payload") -> DataFrame:
    """(key, pos, byte, value, class): a row for each byte."""
    digits = F.hex(F.col(column).cast("binary"))
    pairs = F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1))
    each = payloads.select(key, F.posexplode(pairs).alias("pos", "byte"))
    return each.select(key, "pos", "byte", F.conv("byte", 16, 10).cast("int").alias("value"), byte_class(F.col("byte")).alias("class"))
