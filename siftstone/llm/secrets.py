"""Secret scans with corpus-wide ownership of each candidate.

Patterns find candidates.  A digest of each candidate's value, never the value,
is counted over the corpus by distinct repositories and owners.  A value that
many owners have is an example that was copied widely; one that a single owner
has, and that looks random, looks like a live credential.  Both add spans
(``example`` and ``live``) over the value to the base spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm._joins import dealt_anew
from siftstone.llm._scratch import materialise

KINDS = ("assign", "access", "hex", "live", "example")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = ("passw", "secret", "token", "api")
#: Distinct owners, and repositories of several owners, from which on a value counts as a widely copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 5
#: A live-looking value has one owner, who has it in so many repositories at most: a fixture is in more.
LIVE_REPOSITORIES = 2
#: Entropy in bits a character, and length, of a live-looking value.
LIVE_BITS, LIVE_LENGTH = 2.5, 12

_SPAN = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())])
_CANDIDATE = pa.struct([("digest", pa.binary()), ("start", pa.int32()), ("end", pa.int32()), ("random", pa.bool_())])


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value's start, value's end) of each base match, by start and kind; code points."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                found.append((m.start(), 0, m.end(), m.start(2), m.end(2)))
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= 20:
                found.append((m.start(), 1, m.end(), m.start(), m.end()))
    for m in _HEX.finditer(text):
        found.append((m.start(), 2, m.end(), m.start(), m.end()))
    return sorted(found)


def _looks_random(value: str) -> bool:
    if len(value) < LIVE_LENGTH:
        return False
    _, counts = np.unique(np.frombuffer(value.encode(), np.uint8), return_counts=True)
    share = counts / counts.sum()
    return float(-(share * np.log2(share)).sum()) >= LIVE_BITS


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        spans, candidates = [], []
        for start in range(0, batch.num_rows, 512):
            for text in batch.column(at).slice(start, 512).to_pylist():
                found = base_spans(text) if text else []
                spans.append([(s, k, e) for s, k, e, _, _ in found])
                values = sorted({(s, e) for _, _, _, s, e in found})
                candidates.append(
                    [(sha256(text[s:e].encode()).digest()[:16], s, e, _looks_random(text[s:e])) for s, e in values]
                )
        columns = [c for i, c in enumerate(batch.columns) if i != at]
        as_rows = lambda rows, kind: pa.array([[dict(zip(kind.names, x)) for x in r] for r in rows], pa.list_(kind))
        yield pa.record_batch(
            [*columns, as_rows(spans, _SPAN), as_rows(candidates, _CANDIDATE)],
            names=[n for n in batch.schema.names if n != "text"] + ["base", "candidates"],
        )


def _joined(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def ownership(found: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """digest, n_repositories, n_owners of every candidate of ``found`` (repo, owner, candidates), whether it is a widely copied example, and whether one owner's.

    Counting is in two steps, so a value that a third of all rows hold comes
    to a row for each repository and task before it is shuffled.
    """
    each = found.select("repo", "owner", F.explode("candidates.digest").alias("digest"))
    return (
        each.groupBy("digest", "owner", "repo").agg(F.lit(1).alias("one"))
        .groupBy("digest", "owner").agg(F.count("*").alias("repos"))
        .groupBy("digest").agg(F.sum("repos").alias("n_repositories"), F.count("*").alias("n_owners"))
        .withColumn("example", (F.col("n_owners") >= example_owners) | (F.col("n_owners") > 1) & (F.col("n_repositories") >= EXAMPLE_REPOSITORIES))
        .withColumn("owned", (F.col("n_owners") == 1) & (F.col("n_repositories") <= LIVE_REPOSITORIES))
    )


def _repository(docs: DataFrame, repo: Column | None, owner: Column | None) -> list[Column]:
    """Repository and owner of each row: as given, else source with lang, and source; a missing column is null."""
    own = lambda name: F.col(name) if name in docs.columns else F.lit(None).cast("string")
    repo = F.concat_ws("/", own("source"), own("lang")) if repo is None else repo
    owner = own("source") if owner is None else owner
    return [F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in ((repo, "repo"), (owner, "owner"))]


_FOUND = "base array<struct<start:int,rank:int,end:int>>, candidates array<struct<digest:binary,start:int,end:int,random:boolean>>"


def _judged(found: DataFrame, example_owners: int) -> DataFrame:
    """(row, added): the spans that the counts over all of ``found`` (row, repo, owner, candidates) add."""
    each = dealt_anew(found.select("row", F.inline("candidates")), ownership(found, example_owners), "digest")
    rank = F.when(F.col("example"), F.lit(4)).when(F.col("owned") & F.col("random"), F.lit(3))
    return each.withColumn("rank", rank).where("rank is not null").groupBy("row").agg(F.collect_list(F.struct("start", "rank", "end")).alias("added"))


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo: Column | None = None,
    owner: Column | None = None,
    example_owners: int = EXAMPLE_OWNERS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and all spans (start, rank of kind, end), and counts by kind.

    A null text is empty.  A null repository or owner is one of its own name,
    ''.  Repeated rows are scanned each for itself.  ``repo`` and ``owner``
    default to source with lang, and source, where there are such columns.
    Other columns are not read; an empty table has no spans.
    """
    kept = docs.select(F.col(id_col).alias("doc_id"), *_repository(docs, repo, owner), F.col(text_col).alias("text"))
    id_type = kept.schema["doc_id"].dataType.simpleString()
    found = materialise(
        kept.mapInArrow(_scan, f"doc_id {id_type}, repo string, owner string, {_FOUND}").withColumn("row", F.monotonically_increasing_id()), "candidates"
    )
    with_some = found.where(F.size("candidates") > 0)
    some = with_some.join(_judged(with_some, example_owners), "row", "left").withColumn(
        "spans", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added"))
    )
    out = some.select("doc_id", "base", "spans").unionByName(
        found.where(F.size("candidates") == 0).select("doc_id", "base", F.col("base").alias("spans"))
    )
    counted = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return out.withColumns({f"n_{kind}": counted(i) for i, kind in enumerate(KINDS[:3])})


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each document."""
    return scan(docs).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )


def _split_off(with_spans: bool, text: str):
    """Rows whose text has a base span, with their spans and candidates; or the other rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            has = np.array([bool(t) and bool(base_spans(t)) for first in range(0, batch.num_rows, 512) for t in batch.column(at).slice(first, 512).to_pylist()], bool)
            part = batch.filter(pa.array(has == with_spans))
            if with_spans and part.num_rows:
                spans = next(_scan(iter([pa.record_batch([part.column(at)], names=["text"])])))
                part = pa.record_batch([*part.columns, *spans.columns], names=[*part.schema.names, "base", "candidates"])
            if part.num_rows:
                yield part

    return run


def _hidden(text: str, spans: list[dict], mark: str) -> str:
    """The text with each span replaced by the mark; one that begins within a hidden one adds only its rest."""
    done, at = [], 0
    for span in sorted(spans, key=lambda s: (s["start"], s["rank"], s["end"])):
        if span["start"] >= at:
            done += [text[at : span["start"]], mark]
        at = max(at, span["end"])
    return "".join([*done, text[at:]])


def redact(
    docs: DataFrame, text_col: str = "text", mark: str = "[secret]", example_owners: int = EXAMPLE_OWNERS, length_col: str | None = None
) -> DataFrame:
    """``docs`` with each base or live span that is not a widely copied example replaced by ``mark``.

    Columns and rows stay as they are, and so does a text without such spans,
    which is passed on where it is read; ``length_col``, if given, gets the new
    length of a text that has changed.  A null text stays null, repeated rows
    stay repeated, and an empty table stays empty.
    """
    names = docs.columns
    text = f"c{names.index(text_col)}"
    named = docs.select(*(F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema)
    plain = named.mapInArrow(_split_off(False, text), fields)
    with_owner = docs.select(*(F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)), *_repository(docs, None, None))
    found = materialise(
        with_owner.mapInArrow(_split_off(True, text), f"{fields}, repo string, owner string, {_FOUND}").withColumn("row", F.monotonically_increasing_id()), "candidates"
    )

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            added = batch.column(batch.schema.get_field_index("added"))
            out = []
            for value, base, more in zip(batch.column(at).to_pylist(), batch.column(batch.schema.get_field_index("base")).to_pylist(), added.to_pylist()):
                examples = [s for s in more or [] if s["rank"] == 4]
                spans = [s for s in base + [s for s in more or [] if s["rank"] != 4] if not any(x["start"] >= s["start"] and x["end"] <= s["end"] for x in examples)]
                out.append(_hidden(value, spans, mark))
            columns = [pa.array(out, pa.string()) if i == at else c for i, c in enumerate(batch.columns[: len(names)])]
            changed = pa.array([a != b for a, b in zip(out, batch.column(at).to_pylist())], pa.bool_())
            yield pa.record_batch([*columns, changed], names=[*batch.schema.names[: len(names)], "changed"])

    own = [f"c{i}" for i in range(len(names))]
    done = found.join(_judged(found, example_owners), "row", "left").select(*own, "base", "added").mapInArrow(hide, f"{fields}, changed boolean")
    if length_col:
        length = f"c{names.index(length_col)}"
        done = done.withColumn(length, F.when(F.col("changed"), F.length(text).cast(docs.schema[length_col].dataType)).otherwise(F.col(length)))
    return plain.unionByName(done.select(*own)).select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))
