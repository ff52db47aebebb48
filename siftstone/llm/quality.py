"""Quality scores by compression.

One zstandard dictionary is built from texts labelled good and one from texts
labelled bad.  A text is compressed with each; the difference of the two sizes
over their sum is small for neither and is turned into a probability by a
logistic curve that is fitted on labelled rows the dictionaries haven't seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm._sample import balanced, held_out

FOLDS, HELD_OUT_FOLD = 3, 1
#: Labelled rows that are learned from, at most about this many in all; half builds dictionaries, half fits the curve.
SAMPLE_ROWS = 4000
DICTIONARY_BYTES = 64 << 10
#: Characters of a labelled text that are learned from; whole texts are scored.
SAMPLE_CHARS = 16_384
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    _ready: list = field(default_factory=list, repr=False, compare=False)

    def __getstate__(self):
        return {"good": self.good, "bad": self.bad, "slope": self.slope, "offset": self.offset, "_ready": []}

    def difference(self, text: bytes) -> float:
        """(size with the bad dictionary - size with the good one) / their sum."""
        import zstandard

        if not self._ready:
            for content in (self.good, self.bad):
                if content:
                    table = zstandard.ZstdCompressionDict(content)
                    table.precompute_compress(level=LEVEL)
                    self._ready.append(zstandard.ZstdCompressor(dict_data=table, write_content_size=False, write_dict_id=False))
                else:
                    self._ready.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False))
        good, bad = (len(c.compress(text)) for c in self._ready)
        return (bad - good) / (bad + good)

    def score(self, text: bytes) -> float:
        x = self.slope * self.difference(text) + self.offset
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def _dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; where there is too little to train one, the texts themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, texts, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, MemoryError):
        return b"\n".join(texts)[:size]


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's method with a little shrinkage; classes weigh as they come."""
    if not len(x):
        return 0.0, 0.0
    scale = float(np.abs(x).max()) or 1.0
    design = np.stack([x / scale, np.ones(len(x))], axis=1)
    beta, penalty = np.zeros(2), np.diag([1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - penalty @ beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + penalty
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def fit(rows: list[tuple[bytes, int]]) -> Model:
    """A model of (text, 1 for good or 0) rows; even rows build the dictionaries, odd ones fit the curve."""
    build, rest = rows[::2], rows[1::2]
    of = lambda y: [t for t, label in build if label == y and t]
    model = Model(_dictionary(of(1)) if of(1) else b"", _dictionary(of(0)) if of(0) else b"", 0.0, 0.0)
    x = np.array([model.difference(t) for t, _ in rest])
    model.slope, model.offset = _curve(x, np.array([y for _, y in rest], float))
    return model


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold: int = HELD_OUT_FOLD, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from a bounded, balanced sample of labelled documents outside fold ``fold``.

    The labels are sampled first, so what is sent to the documents' tasks is
    bounded by ``sample_rows``.  Labels other than 0 and 1, and null ones, are
    left out; of several labels of an id each counts once, and of several rows
    of an id the least text.  What comes to the driver is bounded too: the first
    SAMPLE_CHARS characters of each text.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null")
    chosen = balanced(known.distinct().where(~held_out(F.col("doc_id"), folds, fold)), "quality", "doc_id", sample_rows)
    texts = docs.select("doc_id", F.left(F.coalesce("text", F.lit("")), F.lit(SAMPLE_CHARS)).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("doc_id", "text", "quality").collect()
    rows = sorted(((r[1] or "").encode(), r[2], r[0]) for r in rows)
    rows.sort(key=lambda r: (r[2] * 0x9E3779B1 & 0xFFFFFFFF, r[0], r[1]))
    return fit([(text, y) for text, y, _ in rows])


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Columns ``keep`` and score (0 to 1) of every row; a null text is empty.  Only the text is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            found = []
            for first in range(0, batch.num_rows, 512):
                found += [model.score((t or "").encode()) for t in batch.column(at).slice(first, 512).to_pylist()]
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.record_batch([*columns, pa.array(found, pa.float64())], names=[n for n in batch.schema.names if n != "__text"] + ["score"])

    kept = docs.select(*keep, F.col(text_col).alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "__text"]
    return kept.mapInArrow(run, ", ".join([*fields, "score double"]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    return score(docs, train(docs, labels)).select(
        "doc_id",
        held_out(F.col("doc_id"), FOLDS, HELD_OUT_FOLD).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
