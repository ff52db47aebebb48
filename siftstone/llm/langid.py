"""Language identification by error-correcting output codes.

Each language has a codeword, a row of a Hadamard matrix.  For each bit a
ridge classifier over hashed character n-grams tells the languages whose bit is
1 from the others.  Decoding adds an exponential loss over the bits, weighted
by how reliable each bit was in training, and takes the nearest codeword; a
text whose two nearest codewords lie close together is flagged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm import _words
from siftstone.llm._sample import balanced, held_out

FOLDS, HELD_OUT_FOLD = 4, 2
#: Labelled rows that are learned from, at most about this many in all.
SAMPLE_ROWS = 6000
DIMENSIONS = 1024
RIDGE = 0.02
#: A text is ambiguous if its two best languages' probabilities are nearer than this.
AMBIGUOUS_GAP = 0.2
UNDETERMINED = "und"

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32


def _features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed bigrams and trigrams of bytes, a row for each text.

    ASCII letters are taken as small; every byte of a character beyond ASCII
    takes part.  White space, digits and ASCII marks all count as one blank.
    """
    rows = len(offsets) - 1
    total = np.zeros((rows, DIMENSIONS), np.float32)
    size = len(data)
    if size < 2:
        return total
    codes = _LOWER[data]
    codes[(codes < 97) | ((codes > 122) & (codes < 128))] = 32
    of = np.repeat(np.arange(rows), np.diff(offsets))
    for length, factor in ((2, 0x9E3779B97F4A7C15), (3, 0xC2B2AE3D27D4EB4F)):
        count = size - length + 1
        if count <= 0:
            continue
        grams = codes[:count].copy()
        for j in range(1, length):
            grams = grams << np.uint64(8) | codes[j : j + count]
        spot = (grams * np.uint64(factor) >> np.uint64(54)).astype(np.int64)
        inside = (of[:count] == of[length - 1 :]) & (grams != (0x202020 & ((1 << 8 * length) - 1)))
        flat = np.bincount(of[:count][inside] * DIMENSIONS + spot[inside], minlength=rows * DIMENSIONS)
        total += flat.reshape(rows, DIMENSIONS)
    return np.sqrt(total / np.maximum(total.sum(axis=1, keepdims=True), 1))


def codewords(count: int) -> np.ndarray:
    """A row of +1 and -1 for each of ``count`` classes; any two differ in half of the places."""
    order = 8
    while order < count:
        order *= 2
    rows = np.arange(order)
    parity = np.array([[bin(i & j).count("1") & 1 for j in rows] for i in rows])
    code = np.where(parity, -1, 1)[:, 1:]  # the first column is the same for all
    used = code[:count]
    return used[:, np.abs(used.sum(axis=0)) < count] if count > 1 else used


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # dimensions + 1 x bits
    trust: np.ndarray  # weight of each bit
    sharpness: float

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        margins = features @ self.weights[:-1] + self.weights[-1]
        agree = np.clip(margins[:, None, :] * self.code[None], -4, 4)
        loss = (np.exp(-agree) * self.trust).sum(axis=2) / self.trust.sum()
        scaled = -loss * self.sharpness
        scaled -= scaled.max(axis=1, keepdims=True)
        shares = np.exp(scaled)
        return shares / shares.sum(axis=1, keepdims=True)


def fit(features: np.ndarray, labels: list[str]) -> Model:
    """Learn codewords' bits; classes weigh the same however many rows they have."""
    languages = sorted(set(labels))
    index = {x: i for i, x in enumerate(languages)}
    of = np.array([index[x] for x in labels], np.int64)
    code = codewords(len(languages)).astype(np.float64)
    if not languages:
        return Model([], code, np.zeros((DIMENSIONS + 1, 0)), np.zeros(0), 1.0)
    counts = np.bincount(of, minlength=len(languages))
    row_weight = (1.0 / counts)[of] / len(languages)
    x = np.hstack([features.astype(np.float64), np.ones((len(features), 1))])
    weighted = x * row_weight[:, None]
    penalty = RIDGE * np.trace(weighted.T @ x) / x.shape[1]
    weights = np.linalg.solve(weighted.T @ x + penalty * np.eye(x.shape[1]), weighted.T @ code[of])
    margins = x @ weights
    wrong = ((np.sign(margins) != code[of]) * row_weight[:, None]).sum(axis=0)
    trust = np.log((1 - wrong + 0.01) / (wrong + 0.01)).clip(0.05)
    model = Model(languages, code, weights, trust, 1.0)
    model.sharpness = max((2.0, 4.0, 8.0, 16.0), key=lambda s: _likelihood(model, s, features, of, row_weight))
    return model


def _likelihood(model: Model, sharpness: float, features: np.ndarray, of: np.ndarray, weight: np.ndarray) -> float:
    model.sharpness = sharpness
    shares = model.probabilities(features)
    return float((np.log(shares[np.arange(len(of)), of] + 1e-9) * weight).sum())


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = _words.flat(batch.column(1))
        for first, last in _words.chunks(offsets):
            part = offsets[first : last + 1]
            rows = _features(data[part[0] : part[-1]], part - part[0])
            yield pa.record_batch(
                [batch.column(0).slice(first, last - first), pa.array([r.tobytes() for r in rows], pa.binary())],
                names=["lang", "features"],
            )


def train(docs: DataFrame, folds: int = FOLDS, fold: int = HELD_OUT_FOLD, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from a bounded sample of the rows outside fold ``fold`` that have text, lang and an id."""
    known = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"), folds, fold)).where("lang is not null and text is not null")
    rows = balanced(known, "lang", "doc_id", sample_rows).select("lang", "text").mapInArrow(_featured, "lang string, features binary").collect()
    rows.sort(key=lambda r: (r[0], bytes(r[1])))
    features = np.stack([np.frombuffer(r[1], np.float32) for r in rows]) if rows else np.zeros((0, DIMENSIONS), np.float32)
    return fit(features, [r[0] for r in rows])


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            data, offsets = _words.flat(batch.column(at))
            for first, last in _words.chunks(offsets):
                part = offsets[first : last + 1]
                rows = last - first
                texts = batch.column(at).slice(first, rows)
                letters = np.array([_has_letter(t) for t in texts.to_pylist()], bool)
                names = np.full(rows, UNDETERMINED, object)
                score, unsure = np.zeros(rows), np.ones(rows, bool)
                if model.languages and letters.any():
                    shares = model.probabilities(_features(data[part[0] : part[-1]], part - part[0]))
                    best = shares.argmax(axis=1)
                    top = np.sort(shares, axis=1)
                    gap = top[:, -1] - (top[:, -2] if shares.shape[1] > 1 else 0)
                    names = np.where(letters, np.array(model.languages, object)[best], UNDETERMINED)
                    score = np.where(letters, top[:, -1], 0.0)
                    unsure = ~letters | (gap < AMBIGUOUS_GAP)
                columns = [c.slice(first, rows) for i, c in enumerate(batch.columns) if i != at]
                columns += [pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_()), pa.array(letters, pa.bool_())]
                yield pa.record_batch(
                    columns, names=[n for n in batch.schema.names if n != "__text"] + ["lang_pred", "score", "ambiguous", "__letters"]
                )

    return run


def _marked(docs: DataFrame, model: Model, keep: tuple[str, ...], text_col: str) -> DataFrame:
    """What ``predict`` gives, and whether the text has a letter."""
    kept = docs.select(*keep, F.col(text_col).alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "__text"]
    return kept.mapInArrow(_predict(model), ", ".join([*fields, "lang_pred string", "score double", "ambiguous boolean", "__letters boolean"]))


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Columns ``keep``, lang_pred, score (0 to 1) and ambiguous of every row.

    A null text, or one without a letter, is ``und`` with score 0; so is every
    text if there was nothing to learn from.  Only the text is looked at.
    """
    return _marked(docs, model, keep, text_col).drop("__letters")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of each document."""
    model = train(docs)
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT_FOLD).alias("held_out"), "lang_pred", "score", "ambiguous")


def accepted(docs: DataFrame) -> DataFrame:
    """``docs`` without the texts that have no letter, and so no language; a null lang is filled in.

    Whether a text stays doesn't depend on what was learned, nor on ambiguity:
    the flag says that two learned languages are near, not that there is none.
    A text without a label gets the language that the decoder finds, unless
    that is ambiguous or fewer than two languages were learned.
    """
    names = docs.columns
    named = docs.select(*(F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)))
    model = train(docs)
    marked = _marked(named, model, tuple(named.columns), f"c{names.index('text')}").where("__letters")
    if len(model.languages) > 1:
        lang = f"c{names.index('lang')}"
        marked = marked.withColumn(lang, F.coalesce(F.col(lang), F.when(~F.col("ambiguous"), F.col("lang_pred"))))
    return marked.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))
