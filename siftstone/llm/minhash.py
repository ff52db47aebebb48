"""Near-duplicate documents by circulant MinHash.

Two permutations of the 32-bit integers make all coordinates: the first
scatters the shingles, the second is applied after a circular shift, and
coordinate k takes the shift k * STEP.  Bands of coordinates give candidates,
which are confirmed on full shingle sets.

Equal sets are one class from the start, so exact copies cost one row each.  In
a band's bucket every member is confirmed against the two ends of the bucket
first: the members whose id, mixed with the band, is least and greatest.  As
each band mixes otherwise, a member of a large group meets up to 2 * BANDS
different ends.  Buckets whose members are still apart are joined into clouds by
the members they share.  In a cloud everything outside its largest component is
compared with everything, each two blocks once: a task counts the shingles that
two blocks of sets have in common and returns links, never pairs.  So no link
between members of a bucket is given up, and a large group that is linked
through its ends costs a linear number of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm import _words
from siftstone.llm._joins import dealt_anew
from siftstone.llm._scratch import materialise
from siftstone.llm.components import components

SHINGLE_WORDS = 5
#: Documents are linked at this many hundredths of Jaccard similarity.
THRESHOLD = 75
#: At similarity 0.75 a pair misses all bands with probability (1 - 0.75**5)**40 = 2e-5.
BANDS, ROWS = 40, 5
STEP = 0x9E3779B1
_BLOCK = 2048
#: Sets of a block that is compared with another, and shared shingles that are counted at once.
_BLOCK_NODES, _COLUMNS = 256, 4096


def _document_shingles(words: _words.Words) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    hashes = _words.hash_words(words, lower=True)
    runs = _words.hash_runs(hashes, SHINGLE_WORDS)
    bounds = words.bounds.tolist()
    for first, last in zip(bounds, bounds[1:]):
        count = last - first
        if count >= SHINGLE_WORDS:
            found = np.sort(runs[first : last - SHINGLE_WORDS + 1])
            keep = np.empty(len(found), bool)
            keep[0] = True
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            yield found[keep]
        else:
            yield _words.hash_runs(hashes[first:last], count) if count else hashes[:0]


def _coordinates(shingles: np.ndarray, count: int) -> np.ndarray:
    """The smallest second-permuted value of the set under each of ``count`` shifts."""
    scattered = (_words.mix(shingles) >> np.uint64(32)).astype(np.uint32)
    shifts = (np.arange(count, dtype=np.uint64) * np.uint64(STEP)).astype(np.uint32)[:, None]
    least = None
    for at in range(0, len(scattered), _BLOCK):
        x = scattered[None, at : at + _BLOCK] + shifts
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        now = x.min(axis=1)
        least = now if least is None else np.minimum(least, now)
    return least


def _band_keys(coordinates: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of each row of ``coordinates``."""
    rows = coordinates.reshape(len(coordinates), bands, -1).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for j in range(rows.shape[2]):
        keys = _words.mix(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, j])
    return keys.view(np.int64)


def _signatures(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, words in _words.text_chunks(batch, "text"):
                sizes, keys, coordinates, at = [], [], [], []
                for i, shingles in enumerate(_document_shingles(words)):
                    sizes.append(len(shingles))
                    keys.append(blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
                    if len(shingles):
                        coordinates.append(_coordinates(shingles, bands * rows))
                        at.append(i)
                filled = np.zeros(last - first, np.int32)
                filled[at] = bands
                values = _band_keys(np.stack(coordinates), bands).ravel() if at else np.zeros(0, np.int64)
                offsets = np.concatenate([[0], np.cumsum(filled)]).astype(np.int32)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(sizes, pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "bands"],
                )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, words in _words.text_chunks(batch, "text"):
            sets = list(_document_shingles(words))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.record_batch(
                [batch.column(0).slice(first, last - first), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                names=["node", "shingles"],
            )


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left_set"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right_set"))
    both = F.size(F.array_intersect("left_set", "right_set"))
    sizes = F.size("left_set") + F.size("right_set")
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where(100 * F.least(F.size("left_set"), F.size("right_set")) >= threshold * F.greatest(F.size("left_set"), F.size("right_set")))
        .where(100 * both >= threshold * (sizes - both))
        .select("a", "b")
    )


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many members each set of ``left`` has in common with each of ``right``; sets are of distinct integers."""

    def flat(sets):
        return np.concatenate(sets) if sets else np.zeros(0, np.int64)

    shared = np.intersect1d(flat(left), flat(right))
    counts = np.zeros((len(left), len(right)), np.float32)
    places = []
    for sets in (left, right):
        values, owner = flat(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        spot = np.minimum(np.searchsorted(shared, values), max(0, len(shared) - 1))
        inside = shared[spot] == values if len(shared) else np.zeros(len(values), bool)
        spot, owner = spot[inside], owner[inside]
        order = np.argsort(spot, kind="stable")
        places.append((spot[order], owner[order], len(sets)))
    for first in range(0, len(shared), _COLUMNS):
        tables = []
        for spot, owner, size in places:
            low, high = np.searchsorted(spot, [first, first + _COLUMNS])
            table = np.zeros((size, _COLUMNS), np.float32)
            table[owner[low:high], spot[low:high] - first] = 1
            tables.append(table)
        counts += tables[0] @ tables[1].T
    return counts.astype(np.int64)


def _block_links(threshold: int):
    """Links of a block of nodes with another: for each node one with each component that it reaches there."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if left.num_rows and right.num_rows:
            sets = [[x.values.to_numpy() for x in t["shingles"]] for t in (left, right)]
            nodes = [t["node"].to_numpy() for t in (left, right)]
            labels = [t["label"].to_numpy() for t in (left, right)]
            sizes = [np.array([len(s) for s in x]) for x in sets]
            common = _common(*sets)
            union = sizes[0][:, None] + sizes[1][None, :] - common
            found = (100 * common >= threshold * union) & (labels[0][:, None] != labels[1][None, :])
            for i in np.flatnonzero(found.any(axis=1)).tolist():
                at = np.flatnonzero(found[i])
                _, first = np.unique(labels[1][at], return_index=True)
                b += nodes[1][at[first]].tolist()
                a += [int(nodes[0][i])] * len(first)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _between_components(open_rows: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) between components among the rows (band, node, label) of buckets that hold several."""
    first = open_rows.groupBy("band").agg(F.min("node").alias("a"))
    clouds = components(dealt_anew(open_rows.select("band", F.col("node").alias("b")), first, "band").select("a", "b"))
    nodes = open_rows.select("node", "label").distinct().join(clouds, "node", "left").select("node", "label", F.coalesce("root", "node").alias("cloud"))
    counts = nodes.groupBy("cloud", "label").agg(F.count("*").alias("n"))
    each = counts.groupBy("cloud").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("total"))
    blocks = lambda rows: F.ceil(rows / _BLOCK_NODES).cast("int")
    clouds = each.where(F.col("total") > F.col("most.n")).select(
        "cloud", F.col("most.label").alias("main"), blocks(F.col("total") - F.col("most.n")).alias("rows"), blocks(F.col("most.n")).alias("more")
    )
    full = materialise(nodes.join(clouds, "cloud").join(sets, "node"), "open_sets")
    # Blocks below ``rows`` hold what is outside the largest component; each meets itself and every later one.
    deal = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
    full = full.withColumn("block", F.when(F.col("label") != F.col("main"), deal("rows")).otherwise(F.col("rows") + deal("more")))
    later = F.sequence("block", F.col("rows") + F.col("more") - 1)
    earlier = F.sequence(F.lit(0), F.least("block", F.col("rows") - 1))
    left = full.where("label <> main").select("cloud", "node", "label", "shingles", F.col("block").alias("i"), F.explode(later).alias("j"))
    right = full.select("cloud", "node", "label", "shingles", F.col("block").alias("j"), F.explode(earlier).alias("i"))
    key = ("cloud", "i", "j")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_block_links(threshold), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: int = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id and kept.

    A null or wordless text has an empty set and is linked with nothing.  Rows
    that repeat an id are one document: they share its component.  A row
    without an id is linked with nothing; its component_id is null and it is
    kept.  Other columns of ``docs`` are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialise(
        texts.mapInArrow(_signatures(bands, rows), "doc_id long, n_shingles long, set_key binary, bands array<long>"),
        "signatures",
    )
    filled = signed.where("set_key is not null and doc_id is not null")
    classes = materialise(
        filled.groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("least")).select(
            "set_key", F.col("least.doc_id").alias("node"), F.col("least.n_shingles").alias("n"), "least.bands"
        ),
        "classes",
    )

    in_band = classes.select("node", "n", F.explode("bands").alias("band"))
    mixed = F.col("node").bitwiseXOR(F.col("band"))
    end = lambda name: F.col(name).bitwiseXOR(F.col("band")).alias(name)
    buckets = in_band.groupBy("band").agg(F.min(mixed).alias("low"), F.max(mixed).alias("high")).where("low < high")
    shared = materialise(dealt_anew(in_band, buckets.select("band", end("low"), end("high")), "band"), "buckets")

    wanted = shared.select("node").distinct()
    sets = materialise(
        texts.join(wanted, F.col("doc_id") == F.col("node"), "left_semi").distinct().mapInArrow(_sets, "node long, shingles array<long>"),
        "sets",
    )

    stars = (
        shared.select("node", F.explode(F.array("low", "high")).alias("end"))
        .where("node <> end")
        .select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b"))
        .distinct()
    )
    of_class = filled.select("doc_id", "set_key").join(classes.select("set_key", "node"), "set_key")
    several = of_class.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    repeated = of_class.join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b"))
    linked = materialise(_confirmed(stars, sets, threshold).unionByName(repeated).distinct(), "links")
    roots = components(linked)

    labelled = shared.join(roots, "node", "left").select("band", "node", "n", "low", "high", F.coalesce("root", "node").alias("label"))
    apart = labelled.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("band")
    open_rows = materialise(dealt_anew(labelled, apart, "band").where("node <> low and node <> high").select("band", "node", "label"), "open")
    late = materialise(_between_components(open_rows, sets, threshold), "late_links")
    if not late.isEmpty():
        roots = components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(late))

    least = classes.select("set_key", "node").join(roots, "node", "left").select("set_key", F.coalesce("root", "node").alias("component_id"))
    grouped = filled.select("doc_id", "n_shingles", "set_key").join(least, "set_key").select("doc_id", "n_shingles", "component_id")
    alone = signed.where("set_key is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near-duplicates: of each component the document with the smallest id stays.

    Repeated rows of one id stay together; rows without an id stay.
    """
    gone = near_duplicates(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == F.col("__gone"), "left_anti")
