"""Exact top-k search by integer inner product, a block at a time.

Vectors are put in the order of their ids and cut into document-range blocks.
A block is one row: its forward index (ids and components, in the narrowest
integers that hold them) and the largest and smallest value of each component.
A query's bound for a block is the sum over the components of the larger of
q * max and q * min, so no row of the block scores more.

Blocks lie in groups of consecutive ones.  Three steps, of which only the first
looks at each pair of a query and a group, and reads no forward index for it:

* Bounds: chunks of queries meet the maxima of each group's blocks.
* Seed: a query searches the group with its best bound, block after block by
  falling bound, until the next bound is below its kth score.
* Rest: a query goes to another group only if a bound there reaches that kth
  score, and starts there with it.

What one task holds is a group and a chunk, both of at most GROUP_VALUES
components (or one block), whatever the number of vectors and their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftstone.llm._joins import dealt_anew
from siftstone.llm._scratch import materialise

BLOCK_ROWS = 512
#: Components of a group of blocks, and of a chunk of queries.
GROUP_VALUES = 1 << 24
#: Queries whose bounds and scores are held at once.
SLICE = 2048
SCALE = 256
#: Products and their sums are exact in doubles, and in 64-bit integers, below these.
_EXACT, _WHOLE = float(1 << 53), float(1 << 62)
#: Scores beyond this count as this; one less than the least is no score.
_MOST = (1 << 63) - 2
_NONE = -_MOST - 1


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same integers in 16, 32 or 64 bits."""
    for kind in (np.int16, np.int32):
        limits = np.iinfo(kind)
        if not values.size or limits.min <= values.min() and values.max() <= limits.max:
            return values.astype(kind)
    return values


def _wide(data, rows: int, width: int) -> np.ndarray:
    """The rows of ``width`` integers that ``_narrow`` made ``data`` of."""
    size = len(data) // max(1, rows * width)
    return np.frombuffer(data, f"<i{size}" if size else "<i2").reshape(rows, width)


# ---------------------------------------------------------------- blocks


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of consecutive rows (vec_id, v) of one length."""
    for batch in batches:
        vectors = batch.column(1)
        lengths = vectors.value_lengths().to_numpy()
        edges = np.flatnonzero(np.diff(lengths)) + 1
        for a, z in zip([0, *edges.tolist()], [*edges.tolist(), len(lengths)]):
            if a < z:
                part = vectors.slice(a, z - a)
                yield batch.column(0).slice(a, z - a).to_numpy(), part.flatten().to_numpy(zero_copy_only=False).reshape(z - a, int(lengths[a]))


def _blocks(block_rows: int):
    """Blocks of a sorted partition: its task, the place of the first row in it, rows, width, ids, components, maxima and minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, place = TaskContext.get().partitionId(), 0
        ids, rows = np.zeros(0, np.int64), np.zeros((0, 0), np.int64)

        def cut(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal ids, rows, place
            while len(ids) >= block_rows or whole and len(ids):
                own, block = ids[:block_rows], rows[:block_rows]
                raw = [own.tobytes(), _narrow(block).tobytes(), block.max(0).tobytes(), block.min(0).tobytes()]
                yield pa.record_batch(
                    [
                        pa.array([task], pa.int32()), pa.array([place], pa.int64()), pa.array([len(own)], pa.int32()), pa.array([block.shape[1]], pa.int32()),
                        *(pa.array([x], pa.binary()) for x in raw),
                    ],
                    names=["task", "place", "n", "width", "ids", "data", "high", "low"],
                )
                ids, rows, place = ids[block_rows:], rows[block_rows:], place + len(own)

        for own, matrix in _runs(batches):
            if len(ids) and matrix.shape[1] != rows.shape[1]:
                yield from cut(True)
            ids, rows = (np.concatenate([ids, own]), np.concatenate([rows, matrix])) if len(ids) else (own, matrix)
            yield from cut(False)
        yield from cut(True)

    return run


_BLOCK = "task int, place long, n int, width int, ids binary, data binary, high binary, low binary"


def _indexed(vectors: DataFrame, group_rows: int, block_rows: int) -> DataFrame:
    """The blocks of ``vectors``, with the group that each is in."""
    # a random last key, so that rows of one id can be dealt to several tasks
    dealt = vectors.select("vec_id", "v").repartitionByRange(F.size("v"), "vec_id", F.rand(7)).sortWithinPartitions(F.size("v"), "vec_id")
    blocks = materialise(dealt.mapInArrow(_blocks(block_rows), _BLOCK), "blocks")
    starts, total = [], 0
    for task, rows in sorted(map(tuple, blocks.groupBy("task").agg(F.sum("n")).collect())):  # a row for each task
        starts.append((task, total))
        total += rows
    first = vectors.sparkSession.createDataFrame(starts, "task int, first long")
    return blocks.join(first, "task").withColumn("group", F.floor((F.col("first") + F.col("place")) / group_rows).cast("int")).drop("task", "place", "first")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, matrix in _runs(batches):
        data = [row.tobytes() for row in _narrow(matrix)]
        yield pa.record_batch(
            [pa.array(ids, pa.int64()), pa.array(np.full(len(ids), matrix.shape[1], np.int32)), pa.array(data, pa.binary())], names=["vec_id", "width", "data"]
        )


# ---------------------------------------------------------------- bounds and scores


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """No row of block b scores more with query q than bounds[q, b]; ``high`` and ``low`` have a row for each block."""
    queries, high, low = (x.astype(np.float64) for x in (queries, high, low))
    found = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    return found + np.abs(queries) @ np.maximum(np.abs(high), np.abs(low)).T * 1e-12  # rounding must not lower a bound


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles or 64-bit integers where those are exact, else whole numbers, cut to 64 bits."""
    left, right = queries.astype(np.float64), rows.astype(np.float64)
    most = np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * max(1, queries.shape[1])
    if most < _EXACT:
        return (left @ right.T).astype(np.int64)
    if most < _WHOLE:
        return queries.astype(np.int64) @ rows.T.astype(np.int64)
    return np.clip(queries.astype(object) @ rows.T.astype(object), -_MOST, _MOST).astype(np.int64)


def _merge(best, scores, ids, k):
    """The k highest of both, ties to the smaller id; ``best`` is (scores, ids), a row for each query."""
    scores = np.concatenate([best[0], scores], axis=1)
    ids = np.concatenate([best[1], ids], axis=1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def search_blocks(query_ids, queries, blocks, k, floor=None):
    """(query_ids, ids, scores) of the k best rows of other ids for each query, and how many blocks each query has scored.

    ``blocks`` are (ids, rows, maxima, minima), ids rising within each.  With
    ``floor``, a score for each query, rows below it may be left out.
    """
    count = len(query_ids)
    best = np.full((count, k), _NONE), np.full((count, k), np.iinfo(np.int64).max)
    floor = np.full(count, _NONE) if floor is None else floor
    limits = bounds(queries, np.stack([b[2] for b in blocks]), np.stack([b[3] for b in blocks]))
    visits = np.argsort(-limits, axis=1, kind="stable")
    scored = np.zeros(count, np.int64)
    active = np.ones(count, bool)
    for step in range(len(blocks)):
        turn = visits[:, step]
        active &= limits[np.arange(count), turn] >= np.maximum(best[0][:, -1], floor)
        if not active.any():
            break
        for block in np.unique(turn[active]).tolist():
            of = np.flatnonzero(active & (turn == block))
            scored[of] += 1
            ids, rows = blocks[block][:2]
            scores = _scores(queries[of], rows)
            scores[query_ids[of, None] == ids[None, :]] = _NONE
            rise = (scores >= np.maximum(best[0][of, -1], floor[of])[:, None]).any(axis=1)
            if not rise.any():
                continue
            of, scores = of[rise], scores[rise]
            # ids rise within a block, so a stable sort leaves ties to the smaller id
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            best[0][of], best[1][of] = _merge((best[0][of], best[1][of]), np.take_along_axis(scores, top, 1), ids[top], k)
    found = best[0] > _NONE
    return np.repeat(query_ids, k)[found.ravel()], best[1][found], best[0][found], scored


def _by_width(queries: pa.Table, blocks: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of vectors in both: rows of queries, a slice at a time, their components, and rows of blocks."""
    widths = queries["width"].to_numpy(), blocks["width"].to_numpy()
    for width in np.intersect1d(*widths).tolist():
        rows, own = (np.flatnonzero(w == width) for w in widths)
        for at in range(0, len(rows), SLICE):
            part = rows[at : at + SLICE]
            data = queries["data"].take(pa.array(part)).to_pylist()
            yield part, np.stack([_wide(x, 1, width)[0].astype(np.int64) for x in data]), own


def _bounds(queries: pa.Table, blocks: pa.Table) -> pa.Table:
    """The best bound of each query among the blocks of a group."""
    ids, most = [], []
    for part, matrix, own in _by_width(queries, blocks):
        high, low = (np.stack([np.frombuffer(blocks[side][i].as_buffer(), "<i8") for i in own.tolist()]) for side in ("high", "low"))
        ids.append(queries["vec_id"].to_numpy()[part])
        most.append(bounds(matrix, high, low).max(axis=1))
    group = queries["group"][0].as_py() if queries.num_rows else 0
    ids, most = (np.concatenate(x) if x else np.zeros(0) for x in (ids, most))
    return pa.table([pa.array(ids.astype(np.int64)), pa.array(np.full(len(ids), group, np.int32)), pa.array(most.astype(np.float64))], names=["vec_id", "group", "bound"])


_FOUND = "query_id long, vec_id long, score long, scored long, blocks long"


def _search(k: int):
    """The k best of a group for each query; and a row for each query with the blocks that it scored, of how many."""

    def run(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        parts = []
        for part, matrix, own in _by_width(queries, blocks):
            sizes = [(int(blocks["n"][i].as_py()), int(blocks["width"][i].as_py())) for i in own.tolist()]
            raw = [[blocks[c][i].as_buffer() for c in ("ids", "data", "high", "low")] for i in own.tolist()]
            index = [(np.frombuffer(x, "<i8"), _wide(d, *size), np.frombuffer(h, "<i8"), np.frombuffer(low, "<i8")) for size, (x, d, h, low) in zip(sizes, raw)]
            ids = queries["vec_id"].to_numpy()[part]
            floor = queries["kth"].take(pa.array(part)).fill_null(_NONE).to_numpy()
            of, near, score, scored = search_blocks(ids, matrix, index, k, floor)
            none = np.zeros(len(ids), bool)
            parts.append(
                pa.table(
                    [
                        pa.array(np.concatenate([of, ids])),
                        pa.array(np.concatenate([near, np.zeros(len(ids), np.int64)]), mask=np.concatenate([np.zeros(len(of), bool), ~none])),
                        pa.array(np.concatenate([score, np.zeros(len(ids), np.int64)]), mask=np.concatenate([np.zeros(len(of), bool), ~none])),
                        pa.array(np.concatenate([np.zeros(len(of), np.int64), scored])),
                        pa.array(np.concatenate([np.zeros(len(of), np.int64), np.full(len(ids), len(index))])),
                    ],
                    names=[x.split()[0] for x in _FOUND.split(", ")],
                )
            )
        return pa.concat_tables(parts) if parts else pa.table({n.split()[0]: pa.array([], pa.int64()) for n in _FOUND.split(", ")})

    return run


# ---------------------------------------------------------------- the search as relations


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Rows (vec_id, v array<long>) of the vectors that take part: not null, all components present and finite.

    A row without an id takes no part.  A component beyond 64 bits counts as
    the nearest 64-bit number.
    """
    whole = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x"))
        .where("vec_id is not null and x is not null")
        .where(whole)
        .select("vec_id", F.transform("x", lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))
    )


def _found(queries: DataFrame, vectors: DataFrame, k: int, group_values: int, block_rows: int) -> DataFrame:
    """Rows _FOUND: candidates that hold the k best of each query, and for each query and group searched, visits."""
    spark = queries.sparkSession
    (rows, widest), (asked, _) = (df.agg(F.count("*"), F.max(F.size("v"))).first() for df in (vectors, queries))
    if not rows or not asked:
        return spark.createDataFrame([], _FOUND)
    held = max(block_rows, group_values // max(1, widest))  # vectors of a group, and queries of a chunk
    groups, chunks = -(-rows // held), -(-asked // held)
    index = _indexed(vectors, held, block_rows)
    packed = materialise(
        queries.select("vec_id", "v").mapInArrow(_packed, "vec_id long, width int, data binary").withColumn("chunk", F.floor(F.rand(11) * chunks).cast("int")), "queries"
    )

    def each(count: int, name: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)

    maxima = index.select("group", "width", "high", "low", each(chunks, "chunk"))
    asking = packed.select("vec_id", "width", "data", "chunk", each(groups, "group"))
    key = ("group", "chunk")
    limits = materialise(asking.groupBy(*key).cogroup(maxima.groupBy(*key)).applyInArrow(_bounds, "vec_id long, group int, bound double"), "bounds")
    limits = limits.groupBy("vec_id", "group").agg(F.max("bound").alias("bound"))  # query rows of one id are one query
    seeds = limits.groupBy("vec_id").agg(F.max_by("group", F.struct("bound", -F.col("group"))).alias("seed"))

    def searched(wanted: DataFrame) -> DataFrame:
        """``wanted`` (vec_id, group, kth) searched; blocks go to the chunks that ask for their group, and nowhere else."""
        asking = dealt_anew(packed, wanted, "vec_id")
        pairs = asking.select(F.col("group").alias("__group"), F.col("chunk").alias("__chunk")).distinct()
        needed = index.join(pairs, F.col("group") == F.col("__group")).withColumn("chunk", F.col("__chunk")).drop("__group", "__chunk")
        return asking.groupBy(*key).cogroup(needed.groupBy(*key)).applyInArrow(_search(k), _FOUND)

    first = materialise(searched(seeds.select("vec_id", F.col("seed").alias("group"), F.lit(None).cast("long").alias("kth"))), "seeds")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))
    kth = first.where("vec_id is not null").withColumn("place", place).where(F.col("place") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    rest = limits.join(seeds, "vec_id").join(kth, "vec_id", "left").where("group <> seed and (kth is null or bound >= kth)")
    return first.unionByName(searched(rest.select("vec_id", "group", "kth")))


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, group_values: int = GROUP_VALUES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k best of ``vectors`` (vec_id, v) for each id of ``queries``: query_id, rank, vec_id, score.

    Vectors are compared with those of the same length only.  Rows of a query's
    own id are no candidates.  Each row of a repeated id is a candidate; query
    rows of one id are one query, whose scores are ranked together.  A query
    without a candidate has no row, and so has an empty table.  A score beyond
    64 bits counts as the nearest one that fits.  Other columns are not read.
    """
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    near = _found(queries, vectors, k, group_values, block_rows).where("vec_id is not null")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def block_visits(queries: DataFrame, vectors: DataFrame, k: int = 5, group_values: int = GROUP_VALUES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row: the blocks that queries scored, the blocks of the groups that they were sent to, and the groups."""
    found = _found(queries, vectors, k, group_values, block_rows).where("vec_id is null")
    return found.agg(F.sum("scored").alias("scored"), F.sum("blocks").alias("sent_to"), F.count("*").alias("groups"))
