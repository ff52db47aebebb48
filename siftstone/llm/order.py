"""Training order: token sequences dealt to global slots, and shards of them.

Documents are encoded, ended with a mark and cut into sequences of a fixed
length.  Sequences are numbered in the order of (id, text, part); a keyed
Feistel permutation with cycle-walking gives each number its slot, so the order
is a shuffle of the whole corpus that needs no random state and can be undone.
A shard is a range of slots, written at a fixed stride: a reader finds slot s
at byte (s mod rows) * stride of shard s div rows, and can go on from any slot.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from siftstone.llm import _words
from siftstone.llm._scratch import materialise
from siftstone.llm.bpe import codec, default_vocabulary

SEQUENCE_TOKENS = 512
SHARD_ROWS = 2048
KEY = 20240607
ROUNDS = 6
#: Ranges of shards that are written one after the other.
PASSES = 3
#: Shards that one task of a pass writes, one after the other; there are at least as many tasks as cores.
TASK_SHARDS = 64
#: The id that ends a document and fills its last sequence; the vocabulary leaves it free.
END_OF_TEXT = 50256

_U = np.uint64


class Permutation:
    """A keyed bijection of 0..size-1: a Feistel network on the next even number of bits, walked until it lands inside."""

    def __init__(self, size: int, key: int = KEY, rounds: int = ROUNDS):
        self.size = size
        self.half = max(1, -(-max(1, size - 1).bit_length() // 2))
        self.keys = _words.mix(np.arange(1, rounds + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(key % (1 << 64)))
        self.mask = _U((1 << self.half) - 1)

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        return _words.mix(x * _U(0xD6E8FEB86659FD93) + key) & self.mask

    def _once(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        left, right = x >> _U(self.half), x & self.mask
        for key in keys:
            left, right = right, left ^ self._round(right, key)
        return right << _U(self.half) | left

    def _walk(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        x = self._once(np.asarray(x).astype(_U), keys)
        while True:
            out = np.flatnonzero(x >= _U(self.size))
            if not len(out):
                return x.astype(np.int64)
            x[out] = self._once(x[out], keys)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, self.keys)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        """The inverse of ``slots``: the same network with its keys in the other order."""
        return self._walk(slots, self.keys[::-1])


def _cut(path: str, pattern: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = codec(path, pattern)
        if len(tree.pieces) > 1 << 16 or any(tree.pieces[END_OF_TEXT : END_OF_TEXT + 1]):
            raise ValueError(f"ids are 16 bits, and {END_OF_TEXT} must be free: it ends documents")
        task, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                owner, parts, counts, ids = [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    tokens = np.append(tree.encode(text or ""), END_OF_TEXT).astype("<u2")
                    for j in range(0, len(tokens), length):
                        owner.append(i)
                        parts.append(j // length)
                        counts.append(min(length, len(tokens) - j))
                        ids.append(tokens[j : j + length].tobytes())
                rows = len(owner)
                yield pa.record_batch(
                    [
                        part.column(0).take(pa.array(owner, pa.int64())),
                        pa.array(parts, pa.int32()),
                        pa.array(counts, pa.int32()),
                        pa.array(ids, pa.binary()),
                        pa.array(np.full(rows, task, np.int32)),
                        pa.array(np.arange(place, place + rows)),
                    ],
                    names=["doc_id", "part", "n_tokens", "token_ids", "task", "place"],
                )
                place += rows

    return run


def ordered_sequences(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE_TOKENS, key: int = KEY, vocabulary: tuple[str, str] | None = None
) -> DataFrame:
    """One row per sequence: slot, number, doc_id, part, n_tokens and token_ids (little-endian unsigned 16-bit).

    A null or empty text is one sequence with the end mark alone.  Repeated
    rows give repeated sequences, each with a slot of its own; rows without an
    id come first.  Slots are 0..n-1, each once, and depend on the documents
    and the key alone, not on files or partitions.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # ranges in the order of ids and texts: numbers follow from a count for each task, and rows of one id can be several ranges
    dealt = texts.repartitionByRange("doc_id", F.left("text", F.lit(64))).sortWithinPartitions("doc_id", "text")
    cut = materialise(
        dealt.mapInArrow(
            _cut(*(vocabulary or default_vocabulary()), length), "doc_id long, part int, n_tokens int, token_ids binary, task int, place long"
        ),
        "sequences",
        compression="zstd",
    )
    counts = sorted((r[0], r[1]) for r in cut.groupBy("task").count().collect())  # a row for each task
    starts, total = {}, 0
    for task, count in counts:
        starts[task] = total
        total += count

    firsts = np.zeros(max(starts, default=0) + 1, np.int64)
    firsts[list(starts)] = list(starts.values())

    # only the two numbers go to Python; the tokens stay in the JVM
    @arrow_udf("struct<slot:long,number:long>")
    def placed(task: pa.Array, place: pa.Array) -> pa.Array:
        numbers = firsts[task.to_numpy()] + place.to_numpy()
        return pa.StructArray.from_arrays([pa.array(Permutation(total, key).slots(numbers)), pa.array(numbers)], names=["slot", "number"])

    # marked so that a filter on slots doesn't work them out a second time
    at = placed.asNondeterministic()("task", "place").alias("at")
    return cut.select(at, "doc_id", "part", "n_tokens", "token_ids").select("at.slot", "at.number", "doc_id", "part", "n_tokens", "token_ids")


_SHARD = "shard long, first_slot long, n_slots long, stride int, sha256 string, doc_ids array<long>, parts array<int>, n_tokens array<int>, data binary"


def _shard(rows: pa.Table, number: int, length: int) -> pa.RecordBatch:
    counts = rows["n_tokens"].to_numpy()
    data = np.full((rows.num_rows, length), END_OF_TEXT, "<u2")
    inside = np.arange(length) < counts[:, None]
    data[inside] = np.frombuffer(b"".join(x.as_buffer() for x in rows["token_ids"]), "<u2")
    raw = data.tobytes()
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
    values = [number, rows["slot"][0].as_py(), rows.num_rows, 2 * length, hashlib.sha256(raw).hexdigest(), *(rows[c].to_pylist() for c in ("doc_id", "part", "n_tokens")), raw]
    return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds)], names=[f.split()[0] for f in _SHARD.split(", ")])


def shards(sequences: DataFrame, length: int = SEQUENCE_TOKENS, rows: int = SHARD_ROWS, span: tuple[int, int] | None = None) -> DataFrame:
    """One row per shard: the range of slots, what lies in each of them, and the shard's bytes at a fixed stride.

    Partitions are ranges of shards, so a task goes through its slots in order
    and holds one shard at a time.  No sequences give no shard.  A null id or
    text is in its slot like any other.  Where it is known that all shards lie
    in ``span`` (the first, one past the last), ranges are cut by number, with
    no look at the sequences beforehand, and grow in number with them.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            numbers = table["shard"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), table.num_rows]
            for a, z in zip(edges, edges[1:]):
                if a == z:
                    continue
                if held and held[0]["shard"][0].as_py() != int(numbers[a]):
                    yield _shard(pa.concat_tables(held), held[0]["shard"][0].as_py(), length)
                    held = []
                held.append(table.slice(a, z - a))
        if held:
            yield _shard(pa.concat_tables(held), held[0]["shard"][0].as_py(), length)

    keyed = sequences.select(F.floor(F.col("slot") / rows).alias("shard"), "slot", "doc_id", "part", "n_tokens", "token_ids")
    if span is None:
        ranges = keyed.repartitionByRange("shard")
    else:
        first, count = span[0], span[1] - span[0]
        tasks = min(count, max(sequences.sparkSession.sparkContext.defaultParallelism, -(-count // TASK_SHARDS)))
        ranges = keyed.repartitionById(tasks, F.floor((F.col("shard") - first) * tasks / count).cast("int"))
    return ranges.sortWithinPartitions("slot").mapInArrow(build, _SHARD)


def write_shards(built: DataFrame, uri: str) -> DataFrame:
    """Write each shard's bytes as ``uri``/shard-<number>.bin, and return the rows without their bytes.

    ``uri`` is a folder that all executors reach.  A file appears whole, by a
    rename; one of the right size and bytes is left as it is, so a run that was
    broken off can be run again.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(uri)  # a plain path is a local or mounted folder
        system.create_dir(folder, recursive=True)
        for batch in batches:
            for number, data in zip(batch.column("shard").to_pylist(), batch.column("data")):
                name, raw = f"{folder}/shard-{number:08d}.bin", data.as_buffer()
                if system.get_file_info(name).size != raw.size or system.open_input_file(name).read() != raw.to_pybytes():
                    with system.open_output_stream(part := f"{name}.{uuid.uuid4().hex}") as out:
                        out.write(raw)
                    system.move(part, name)
            yield batch.drop_columns(["data"])

    return built.mapInArrow(put, _SHARD.removesuffix(", data binary"))


def write_order(sequences: DataFrame, uri: str, length: int = SEQUENCE_TOKENS, rows: int = SHARD_ROWS, passes: int = PASSES) -> DataFrame:
    """Write all shards of ``sequences`` to ``uri``, a range of shards in each pass, and return their manifest.

    A pass shuffles its own sequences alone, so the disk that a shuffle takes
    is a part of the corpus.  Run again after a break, it finds the files that
    are there.
    """
    count = -(-sequences.count() // rows)
    manifest = None
    for p in range(passes):
        low, high = (count * x // passes for x in (p, p + 1))
        if low < high:
            part = sequences.where((F.col("slot") >= low * rows) & (F.col("slot") < high * rows))
            written = materialise(write_shards(shards(part, length, rows, (low, high)), uri), "manifest")
            manifest = written if manifest is None else manifest.unionByName(written)
    return sequences.sparkSession.createDataFrame([], _SHARD.removesuffix(", data binary")) if manifest is None else manifest


def read_slots(uri: str, first: int, count: int, length: int = SEQUENCE_TOKENS, rows: int = SHARD_ROWS) -> np.ndarray:
    """The sequences of ``count`` slots from ``first`` on, a row each, read at their offsets."""
    from pyarrow import fs

    system, folder = fs.FileSystem.from_uri(uri)
    out = []
    while count > 0:
        shard, row = divmod(first, rows)
        wanted = min(count, rows - row)
        with system.open_input_file(f"{folder}/shard-{shard:08d}.bin") as file:
            file.seek(row * 2 * length)
            got = np.frombuffer(file.read(wanted * 2 * length), "<u2").reshape(-1, length)
        out.append(got)
        if len(got) < wanted:
            break
        first, count = first + wanted, count - wanted
    return np.concatenate(out) if out else np.zeros((0, length), "<u2")
