"""Byte-level BPE by reduction of a tree of halves.

Encoding: a text is cut into halves until a part is at most LEAF bytes; a leaf
is encoded alone.  Two neighbours are joined by encoding a window around their
boundary again.  The window grows until both of its ends are stable:

* between pre-tokens, an end is stable just before white space that follows a
  visible character.  No alternative of the pattern crosses such a place and
  none looks behind, so every scan has a boundary there and goes on alike.
* within one long pre-token, an end is stable if the tokens on its two sides
  stay as they are when encoded together.  A sequence of tokens is the encoding
  of its bytes exactly if that holds for each neighbouring pair.

Decoding concatenates the bytes of leaves of ids up the tree.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 4096
#: A window without a stable place that grows beyond this is split into pre-tokens, and long ones are trees of their own.
LONG_WINDOW = 4 * LEAF
LONG_PIECE = 512
FIRST_WINDOW = 64
DECODE_LEAF = 4096


class TreeCodec:
    """Encodes and decodes with the ranks of one vocabulary file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import tiktoken

        self._leaf = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._split = regex.compile(pattern)
        size = max(ranks.values()) + 1
        self.pieces = [b""] * size
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self._lengths = np.array([len(x) for x in self.pieces], np.int64)
        self._pairs: dict[tuple[int, int], bool] = {}

    def encode(self, text: str) -> np.ndarray:
        """The ids of ``text``, as 32-bit integers."""
        data = text.encode()
        return self._encode(data) if data else np.zeros(0, np.uint32)

    def _leaf_ids(self, data: bytes) -> np.ndarray:
        return self._leaf.encode_to_numpy(data.decode(), disallowed_special=())

    def _encode(self, data: bytes) -> np.ndarray:
        if len(data) <= LEAF:
            return self._leaf_ids(data)
        middle = len(data) // 2
        while data[middle] & 0xC0 == 0x80:
            middle -= 1
        return self._join(data, middle, self._encode(data[:middle]), self._encode(data[middle:]))

    def _join(self, data: bytes, middle: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        first, last = _cut_before(data, middle), _cut_after(data, middle)
        window = data[first:last]
        between = self._leaf_ids(window) if len(window) <= LONG_WINDOW else self._window_ids(window)
        parts = [between]
        if first:
            ends = np.cumsum(self._lengths[left])
            parts.insert(0, left[: int(np.searchsorted(ends, first, side="right"))])
        if last < len(data):
            starts = middle + np.cumsum(self._lengths[right]) - self._lengths[right]
            parts.append(right[int(np.searchsorted(starts, last)) :])
        return np.concatenate(parts)

    def _window_ids(self, window: bytes) -> np.ndarray:
        """Ids of a long window, one pre-token at a time."""
        parts, short = [], []
        for match in self._split.finditer(window.decode()):
            piece = match[0].encode()
            if len(piece) <= LONG_PIECE:
                short.extend(self._leaf.encode_ordinary(match[0]) if len(piece) > 1 else [self._single(piece)])
            else:
                parts += [np.array(short, np.uint32), self._piece_ids(piece)]
                short = []
        return np.concatenate([*parts, np.array(short, np.uint32)])

    def _single(self, piece: bytes) -> int:
        return self._leaf.encode_single_token(piece)

    def _bytes_ids(self, piece: bytes) -> list[int]:
        """Ids of bytes that lie within one pre-token; they need not be whole code points."""
        return self._leaf._core_bpe.encode_single_piece(piece)

    def _piece_ids(self, piece: bytes) -> np.ndarray:
        if len(piece) <= LONG_PIECE:
            return np.array(self._bytes_ids(piece), np.uint32)
        middle = len(piece) // 2
        return self._join_piece(self._piece_ids(piece[:middle]), self._piece_ids(piece[middle:]))

    def _join_piece(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        reach = 4
        while True:
            head, tail = left[: max(0, len(left) - reach)], right[reach:]
            window = b"".join(self.pieces[i] for i in [*left[len(head) :], *right[:reach]])
            between = np.array(self._bytes_ids(window), np.uint32)
            if (not len(head) or self._stay(int(head[-1]), int(between[0]))) and (
                not len(tail) or self._stay(int(between[-1]), int(tail[0]))
            ):
                return np.concatenate([head, between, tail])
            reach *= 2

    def _stay(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are when encoded together."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) > 1 << 16:
                self._pairs.clear()
            known = self._bytes_ids(self.pieces[left] + self.pieces[right]) == [left, right]
            self._pairs[left, right] = known
        return known

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ``ids``."""
        parts = [
            b"".join(map(self.pieces.__getitem__, ids[i : i + DECODE_LEAF].tolist())) for i in range(0, len(ids), DECODE_LEAF)
        ]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0] if parts else b""


def _visible_then_space(data: bytes, at: int) -> bool:
    return data[at] in b" \t\n\r" and 0x21 <= data[at - 1] <= 0x7E


def _cut_before(data: bytes, middle: int) -> int:
    """The last stable place before ``middle``, or 0; looked for in growing windows."""
    reach, high = FIRST_WINDOW, middle - 1
    while high > 0:
        low = max(0, middle - reach)
        for at in range(high, max(low, 1) - 1, -1):
            if _visible_then_space(data, at):
                return at
        high, reach = low, reach * 2
    return 0


def _cut_after(data: bytes, middle: int) -> int:
    """The first stable place beyond ``middle``, or the end."""
    reach, low, size = FIRST_WINDOW, middle + 1, len(data)
    while low < size:
        high = min(size, middle + reach)
        for at in range(low, high):
            if _visible_then_space(data, at):
                return at
        low, reach = max(low, high), reach * 2
    return size


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> TreeCodec:
    """The codec of a rank file (base64 bytes and rank on each line); loaded once in a worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return TreeCodec(ranks, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _encode_batches(path: str, pattern: str, text_col: str, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = codec(path, pattern)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                counts, ids, decoded = [], [], []
                for text in part.column(at).to_pylist():
                    found = tree.encode(text or "")
                    counts.append(len(found))
                    ids.append(found.astype("<u4").tobytes())
                    if decode:
                        decoded.append(tree.decode(found))
                columns = [c for i, c in enumerate(part.columns) if i != at]
                columns += [pa.array(counts, pa.int64()), pa.array(ids, pa.binary())]
                names = [n for n in part.schema.names if n != text_col] + ["n_tokens", "token_ids"]
                if decode:
                    columns.append(pa.array(decoded, pa.binary()))
                    names.append("decoded")
                yield pa.record_batch(columns, names=names)

    return run


def encode(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: tuple[str, str] | None = None, decode: bool = False) -> DataFrame:
    """Columns ``keep``, n_tokens and token_ids (little-endian unsigned 32-bit) of every row; a null text is empty.

    Rows come back one for one, repeated rows too.  With ``decode`` the ids are
    decoded again, into ``decoded``.
    """
    kept = docs.select(*keep, text_col)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != text_col]
    fields += ["n_tokens long", "token_ids binary"] + ["decoded binary"] * decode
    return kept.mapInArrow(_encode_batches(*(vocabulary or default_vocabulary()), text_col, decode), ", ".join(fields))


def decode(encoded: DataFrame, ids_col: str = "token_ids", keep: tuple[str, ...] = ("doc_id",), vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Columns ``keep`` and decoded (binary) of every row of ids; null ids decode to null."""
    path, pattern = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = codec(path, pattern)
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            texts = [None if x is None else tree.decode(np.frombuffer(x, "<u4")) for x in batch.column(at).to_pylist()]
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.record_batch([*columns, pa.array(texts, pa.binary())], names=[n for n in batch.schema.names if n != ids_col] + ["decoded"])

    kept = encoded.select(*keep, ids_col)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != ids_col]
    return kept.mapInArrow(run, ", ".join([*fields, "decoded binary"]))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document's round trip."""
    return encode(docs, decode=True).select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
