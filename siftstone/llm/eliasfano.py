"""Elias-Fano sequences and the n-gram trie built of them, vectorised.

A rising sequence of n integers below ``universe`` keeps the low bits of each
value packed, and the high bits as a bit vector: for each high value, a one for
each element that has it and then a zero.  A directory of the zeros before each
64-bit word makes selection a search and a few steps within a word.
"""

from __future__ import annotations

import mmap

import numpy as np

_U = np.uint64
_ONES = _U(0xFFFFFFFFFFFFFFFF)


#: Place of the one with so many ones below it, for each byte; 8 where there are fewer.
_IN_BYTE = np.full((256, 8), 8, np.uint8)
for _byte in range(256):
    _set = [i for i in range(8) if _byte >> i & 1]
    _IN_BYTE[_byte, : len(_set)] = _set


def _select_one(bits: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place in each word of the one with ``rank`` ones below it."""
    left = rank.astype(np.uint8)
    position = np.zeros(len(bits), np.uint8)
    for half in (32, 16, 8):
        count = np.bitwise_count(bits & _U((1 << half) - 1))
        over = left >= count
        left = left - count * over
        position += over.astype(np.uint8) * np.uint8(half)
        bits = bits >> (over.astype(_U) * _U(half))
    return position.astype(np.int64) + _IN_BYTE[(bits & _U(255)).astype(np.intp), np.minimum(left, 7)]


class EliasFano:
    """Arrays of one sequence; ``parts`` are what is stored."""

    def __init__(self, size: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.size, self.low_bits, self.low, self.high, self.zeros = size, low_bits, low, high, zeros

    @classmethod
    def build(cls, values: np.ndarray, universe_bits: int) -> EliasFano:
        """Of rising 64-bit values below 2**universe_bits."""
        values = values.astype(_U)
        size = len(values)
        low_bits = max(0, universe_bits - max(0, size - 1).bit_length())
        tops = values >> _U(low_bits) if low_bits < 64 else np.zeros(size, _U)
        buckets = int(tops[-1]) + 1 if size else 1
        total = size + buckets
        high = np.zeros(total // 64 + 1, _U)
        at = tops + np.arange(size, dtype=_U)
        np.bitwise_or.at(high, (at >> _U(6)).astype(np.int64), _U(1) << (at & _U(63)))
        per_word = 64 - np.bitwise_count(high).astype(np.int64)
        zeros = np.concatenate([[0], np.cumsum(per_word)])
        return cls(size, low_bits, _pack(values & _mask(low_bits), low_bits), high, zeros)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.size, self.low_bits], np.int64), self.low, self.high, self.zeros]

    @classmethod
    def of(cls, parts: list[np.ndarray]) -> EliasFano:
        return cls(int(parts[0][0]), int(parts[0][1]), *parts[1:])

    def _low(self, index: np.ndarray) -> np.ndarray:
        if self.low_bits == 0:
            return np.zeros(len(index), _U)
        bit = index.astype(_U) * _U(self.low_bits)
        word, shift = (bit >> _U(6)).astype(np.int64), bit & _U(63)
        first = self.low[word] >> shift
        second = np.where(shift > 0, self.low[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
        return (first | second) & _mask(self.low_bits)

    def _select_zero(self, rank: np.ndarray) -> np.ndarray:
        """Position of the zero with ``rank`` zeros before it."""
        word = np.searchsorted(self.zeros, rank, side="right") - 1
        word = np.minimum(word, len(self.high) - 1)
        return word * 64 + _select_one(~self.high[word], rank - self.zeros[word])

    def access(self, index: np.ndarray) -> np.ndarray:
        """Values at ``index``: the bucket of the indexth one, by a search over buckets, then its low bits."""
        word = np.searchsorted(self._ones(), index, side="right") - 1
        position = _select_one(self.high[word], index - self._ones()[word])
        top = (word * 64 + position - index).astype(_U)
        return (top << _U(self.low_bits) if self.low_bits < 64 else _U(0) * top) | self._low(index)

    def _ones(self) -> np.ndarray:
        return np.arange(len(self.zeros)) * 64 - self.zeros

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each of ``values``, or -1: a successor search within the value's bucket."""
        values = values.astype(_U)
        if self.size == 0 or not len(values):
            return np.full(len(values), -1, np.int64)
        top = (values >> _U(self.low_bits) if self.low_bits < 64 else np.zeros(len(values), _U)).astype(np.int64)
        buckets = int(self.zeros[-1]) - 1
        inside = top < buckets
        safe = np.where(inside, top, 0)
        begin = np.where(safe > 0, self._select_zero(np.maximum(safe - 1, 0)) - (safe - 1), 0)
        end = np.minimum(self._select_zero(safe) - safe, self.size)
        wanted = values & _mask(self.low_bits)
        low, high = begin.copy(), end.copy()
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            middle = (low[live] + high[live]) >> 1
            less = self._low(middle) < wanted[live]
            low[live] = np.where(less, middle + 1, low[live])
            high[live] = np.where(less, high[live], middle)
        hit = inside & (low < end)
        hit[hit] = self._low(low[hit]) == wanted[hit]
        return np.where(hit, low, -1)


def _mask(bits: int) -> np.uint64:
    return _ONES if bits >= 64 else _U((1 << bits) - 1)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """``values`` of ``width`` bits each, end to end, with a word to spare."""
    out = np.zeros(len(values) * width // 64 + 2, _U)
    if width == 0 or not len(values):
        return out
    bit = np.arange(len(values), dtype=_U) * _U(width)
    word, shift = (bit >> _U(6)).astype(np.int64), bit & _U(63)
    np.bitwise_or.at(out, word, values << shift)
    over = shift + _U(width) > _U(64)
    np.bitwise_or.at(out, word[over] + 1, values[over] >> (_U(64) - shift[over]))
    return out


#: Codes of a quantised positive number: 0 is zero, the rest are even steps of its logarithm.
CODE_LOW, CODE_HIGH = -9.0, 13.0
_CODE_STEP = (CODE_HIGH - CODE_LOW) / 65534


def quantise(values: np.ndarray) -> np.ndarray:
    """16-bit codes; relative error under 0.04 %."""
    codes = np.zeros(len(values), np.uint16)
    some = values > 0
    steps = np.rint((np.log10(values[some]) - CODE_LOW) / _CODE_STEP) + 1
    codes[some] = np.clip(steps, 1, 65535).astype(np.uint16)
    return codes


_DECODED = np.concatenate([[0.0], 10 ** (CODE_LOW + _CODE_STEP * np.arange(65535))])


def dequantise(codes: np.ndarray) -> np.ndarray:
    return _DECODED[codes]


_KINDS = (np.dtype("<i8"), np.dtype("<u8"), np.dtype("<u2"))


class Trie:
    """Levels of words, pairs and triples in one mapping of memory.

    A child's identity is relative to its context: the rank of the parent above
    32 bits of the word's hash, so that a whole level rises and one search finds
    a word after a context.  Pointers, the first child of each node, rise too.

    The mapping holds the numbers of arrays, a kind and a length for each, and
    then the arrays themselves, each from a multiple of 8 bytes on.  Its bytes
    are the stored form, and a trie made of them copies nothing.
    """

    LEVELS = 3
    VALUES = ("count", "pair", "back_off", "triple")

    def __init__(self, data):
        """data: what ``build`` has made, as any buffer."""
        self.data = data
        shape = np.frombuffer(data, np.int64, 1 + 2 * int(np.frombuffer(data, np.int64, 1)[0]))[1:].reshape(-1, 2)
        at, views = 8 * (1 + shape.size), []
        for kind, count in shape.tolist():
            views.append(np.frombuffer(data, _KINDS[kind], count, at))
            at += -(-_KINDS[kind].itemsize * count // 8) * 8
        found = [EliasFano.of(views[i : i + 4]) for i in range(0, 4 * (2 * self.LEVELS - 1), 4)]
        self.words, self.children, self.pointers = found[0], found[1:3], found[3:]
        self.values = dict(zip(self.VALUES, views[4 * len(found) :]))

    @classmethod
    def build(cls, words: np.ndarray, children: list[np.ndarray], pointers: list[np.ndarray], values: dict[str, np.ndarray]) -> Trie:
        """words: 64-bit hashes; children: keys of levels 2 and 3; pointers of levels 1 and 2; values: arrays to keep beside them."""
        sequences = [EliasFano.build(words, 64)]
        for parents, keys in zip((len(words), len(children[0])), children):
            sequences.append(EliasFano.build(keys, 32 + max(1, parents).bit_length()))
        for first in pointers:
            sequences.append(EliasFano.build(first, max(1, int(first[-1])).bit_length() + 1))
        arrays = [p for s in sequences for p in s.parts()] + [values[n] for n in cls.VALUES]
        shape = np.array([(_KINDS.index(x.dtype), len(x)) for x in arrays], np.int64)
        size = 8 * (1 + shape.size) + sum(-(-x.nbytes // 8) * 8 for x in arrays)
        mapped = mmap.mmap(-1, size)  # of memory alone, no file
        for at, x in zip(np.cumsum([0, 8, shape.nbytes, *(-(-x.nbytes // 8) * 8 for x in arrays)]).tolist(), [np.array([len(arrays)]), shape, *arrays]):
            mapped[at : at + x.nbytes] = np.ascontiguousarray(x).tobytes()
        return cls(mapped)

    def tobytes(self) -> bytes:
        return self.data[:]

    def word(self, hashes: np.ndarray) -> np.ndarray:
        return self.words.find(hashes)

    def child(self, level: int, parents: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Rank in ``level`` (2 or 3) of the children with these 32-bit hashes; -1 where parent or child is unknown."""
        out = np.full(len(parents), -1, np.int64)
        known = np.flatnonzero(parents >= 0)
        keys = parents[known].astype(_U) << _U(32) | prints[known].astype(_U)
        out[known] = self.children[level - 2].find(keys)
        return out

    def fan_out(self, level: int, ranks: np.ndarray) -> np.ndarray:
        """How many children the nodes of ``level`` (1 or 2) have; none for -1."""
        safe = np.maximum(ranks, 0)
        if not len(ranks) or self.pointers[level - 1].size < 2:
            return np.zeros(len(ranks), np.int64)
        pointers = self.pointers[level - 1]
        wide = (pointers.access(safe + 1) - pointers.access(safe)).astype(np.int64)
        return np.where(ranks >= 0, wide, 0)
