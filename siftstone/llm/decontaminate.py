"""Benchmark passages in documents, by CGK embedding, bit sampling and edit distance.

Words are lower-cased runs of ASCII letters and digits and of all characters
beyond ASCII; each character from U+3000 to U+9FFF is a word of its own, as
scripts there have no spaces.  A passage of a document matches an item of m
words if its words are within floor(m / 4) edits of the item's; an item under
SHORT_WORDS words only if it is there word for word.

* Windows.  Cut an item's words into one piece more than the edits allowed: a
  matching passage has at least one piece unchanged.  So each place where a
  piece of an item occurs proposes item-sized windows around it, and a document
  without any piece has no match.
* Embedding.  The random walk of CGK copies a window's words to its output and
  moves on by 0 or 1 after each, as a hash of word and step says.  Windows at a
  small edit distance have outputs that agree in many places.
* Bit sampling.  A table takes SAMPLED places of one walk; a window and an item
  of its size meet if they agree there in some table.  TABLES are enough for the
  target recall at the agreement MEETING.
* Verification.  Every meeting is decided by the exact edit distance between the
  item and its best passage around the window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm import _words

#: Hundredths of an item's words that may be edited.
EDITS = 25
#: Items with fewer words are found word for word only: an edit more would find them in plain text.
SHORT_WORDS = 8
SAMPLED, TABLES = 2, 96
#: Agreement at which the tables reach the target recall: (1 - 0.22**2)**96 = 0.9 %.
MEETING, RECALL = 0.22, 0.99
#: Bytes of items that are sent to all tasks at once, their words, pieces and tables; more items are looked for in several passes.
PASS_BYTES = 32 << 20
WALKS = 4
#: Windows begin at every STEP-th shift around a piece.
STEP = 2
#: Words of windows whose walks are held at once.
_WINDOW_WORDS = 1 << 18

_U = np.uint64


def _split(data: np.ndarray, offsets: np.ndarray) -> _words.Words:
    """Words of letters and digits: all ASCII marks count as space, and a character of a script without spaces is a word."""
    words = _words.split_words(_BLANKED[data], offsets)
    lead = np.flatnonzero((data >= 0xE3) & (data <= 0xE9))  # the first bytes of U+3000 to U+9FFF in UTF-8
    if not len(lead):
        return words
    starts = np.union1d(words.starts, lead)
    # what follows such a character, within the same run, is the next word
    after = lead + 3
    run = np.searchsorted(words.starts, lead, side="right") - 1
    starts = np.union1d(starts, after[after < words.ends[run]])
    run = np.searchsorted(words.starts, starts, side="right") - 1
    ends = np.minimum(np.append(starts[1:], len(data)), words.ends[run])
    return _words.Words(words.data, starts, ends, np.searchsorted(starts, offsets))


_BLANKED = np.arange(256, dtype=np.uint8)
_BLANKED[[c for c in range(128) if not chr(c).isalnum()]] = 0x20


def _edits(words: int) -> int:
    return words * EDITS // 100 if words >= SHORT_WORDS else 0


def _bytes(words: int) -> int:
    """What an item takes in a pass: its words, its pieces, and a key and an owner in each table."""
    return 8 * words + 32 * (_edits(words) + 1) + 12 * TABLES


@dataclass
class Items:
    """Items of one pass: their words, pieces and tables."""

    ids: list[int]
    words: list[np.ndarray]

    def __post_init__(self):
        keys, spots = [], []
        for i, words in enumerate(self.words):
            size, pieces = len(words), _edits(len(words)) + 1
            length = size // pieces
            found = _words.hash_runs(words, length, seed=8)[: pieces * length : length]
            keys += found.tolist()
            spots += [(i, j * length, length) for j in range(pieces)]
        order = np.argsort(np.array(keys, _U), kind="stable")
        self.keys = np.array(keys, _U)[order]
        self.spots = np.array(spots, np.int64).reshape(-1, 3)[order]
        self.lengths = sorted({s[2] for s in spots})
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.edits = np.array([_edits(len(w)) for w in self.words], np.int64)
        #: Table keys of all items, rising, and the item of each.
        keys, owners = [], []
        for of in _alike(self.sizes):
            longest = int(self.sizes[of].max())
            found = table_keys(np.stack([np.pad(self.words[i], (0, longest - len(self.words[i]))) for i in of]), self.sizes[of])
            keys.append(found.ravel())
            owners.append(np.repeat(of, found.shape[1]))
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(keys, kind="stable")
        self.table, self.owner = keys[order], owners[order].astype(np.int32)


def _walk(windows: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """CGK outputs, twice as many places as the longest window has words; beyond a window's end all places are padding."""
    count, longest = windows.shape
    padded = np.concatenate([windows, np.zeros((count, 1), _U)], axis=1)
    at = np.zeros(count, np.int64)
    out = np.empty((2 * longest, count), _U)
    rows = np.arange(count)
    for t in range(2 * longest):
        word = padded[rows, at]
        out[t] = word
        move = (_words.mix(word + _U(0x9E3779B97F4A7C15 * (seed * 4096 + t + 1) % (1 << 64))) >> _U(63)).astype(np.int64)
        at = np.minimum(at + move, sizes)
    return out


@lru_cache(maxsize=4096)
def _sampled(size: int, walk: int) -> np.ndarray:
    """The places that each table of a walk takes of the outputs of windows of ``size`` words."""
    chosen = np.random.Generator(np.random.PCG64([size, walk])).integers(0, 2 * size, (TABLES // WALKS, SAMPLED))
    return np.sort(chosen, axis=1)


def table_keys(windows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A key for each window and table; windows are padded with 0 to the longest and differ in size."""
    known, which = np.unique(sizes, return_inverse=True)
    rows = np.arange(len(windows))[:, None]
    keys = []
    for walk in range(WALKS):
        out = _walk(windows, sizes, walk + 1)
        places = np.stack([_sampled(int(size), walk) for size in known])[which]
        key = sizes.astype(_U)[:, None] * _U(1000) + np.arange(walk * 100 + 1, walk * 100 + 1 + places.shape[1], dtype=_U)
        for j in range(SAMPLED):
            key = _words.mix(key * _U(0x9E3779B97F4A7C15) + out[places[:, :, j], rows])
        keys.append(key)
    return np.concatenate(keys, axis=1)


def _alike(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Places of ``sizes`` of one octave, some at a time, so that padding to the longest at most doubles what is held."""
    octave = np.frexp(sizes)[1]
    for x in np.unique(octave).tolist():
        of = np.flatnonzero(octave == x)
        step = max(1, _WINDOW_WORDS // int(sizes[of].max()))
        for at in range(0, len(of), step):
            yield of[at : at + step]


def best_passage(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """(edits, first word, one past the last) of the passage of ``words`` nearest to the item; of equals the shortest, then the first."""
    size = len(words)
    cost = np.zeros(size + 1, np.int64)
    start = np.arange(size + 1)
    ramp = np.arange(size + 1)
    for i, word in enumerate(item, 1):
        # cost and start packed: smaller cost first, then the later start
        here = np.empty(size + 1, np.int64)
        from_start = np.empty(size + 1, np.int64)
        change = cost[:-1] + (words != word)
        remove = cost[1:] + 1
        better = (change < remove) | ((change == remove) & (start[:-1] >= start[1:]))
        here[1:] = np.where(better, change, remove)
        from_start[1:] = np.where(better, start[:-1], start[1:])
        here[0], from_start[0] = i, 0
        packed = (here - ramp) * (size + 1) + (size - from_start)
        least = np.minimum.accumulate(packed)
        cost, start = least // (size + 1) + ramp, size - least % (size + 1)
    span = (np.arange(size + 1) - start) + cost * (size + 2)
    end = int(span.argmin())
    return int(cost[end]), int(start[end]), end


def _proposals(hashes: np.ndarray, bounds: np.ndarray, items: Items) -> np.ndarray:
    """Distinct rows (item, document, first word) of the windows that pieces of items propose."""
    found = []
    for length in items.lengths:
        runs = _words.hash_runs(hashes, length, seed=8)
        low = np.searchsorted(items.keys, runs)
        places = np.flatnonzero(items.keys[np.minimum(low, len(items.keys) - 1)] == runs)
        count = np.searchsorted(items.keys, runs[places], side="right") - low[places]
        place = np.repeat(places, count)
        spot = np.repeat(low[places], count) + np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)
        item, offset, own = items.spots[spot].T
        document = np.searchsorted(bounds, place, side="right") - 1
        inside = (own == length) & (place + length <= bounds[document + 1])
        found.append(np.stack([item, document, place - offset], axis=1)[inside])
    pieces = np.unique(np.concatenate(found), axis=0)
    item, document, first = pieces.T
    shifts = 2 * (items.edits[item] // STEP) + 1
    row = np.repeat(np.arange(len(pieces)), shifts)
    shift = STEP * (np.arange(len(row)) - np.repeat(np.cumsum(shifts) - shifts, shifts)) - np.repeat(items.edits[item] // STEP * STEP, shifts)
    item, document, first = item[row], document[row], first[row] + shift
    first = np.clip(first, bounds[document], np.maximum(bounds[document], bounds[document + 1] - items.sizes[item]))
    return np.unique(np.stack([item, document, first], axis=1), axis=0)


def _meetings(hashes: np.ndarray, bounds: np.ndarray, proposed: np.ndarray, items: Items) -> np.ndarray:
    """Distinct rows (document, item, first word) of windows and items that meet in some table."""
    # a window is looked at once, whichever items of its size propose it
    windows = np.unique(np.stack([items.sizes[proposed[:, 0]], proposed[:, 1], proposed[:, 2]], axis=1), axis=0)
    padded = np.concatenate([hashes, np.zeros(int(items.sizes.max()), _U)])
    met = []
    for of in _alike(windows[:, 0]):
        size, document, first = windows[of].T
        own = np.arange(int(size.max()))
        place = first[:, None] + own
        inside = (own < size[:, None]) & (place < bounds[document + 1][:, None])
        keys = table_keys(np.where(inside, padded[place], _U(0)), size).ravel()
        left, right = np.searchsorted(items.table, keys, "left"), np.searchsorted(items.table, keys, "right")
        hit = np.flatnonzero(right > left)
        count = (right - left)[hit]
        spot = np.repeat(left[hit], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        window = np.repeat(hit // (len(keys) // len(document)), count)
        met.append(np.unique(np.stack([document[window], items.owner[spot].astype(np.int64), first[window]], axis=1), axis=0))
    return np.concatenate(met) if met else np.zeros((0, 3), np.int64)


def _in_chunk(hashes: np.ndarray, bounds: np.ndarray, items: Items, exact: bool) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, item, edits, first word, end) of the best matching passage of each item in each document."""
    proposed = _proposals(hashes, bounds, items)
    met = proposed[:, [1, 0, 2]] if exact else _meetings(hashes, bounds, proposed, items)
    met = met[np.lexsort((met[:, 2], met[:, 1], met[:, 0]))]
    pairs, begins = np.unique(met[:, :2], axis=0, return_index=True)
    ends = np.append(begins[1:], len(met))
    for (document, item), begin, end in zip(pairs.tolist(), begins.tolist(), ends.tolist()):
        base, stop = int(bounds[document]), int(bounds[document + 1])
        near = np.unique(met[begin:end, 2]) - base
        match = _verified(items.words[item], hashes[base:stop], near.tolist(), int(items.edits[item]))
        if match:
            yield document, item, *match


def _verified(item: np.ndarray, words: np.ndarray, starts: list[int], edits: int) -> tuple[int, int, int] | None:
    """The best passage around windows that lie close together, if it is within ``edits``."""
    best, at = None, 0
    while at < len(starts):
        end = at + 1
        while end < len(starts) and starts[end] - starts[end - 1] <= 2 * edits + 1 and starts[end] - starts[at] <= 16 * len(item):
            end += 1
        low = max(0, starts[at] - edits)
        high = starts[end - 1] + len(item) + 2 * edits
        # each word of the item that isn't there at all is an edit
        if int((~np.isin(item, words[low:high])).sum()) > edits:
            at = end
            continue
        cost, first, last = best_passage(item, words[low:high])
        if cost <= edits and (best is None or cost < best[0]):
            best = cost, low + first, low + last
        at = end
    return best


def _in_batch(batch: pa.RecordBatch, items: Items, exact: bool) -> Iterator[tuple]:
    """(row, item, edits, first word, end) of the matches in a batch."""
    data, offsets = _words.flat(batch.column(batch.schema.get_field_index("__text")))
    for first, last in _words.chunks(offsets):
        part = offsets[first : last + 1]
        words = _split(data[part[0] : part[-1]], part - part[0])
        hashes = _words.hash_words(words, lower=True)
        for document, *match in _in_chunk(hashes, words.bounds, items, exact):
            yield first + document, *match


_FOUND = ("item_id", "item_words", "edits", "first_word", "end_word")


def _matches(sent, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        for batch in batches:
            rows = [(i, items.ids[k], len(items.words[k]), *m) for i, k, *m in _in_batch(batch, items, exact)]
            if rows:
                columns = list(zip(*rows))
                text = batch.schema.get_field_index("__text")
                kept = [c.take(pa.array(columns[0], pa.int64())) for j, c in enumerate(batch.columns) if j != text]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                names = [n for n in batch.schema.names if n != "__text"] + [f"__{n}" for n in _FOUND]
                yield pa.record_batch([*kept, *(pa.array(c, k) for c, k in zip(columns[1:], kinds))], names=names)

    return run


def _without(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        for batch in batches:
            stays = np.ones(batch.num_rows, bool)
            stays[[m[0] for m in _in_batch(batch, items, False)]] = False
            yield batch.filter(pa.array(stays))

    return run


def _passes(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Broadcast]:
    """Items, sent to all executors in passes of at most PASS_BYTES (or one item); the table is read a partition at a time."""
    send = benchmark.sparkSession.sparkContext.broadcast
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null").distinct()
    ids, words, held = [], [], 0
    for row in rows.orderBy("i", "t").toLocalIterator():
        data, offsets = _words.flat(pa.array([row[1]], pa.string()))
        own = _words.hash_words(_split(data, offsets), lower=True)
        if not len(own):
            continue
        if ids and held + _bytes(len(own)) > PASS_BYTES:
            yield send(Items(ids, words))
            ids, words, held = [], [], 0
        ids.append(row[0])
        words.append(own)
        held += _bytes(len(own))
    if ids:
        yield send(Items(ids, words))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    exact: bool = False,
) -> DataFrame:
    """A row for each document and item found in it: ``keep``, item_id, item_words, edits, first_word and end_word.

    The passage with the fewest edits is given, of several the first, in words
    of this module.  A null text or one without a word has no passage; null
    items, items without a word and those whose id is no whole number are not
    looked for.  Repeated rows are found each for itself, repeated items once;
    different texts of one item_id are items of their own.  ``exact`` verifies
    every proposed window.  A column of ``keep`` that is named like one of the
    result's comes first, and so twice.
    """
    names = [f"c{i}" for i in range(len(keep))]
    kept = docs.select(*(F.col(f"`{n}`").alias(c) for n, c in zip(keep, names)), F.col(text_col).alias("__text")).where("__text is not null")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "__text"]
    schema = ", ".join([*fields, *(f"__{n} {'long' if n == 'item_id' else 'int'}" for n in _FOUND)])
    found = None
    for items in _passes(benchmark, item_id, item_text):
        part = kept.mapInArrow(_matches(items, exact), schema)
        found = part if found is None else found.unionByName(part)
    found = docs.sparkSession.createDataFrame([], schema) if found is None else found
    return found.select(*(F.col(c).alias(n) for n, c in zip(keep, names)), *(F.col(f"__{n}").alias(n) for n in _FOUND))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark passage; rows with a null text stay.

    Rows are left out where they are read, so nothing is shuffled.
    """
    names = docs.columns
    kept = docs.select(*(F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)), F.col(text_col).alias("__text"))
    for items in _passes(benchmark, "item_id", "text"):
        kept = kept.mapInArrow(_without(items), kept.schema)
    return kept.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))
