"""Language-model scores from an Elias-Fano n-gram trie.

The model is a trigram model with interpolated absolute discounting.  Its trie
is dealt into shards by the first word of a trigram; a word with more training
tokens than a shard should hold is dealt on by the second word.  Documents are
packed into batches, and each batch sends its distinct trigrams to their shards
once: a shard adds up the training counts, builds its part of the trie, and
answers the same blocks by search.  Batches put answers and documents together
again.  No model is ever in one place, and what is sent grows with the distinct
trigrams of a batch, not with the tokens.

Shards answer with a word's count and number of followers, with a pair's
quantised discounted count and weight of backing off, and with a triple's
quantised discounted probability:

    p1(w)       = (c(w) - d) / N, or (singletons / N) for all unknown words
    p2(w | v)   = (c(v, w) - D) / c(v) + D * followers(v) / c(v) * p1(w)
    p3(w | u v) = (c(u, v, w) - D) / c(u, v) + D * followers(u, v) / c(u, v) * p2(w | v)
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm import _words
from siftstone.llm._sample import held_out
from siftstone.llm._scratch import discard, materialise, shuffles_end_with_the_write
from siftstone.llm.eliasfano import Trie, dequantise, quantise

FOLDS, HELD_OUT_FOLD = 7, 2
BATCH_TOKENS = 400_000
SHARD_TOKENS = 400_000
DISCOUNT = 0.8
#: Shares of the shards that are taught one after the other: only a share's blocks lie on disk at a time.
PASSES = 2
#: Blocks of a shard that are searched for at once.
ANSWERED = 32
#: A word is told by the upper 56 bits of its hash; marks have lower ones too.
_WORD_BITS = np.uint64((1 << 64) - 256)
#: Hashes of the marks: before a text, its end, and padding beyond it.
_BEGIN, _END, _PAD = (np.uint64(0xA5A5_0000_0000_0001 + (i << 40)) for i in range(3))
_MARKS = np.array([_BEGIN, _END, _PAD])
_U = np.uint64


# ---------------------------------------------------------------- packing


@lru_cache(maxsize=1)
def _zstd():
    """The worker's compressor and decompressor; making one costs more than a small array."""
    import zstandard

    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _squeeze(array: np.ndarray) -> bytes:
    """Compressed bytes of an array, all first bytes before all second ones."""
    planes = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), array.itemsize).T
    return _zstd()[0].compress(np.ascontiguousarray(planes).tobytes())


def _loosen(data, kind) -> np.ndarray:
    raw = np.frombuffer(_zstd()[1].decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays end to end, each compressed for itself."""
    parts = [_squeeze(a) for a in arrays]
    return np.array([len(p) for p in parts], np.uint32).tobytes() + b"".join(parts)


def _unpack(data, *kinds) -> list[np.ndarray]:
    lengths = np.frombuffer(data, np.uint32, len(kinds)).tolist()
    at, out = 4 * len(kinds), []
    for kind, length in zip(kinds, lengths):
        out.append(_loosen(data[at : at + length], kind))
        at += length
    return out


def _palette(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, the most frequent first, and the place of each code among them."""
    values, place, counts = np.unique(codes, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.uint16)
    rank[order] = np.arange(len(order))
    return values[order], rank[place]


# ---------------------------------------------------------------- batches


def _batches(size: int):
    """Batches of about ``size`` tokens: ids, folds, lengths, distinct word hashes, and each token's place among them."""
    return lambda batches: _packed_batches(batches, size)


def _packed_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    held, count = [], 0

    def packed() -> pa.RecordBatch:
        ids = pa.concat_arrays([h[0] for h in held])
        folds = pa.concat_arrays([h[1] for h in held])
        lengths = np.concatenate([h[2] for h in held])
        vocabulary, places = np.unique(np.concatenate([_MARKS, *(h[3] for h in held)]), return_inverse=True)
        tokens = len(places) - len(_MARKS) + len(lengths)
        as_list = lambda x: pa.array([x.to_pylist() if isinstance(x, pa.Array) else x])
        counts = np.bincount(places[len(_MARKS) :], minlength=len(vocabulary))
        counts[places[0]] += len(lengths)  # a text begins with the first mark, which is dealt on like any other frequent word
        return pa.record_batch(
            [
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                pa.ListArray.from_arrays(pa.array([0, len(folds)], pa.int32()), folds),
                as_list(lengths),
                pa.array([_squeeze(np.diff(vocabulary, prepend=_U(0)))], pa.binary()),
                pa.array([_squeeze(places[len(_MARKS) :].astype(np.int32))], pa.binary()),
                pa.array([tokens], pa.int64()),
                pa.array([_squeeze(counts.astype(np.int32))], pa.binary()),
            ],
            names=["ids", "held", "lengths", "vocabulary", "places", "tokens", "counts"],
        )

    for batch in batches:
        for first, last, words in _words.text_chunks(batch, "text"):
            hashes = _words.hash_words(words, lower=True) & _WORD_BITS
            held.append((batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), np.diff(words.bounds), hashes))
            count += len(hashes)
            if count >= size:
                yield packed()
                held, count = [], 0
    if held:
        yield packed()


def _vocabulary(data) -> np.ndarray:
    return np.cumsum(_loosen(data, np.uint64), dtype=np.uint64)


_PACKED = "ids array<long>, held array<boolean>, lengths array<long>, vocabulary binary, places binary, tokens long, counts binary"


def _heavy(packed: DataFrame, batches: int, share: int) -> dict[int, int]:
    """Words with more than ``share`` tokens in all batches, with their numbers, which don't depend on how rows fall into batches.

    Such a word has more than ``share / batches`` in one batch at least, so the
    words that do are added up exactly.
    """
    least = share // max(batches, 1) + 1

    def counted(chosen):
        def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in tables:
                for words, counts in zip(table.column("vocabulary"), table.column("counts")):
                    words, counts = _vocabulary(words.as_buffer()), _loosen(counts.as_buffer(), np.int32).astype(np.int64)
                    at = np.flatnonzero(chosen(words, counts))
                    yield pa.record_batch([pa.array(words[at].view(np.int64)), pa.array(counts[at])], names=["word", "n"])

        return packed.select("vocabulary", "counts").mapInArrow(run, "word long, n long")

    likely = [r[0] for r in counted(lambda words, counts: counts >= least).select("word").distinct().collect()]
    if not likely:
        return {}
    known = np.array(likely, np.int64).view(_U)
    sums = counted(lambda words, counts: (counts > 0) & np.isin(words, known)).groupBy("word").agg(F.sum("n").alias("n"))
    return {r[0] % (1 << 64): r[1] for r in sums.where(F.col("n") > share).collect()}


class _Deal:
    """How a batch's words are dealt to shards: what is left of the words where only that is needed.

    ``deal`` has a number for each word, 16 bits of its hash while shards are
    few; ``marks`` are the places of the marks, ``heavy`` those of the words
    that go to several shards, and ``parts`` how many.
    """

    def __init__(self, deal: np.ndarray, marks: np.ndarray, heavy: np.ndarray, parts: np.ndarray):
        self.deal, self.marks, self.heavy, self.parts = deal, marks, heavy, parts

    @classmethod
    def of(cls, vocabulary: np.ndarray, shards: int, heavy: dict[int, int]) -> _Deal:
        deal = (vocabulary >> _U(48)).astype(np.uint16) if shards <= 1024 else vocabulary
        at = np.flatnonzero(np.isin(vocabulary, np.array(list(heavy), _U))) if heavy else np.zeros(0, np.int64)
        parts = np.array([heavy[h] for h in vocabulary[at].tolist()], np.int64)
        return cls(deal, np.searchsorted(vocabulary, _MARKS), at, parts)


class _Layout:
    """The distinct trigrams of a batch in the order of their shards; the same wherever it is computed.

    Of several ``passes`` it holds the trigrams of one share of the shards, each
    shard's as the whole layout has them.
    """

    def __init__(self, deal: _Deal, places: np.ndarray, lengths: np.ndarray, shards: int, passes: int = 1, own_pass: int = 0):
        places = places.astype(np.int64)
        lengths = np.asarray(lengths, np.int64)
        self.lengths = lengths
        marks = deal.marks
        # each text becomes BEGIN words END PAD PAD
        firsts = np.concatenate([[0], np.cumsum(lengths + 4)])
        sequence = np.empty(firsts[-1], np.int64)
        of = np.repeat(np.arange(len(lengths)), lengths)
        own = np.arange(len(places)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        sequence[firsts[of] + 1 + own] = places
        sequence[firsts[:-1]] = marks[0]
        for back, mark in ((3, 1), (2, 2), (1, 2)):
            sequence[firsts[1:] - back] = marks[mark]
        begins = np.ones(len(sequence), bool)  # where a trigram begins
        begins[firsts[1:] - 1] = begins[firsts[1:] - 2] = False
        at = np.flatnonzero(begins)
        u, v, w = sequence[at], sequence[at + 1], sequence[at + 2]
        size = self.size = len(deal.deal)
        parts = np.ones(size, np.int64)
        parts[deal.heavy] = deal.parts
        number = deal.deal.astype(_U)
        home, spread = (number % _U(shards)).astype(np.int64), (_words.mix(number) >> _U(33)).astype(np.int64)
        begin_doc = np.repeat(np.arange(len(lengths)), lengths + 2)
        if passes > 1:
            own_shard = (home[u] + spread[v] % parts[u]) % shards % passes == own_pass
            u, v, w, begin_doc = u[own_shard], v[own_shard], w[own_shard], begin_doc[own_shard]
        pairs, pair_of = np.unique(u * size + v, return_inverse=True)
        triples, triple_of = np.unique(pair_of * size + w, return_inverse=True)
        pair_of_triple = triples // size
        pair_u, pair_v = pairs // size, pairs % size
        shard = (home[pair_u] + spread[pair_v] % parts[pair_u]) % shards
        pair_order = np.argsort(shard, kind="stable")
        triple_order = np.argsort(shard[pair_of_triple], kind="stable")
        back = np.empty_like(pair_order)
        back[pair_order] = np.arange(len(pair_order))
        self.pair_u, self.pair_v, self.shard = pair_u[pair_order], pair_v[pair_order], shard[pair_order]
        self.triple_pair, self.triple_w = back[pair_of_triple[triple_order]], (triples % size)[triple_order]
        back3 = np.empty_like(triple_order)
        back3[triple_order] = np.arange(len(triple_order))
        self.pair_at, self.triple_at = back[pair_of], back3[triple_of]  # of each trigram's beginning
        self.begin_doc = begin_doc
        self.heavy = [(i, int(home[i]), n) for i, n in zip(deal.heavy.tolist(), deal.parts.tolist())]
        self.shards = shards

    def blocks(self):
        """(shard, words, first and last pair, first and last triple) of each block; words rise."""
        extra: dict[int, list[int]] = {}
        for word, home, parts in self.heavy:  # its count is the sum over all of its shards
            for shard in {(home + j) % self.shards for j in range(parts)}:
                extra.setdefault(shard, []).append(word)
        shards = np.union1d(self.shard, np.array(list(extra), np.int64))
        bounds = np.searchsorted(self.shard, [shards, shards + 1])
        triple_shard = self.shard[self.triple_pair]
        triple_bounds = np.searchsorted(triple_shard, [shards, shards + 1])
        for i, shard in enumerate(shards.tolist()):
            a, z = bounds[:, i].tolist()
            words = np.unique(np.concatenate([self.pair_u[a:z], np.array(extra.get(shard, []), np.int64)]))
            yield shard, words, a, z, *triple_bounds[:, i].tolist()


#: Words, pairs of each, hashes of second words, triples of each pair, hashes of third words, counts.
_BLOCK = (np.uint64, np.int32, np.uint32, np.int32, np.uint32, np.uint32)
#: Counts and followers of words; palettes and places of the codes of pairs, their backing off, and triples.
_ANSWER = (np.int64, np.int64, *[np.uint16] * 6)


def _prints(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(32)).astype(np.uint32)


def _send(shards: int, heavy: dict[int, int], passes: int, own_pass: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                vocabulary = _vocabulary(batch.column("vocabulary")[i].as_buffer())
                places = _loosen(batch.column("places")[i].as_buffer(), np.int32)
                layout = _Layout(_Deal.of(vocabulary, shards, heavy), places, batch.column("lengths")[i].values.to_numpy(), shards, passes, own_pass)
                learned = ~batch.column("held")[i].values.to_numpy(zero_copy_only=False).astype(bool)
                counts = np.bincount(layout.triple_at, weights=learned[layout.begin_doc], minlength=len(layout.triple_w)).astype(np.uint32)
                out: dict[str, list] = {"shard": [], "block": []}
                for shard, words, a, z, a3, z3 in layout.blocks():
                    if shard % passes != own_pass:
                        continue
                    pairs = np.bincount(np.searchsorted(words, layout.pair_u[a:z]), minlength=len(words)).astype(np.int32)
                    triples = np.bincount(layout.triple_pair[a3:z3] - a, minlength=z - a).astype(np.int32)
                    second, third = _prints(vocabulary[layout.pair_v[a:z]]), _prints(vocabulary[layout.triple_w[a3:z3]])
                    out["shard"].append(shard)
                    out["block"].append(_pack(np.diff(vocabulary[words], prepend=_U(0)), pairs, second, triples, third, counts[a3:z3]))
                own = pa.array([batch.column("batch")[i].as_py()] * len(out["shard"]), pa.int64())
                yield pa.record_batch([own, pa.array(out["shard"], pa.int32()), pa.array(out["block"], pa.binary())], names=["batch", "shard", "block"])

    return run


def _slim(shards: int, heavy: dict[int, int]):
    """Batches without their words: numbers that tell shards are enough to put answers in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deals = [_Deal.of(_vocabulary(x.as_buffer()), shards, heavy) for x in batch.column("vocabulary")]
            lists = [[d.marks.tolist() for d in deals], [d.heavy.tolist() for d in deals], [d.parts.tolist() for d in deals]]
            yield pa.record_batch(
                [
                    *(batch.column(n) for n in ("batch", "ids", "held", "lengths", "places")),
                    pa.array([_squeeze(d.deal) for d in deals], pa.binary()),
                    *(pa.array(x, pa.list_(pa.int64())) for x in lists),
                ],
                names=["batch", "ids", "held", "lengths", "places", "deal", "marks", "heavy", "parts"],
            )

    return run


# ---------------------------------------------------------------- shards


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, with the sums of their counts; keys whose sum is nothing are left out."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = np.add.reduceat(counts, first) if len(first) else counts
    some = sums > 0
    return keys[first][some], sums[some]


def _read_block(data) -> list[np.ndarray]:
    """Words, pairs of each, hashes of second words, triples of each pair, hashes of third words, counts."""
    words, *rest = _unpack(data, *_BLOCK)
    return [np.cumsum(words, dtype=np.uint64), *rest]


def build_trie(blocks: list[list[np.ndarray]]) -> tuple[Trie, np.ndarray, np.ndarray]:
    """The trie of what the blocks' texts teach; also the hash and count of each word in it."""
    words = [np.repeat(b[0], b[1]) for b in blocks]
    triple_words = np.concatenate([np.repeat(u, b[3]) for u, b in zip(words, blocks)])
    triple_pairs = np.concatenate([np.repeat(b[2], b[3]) for b in blocks]).astype(_U)
    prints = np.concatenate([b[4] for b in blocks]).astype(_U)
    counts = np.concatenate([b[5] for b in blocks]).astype(np.int64)
    taught = counts > 0
    triple_words, triple_pairs, prints, counts = triple_words[taught], triple_pairs[taught], prints[taught], counts[taught]

    names, name_counts = _summed(triple_words, counts)
    pair_keys = np.searchsorted(names, triple_words).astype(_U) << _U(32) | triple_pairs
    pairs, pair_counts = _summed(pair_keys, counts)
    triple_keys = np.searchsorted(pairs, pair_keys).astype(_U) << _U(32) | prints
    triples, triple_counts = _summed(triple_keys, counts)

    pair_parent = (pairs >> _U(32)).astype(np.int64)
    triple_parent = (triples >> _U(32)).astype(np.int64)
    first_pair = np.searchsorted(pair_parent, np.arange(len(names) + 1))
    first_triple = np.searchsorted(triple_parent, np.arange(len(pairs) + 1))
    followers = np.diff(first_triple)
    values = {
        "count": name_counts,
        "pair": quantise(pair_counts - DISCOUNT),
        "back_off": quantise(DISCOUNT * followers / np.maximum(pair_counts, 1)),
        "triple": quantise((triple_counts - DISCOUNT) / np.maximum(pair_counts[triple_parent], 1)),
    }
    return Trie.build(names, [pairs, triples], [first_pair, first_triple], values), names, name_counts


_CERTAIN = quantise(np.ones(1))[0]


def _looked_up(values: np.ndarray, ranks: np.ndarray, default) -> np.ndarray:
    out = np.full(len(ranks), default, values.dtype)
    known = ranks >= 0
    out[known] = values[ranks[known]]
    return out


def answer(trie: Trie, block: list[np.ndarray]) -> list[np.ndarray]:
    """Count and followers of a block's words, codes of its pairs and of their backing off, and of its triples."""
    words, pairs, pair_prints, triples, triple_prints, _ = block
    word_ranks = trie.word(words)
    pair_ranks = trie.child(2, np.repeat(word_ranks, pairs), pair_prints)
    triple_ranks = trie.child(3, np.repeat(pair_ranks, triples), triple_prints)
    return [
        _looked_up(trie.values["count"], word_ranks, 0),
        trie.fan_out(1, word_ranks),
        _looked_up(trie.values["pair"], pair_ranks, 0),
        _looked_up(trie.values["back_off"], pair_ranks, _CERTAIN),
        _looked_up(trie.values["triple"], triple_ranks, 0),
    ]


def _replies(trie: Trie, blocks: list[list[np.ndarray]]) -> list[bytes]:
    """The packed answer to each block; a search for ANSWERED blocks at once, cut where their words, pairs and triples end."""
    out = []
    for at in range(0, len(blocks), ANSWERED):
        some = blocks[at : at + ANSWERED]
        found = answer(trie, [np.concatenate(x) for x in zip(*some)])
        ends = [np.cumsum([len(b[i]) for b in some])[:-1] for i in (0, 0, 2, 2, 4)]
        cut = zip(*(np.split(x, end) for x, end in zip(found, ends)))
        out += [_pack(count, followers, *(x for c in codes for x in _palette(c))) for count, followers, *codes in cut]
    return out


_SHARD = "batch long, shard int, answer binary, trie binary, tokens long, types long, singles long, dealt array<long>, dealt_counts array<long>"


def _shard(heavy: dict[int, int], replies: bool, keep: bool):
    """Teach a shard its blocks; give the answers to them, the trie, and in the last row the shard's totals."""

    def run(table: pa.Table) -> pa.Table:
        blocks = [_read_block(x.as_buffer()) for x in table["block"]]
        trie, names, counts = build_trie(blocks)
        shard = table["shard"][0].as_py()
        real = ~np.isin(names, _MARKS[[0, 2]])
        names, counts = names[real], counts[real]
        # what a word that is dealt to several shards counts is known when they are added up
        dealt = np.isin(names, np.array(list(heavy), _U)) if heavy else np.zeros(len(names), bool)
        rows = _replies(trie, blocks) if replies else []
        totals = [int(counts.sum()), int((~dealt).sum()), int((counts[~dealt] == 1).sum()), names[dealt].view(np.int64), counts[dealt]]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        empty = [None] * len(rows)
        return pa.table(
            [
                pa.array([*table["batch"].to_pylist()[: len(rows)], None], pa.int64()),
                pa.array([shard] * (len(rows) + 1), pa.int32()),
                pa.array([*rows, None], pa.binary()),
                pa.array([*empty, trie.tobytes() if keep else None], pa.binary()),
                *(pa.array([*empty, t], k) for t, k in zip(totals, kinds)),
            ],
            names=[x.split()[0] for x in _SHARD.split(", ")],
        )

    return run


def _asked(blocks: pa.Table, tries: pa.Table) -> pa.Table:
    """Answers of a stored shard; one that has learned nothing knows nothing."""
    trie = Trie(tries["trie"][0].as_buffer()) if tries.num_rows else build_trie([[np.zeros(0, kind) for kind in _BLOCK]])[0]
    rows = _replies(trie, [_read_block(x.as_buffer()) for x in blocks["block"]])
    return pa.table([blocks["batch"], blocks["shard"], pa.array(rows, pa.binary())], names=["batch", "shard", "answer"])


def _totals(shards: DataFrame) -> tuple[int, int, int]:
    """Tokens, distinct words, and words that occur once, of all shards; words dealt to several shards count once."""
    sums = shards.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "types", "singles"))).first()
    each = shards.where("size(dealt) > 0").select(F.explode(F.arrays_zip("dealt", "dealt_counts")).alias("w")).groupBy("w.dealt").agg(F.sum("w.dealt_counts").alias("n"))
    dealt = each.agg(F.count("*"), F.count_if(F.col("n") == 1)).first()
    return sums[0], sums[1] + dealt[0], sums[2] + dealt[1]


# ---------------------------------------------------------------- scores


def _assemble(shards: int, tokens: int, types: int, singles: int):
    total, kinds = max(tokens, 1), max(types, 1)
    free = max(singles, 1) / kinds * 0.999  # what each known word gives to the unknown
    unknown = free * kinds / total if tokens else 1.0

    def run(batch: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for i in range(batch.num_rows):
            numbers = [batch[n][i].values.to_numpy() for n in ("marks", "heavy", "parts")]
            deal = _Deal(_loosen(batch["deal"][i].as_buffer(), np.uint16 if shards <= 1024 else np.uint64), *numbers)
            places = _loosen(batch["places"][i].as_buffer(), np.int32)
            layout = _Layout(deal, places, batch["lengths"][i].values.to_numpy(), shards)
            found = {s.as_py(): x.as_buffer() for s, x in zip(answers["shard"], answers["answer"])}
            size = layout.size
            count, followers = np.zeros(size, np.int64), np.zeros(size, np.int64)
            pair, back, triple = (np.zeros(n, np.uint16) for n in (len(layout.pair_u), len(layout.pair_u), len(layout.triple_w)))
            for shard, words, a, z, a3, z3 in layout.blocks():
                got = _unpack(found[shard], *_ANSWER)
                count[words] += got[0]
                followers[words] += got[1]
                pair[a:z], back[a:z], triple[a3:z3] = got[2][got[3]], got[4][got[5]], got[6][got[7]]

            # the tokens of a text are its trigrams' beginnings from the second on
            lengths = layout.lengths
            firsts = np.cumsum(lengths + 2) - (lengths + 2)
            predicted = np.ones(len(layout.begin_doc), bool)
            predicted[firsts] = False
            at = np.flatnonzero(predicted)
            opens = ~predicted[at - 1]
            word, context = layout.pair_u[layout.pair_at[at]], layout.pair_u[layout.pair_at[at - 1]]
            known = count[word]
            p1 = np.where(known > 0, (known - free) / total, unknown)
            seen = np.maximum(count[context], 1)
            own, rest = dequantise(pair[layout.pair_at[at - 1]]) / seen, DISCOUNT * followers[context] / seen
            p2 = np.where(count[context] > 0, own + rest * p1, p1)
            # before a text's first token stand two marks, and the first of them says no more than the second
            p3 = dequantise(triple[layout.triple_at[at - 2]]) + dequantise(back[layout.pair_at[at - 2]]) * p2
            p3 = np.where(opens, np.where(count[context] > 0, own + rest * p2, p1), p3)
            base = np.log10((known + 1) / (tokens + types + 1))
            doc = layout.begin_doc[at]
            add = lambda x: np.bincount(doc, weights=x, minlength=len(lengths))  # noqa: B023, E731
            out.append(
                pa.table(
                    [
                        batch["ids"][i].values,
                        batch["held"][i].values,
                        pa.array(lengths + 1, pa.int64()),
                        pa.array(add(known > 0).astype(np.int64)),
                        pa.array(np.full(len(lengths), tokens, np.int64)),
                        pa.array(add(base)),
                        pa.array(add(np.log10(p3))),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
            )
        return pa.concat_tables(out) if out else _NOTHING

    return run


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_NOTHING = pa.table(
    [pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())],
    names=[x.split()[0] for x in _RESULT.split(", ")],
)


def _batched(docs: DataFrame, id_col: str, text_col: str, folds: int, fold: int, batch_tokens: int) -> DataFrame:
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), folds, fold).alias("held"), F.col(text_col).alias("text")
    )
    return materialise(texts.mapInArrow(_batches(batch_tokens), _PACKED).withColumn("batch", F.monotonically_increasing_id()), "batches")


def _plan(packed: DataFrame, shard_tokens: int) -> tuple[int, dict[int, int]]:
    """The number of shards, and the words that are dealt to several, with how many."""
    size, batches = packed.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    shards = max(8, -(-size // shard_tokens))
    share = shard_tokens // 2
    return shards, {word: min(shards, -(-n // share)) for word, n in _heavy(packed, batches, share).items()}


def _sent(packed: DataFrame, shards: int, heavy: dict[int, int], passes: int = 1, own_pass: int = 0) -> DataFrame:
    """The blocks for every shard, or for one of ``passes`` shares of them."""
    return packed.select("batch", "held", "lengths", "vocabulary", "places").mapInArrow(
        _send(shards, heavy, passes, own_pass), "batch long, shard int, block binary"
    )


def _assembled(packed: DataFrame, answers: DataFrame, shards: int, heavy: dict[int, int], totals: tuple[int, int, int]) -> DataFrame:
    own = packed.select("batch", "ids", "held", "lengths", "vocabulary", "places").mapInArrow(
        _slim(shards, heavy),
        "batch long, ids array<long>, held array<boolean>, lengths array<long>, places binary, deal binary, marks array<long>, heavy array<long>, parts array<long>",
    )
    return own.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_assemble(shards, *totals), _RESULT)


def scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = FOLDS,
    fold: int = HELD_OUT_FOLD,
    batch_tokens: int = BATCH_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
    passes: int = PASSES,
) -> DataFrame:
    """One row per row of ``docs``, with the scores of the model learned from the rows outside fold ``fold``.

    A null text is empty, and has its end as the only token.  Repeated rows
    count as often as they come.  A row without an id is scored and not learned
    from.  With nothing to learn from every token is unknown, with probability 1;
    an empty table has no scores.  Other columns of ``docs`` are not read.

    A task holds one batch or one shard, and a batch sends one block to each
    shard that it needs; executors with more memory should get larger batches
    and shards, so that blocks stay large on a large corpus.
    """
    packed = _batched(docs, id_col, text_col, folds, fold, batch_tokens)
    shards, heavy = _plan(packed, shard_tokens)
    learned = None
    for p in range(passes):
        taught = materialise(_sent(packed, shards, heavy, passes, p).groupBy("shard").applyInArrow(_shard(heavy, True, False), _SHARD), "answers")
        learned = taught if learned is None else learned.unionByName(taught)
    totals = _totals(learned.where("batch is null"))
    return _assembled(packed, learned.where("batch is not null").select("batch", "shard", "answer"), shards, heavy, totals)


def train(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = FOLDS,
    fold: int = HELD_OUT_FOLD,
    batch_tokens: int = BATCH_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Write the model of the rows outside fold ``fold`` to the folder ``path``, where ``score`` finds it, in any session.

    The folder holds a row with the trie of each shard and a row of totals; it
    must not exist yet.
    """
    spark = docs.sparkSession
    packed = _batched(docs.where(~held_out(F.col(id_col), folds, fold)), id_col, text_col, folds, fold, batch_tokens)
    shards, heavy = _plan(packed, shard_tokens)
    taught = _sent(packed, shards, heavy).groupBy("shard").applyInArrow(_shard(heavy, False, True), _SHARD)
    with shuffles_end_with_the_write(spark):
        taught.drop("batch", "answer").write.parquet(f"{path}/shards")
    discard(packed)
    totals = _totals(spark.read.parquet(f"{path}/shards"))
    words, parts = [w - (w >> 63 << 64) for w in heavy], list(heavy.values())
    spark.createDataFrame([(shards, words, parts, *totals)], "shards int, words array<long>, parts array<int>, tokens long, types long, singles long").write.parquet(
        f"{path}/totals"
    )


def score(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = FOLDS,
    fold: int = HELD_OUT_FOLD,
    batch_tokens: int = BATCH_TOKENS,
) -> DataFrame:
    """What ``scores`` gives, by the model that ``train`` has written to ``path``; nothing is learned."""
    spark = docs.sparkSession
    kept = spark.read.parquet(f"{path}/totals").first()
    heavy = {w % (1 << 64): n for w, n in zip(kept.words, kept.parts)}
    packed = _batched(docs, id_col, text_col, folds, fold, batch_tokens)
    tries = spark.read.parquet(f"{path}/shards").select("shard", "trie")
    asked = _sent(packed, kept.shards, heavy).groupBy("shard").cogroup(tries.groupBy("shard"))
    answers = materialise(asked.applyInArrow(_asked, "batch long, shard int, answer binary"), "answers")
    return _assembled(packed, answers, kept.shards, heavy, (kept.tokens, kept.types, kept.singles))
