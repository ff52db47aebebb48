import re
import zlib
from collections import Counter, defaultdict
from math import log10

import pytest

from siftstone.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows):
    texts = [(d, d is None or zlib.crc32(str(d).encode()) % 7 == 2, WORD.findall((t or "").translate(UPPER))) for d, t in rows]
    one, two, three = Counter(), Counter(), Counter()
    for _, held, words in texts:
        if not held:
            s = [1, 2, *words, 3]
            one.update(s[2:])
            two.update(zip(s[1:], s[2:]))
            three.update(zip(s, s[1:], s[2:]))
    context, follow, context2, follow2 = Counter(), Counter(), Counter(), Counter()
    for (a, _), c in two.items():
        context[a] += c
        follow[a] += 1
    for (a, b, _), c in three.items():
        context2[a, b] += c
        follow2[a, b] += 1
    n, kinds, singles = sum(one.values()), len(one), sum(c == 1 for c in one.values())
    free = max(singles, 1) / max(kinds, 1) * 0.999
    unknown = free * kinds / n if n else 1.0
    out = []
    for d, held, words in texts:
        s = [1, 2, *words, 3]
        base = score = known = 0
        for u, v, w in zip(s, s[1:], s[2:]):
            c = one[w]
            known += c > 0
            base += log10((c + 1) / (n + kinds + 1))
            p = (c - free) / n if c else unknown
            if context[v]:
                p = max(two[v, w] - lm.DISCOUNT, 0) / context[v] + lm.DISCOUNT * follow[v] / context[v] * p
            if context2[u, v]:
                p = max(three[u, v, w] - lm.DISCOUNT, 0) / context2[u, v] + lm.DISCOUNT * follow2[u, v] / context2[u, v] * p
            score += log10(p)
        out.append((d, held, len(words) + 1, known, n, base, score))
    return out


def check(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5] == pytest.approx(b[5], rel=1e-9)
        assert a[6] == pytest.approx(b[6], abs=1.8e-4 * b[2])  # half a step of the quantised codes for each token


def rows_of(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, [tuple(r) for r in docs.select("doc_id", "text").collect()]


def test_documents_against_brute_force(spark):
    docs, rows = rows_of(spark)
    got = lm.scores(docs).collect()
    check(got, brute(rows))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.95 * sum(r.base_score for r in held) and sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("passes", [1, 3, 50])
def test_shards_taught_in_shares(spark, passes):
    docs, rows = rows_of(spark)
    some = rows[:80] + [(None, "x"), (1, None)]
    docs = spark.createDataFrame(some, "doc_id long, text string")
    check(lm.scores(docs, batch_tokens=3000, shard_tokens=2000, passes=passes).collect(), brute(some))


def test_many_shards_batches_and_dealt_words(spark, monkeypatch):
    import siftstone.llm._words as words

    docs, rows = rows_of(spark)
    docs, rows = docs.where("doc_id < 150"), [r for r in rows if r[0] < 150]
    monkeypatch.setattr(words, "CHUNK_BYTES", 5000)
    for shard_tokens in (1000, 40):  # so that frequent words are dealt by the next one; and more shards than 16 bits serve
        check(lm.scores(docs, batch_tokens=3000, shard_tokens=shard_tokens).collect(), brute(rows))


def test_edge_cases(spark):
    rows = [(1, None), (3, ""), (4, " \t"), (5, "a"), (5, "a"), (7, "A b\x0bB é É"), (None, "a b"), (8, "x " * 200_000)]
    frame = lambda r: spark.createDataFrame([(*x, 1) for x in r], "doc_id long, text string, batch int")
    check(lm.scores(frame(rows)).collect(), brute(rows))
    assert lm.scores(frame([])).collect() == []
    check(lm.scores(frame([(None, "a b")])).collect(), brute([(None, "a b")]))


def test_words_rare_in_each_batch_are_dealt(spark):
    rows = [(i, " ".join(["rare", *(f"w{i}x{j}" for j in range(2999))])) for i in range(12)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "false AS held", "text").repartition(4).cache()
    want = {int(lm._words.hash_words(next(lm._words.text_chunks(word_of("rare"), "text"))[2], lower=True)[0] & lm._WORD_BITS): 12, int(lm._BEGIN): 12}
    for size in (3000, 9000, 100_000):  # a third of a thousandth of a batch
        packed = texts.mapInArrow(lm._batches(size), lm._PACKED).cache()
        assert lm._heavy(packed, packed.count(), 10) == want
    check(lm.scores(spark.createDataFrame(rows, "doc_id long, text string"), batch_tokens=3000, shard_tokens=20).collect(), brute(rows))


def test_a_frequent_word_of_held_out_texts_alone_is_no_known_word(spark):
    held = [d for d in range(400) if zlib.crc32(str(d).encode()) % 7 == 2][:6]
    rows = [(d, "only here " * 50) for d in held] + [(d, f"word{d} and more") for d in range(400) if d not in held]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bases = []
    for shard_tokens in (40, 200, 750_000):
        got = lm.scores(docs, shard_tokens=shard_tokens).collect()
        check(got, brute(rows))
        bases.append(sorted((r.doc_id, round(r.base_score, 9), r.n_known) for r in got))
    assert bases[0] == bases[1] == bases[2]


def test_openings_are_dealt_on(spark):
    rows = [(i, f"w{i % 50} x{i} y") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    packed = lm._batched(docs, "doc_id", "text", 7, 2, 100)
    shards, heavy = lm._plan(packed, 60)
    assert heavy[int(lm._BEGIN)] > 1
    check(lm.scores(docs, batch_tokens=100, shard_tokens=60).collect(), brute(rows))


@pytest.mark.parametrize("shard_tokens", [750_000, 200])
def test_a_stored_model_scores_as_one_just_learned(spark, tmp_path, shard_tokens):
    docs, rows = rows_of(spark)
    docs, rows = docs.where("doc_id < 120"), [r for r in rows if r[0] < 120]
    lm.train(docs, str(tmp_path / "model"), shard_tokens=shard_tokens)
    check(lm.score(docs, str(tmp_path / "model")).collect(), brute(rows))
    new = [(9001, "never seen words"), (9002, rows[0][1]), (9003, None)]
    texts = {d: t for d, t in rows} | dict(new)
    got = lm.score(spark.createDataFrame(new, "doc_id long, text string"), str(tmp_path / "model")).collect()
    assert {r.train_tokens for r in got} == {brute(rows)[0][4]} and all(r.n_tokens == len(WORD.findall(texts[r.doc_id] or "")) + 1 for r in got)
    same = next(r for r in lm.score(docs, str(tmp_path / "model")).collect() if r.doc_id == rows[0][0])
    assert next(r.score for r in got if r.doc_id == 9002) == pytest.approx(same.score)


def word_of(word):
    import pyarrow as pa

    return pa.record_batch([pa.array([word])], names=["text"])
