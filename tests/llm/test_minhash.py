import re
from collections import defaultdict

import numpy as np
import pytest

from siftstone.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """rows: (doc_id, text); the expected (doc_id, n_shingles, component_id, kept)."""
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_shingle = defaultdict(set)
    for i, (_, s) in enumerate(sets):
        for x in s:
            by_shingle[x].add(i)
    pairs = {(i, j) for group in by_shingle.values() for i in group for j in group if i < j}
    for i, j in pairs:
        (a, x), (b, y) = sets[i], sets[j]
        if 100 * len(x & y) >= 75 * len(x | y):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return sorted((d, len(s), root(d), root(d) == d) for d, s in sets)


def run(spark, rows, **more):
    df = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **more)
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is None, r))


def test_against_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, minhash.near_duplicates(docs).collect())) == brute(rows)


@pytest.mark.parametrize("block", [256, 4])
def test_chains_and_outliers_of_one_bucket(spark, monkeypatch, block):
    import random

    monkeypatch.setattr(minhash, "_BLOCK_NODES", block)
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(60):  # each drifts from its predecessor, so that the ends of the chain differ
        base = list(base)
        base[rng.randrange(120)] = f"x{i}"
        rows.append((i * 7 % 61, " ".join(base)))
    for i in range(40):  # half of each text is shared, half is its own
        rows.append((1000 + i, " ".join([f"s{j}" for j in range(60)] + [f"o{i}_{j}" for j in range(30)])))
    assert run(spark, rows) == brute(rows)


def test_null_empty_short_and_repeated_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one Two"), (5, "ONE two"), (6, "one two three"), (7, "one two")]
    rows += [(8, "a b c d e f g"), (8, "a b c d e f g"), (9, "A B C D E F G"), (10, "ÄB c d e f"), (11, "äb c d e f")]
    assert run(spark, rows) == brute(rows)


def test_rows_without_an_id_are_kept_alone(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, None)]
    assert run(spark, rows) == [(1, 2, 1, True), (2, 2, 1, False), (None, 0, None, True), (None, 2, None, True)]


def test_repeated_ids_with_other_texts_are_one_document(spark):
    rows = [(5, "a b c d e f"), (5, "p q r s t u"), (2, "a b c d e f"), (3, "p q r s t u")]
    assert {r[2] for r in run(spark, rows)} == {2}


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    docs = spark.createDataFrame([(1, "a b c d e", 7, "x"), (2, "a b c d e", 7, "y")], "doc_id long, text string, node long, band string")
    assert [r.doc_id for r in minhash.keep_one_of_each(docs).collect()] == [1]
    assert minhash.keep_one_of_each(docs).columns == docs.columns


def test_very_long_text(spark):
    long = " ".join(str(i * i % 9973) for i in range(300_000))
    rows = [(1, long), (2, long + " tail"), (3, "x" * 3_000_000)]
    got = run(spark, rows)
    assert [r[2] for r in got] == [1, 1, 3]


@pytest.mark.parametrize("similar", [0.9, 0.75])
def test_band_recall_is_the_documented_one(similar):
    miss = (1 - similar**minhash.ROWS) ** minhash.BANDS
    assert miss < 2.1e-5


@pytest.mark.parametrize(("common", "own", "pairs"), [(3, 1, 20000), (6, 2, 20000), (30, 10, 10000), (300, 100, 1500)])
def test_band_recall_measured_at_the_limit(common, own, pairs):
    """Pairs of sets at similarity 0.75 exactly: coordinates agree as often, and hardly a pair meets in no band."""
    rng = np.random.default_rng(common)
    count = minhash.BANDS * minhash.ROWS
    missed, agreed = 0, 0
    for _ in range(pairs):
        values = rng.integers(0, 1 << 63, common + own, dtype=np.uint64)
        mine = own // 2
        left = np.concatenate([values[:common], values[common : common + mine]])
        right = np.concatenate([values[:common], values[common + mine :]])
        a, b = minhash._coordinates(left, count), minhash._coordinates(right, count)
        same = (a == b).reshape(minhash.BANDS, minhash.ROWS)
        agreed += same.mean()
        missed += not same.all(axis=1).any()
    assert abs(agreed / pairs - 0.75) < 0.005
    assert missed <= max(1, pairs * 1e-4)
