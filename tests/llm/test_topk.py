import math

import numpy as np
from pyspark.sql import functions as F

from siftstone.llm import topk


def brute(rows, k=5, every=50):
    """rows: (vec_id, vector or None); query rows of one id are ranked together."""
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        asked = [v for i, v in good if i == q]
        scored = sorted((-sum(a * b for a, b in zip(x, v)), i) for x in asked for i, v in good if i != q and len(v) == len(x))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return out


def run(spark, rows, k=5, **more):
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    return sorted(map(tuple, topk.top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors, k, **more).collect()))


def test_against_brute_force_on_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [tuple(r) for r in df.select("vec_id", "embedding").collect()]
    vectors = topk.quantised(df)
    got = sorted(map(tuple, topk.top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors).collect()))
    assert got == brute(rows)


def test_ties_nulls_and_other_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.5, -0.25], 0) for i in range(0, 120)]
    rows += [(200, None, 0), (250, [1.0, None, 2.0], 0), (300, [nan, 1.0, 1.0], 0), (350, [inf, 1.0, 1.0], 0), (400, [1.0, 2.0], 0), (401, [3.0, 2.0], 0)]
    assert run(spark, rows) == brute([r[:2] for r in rows])


def test_repeated_rows_few_candidates_and_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(50, [1.0], 0)]) == []
    rows = [(50, [1.0], 0), (50, [1.0], 0), (7, [2.0], 0), (7, [2.0], 0), (8, [2.0], 0), (None, [9.0], 0)]
    assert run(spark, rows) == brute([r[:2] for r in rows]) == [(50, r, i, 256 * 512) for r, i in enumerate([7, 7, 7, 7, 8], 1)]
    rows = [(50, [1.0], 0), (7, [2.0], 0), (7, [3.0], 0), (7, [2.0], 0), (8, [1.0], 0)]
    assert [r[2:] for r in run(spark, rows)] == [(7, 196608), (7, 131072), (7, 131072), (8, 65536)]


def test_repeated_ids_against_the_sql(spark, tmp_path):
    import duckdb

    from siftstone.llm import oracles

    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.integers(-4, 5, 3) / 8], 0) for i in rng.integers(0, 120, 400)]
    rows += [(7, [0.5, 0.5, 0.5], 0)] * 200
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings"))
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{tmp_path}/embeddings/*.parquet'")
    assert run(spark, rows, group_values=300, block_rows=16) == sorted(db.execute(oracles.TOP_K).fetchall())


def clustered(seed=3, count=12):
    """Runs of neighbouring ids lie around one centre each, as documents of one source do."""
    rng = np.random.default_rng(seed)
    return [(c * 300 + i, [float(x) for x in row / 256], 0) for c in range(count) for i, row in enumerate(rng.integers(-50, 50, (300, 8)) + 400 * rng.integers(-1, 2, 8))]


def test_pruned_search_is_exact_and_skips_blocks(spark):
    rows = clustered()
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    queries = vectors.where(F.col("vec_id") % 50 == 0)
    for group_values in (1 << 24, 8 * 500):
        got = sorted(map(tuple, topk.top_k(queries, vectors, 7, group_values, 64).collect()))
        assert got == brute([r[:2] for r in rows], 7)
        seen = topk.block_visits(queries, vectors, 7, group_values, 64).first()
        every = queries.count() * -(-len(rows) // 64)
        assert seen.scored < 0.5 * every
        if group_values < 1 << 24:  # whole groups are left out before their forward indexes are sent
            assert seen.sent_to < 0.7 * every


def test_extra_columns_with_clashing_names(spark):
    rows = [(i, [float(i % 7), 1.0], i, i, b"x") for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, `group` int, score int, data binary")
    vectors = topk.quantised(df)
    got = sorted(map(tuple, topk.top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors).collect()))
    assert got == brute([r[:2] for r in rows])


def test_large_components_stay_whole():
    rows = np.array([[1 << 31, 1], [1 << 31, 3], [-(1 << 31), 5]], np.int64)
    block = (np.arange(3), rows, rows.max(0), rows.min(0))
    _, ids, scores, _ = topk.search_blocks(np.array([0]), rows[:1], [block], 2)
    assert ids.tolist() == [1, 2] and scores.tolist() == [(1 << 62) + 3, -(1 << 62) + 5]


def test_components_beyond_64_bits_are_the_nearest_that_fit(spark):
    rows = [(50, [3e38], 0), (1, [3e38], 0), (2, [-3e38], 0), (3, [1.0], 0)]
    got = run(spark, rows)
    assert [r[2] for r in got] == [1, 3, 2] and got[0][3] == (1 << 63) - 2 and got[2][3] == -(1 << 63) + 2
