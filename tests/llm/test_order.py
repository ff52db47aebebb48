import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftstone.llm import bpe, order


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 2**64 - 1))
def test_permutation_is_a_bijection_with_its_inverse(size, key):
    shuffle = order.Permutation(size, key)
    slots = shuffle.slots(np.arange(size))
    assert sorted(slots.tolist()) == list(range(size))
    assert shuffle.numbers(slots).tolist() == list(range(size))


def test_keys_differ_and_order_is_mixed():
    a, b = (order.Permutation(100_000, k).slots(np.arange(100_000)) for k in (1, 2))
    assert (a != b).mean() > 0.99
    assert abs(np.corrcoef(np.arange(100_000), a)[0, 1]) < 0.02


def brute(rows, length):
    tree = bpe.codec(*bpe.default_vocabulary())
    out = []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*tree._leaf.encode_ordinary(t or ""), order.END_OF_TEXT]
        out += [(d, j // length, ids[j : j + length]) for j in range(0, len(ids), length)]
    slots = order.Permutation(len(out)).slots(np.arange(len(out))) if out else []
    return {int(s): x for s, x in zip(slots, out)}


def check(docs, rows, length=64):
    got = order.ordered_sequences(docs, length=length).collect()
    want = brute(rows, length)
    assert len(got) == len(want)
    for r in got:
        assert (r.doc_id, r.part, np.frombuffer(r.token_ids, "<u2").tolist()) == want[r.slot]
    return want


def test_ranges_cut_by_number_give_the_same_shards(spark, monkeypatch):
    monkeypatch.setattr(order, "TASK_SHARDS", 1)
    rows = [(i, "word " * (i % 90)) for i in range(300)]
    sequences = order.ordered_sequences(spark.createDataFrame(rows, "doc_id long, text string"), length=16)
    count = -(-sequences.count() // 8)
    asked = sequences.where(f"slot >= {8 * 5}")
    plain = order.shards(asked, 16, 8).collect()
    cut = order.shards(asked, 16, 8, (5, count))
    assert cut.rdd.getNumPartitions() == count - 5
    assert sorted(map(str, cut.collect())) == sorted(map(str, plain)) and len(plain) == count - 5
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "MapInArrow" not in plan


def test_documents_against_brute_force_whatever_the_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 300")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(docs, rows)
    check(docs.repartition(5), rows)


def test_edge_cases(spark):
    rows = [(1, None), (1, ""), (2, "a b c"), (2, "a b c"), (None, "z"), (3, "word " * 5000)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert order.shards(order.ordered_sequences(empty)).collect() == []


def test_shards_are_written_at_a_fixed_stride_and_read_from_any_slot(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 100")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 64)
    built = order.shards(order.ordered_sequences(docs, length=64), length=64, rows=32).persist()
    uri = f"file://{tmp_path}/shards"
    for _ in range(2):  # a second run finds its files in place
        manifest = order.write_shards(built, uri).collect()
    assert sum(r.n_slots for r in manifest) == len(want)
    assert sorted(r.first_slot for r in manifest) == list(range(0, len(want), 32))
    for first, count in ((0, len(want)), (17, 50), (len(want) - 3, 10)):
        rows = order.read_slots(uri, first, count, 64, 32)
        assert len(rows) == min(count, len(want) - first)
        for slot, row in enumerate(rows.tolist(), first):
            ids = want[slot][2]
            assert row == ids + [order.END_OF_TEXT] * (64 - len(ids))
    assert len(list((tmp_path / "shards").iterdir())) == len(manifest)
    built.unpersist()
    (tmp_path / "shards" / "shard-00000001.bin").unlink()  # as if a run had been broken off
    again = order.write_order(order.ordered_sequences(docs, length=64), uri, 64, 32)
    assert sorted(map(tuple, again.drop("stride").collect())) == sorted(tuple(r) for r in [[r[c] for c in again.columns if c != "stride"] for r in manifest])
    assert len(list((tmp_path / "shards").iterdir())) == len(manifest)
    assert order.write_order(order.ordered_sequences(docs.limit(0)), uri).collect() == []


def test_rows_of_one_id_are_several_ranges(spark):
    rows = [(7, f"text {i:03d} of one id") for i in range(200)] + [(None, f"{i} without") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs, rows)
    placed = order.ordered_sequences(docs, length=64).select("number", "doc_id").collect()
    assert sorted(r.number for r in placed) == list(range(250))
    assert docs.repartitionByRange(8, "doc_id", docs.text.substr(1, 64)).rdd.glom().map(len).filter(lambda n: n > 0).count() > 3


def test_ids_beyond_16_bits_are_refused(spark, tmp_path):
    import base64

    for ranks in ({bytes([i]): i for i in range(256)} | {b"ab": 70_000}, {bytes([i]): i for i in range(256)} | {b"ab": order.END_OF_TEXT}):
        path = tmp_path / f"{max(ranks.values())}.tiktoken"
        path.write_text("".join(f"{base64.b64encode(p).decode()} {r}\n" for p, r in ranks.items()))
        with pytest.raises(Exception, match="must be free"):
            order.ordered_sequences(spark.createDataFrame([(1, "ab")], "doc_id long, text string"), vocabulary=(str(path), bpe.default_vocabulary()[1])).collect()


def test_the_query_writes_its_shards_and_reads_them_back(spark):
    from siftstone.llm import queries

    manifest = queries.op3_training_order(spark, "/root/testdata/sf0.001")
    rows = sorted(manifest.collect(), key=lambda r: r.shard)
    assert "data" not in manifest.columns and rows
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], order.SEQUENCE_TOKENS)
    assert [d for r in rows for d in r.doc_ids] == [want[s][0] for s in range(len(want))]
    assert [n for r in rows for n in r.n_tokens] == [len(want[s][2]) for s in range(len(want))]


def test_clashing_columns(spark):
    rows = [(1, "a b", 9, b"x"), (2, None, 9, b"y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int, token_ids binary")
    check(docs, [r[:2] for r in rows])


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5])
def test_tiny_permutations(size):
    assert sorted(order.Permutation(size).slots(np.arange(size)).tolist()) == list(range(size))
