import hashlib
import random
import re

from siftstone.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=50):
    docs = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, words in docs:
        if d is not None:
            for i in range(len(words) - window + 1):
                key = tuple(words[i : i + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, words in docs:
        gone = set()
        if d is not None:
            for i in range(len(words) - window + 1):
                if first[tuple(words[i : i + window])] < d:
                    gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, substrings.repeated_words(df, **more).collect()), key=str)


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, substrings.repeated_words(docs).collect()), key=str) == brute(rows)


def test_random_overlaps_against_brute_force(spark):
    rng = random.Random(11)
    pool = [f"w{i}" for i in range(40)]
    long = [rng.choice(pool) for _ in range(600)]
    rows = []
    for d in rng.sample(range(1000), 80):
        words = []
        for _ in range(rng.randrange(1, 5)):
            if rng.random() < 0.6:
                at = rng.randrange(500)
                words += long[at : at + rng.randrange(5, 90)]
            else:
                words += [rng.choice(pool) for _ in range(rng.randrange(1, 40))]
        rows.append((d, " ".join(words)))
    for batches in (1, 5):
        assert run(spark, rows, batches=batches) == brute(rows)
    assert run(spark, rows, window=10) == brute(rows, 10)


def test_edge_cases_against_brute_force(spark):
    text = " ".join(map(str, range(80)))
    same = " ".join(["x"] * 200)
    rows = [(5, text), (5, text), (3, None), (4, ""), (9, "a " + text.replace(" ", "\n")), (None, text), (2, " \t"), (7, same), (8, same + " y"), (6, text + " z")]
    rows += [(9, "other words " * 40), (12, same + " z"), (12, text + " " + text)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_very_long_text(spark):
    long = " ".join(str(i * i % 99991) for i in range(200_000))
    got = run(spark, [(1, long), (2, "head " + long)])
    assert [r[1:3] for r in got] == [(200_000, 0), (200_001, 200_000)]


def texts(seed, count, first=0):
    rng = random.Random(seed)
    long = [random.Random(99).choice([f"w{i}" for i in range(60)]) for _ in range(900)]
    out = []
    for d in range(first, first + count):
        at = rng.randrange(800)
        out.append((d, " ".join([f"{d}x", *long[at : at + rng.randrange(20, 200)], "end", *long[:rng.randrange(70)]])))
    return out


def test_batches_ingested_in_several_sessions_equal_one_run(spark, tmp_path):
    rows = texts(1, 90)
    path, got = str(tmp_path / "index"), []
    for first in range(0, 90, 15):
        session = spark.newSession()  # knows nothing of tables that others have made
        index = substrings.FingerprintIndex(session, path, buckets=4)
        batch = session.createDataFrame(rows[first : first + 15], "doc_id long, text string")
        got += map(tuple, index.ingest(batch).collect())
    assert sorted(got, key=str) == brute(rows) == run(spark, rows)
    index = substrings.FingerprintIndex(spark, path)
    assert index.last_id == 89 and index.buckets == 4 and len(index.texts) == 6
    assert sorted(t for _, t in index.runs) == [0, 0, 2]  # compacted before a batch is joined
    index.fan_in = 2
    while index.compact():
        pass
    assert len(index.runs) == 2 and {p.name for p in (tmp_path / "index").iterdir() if p.name.startswith("run")} == {f for f, _ in index.runs}
    keys = [index._table(f).select("context").count() for f, _ in index.runs]
    assert sum(keys) == index._table(index.runs[0][0]).union(index._table(index.runs[1][0])).select("context").distinct().count()


def test_ids_must_rise_and_a_broken_ingest_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    import pytest

    rows = texts(2, 30)
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    index = substrings.FingerprintIndex(spark, str(tmp_path / "index"), buckets=4)
    first = sorted(map(tuple, index.ingest(frame(rows[:20])).collect()), key=str)
    with pytest.raises(ValueError):
        index.ingest(frame(rows[10:]))
    with monkeypatch.context() as broken:
        broken.setattr(substrings, "_cut", lambda window: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.ingest(frame(rows[20:]))
    again = substrings.FingerprintIndex(spark, str(tmp_path / "index"))
    assert len(again.runs) == 1 and again.last_id == 19
    assert sorted(first + [tuple(r) for r in again.ingest(frame(rows[20:])).collect()], key=str) == brute(rows)


def test_the_query_compacts_and_joins_runs_without_shuffling_them(spark, monkeypatch):
    merged, plans = [], []
    compact, met = substrings.FingerprintIndex.compact, substrings.materialise
    monkeypatch.setattr(substrings.FingerprintIndex, "compact", lambda self: merged.append(compact(self)) or merged[-1])

    def seen(df, name):
        if name == "met":
            plans.append(df._jdf.queryExecution().sparkPlan().toString() and df._jdf.queryExecution().executedPlan().toString())
        return met(df, name)

    monkeypatch.setattr(substrings, "materialise", seen)
    rows = texts(3, 40)
    assert run(spark, rows) == brute(rows)
    assert any(merged)
    for plan in plans:
        assert "Bucketed: true" in plan or "SelectedBucketsCount" in plan
        scan = next(line for line in plan.splitlines() if "FileScan parquet" in line and "fingerprint" in line)
        assert scan


def test_clashing_columns_and_another_window(spark):
    rows = [(d, t, d, "x", [1]) for d, t in texts(4, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own int, fingerprint string, entries array<int>")
    got = sorted(map(tuple, substrings.repeated_words(docs).collect()), key=str)
    assert got == brute([r[:2] for r in rows])
    assert run(spark, [r[:2] for r in rows], window=1, batches=2) == brute([r[:2] for r in rows], 1)
