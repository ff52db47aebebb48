import re

import pytest

import corpus_pipeline
from siftstone.llm import bpe, decontaminate, secrets

from .test_decontaminate import brute as leaks
from .test_minhash import brute as groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), name)
        out.append((name, docs))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay(stages):
    for name, df in stages[:-1]:
        assert df.columns == stages[0][1].columns, name


def test_each_stage_does_its_work_on_what_the_one_before_kept(spark, stages):
    tables = [rows(df) for _, df in stages]
    assert set(tables[1]) == {d for d, r in tables[0].items() if any(map(str.isalpha, r.text or ""))}
    assert set(tables[2]) == {d for d, _, _, kept in groups([(d, r.text) for d, r in tables[1].items()]) if kept}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {d for d, _ in leaks([(d, r.text) for d, r in tables[2].items()], items)}
    assert set(tables[3]) == set(tables[2]) - gone
    assert set(tables[4]) == set(tables[3])
    for d, r in tables[4].items():
        assert r.n_chars == len(r.text) or r.text == tables[3][d].text
        if not secrets.base_spans(tables[3][d].text):
            assert r.text == tables[3][d].text
    codec = bpe.codec(*bpe.default_vocabulary())
    assert set(tables[5]) == set(tables[4])
    for d, r in tables[5].items():
        assert r.n_tokens * 4 == len(r.token_ids)
        import numpy as np

        assert codec.decode(np.frombuffer(r.token_ids, "<u4")).decode() == tables[4][d].text


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, stages[-1][1].collect()))


def test_nulls_long_texts_repeated_rows_and_extra_columns(spark, tmp_path):
    plain = "the house by the river stood empty for a long time and nobody asked why "
    rows = [(1, None, "en", "a", None, 1), (2, "", None, None, 0, 2), (3, plain, "en", "a", len(plain), 3), (3, plain, "en", "a", len(plain), 3), (4, plain, None, "b", len(plain), 4)]
    rows += [(5, "word " * 200_000, "en", "a", 1_000_000, 5), (None, "without an id but with words of its own", "en", "c", 39, 6), (6, "token=Zk81Mq0pLx27Vt only here", "en", "a", 31, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.node` int")
    (tmp_path / "t").mkdir()
    docs.write.parquet(str(tmp_path / "t/documents.parquet"))
    spark.createDataFrame([(1, "a passage of the benchmark that no document of this table holds at all"), (2, None)], "item_id long, text string").write.parquet(
        str(tmp_path / "t/benchmark.parquet")
    )
    got = corpus_pipeline.run(spark, str(tmp_path / "t")).collect()
    assert sorted(((r.doc_id, r.source) for r in got), key=str) == sorted([(3, "a"), (3, "a"), (5, "a"), (None, "c"), (6, "a")], key=str)
    codec = bpe.codec(*bpe.default_vocabulary())
    import numpy as np

    texts = {r.doc_id: codec.decode(np.frombuffer(r.token_ids, "<u4")).decode() for r in got}
    assert texts[6] == "[secret] only here" and texts[5] == "word " * 200_000


def test_an_empty_table(spark, tmp_path):
    (tmp_path / "t").mkdir()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "t/documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "t/benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "t")).collect() == []


def test_names():
    assert len(corpus_pipeline.STAGES) == 5 and all(re.fullmatch(r"\w+", n) for n, _ in corpus_pipeline.STAGES)
    assert decontaminate.EDITS == 25
