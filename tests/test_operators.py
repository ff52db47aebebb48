import json
import os
import re
import shutil
import subprocess
import sys
import tracemalloc
import urllib.parse
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftstone.functions import columns, htmlscan, sqlscan
from siftstone.functions.lexicon import collected, load
from siftstone.operators import compare, report, verdict
from siftstone.plans import golden, queries
from siftstone.sources import payloads, sinks
from siftstone.streaming import detection

ROOT = Path(__file__).resolve().parent.parent


def golden_payloads(spark):
    rows = [(i, bytearray(golden.data(p))) for i, p, *_ in golden.SQLI] + [("null", None), ("nothing", bytearray())]
    return spark.createDataFrame(rows, "id string, payload binary")


# ---------------------------------------------------------------- columns


def test_null_and_empty_payloads(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray())], "id int, payload binary")
    df = df.select("id", columns.detect_sqli("payload").alias("s"), columns.detect_xss("payload").alias("x"), columns.sqli_tokens("payload").alias("t"))
    rows = {r.id: r for r in df.collect()}
    assert rows[1].s is None and rows[1].x is None and rows[1].t is None
    assert rows[2].s.is_injection is False and rows[2].s.fingerprint == "" and rows[2].x.is_injection is False and rows[2].t == []


def test_one_call_agrees_with_the_scanner(spark):
    df = golden_payloads(spark).where("payload is not null")
    df = df.select("payload", columns.detect_sqli("payload").alias("s"), columns.sqli_check("payload", 9).alias("c"), columns.sqli_fold("payload", 9).alias("f"))
    for r in df.collect():
        data = bytes(r.payload)
        assert (r.s.is_injection, r.s.fingerprint, r.s.flags) == sqlscan.detect(data)
        assert r.s.confidence == float(r.s.is_injection) and r.s.injection_type == "SQL Injection"
        hit, fold = sqlscan.check(data, 9)
        assert (r.c.is_injection, r.c.fingerprint, r.c.stats.tokens) == (hit, fold.fingerprint, fold.pulled)
        assert [t.type for t in r.f] == [t.type for t in fold.tokens]


def test_contexts_of_xss(spark):
    rows = [(i, bytearray(golden.data(p))) for i, p, _ in golden.XSS]
    df = spark.createDataFrame(rows, "id string, payload binary").withColumn("context", F.explode(F.sequence(F.lit(0), F.lit(4))))
    for r in df.select("payload", "context", columns.xss_check("payload", F.col("context")).alias("hit")).collect():
        assert r.hit == (htmlscan.first_hit(bytes(r.payload), r.context) is not None)


def test_one_call_is_evaluated_once(spark):
    df = golden_payloads(spark).select(columns.detect_sqli("payload").alias("r")).select("r.is_injection", "r.fingerprint")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_registered_functions(spark):
    columns.register(spark)
    row = spark.sql("select detect_sqli(cast('1'' OR ''1''=''1' as binary), 0).fingerprint as f, xss_check(cast('<script>' as binary), 0) as x, siftstone_version() as v").first()
    assert tuple(row) == ("s&sos", True, "0.1.1")
    rows = spark.sql("select inline(html5_tokens(cast('<a>b' as binary), 0))").collect()
    assert [r.type for r in rows] == ["TAG_NAME_OPEN", "TAG_NAME_CLOSE", "DATA_TEXT"]


def test_filters_reach_the_scan_and_columns_are_pruned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    df = docs.select("doc_id", columns.detect_sqli("text").alias("r")).where("doc_id < 5").select("doc_id", "r.is_injection")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(doc_id,5)" in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_prefilters_are_sound(spark):
    rows = [(bytearray(golden.data(p)), "s") for _, p, *_ in golden.SQLI] + [(bytearray(golden.data(p)), "x") for _, p, _ in golden.XSS]
    df = spark.createDataFrame(rows + [(bytearray(b"word"), "s")], "payload binary, kind string")
    df = df.select(
        columns.may_be_sqli(F.col("payload")).alias("ms"), columns.may_be_xss(F.col("payload")).alias("mx"),
        columns.detect_sqli("payload")["is_injection"].alias("s"), columns.detect_xss("payload")["is_injection"].alias("x"),
    )
    assert all((r.ms or not r.s) and (r.mx or not r.x) for r in df.collect())


# ---------------------------------------------------------------- relations


def test_relational_form_agrees(spark):
    df = golden_payloads(spark)
    want = {r.id: r.s for r in df.select("id", columns.detect_sqli("payload").alias("s")).collect()}
    for r in verdict.relational_sqli(df, "id").collect():
        expected = want[r.id]
        assert r.is_injection == bool(expected and expected.is_injection), r
        assert r.fingerprint == (expected.fingerprint if expected else "")


def test_relational_form_with_a_dictionary(spark, tmp_path):
    path = tmp_path / "words.tsv"
    words = [f"{w}\t{t}" for w, t in load().rows()]
    path.write_text("\n".join([*words, "S&SOS\tF", "SC\tF", "1C\tF", "1&1\tF"]))
    df = golden_payloads(spark)
    want = {r.id: r.s for r in df.select("id", columns.detect_sqli("payload", 0, str(path)).alias("s")).collect() if r.s}
    got = {r.id: r for r in verdict.relational_sqli(df, "id", dictionary=str(path)).collect()}
    assert want["or_true"].is_injection and not want["union"].is_injection
    assert all(got[i].is_injection == r.is_injection and got[i].fingerprint == r.fingerprint for i, r in want.items())


def test_whitelist_case_agrees_with_the_scanner(spark):
    texts = [b"1 -- ", b"1--", b"8--", b"x/*", b"x--", b"1 union", b"1/**/union", b"'a' + 'b'", b"a and 1", b"1 into outfile", b"1 INTO OUTFILE 'x'", b"foo' -- sp_password", b"\xff' --", b"1 \xa0--x", b"'#"]
    rows = [(i, bytearray(t), f) for i, t in enumerate(texts) for f in (9, 10, 17)]
    df = spark.createDataFrame(rows, "i int, payload binary, flags int").withColumn("c", columns.sqli_check("payload", F.col("flags")))
    df = df.withColumn("stands", verdict.whitelist(F.col("c.fingerprint"), F.col("c.tokens"), F.col("c.stats.tokens"), F.col("payload")))
    for r in df.collect():
        assert r.stands == sqlscan.not_whitelisted(sqlscan.Fold(bytes(r.payload), r.flags)), r


def test_small_predicates(spark):
    row = spark.range(1).select(
        verdict.quote_context(F.lit(6)), verdict.quote_context(F.lit(12)), verdict.quote_context(F.lit(9)), verdict.default_flags(F.lit(0)),
        verdict.dictionary_key(F.lit("s&1")),
        verdict.fingerprint_of(F.array(F.struct(F.lit("1").alias("type")), F.struct(F.lit("X").alias("type")))),
        verdict.reparse(F.struct(F.lit(0).alias("comment_ddx"), F.lit(2).alias("comment_hash"))),
    ).first()
    assert tuple(row) == ("'", '"', "", 9, "0S&1", "X", True)


def test_scan_once_keeps_every_row(spark):
    df = spark.createDataFrame([(1, bytearray(b"x")), (2, bytearray(b"x")), (3, None)], "id int, payload binary")
    got = {r.id: r.result for r in verdict.scan_once(df, lambda p: columns.sqli_fingerprint(p)).collect()}
    assert got == {1: "n", 2: "n", 3: None}


def test_compare(spark):
    schema = "input string, is_injection boolean, fingerprint string"
    a = spark.createDataFrame([("p", True, "s"), ("q", False, "n"), ("r", True, "s"), ("only", True, "x")], schema)
    b = spark.createDataFrame([("p", True, "s"), ("q", True, "n"), ("r", True, "t")], schema)
    got = {r.input: (r.match_result, r.match_fingerprint, r.differs) for r in compare.compare(a, b).collect()}
    assert got == {"p": (True, True, False), "q": (False, None, True), "r": (True, False, True)}


def test_array_diff(spark):
    df = spark.createDataFrame([(["a", "b"], ["a"]), (None, ["x"]), ([], None)], "l array<string>, r array<string>")
    got = [[tuple(x) for x in r["diff"]] for r in compare.array_diff(df, "l", "r").collect()]
    assert got == [[(0, "a", "a", True), (1, "b", "MISSING", False)], [(0, "MISSING", "x", False)], []]


def test_report_on_an_empty_table_and_null_matches(spark):
    schema = "category string, file string, test int, match boolean"
    assert report.category_report(spark.createDataFrame([], schema)).collect() == []
    rows = report.category_report(spark.createDataFrame([("a", "f", 1, None), ("a", "f", 2, True)], schema)).collect()
    assert {(r.level, r.tests, r.matches, r.rate, r.grade) for r in rows} == {(level, 2, 1, 50.0, "poor") for level in ("file", "category", "total")}


# ---------------------------------------------------------------- sources and sinks


def test_rows_of_one_row_group_are_dealt(spark, tmp_path, monkeypatch):
    """A file in more pieces than there are cores, with all rows in one of them."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.range(0, 8000, 1, 1).write.parquet(str(tmp_path / "rows"))
    size = max(f.stat().st_size for f in (tmp_path / "rows").glob("*.parquet"))
    parts = lambda df: sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // 16))
        rows = spark.read.parquet(str(tmp_path / "rows"))
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and parts(rows) == [8000]
        dealt = payloads.spread(rows)
        assert sum(parts(dealt)) == 8000 and max(parts(dealt)) <= 2000 and dealt.distinct().count() == 8000
        assert payloads.spread(spark.range(0, 8000, 1, 16)).rdd.getNumPartitions() == 16
        monkeypatch.setattr(payloads, "TASK_ROWS", 100)  # beyond that, tasks grow in number and not in size
        assert len(parts(payloads.spread(rows))) == 80
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert payloads.spread(spark.range(0)).collect() == []


def test_html_names_are_counted_without_rows_of_tokens(spark):
    pages = ["<P a=1>x<p A=2 b></p><!-- <q> -->", None, "", "<a href=x><a/b>", "no tag", "<\u00c4\u00e9 x><b\u00c9>"]
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    for kind in ("TAG_NAME_OPEN", "ATTR_NAME"):
        each = df.select(F.explode(columns.html5_tokens("html")).alias("t")).where(F.col("t.type") == kind)
        want = each.groupBy(F.lower(F.col("t.val").cast("string")).alias("name")).count()
        got = sinks.html_names(df, kind, "html")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sinks.html_names(df.limit(0), "ATTR_NAME", "html").collect() == []


def test_distinct_html_names_are_held_in_bounded_number():
    """Pages in which each name is new: counts are passed on as the names come, not batch by batch."""
    pages = [b"<a " + b" ".join(b"n%d" % (i * 1000 + k) for k in range(1000)) + b" same>" for i in range(150)]
    out = list(sinks.count_names(iter([pa.record_batch([pa.array(pages, pa.binary())], names=["html"])]), "ATTR_NAME"))
    assert len(out) >= 3 and max(b.num_rows for b in out) < sinks._NAMES + 1001
    got: Counter = Counter()
    for batch in out:
        got.update(dict(zip(*batch.to_pydict().values())))
    assert got[b"same"] == 150 and len(got) == 150_001 and sum(got.values()) == 150_150


def _plan(spark, name: str) -> str:
    return queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_tag_counts_make_no_rows_of_tokens(spark):
    plan = _plan(spark, "xss_tag_counts")
    assert "MapInArrow" in plan and "Generate" not in plan and "ArrowEvalPython" not in plan


def test_attribute_counts_make_no_rows_of_tokens(spark):
    plan = _plan(spark, "xss_attr_counts")
    assert "MapInArrow" in plan and "Generate" not in plan and "ArrowEvalPython" not in plan


def test_bytes_are_counted_in_little_memory():
    data = np.arange(24 << 20, dtype=np.uint32).astype(np.uint8)[3:]
    tracemalloc.start()
    try:
        found = sinks.count_bytes(data)
        assert tracemalloc.get_traced_memory()[1] < len(data)
    finally:
        tracemalloc.stop()
    assert found.tolist() == np.bincount(data, minlength=256).tolist() and sinks.count_bytes(data[:0]).tolist() == [0] * 256


def test_tasks_grow_in_number_with_events(spark, monkeypatch):
    rows = spark.read.parquet(f"{SF}/events.parquet").count()
    monkeypatch.setattr(payloads, "TASK_ROWS", rows // 20)
    assert queries._events(spark, SF).rdd.getNumPartitions() >= 20


def test_relational_verdict_folds_each_pass_once(spark):
    """A second Python function would take time and workers of its own; the tokens are those of folding by itself."""
    plan = _plan(spark, "sqli_relational_verdict")
    assert plan.count("ArrowEvalPython [") == 1 and "sqli_fold" not in plan
    df = golden_payloads(spark).select("id", "payload", F.explode(columns.sqli_passes("payload")).alias("p"))
    rows = df.select("p.flags", "p.tokens", columns.sqli_fold("payload", F.col("p.flags")).alias("alone")).collect()
    assert len(rows) > 20 and all(r.tokens == r.alone for r in rows)


def test_compared_engines_are_dealt_to_more_tasks(spark, monkeypatch):
    rows = spark.read.parquet(f"{SF}/events.parquet").count()
    monkeypatch.setattr(payloads, "TASK_ROWS", rows // 20)
    plan = queries.QUERIES["engine_compare"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    found = re.findall(r"Repartition (\d+), true", plan)
    assert found and min(map(int, found)) >= 20


@pytest.mark.parametrize("name", ["engine_compare", "sqli_relational_verdict"])
def test_rows_of_events_are_not_broadcast(spark, name):
    plan = _plan(spark, name)
    joins = re.findall(r"(\w+Join) \[(\w+)#", plan)
    assert joins and all(kind == "SortMergeJoin" for kind, key in joins if key in ("input", "event_id"))


def test_tasks_grow_in_number_with_distinct_payloads(spark, monkeypatch):
    monkeypatch.setattr(payloads, "TASK_ROWS", 20)
    df = spark.range(0, 1200, 1, 4).select("id", F.concat(F.lit("x "), (F.col("id") % 300).cast("string")).alias("payload"))
    looked = verdict.scan_once(df, lambda p: columns.sqli_fingerprint(p))
    plan = looked._jdf.queryExecution().optimizedPlan().toString()
    assert int(re.search(r"RepartitionByExpression \[__key#\d+\], (\d+)", plan)[1]) >= 13
    assert looked.count() == 1200 and [tuple(r) for r in looked.select("result").distinct().collect()] == [("n1",)]


def test_line_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  one \n\n# note\n two%20x+y \n%zz\n")
    got = sorted(bytes(r.payload) for r in payloads.lines(spark, str(tmp_path / "a.txt")).collect())
    assert got == [b"# note", b"%zz", b"one", b"two%20x+y"]
    rows = payloads.batch(spark, str(tmp_path / "a.txt")).collect()
    assert sorted((r.line_no, bytes(r.payload)) for r in rows) == [(1, b"  one "), (4, b" two%20x+y "), (5, b"%zz")]  # rows come in no order
    rows = payloads.corpus(spark, str(tmp_path / "a.txt"), "sqli", True).collect()
    assert sorted((r.line_no, bytes(r.payload), r.expect_injection) for r in rows) == [(1, b"one", True), (4, b"two x+y", True), (5, b"%zz", True)]


def test_file_and_encoded_sources(spark, tmp_path):
    (tmp_path / "b.bin").write_bytes(b"\xff\x00")
    (tmp_path / "c.txt").write_bytes(b"x")
    assert [bytes(r.payload) for r in payloads.files(spark, str(tmp_path), "*.bin").collect()] == [b"\xff\x00"]
    assert bytes(payloads.single(spark, "é").first().payload) == "é".encode()
    row = spark.range(1).select(payloads.from_hex(F.lit("0x41 42")), payloads.from_hex(F.lit("zz")), payloads.from_base64(F.lit("QUI=")), payloads.from_base64(F.lit("?"))).first()
    assert [x and bytes(x) for x in row] == [b"AB", None, b"AB", None]


def test_golden_case_files(spark, tmp_path):
    (tmp_path / "test-tokens-001.txt").write_text("--TEST--\nname here\n--INPUT--\nSELECT 1\n  x\n--EXPECTED--\nE SELECT\n\n1 1 \n")
    read = lambda suite: payloads.golden_cases(spark, str(tmp_path), suite).first()
    row = read("tokens")
    assert (row["name"], bytes(row.input), row.expected) == ("name here", b"SELECT 1\n  x", ["E SELECT", "1 1"])
    assert bytes(read("folding").input) == b"SELECT 1"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, bytearray(b"SELECT 'a,\"b' @@`c`"))], "id int, payload binary").withColumn("tokens", columns.sqli_tokens("payload", 8))
    text = df.select(F.transform("tokens", sinks.token_text).alias("t")).first().t
    assert text == ["E SELECT", "s 'a,\"b'", "v @@`c`"]
    rows = sinks.token_rows(df)
    assert tuple(rows.columns) == sinks.TOKEN_COLUMNS
    sinks.write_csv(rows, str(tmp_path / "csv"))
    written = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert written.splitlines()[0] == ",".join(sinks.TOKEN_COLUMNS) and '"a,""b"' in written
    sinks.write_json(df.select("id"), str(tmp_path / "json"))
    assert json.loads(sinks.as_json(df.select("id")).first().json) == {"id": 1}
    info = sinks.input_info(spark.createDataFrame([(bytearray(b"\xffa"),)], "payload binary")).first()
    assert (info.text, info.hex, info.length) == ("�a", "ff61", 2)
    classes = {r.value: r["class"] for r in sinks.byte_rows(spark.createDataFrame([(1, bytearray(b" '1a\xe9\xa0"))], "id int, payload binary"), "id").collect()}
    assert classes == {32: "white", 39: "string", 49: "number", 97: "word", 0xE9: "word", 0xA0: "white"}
    assert df.select(F.size(sinks.first_tokens(F.col("tokens"), 2))).first()[0] == 2


def test_dedupe_and_filters(spark):
    df = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"a"),), (None,), (bytearray(),), (bytearray(b"\0b"),)], "payload binary")
    assert payloads.distinct_payloads(df).count() == 2
    assert payloads.short_and_clean(df, below=2).count() == 3


def test_line_numbers_hold_across_the_pieces_of_a_file(spark, tmp_path):
    lines = [f"payload {i} " + "x" * (i % 50) if i % 5 else "# note" if i % 2 else "" for i in range(4000)]
    (tmp_path / "long.txt").write_bytes("\r\n".join(lines).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = payloads.batch(spark, str(tmp_path / "long.txt"))
        assert rows.select(F.spark_partition_id()).distinct().count() > 1
        got = sorted((r.line_no, bytes(r.payload).decode()) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(i, line) for i, line in enumerate(lines, 1) if line and not line.startswith("#")]


# ---------------------------------------------------------------- queries without SQL, against plain calls


SF = "/root/testdata/sf0.001"


def test_documents_and_urls_against_the_relational_form(spark):
    import __spark_entry__ as entry

    found = entry.queries()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: (r.is_injection, r.fingerprint) for r in verdict.relational_sqli(docs, "doc_id", "text").collect()}
    assert {r.doc_id: (r.is_injection, r.fingerprint) for r in found["documents_sqli"](spark, SF).collect()} == want
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    query = lambda url: urllib.parse.unquote(url.partition("?")[2])
    want = {i: sqlscan.detect(query(url).encode())[:2] for i, url in urls.items()}
    assert {r.page_id: (r.is_injection, r.fingerprint) for r in found["pages_url_sqli"](spark, SF).collect()} == want


def test_token_types_against_all_tokens(spark):
    import __spark_entry__ as entry

    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    want = Counter(t.type for text in texts if text for t in sqlscan.Lexer(text.encode(), 0, load()))
    assert {r.type: r.n for r in entry.queries()["documents_token_types"](spark, SF).collect()} == want


def test_prefiltered_payloads_and_a_dictionary_of_pairs(spark):
    rows = [(1, None), (2, "plain"), (3, "<script>"), (4, "")]
    got = {r.i: r.x for r in spark.createDataFrame(rows, "i int, p string").select("i", columns.detect_xss("p").alias("x")).collect()}
    assert got[1] is None and [got[i].is_injection for i in (2, 3, 4)] == [False, True, False]
    assert got[2].injection_type == "XSS" and got[2].rule is None and got[3].rule == "tag"
    with pytest.raises(ValueError):
        collected(spark.createDataFrame([("a", "k"), ("b", "k")], "word string, type string"), most=1)
    long = "LONG" * 6 + "_WORD_OF_MANY_BYTES"
    lexicon = load(((long, "f"), ("SELECT", "E")))
    assert [(t.type, t.val) for t in sqlscan.Lexer(f"{long}.x".encode(), 8, lexicon)][0][0] == "f"


# ---------------------------------------------------------------- streams, package


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:1{i}:00", "1' OR '1'='1" if i % 2 else "hello") for h in range(5) for i in range(4)]
    df = spark.createDataFrame(rows, "ts string, payload string").select(F.to_timestamp("ts").alias("ts"), "payload")
    df.write.parquet(str(tmp_path / "in"))
    want = {tuple(r) for r in detection.window_counts(detection.detected(df)).collect()}
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    detection.start(detection.window_counts(detection.detected(stream)), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got and got <= want  # the last windows stay open until later events pass the watermark
    assert {r[0] for r in want - got} <= {r[0] for r in sorted(want)[-2:]}


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")], ids=["folders", "folders and pipeline"])
def test_the_library_stands_without_the_llm_folders(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    code = (
        "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 41 and not any(n.startswith('op') or n == 'pipeline' for n in q); "
        "assert set(e.oracle_sql()) <= set(q); import siftstone; assert siftstone.__path__[0].startswith({!r})"
    ).format(str(copy))
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env=clean, check=True, timeout=120)
    # and with another copy of everything later on the path
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env=clean | {"PYTHONPATH": str(ROOT)}, check=True, timeout=120)


def test_registry():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", ["SELECT", "union all", "||", "script"])
def test_lexicon_has(name):
    lexicon = load()
    assert lexicon.word(name.encode()) != "n" or name.upper().encode() in lexicon.tags
