"""Registered queries over the reference's operators, and the same in SQL.

The driver's tables hold no attacks, so attacks are templates dealt to the rows
of ``events`` by their id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions import columns
from siftstone.functions.lexicon import collected, load
from siftstone.operators import compare, report, verdict
from siftstone.plans import golden, rules
from siftstone.sources import payloads, sinks
from siftstone.sources.shared import scratch_path
from siftstone.streaming import detection


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    def lit(x) -> str:
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else _sql(x) if isinstance(x, str) else str(x)

    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({names})"


#: Template, whether it is an injection of SQL, and of scripts; {} is the row's id.
TEMPLATES = [
    ("{}' OR '1'='1", True, False),
    ("admin{}'--", True, False),
    ("{} UNION SELECT password FROM users", True, False),
    ("note {}", False, False),
    ("SELECT * FROM users", False, False),
    ("<script>alert({})</script>", False, True),
    ('<a href="javascript:x({})">', False, True),
    ("<p>row {}</p>", False, False),
]


def _filled(events: DataFrame) -> DataFrame:
    """event_id, ts, template (its number) and payload of ``events``, a table or a stream."""
    number = F.pmod("event_id", F.lit(len(TEMPLATES))).cast("int")
    text = F.lit(TEMPLATES[0][0])
    for i, (t, _, _) in enumerate(TEMPLATES):
        text = F.when(number == i, F.lit(t)).otherwise(text)
    filled = F.replace(text, F.lit("{}"), F.col("event_id").cast("string"))
    return events.select("event_id", "ts", "event_type", number.alias("template"), filled.cast("binary").alias("payload"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(payloads.spread(_table(spark, sf_dir, "events").select("event_id", "ts", "event_type")))


_EVENTS = f"""(SELECT event_id, ts, event_type, CAST(event_id % {len(TEMPLATES)} AS INTEGER) AS template,
  replace(CASE event_id % {len(TEMPLATES)} {' '.join(f'WHEN {i} THEN {_sql(t)}' for i, (t, _, _) in enumerate(TEMPLATES))} END,
  '{{}}', CAST(event_id AS VARCHAR)) AS payload FROM events)"""


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- scripts in pages


@query("SELECT page_id, regexp_matches(html, '(?i)<!doctype') AS is_injection FROM pages")
def xss_pages_verdict(spark, sf_dir):
    return payloads.spread(_table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", columns.detect_xss("html")["is_injection"].alias("is_injection"))


def _html_names(spark, sf_dir, kind: str) -> DataFrame:
    return sinks.html_names(payloads.spread(_table(spark, sf_dir, "pages").select("html")), kind, "html")


@query("""SELECT name, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(
  regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<([A-Za-z][^ \\t\\n\\x0b\\x0c\\r/>]*)', 1))) AS name FROM pages) GROUP BY name""")
def xss_tag_counts(spark, sf_dir):
    return _html_names(spark, sf_dir, "TAG_NAME_OPEN")


@query("""SELECT name, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(tag, '[\\s"]([A-Za-z][A-Za-z0-9-]*)=', 1))) AS name
  FROM (SELECT unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<[A-Za-z][^>]*>')) AS tag FROM pages)) GROUP BY name""")
def xss_attr_counts(spark, sf_dir):
    return _html_names(spark, sf_dir, "ATTR_NAME")


@query("""SELECT count(*) AS n, count(*) FILTER (regexp_matches(link, '^(?i)(data|view-source|vbscript|java)')) AS bad FROM
  (SELECT unnest(regexp_extract_all(html, '(?i)href="([^"]*)"', 1)) AS link FROM pages)""")
def xss_url_scheme(spark, sf_dir):
    links = _table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('(?i)href="([^"]*)"'), F.lit(1))).alias("link"))
    return links.agg(F.count("*").alias("n"), F.count_if(columns.bad_url("link")).alias("bad"))


@query(f"""SELECT template, count(*) AS n, count(*) FILTER (bad) AS bad FROM (SELECT template, bad FROM {_EVENTS} e JOIN
  {_values([(i, x) for i, (_, _, x) in enumerate(TEMPLATES)], 'i, bad')} ON e.template = v.i) GROUP BY template""")
def xss_templates_verdict(spark, sf_dir):
    found = _events(spark, sf_dir).select("template", columns.detect_xss("payload")["is_injection"].alias("hit"))
    return found.groupBy("template").agg(F.count("*").alias("n"), F.count_if("hit").alias("bad"))


@query("SELECT event_id, 'a' || chr(CAST(65 + event_id % 26 AS INTEGER)) || 'b' AS text FROM events")
def html_entity_decode(spark, sf_dir):
    code = (65 + F.pmod("event_id", F.lit(26))).cast("int")
    written = F.when(F.col("event_id") % 2 == 0, F.format_string("a&#%d;b", code)).otherwise(F.concat(F.lit("a&#x"), F.hex(code), F.lit(";b")))
    codes = _table(spark, sf_dir, "events").select("event_id", columns.html_decode(written).alias("codes"))
    return codes.select("event_id", F.array_join(F.transform("codes", lambda c: F.char(c)), "").alias("text"))


@query(f"SELECT id, is_injection FROM {_values([(i, x) for i, _, x in golden.XSS], 'id, is_injection')}")
def xss_golden(spark, sf_dir):
    rows = [(i, bytearray(golden.data(p))) for i, p, _ in golden.XSS]
    return spark.createDataFrame(rows, "id string, payload binary").select("id", columns.detect_xss("payload")["is_injection"].alias("is_injection"))


# ---------------------------------------------------------------- SQL in payloads


@query(f"SELECT id, flags, is_injection FROM {_values([(i, f, x) for i, _, f, _, x in golden.SQLI], 'id, flags, is_injection')}")
def sqli_golden(spark, sf_dir):
    rows = [(i, bytearray(golden.data(p)), f) for i, p, f, _, _ in golden.SQLI]
    df = spark.createDataFrame(rows, "id string, payload binary, flags int")
    return df.select("id", "flags", columns.detect_sqli("payload", F.col("flags"))["is_injection"].alias("is_injection"))


@query(f"SELECT id, fingerprint FROM {_values([(i, p) for i, _, _, p in golden.FOLDS], 'id, fingerprint')}")
def sqli_golden_folds(spark, sf_dir):
    rows = [(i, bytearray(golden.data(p)), f) for i, p, f, _ in golden.FOLDS]
    df = spark.createDataFrame(rows, "id string, payload binary, flags int")
    return df.select("id", columns.sqli_fingerprint("payload", F.col("flags")).alias("fingerprint"))


_SQLI_COUNTS = f"""SELECT template, count(*) AS n, count(*) FILTER (bad) AS bad FROM (SELECT template, bad FROM {_EVENTS} e JOIN
  {_values([(i, x) for i, (_, x, _) in enumerate(TEMPLATES)], 'i, bad')} ON e.template = v.i) GROUP BY template"""


@query(_SQLI_COUNTS)
def sqli_templates_verdict(spark, sf_dir):
    found = _events(spark, sf_dir).select("template", columns.detect_sqli("payload")["is_injection"].alias("hit"))
    return found.groupBy("template").agg(F.count("*").alias("n"), F.count_if("hit").alias("bad"))


@query(_SQLI_COUNTS)
def sqli_relational_verdict(spark, sf_dir):
    events = _events(spark, sf_dir)
    found = events.select("event_id", "template").hint("merge").join(verdict.relational_sqli(events, "event_id"), "event_id")
    return found.groupBy("template").agg(F.count("*").alias("n"), F.count_if("is_injection").alias("bad"))


@query(_SQLI_COUNTS)
def sqli_distinct_verdict(spark, sf_dir):
    found = verdict.scan_once(_events(spark, sf_dir), lambda p: columns.detect_sqli(p))
    return found.groupBy("template").agg(F.count("*").alias("n"), F.count_if("result.is_injection").alias("bad"))


_CLASS_CASE = " ".join(f"WHEN h IN ({', '.join(f'{b:02X}'.join(chr(39) * 2) for b in members)}) THEN '{name}'" for name, members in sinks._CLASSES.items())


@query(f"""SELECT class, count(*) AS n FROM (SELECT CASE {_CLASS_CASE} ELSE 'word' END AS class FROM
  (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents)) GROUP BY class""")
def sqli_char_class(spark, sf_dir):
    counted = sinks.byte_counts(_table(spark, sf_dir, "documents").select("text"), "text")  # where they lie: counting costs less than moving
    return counted.groupBy(sinks.byte_class(F.col("byte")).alias("class")).agg(F.sum("n").alias("n"))


def _keyword_rows() -> list[tuple[str, str]]:
    return [r for r in load().rows() if r[0].isalpha()]


@query(f"""SELECT type, count(*) AS n, count(DISTINCT w) AS words FROM
  (SELECT w, coalesce(v.type, 'n') AS type FROM (SELECT upper(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM documents)
  LEFT JOIN {_values(_keyword_rows(), 'word, type')} ON w = v.word) GROUP BY type""")
def sqli_word_types(spark, sf_dir):
    words = _table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("w"))
    counted = words.groupBy(F.upper("w").alias("word")).agg(F.count("*").alias("n"))
    known = verdict.word_table(spark)
    typed = counted.join(verdict.bounded(known, len(_keyword_rows())), "word", "left").withColumn("type", F.coalesce("type", F.lit("n")))
    return typed.groupBy("type").agg(F.sum("n").alias("n"), F.count("*").alias("words"))


#: Fingerprints dealt to events, with those of them that the dictionary lists.
_PRINTS = ["s&sos", "1UEnk", "Eokn", "nk", "1c", "s&1", "nc", "1&1", "sos", "", "1U", "nkn"]
_LISTED = ["s&sos", "1UEnk", "1c", "s&1", "nc", "1&1", "sos", "1U", "nkn"]


def _prints(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "events").select(
        "event_id", F.element_at(F.array(*map(F.lit, _PRINTS)), (F.pmod("event_id", F.lit(len(_PRINTS))) + 1).cast("int")).alias("fingerprint")
    )


def _listed(spark) -> DataFrame:
    """All fingerprints of the dictionary."""
    return spark.createDataFrame([(p,) for p in sorted(load().fingerprints)], "fingerprint string")


_PRINTS_SQL = f"(SELECT event_id, CASE event_id % {len(_PRINTS)} {' '.join(f'WHEN {i} THEN {_sql(p)}' for i, p in enumerate(_PRINTS))} END AS fingerprint FROM events)"
_LISTED_SQL = f"({', '.join(_sql('0' + p.upper()) for p in _LISTED)})"


@query(f"SELECT event_id, fingerprint FROM {_PRINTS_SQL} WHERE '0' || upper(fingerprint) IN {_LISTED_SQL}")
def sqli_blacklist_semi(spark, sf_dir):
    return verdict.blacklisted(_prints(spark, sf_dir), _listed(spark))


@query(f"SELECT event_id, fingerprint FROM {_PRINTS_SQL} WHERE '0' || upper(fingerprint) NOT IN {_LISTED_SQL}")
def sqli_blacklist_anti(spark, sf_dir):
    return verdict.not_blacklisted(_prints(spark, sf_dir), _listed(spark))


@query(f"""SELECT event_id, CASE WHEN length(fingerprint) = 2 AND fingerprint[2] = 'U' THEN pulled <> 2 WHEN fingerprint = 'nc' THEN false
  WHEN fingerprint = '1c' THEN pulled > 2 WHEN fingerprint = 'sos' THEN false WHEN fingerprint IN ('s&n','n&1','1&1','1&v','1&s') AND pulled = 3 THEN false
  WHEN fingerprint = 'nkn' THEN false ELSE true END AS stands FROM (SELECT *, 2 + event_id % 3 AS pulled FROM {_PRINTS_SQL})""")
def sqli_whitelist_case(spark, sf_dir):
    rows = _prints(spark, sf_dir).withColumn("pulled", (2 + F.pmod("event_id", F.lit(3))).cast("int"))
    value = lambda t: F.when(t == "c", F.lit("--")).otherwise(F.lit("x")).cast("binary")
    token = lambda t: F.struct(
        t.alias("type"), F.lit(0).alias("pos"), F.octet_length(value(t)).alias("len"), value(t).alias("val"), F.lit("'").alias("str_open"), F.lit("'").alias("str_close")
    )
    tokens = F.transform(F.filter(F.split("fingerprint", ""), lambda t: t != ""), token)
    stands = verdict.whitelist(F.col("fingerprint"), tokens, F.col("pulled"), F.lit("abc").cast("binary"))
    return rows.select("event_id", stands.alias("stands"))


@query(f"""SELECT step, flags, count(*) AS n FROM {_EVENTS} JOIN {_values([(1, 9, None), (2, 17, None), (3, 10, "'"), (4, 18, "'"), (5, 20, '"')], 'step, flags, quote')}
  ON length(payload) > 0 AND (quote IS NULL OR contains(payload, quote)) GROUP BY step, flags""")
def sqli_context_gate(spark, sf_dir):
    return verdict.eligible_passes(_events(spark, sf_dir)).groupBy("step", "flags").agg(F.count("*").alias("n"))


@query()
def pages_url_sqli(spark, sf_dir):
    part = F.coalesce(F.regexp_extract("url", r"\?(.*)$", 1), F.lit(""))
    return _table(spark, sf_dir, "pages").select("page_id", columns.detect_sqli(payloads.url_decoded(part)).alias("r")).select(
        "page_id", "r.is_injection", "r.fingerprint"
    )


@query()
def documents_sqli(spark, sf_dir):
    docs = payloads.spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", columns.detect_sqli("text").alias("r")).select("doc_id", "r.is_injection", "r.fingerprint")


@query()
def documents_token_types(spark, sf_dir):
    types = F.explode(F.regexp_extract_all(columns.sqli_token_types("text"), F.lit("(?s)(.)"), F.lit(1))).alias("type")
    return payloads.spread(_table(spark, sf_dir, "documents").select("text")).select(types).groupBy("type").agg(F.count("*").alias("n"))


# Statements with their raw tokens as text, and markup with its tokens.
_TOKEN_TEXTS = [
    ("SELECT x'1234';", ["E SELECT", "1 x'1234'", "; ;"]),
    ("SELECT テスト;", ["E SELECT", "n テスト", "; ;"]),
    ("@ @@ @version @@version", ["v @", "v @@", "v @version", "v @@version"]),
    ("'it''s' 1e5", ["s 'it''s'", "1 1e5"]),
    ("a <=> b -- c", ["n a", "o <=>", "n b", "c -- c"]),
]
_HTML_TEXTS = [
    ("foo", ["DATA_TEXT,3,foo"]),
    ("<a href='x'>t</a>", ["TAG_NAME_OPEN,1,a", "ATTR_NAME,4,href", "ATTR_VALUE,1,x", "TAG_NAME_CLOSE,1,>", "DATA_TEXT,1,t", "TAG_CLOSE,1,a"]),
    ("<br/><!--c-->", ["TAG_NAME_OPEN,2,br", "TAG_NAME_SELFCLOSE,2,/>", "TAG_COMMENT,1,c"]),
]


def _expected(texts) -> str:
    return _values([(t, " ~ ".join(tokens)) for t, tokens in texts], "payload, tokens")


@query(f"SELECT payload, tokens FROM {_expected(_TOKEN_TEXTS)}")
def sqli_golden_tokens(spark, sf_dir):
    df = spark.createDataFrame([(t,) for t, _ in _TOKEN_TEXTS], "payload string")
    return df.select("payload", F.array_join(F.transform(columns.sqli_tokens("payload", 8), sinks.token_text), " ~ ").alias("tokens"))


@query(f"SELECT payload, tokens FROM {_expected(_HTML_TEXTS)}")
def html5_golden_tokens(spark, sf_dir):
    df = spark.createDataFrame([(t,) for t, _ in _HTML_TEXTS], "payload string")
    line = lambda t: F.concat_ws(",", t["type"], t["len"].cast("string"), sinks.printable(t["val"]))
    return df.select("payload", F.array_join(F.transform(columns.html5_tokens("payload"), line), " ~ ").alias("tokens"))


@query("""SELECT event_id, flags, CASE WHEN flags & 2 <> 0 THEN '''' WHEN flags & 4 <> 0 THEN '"' ELSE '' END AS quote,
  CASE WHEN flags = 0 THEN 9 ELSE flags END AS used FROM (SELECT event_id, CAST(event_id % 32 AS INTEGER) AS flags FROM events)""")
def sqli_flags(spark, sf_dir):
    flags = F.pmod("event_id", F.lit(32)).cast("int")
    rows = _table(spark, sf_dir, "events").select("event_id", flags.alias("flags"))
    return rows.withColumns({"quote": verdict.quote_context(F.col("flags")), "used": verdict.default_flags(F.col("flags")).cast("int")})


@query(f"SELECT template, count(*) AS n, count(*) FILTER (regexp_matches(payload, '--[^\\s]')) AS hinted FROM {_EVENTS} GROUP BY template")
def sqli_reparse_hints(spark, sf_dir):
    checked = _events(spark, sf_dir).select("template", columns.sqli_check("payload", 9)["stats"].alias("stats"))
    return checked.groupBy("template").agg(F.count("*").alias("n"), F.count_if(verdict.reparse(F.col("stats"))).alias("hinted"))


@query(f"SELECT template, count(*) AS n, count(*) FILTER (contains(payload, '<script') OR contains(payload, 'href=')) AS bad FROM {_EVENTS} GROUP BY template")
def xss_data_context(spark, sf_dir):
    rows = _events(spark, sf_dir).select("template", columns.xss_check("payload", 0).alias("hit"))
    return rows.groupBy("template").agg(F.count("*").alias("n"), F.count_if("hit").alias("bad"))


# ---------------------------------------------------------------- sources, sinks, reports


@query("SELECT event_id, 'a b''+' || event_id AS text FROM events")
def url_decode_corpus(spark, sf_dir):
    written = F.concat(F.lit("a%20b%27+"), F.col("event_id").cast("string"))
    return _table(spark, sf_dir, "events").select("event_id", payloads.url_decoded(written).alias("text"))


@query("SELECT event_id, event_type AS from_hex, event_type AS from_base64 FROM events")
def encoded_sources(spark, sf_dir):
    data = F.col("event_type").cast("binary")
    return _table(spark, sf_dir, "events").select(
        "event_id",
        payloads.from_hex(F.concat(F.lit("0x"), F.hex(data))).cast("string").alias("from_hex"),
        payloads.from_base64(F.base64(data)).cast("string").alias("from_base64"),
    )


@query("SELECT sha1(text) AS sha1, count(*) AS n FROM (SELECT DISTINCT text FROM documents WHERE length(text) > 0) GROUP BY 1")
def payload_dedupe_sha1(spark, sf_dir):
    found = payloads.distinct_payloads(_table(spark, sf_dir, "documents"), "text")
    return found.groupBy("sha1").agg(F.count("*").alias("n"))


@query("SELECT item_id, lower(hex(encode(text))) AS hex, octet_length(encode(text)) AS length FROM benchmark")
def input_info(spark, sf_dir):
    return sinks.input_info(_table(spark, sf_dir, "benchmark"), "text").select("item_id", "hex", "length")


@query("""SELECT item_id, CAST(i AS INTEGER) AS pos, substr(h, 2 * i + 1, 2) AS byte FROM
  (SELECT item_id, h, unnest(range(length(h) // 2)) AS i FROM (SELECT item_id, hex(encode(text)) AS h FROM benchmark))""")
def byte_rows(spark, sf_dir):
    return sinks.byte_rows(_table(spark, sf_dir, "benchmark"), "item_id", "text").select("item_id", "pos", "byte")


@query("SELECT count(*) AS n FROM documents WHERE strlen(text) < 1000 AND NOT contains(text, chr(0))")
def short_payloads(spark, sf_dir):
    return payloads.short_and_clean(_table(spark, sf_dir, "documents"), "text").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, contains(payload, '''') OR contains(payload, '=') OR contains(payload, '<') AS quoted FROM {_EVENTS}")
def payload_contains(spark, sf_dir):
    text = F.col("payload").cast("string")
    return _events(spark, sf_dir).select("event_id", (F.contains(text, F.lit("'")) | columns.may_be_xss(text)).alias("quoted"))


@query("SELECT event_id, CAST(to_json({'event_id': event_id, 'type': event_type}) AS VARCHAR) AS json FROM events")
def json_rows(spark, sf_dir):
    path = scratch_path(spark, "json")
    sinks.write_json(_table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("type")), path)
    return spark.read.text(path).select(F.get_json_object("value", "$.event_id").cast("long").alias("event_id"), F.col("value").alias("json"))


#: Fingerprints of the injections among TEMPLATES.
_KNOWN_PRINTS = ["s&sos", "sc", "1UEnk", None, None, None, None, None]


def _two_engines(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The scanner, and an engine that knows the templates but errs: in the verdict of each seventh event, in the fingerprint of each fifth."""
    events = _events(spark, sf_dir)
    known = F.element_at(F.array(*(F.lit(x) for _, x, _ in TEMPLATES)), F.col("template") + 1)
    prints = F.element_at(F.array(*(F.lit(p).cast("string") for p in _KNOWN_PRINTS)), F.col("template") + 1)
    engine = events.select(F.col("event_id").alias("input"), columns.detect_sqli("payload").alias("r")).select("input", "r.is_injection", "r.fingerprint")
    erring = events.select(
        F.col("event_id").alias("input"), (known != (F.col("event_id") % 7 == 0)).alias("is_injection"), F.when(F.col("event_id") % 5 != 0, prints).otherwise("none").alias("fingerprint")
    )
    return engine, erring


@query(f"""SELECT event_id AS input, event_id % 7 <> 0 AS match_result, CASE WHEN bad AND event_id % 7 <> 0 THEN event_id % 5 <> 0 END AS match_fingerprint,
  NOT (bad AND event_id % 7 <> 0 AND event_id % 5 <> 0) AS differs
  FROM {_EVENTS} e JOIN {_values([(i, x) for i, (_, x, _) in enumerate(TEMPLATES)], 'i, bad')} ON e.template = v.i""")
def engine_compare(spark, sf_dir):
    return compare.compare(*_two_engines(spark, sf_dir)).select("input", "match_result", "match_fingerprint", "differs")


_TOKEN_SQL = "(SELECT doc_id, CAST(range AS INTEGER) AS index, w[range + 1] AS token FROM (SELECT doc_id, string_split(lang || ' ' || source || {}, ' ') AS w FROM documents), range(4) WHERE range < len(w))"


@query(f"""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.index, b.index) AS index, coalesce(a.token, 'MISSING') AS "left",
  coalesce(b.token, 'MISSING') AS "right", coalesce(a.token, 'MISSING') = coalesce(b.token, 'MISSING') AS same
  FROM {_TOKEN_SQL.format("' x'")} a FULL JOIN {_TOKEN_SQL.format("CASE WHEN doc_id % 2 = 0 THEN ' x y' ELSE '' END")} b ON a.doc_id = b.doc_id AND a.index = b.index""")
def token_diff(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    tokens = lambda end: docs.select("doc_id", F.posexplode(F.split(F.concat("lang", F.lit(" "), "source", end), " ")).alias("index", "token"))
    return compare.token_diff(tokens(F.lit(" x")), tokens(F.when(F.col("doc_id") % 2 == 0, " x y").otherwise("")), "doc_id")


def _results(spark, sf_dir) -> DataFrame:
    """category, file, test and match, dealt to events."""
    return _table(spark, sf_dir, "events").select(
        F.col("event_type").alias("category"), F.concat(F.lit("file"), F.pmod("user_id", F.lit(7)).cast("string")).alias("file"), F.col("event_id").alias("test"), (F.col("event_id") % 11 != 0).alias("match")
    )


_RESULTS = "(SELECT event_type AS category, 'file' || user_id % 7 AS file, event_id AS test, event_id % 11 <> 0 AS match FROM events)"


@query(f"""SELECT level, category, file, tests, matches, tests - matches AS mismatches, rate,
  CASE WHEN rate >= 95 THEN 'excellent' WHEN rate >= 90 THEN 'good' WHEN rate >= 80 THEN 'fair' ELSE 'poor' END AS grade FROM
  (SELECT CASE grouping(category, file) WHEN 0 THEN 'file' WHEN 1 THEN 'category' ELSE 'total' END AS level, category, file, count(*) AS tests,
   count(*) FILTER (match) AS matches, round(100.0 * count(*) FILTER (match) / count(*)::DOUBLE, 2) AS rate FROM {_RESULTS} GROUP BY ROLLUP (category, file))""")
def category_rollup(spark, sf_dir):
    return report.category_report(_results(spark, sf_dir))


@query(f"SELECT category, string_agg(file, ',' ORDER BY file) AS files FROM (SELECT DISTINCT category, file FROM {_RESULTS} WHERE NOT match) GROUP BY category")
def mismatched_files(spark, sf_dir):
    return report.mismatched_files(_results(spark, sf_dir)).select("category", F.array_join("files", ",").alias("files"))


@query(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category, file ORDER BY test) AS place FROM {_RESULTS}) WHERE place <= 20")
def first_n_per_file(spark, sf_dir):
    return report.first_of_each(_results(spark, sf_dir), ["category", "file"], ["test"], 20)


@query(f"SELECT count(*) FILTER (match) AS passed, count(*) FILTER (NOT match) AS failed, count(*) AS total FROM {_RESULTS}")
def pass_fail(spark, sf_dir):
    return report.passed(_results(spark, sf_dir))


_WINDOWS = f"""SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) AS payloads, count(*) FILTER (bad) AS injections FROM
  (SELECT ts, bad FROM {_EVENTS} e JOIN {_values([(i, a or b) for i, (_, a, b) in enumerate(TEMPLATES)], 'i, bad')} ON e.template = v.i) GROUP BY 1"""


@query(_WINDOWS)
def batch_window_counts(spark, sf_dir):
    return detection.window_counts(detection.detected(_events(spark, sf_dir)))


@query(f"SELECT * FROM ({_WINDOWS}) WHERE window_start + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '1 hour'")
def stream_window_counts(spark, sf_dir):
    """The windows that the watermark has closed when the stream has read all events."""
    schema = _table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    path = scratch_path(spark, "stream")
    timed = _filled(payloads.spread(stream.select("event_id", "ts", "event_type"))).withColumn("ts", F.col("ts").cast("timestamp"))
    detection.start(detection.window_counts(detection.detected(timed)), f"{path}/windows", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/windows").withColumn("window_start", F.col("window_start").cast(schema["ts"].dataType))


# ---------------------------------------------------------------- rules, one by one


def _cases(spark, rows: list[tuple], names: str) -> DataFrame:
    """``rows`` with the bytes of their ``payload`` as ``data``."""
    at = [n.split()[0] for n in names.split(", ")].index("payload")
    return spark.createDataFrame([(*r, bytearray(golden.data(r[at]))) for r in rows], f"{names}, data binary")


@query(f"SELECT * FROM {_values(rules.LEXER, 'rule, payload, flags, tokens')}")
def sqli_lexer_rules(spark, sf_dir):
    rows = _cases(spark, [r[:3] for r in rules.LEXER], "rule string, payload string, flags int")
    shown = F.transform(columns.sqli_tokens("data", F.col("flags")), sinks.token_text)
    return rows.select("rule", "payload", "flags", F.array_join(shown, " ~ ").alias("tokens"))


@query(f"SELECT * FROM {_values([(*r[:3], ' ~ '.join(r[3].split(' ~ ')[:2])) for r in rules.LEXER], 'rule, payload, flags, tokens')}")
def sqli_first_tokens(spark, sf_dir):
    rows = _cases(spark, [r[:3] for r in rules.LEXER], "rule string, payload string, flags int")
    shown = F.transform(sinks.first_tokens(columns.sqli_tokens("data", F.col("flags")), 2), sinks.token_text)
    return rows.select("rule", "payload", "flags", F.array_join(shown, " ~ ").alias("tokens"))


@query(f"SELECT * FROM {_values(rules.FOLDING, 'rule, payload, fingerprint')}")
def sqli_folding_rules(spark, sf_dir):
    rows = _cases(spark, [r[:2] for r in rules.FOLDING], "rule string, payload string")
    return rows.select("rule", "payload", verdict.fingerprint_of(columns.sqli_fold("data")).alias("fingerprint"))


@query(f"SELECT * FROM {_values(rules.WHITELIST, 'rule, payload, flags, fingerprint, is_injection')}")
def sqli_whitelist_rules(spark, sf_dir):
    rows = _cases(spark, [r[:3] for r in rules.WHITELIST], "rule string, payload string, flags int")
    checked = rows.withColumn("c", columns.sqli_check("data", F.col("flags")))
    # the rules as one CASE, on fingerprints that are looked up by a join
    stands = verdict.whitelist(F.col("c.fingerprint"), F.col("c.tokens"), F.col("c.stats.tokens"), F.col("data"))
    judged = checked.select("rule", "payload", "flags", F.col("c.fingerprint").alias("fingerprint"), stands.alias("is_injection"))
    listed = verdict.blacklisted(judged, _listed(spark))
    return listed.unionByName(verdict.not_blacklisted(judged, _listed(spark)).withColumn("is_injection", F.lit(False)))


@query(f"SELECT * FROM {_values([r[:3] + r[4:] for r in rules.WHITELIST], 'rule, payload, flags, is_injection')}")
def sqli_single_context(spark, sf_dir):
    rows = _cases(spark, [r[:3] for r in rules.WHITELIST], "rule string, payload string, flags int")
    return rows.select("rule", "payload", "flags", columns.sqli_check("data", F.col("flags"))["is_injection"].alias("is_injection"))


@query(f"SELECT * FROM {_values(rules.SCHEDULE, 'payload, passes')}")
def sqli_context_schedule(spark, sf_dir):
    rows = _cases(spark, [r[:1] for r in rules.SCHEDULE], "payload string")
    return rows.select("payload", F.array_join(F.transform(columns.sqli_passes("data"), lambda p: p["flags"].cast("string")), ",").alias("passes"))


@query(f"SELECT * FROM {_values(rules.STATES, 'state, payload, context, tokens')}")
def html5_states(spark, sf_dir):
    rows = _cases(spark, [r[:3] for r in rules.STATES], "state string, payload string, context int")
    line = lambda t: F.concat_ws(",", t["type"], t["len"].cast("string"), sinks.printable(t["val"]))
    return rows.select("state", "payload", "context", F.array_join(F.transform(columns.html5_tokens("data", F.col("context")), line), " ~ ").alias("tokens"))


@query(f"SELECT * FROM {_values(rules.XSS, 'rule, payload, is_injection')}")
def xss_rules(spark, sf_dir):
    rows = _cases(spark, [r[:2] for r in rules.XSS], "rule string, payload string")
    return rows.select("rule", "payload", columns.detect_xss("data")["is_injection"].alias("is_injection"))


# How many words of each type, fingerprints of each length and event names are listed.
_WORD_COUNTS = [("f", 524), ("k", 208), ("t", 81), ("o", 45), ("n", 35), ("T", 27), ("v", 20), ("E", 18), ("U", 9), ("B", 6), ("1", 6), ("&", 5), ("A", 1)]
_PRINT_COUNTS = [(5, 7926), (4, 356), (3, 78), (2, 6), (1, 1)]
_EVENT_COUNT = 298


@query(f"SELECT type, CAST(n AS BIGINT) AS n, CAST(n AS BIGINT) AS known FROM {_values(_WORD_COUNTS, 'type, n')}")
def sqli_dictionary_lookup(spark, sf_dir):
    looked = verdict.word_table(spark).select("type", columns.sqli_word_type(F.lower("word")).alias("found"))
    return looked.groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("type") == F.col("found")).alias("known"))


@query(f"SELECT length, CAST(n AS BIGINT) AS n FROM {_values(_PRINT_COUNTS, 'length, n')}")
def sqli_fingerprint_table(spark, sf_dir):
    prints = _listed(spark).select(F.lower("fingerprint").alias("fingerprint"))
    asked = prints.unionByName(prints.select(F.concat("fingerprint", F.lit("?")).alias("fingerprint")))  # the latter are never listed
    return verdict.blacklisted(asked, _listed(spark)).groupBy(F.length("fingerprint").alias("length")).agg(F.count("*").alias("n"))


@query(f"SELECT CAST({_EVENT_COUNT} AS BIGINT) AS events, CAST({_EVENT_COUNT} AS BIGINT) AS hits, CAST(0 AS BIGINT) AS others")
def xss_event_table(spark, sf_dir):
    names = spark.createDataFrame([(e.decode(),) for e in sorted(load().events)], "event string")
    attack = lambda end: columns.detect_xss(F.concat(F.lit("<x on"), F.lower("event"), F.lit(end)))["is_injection"]
    return names.agg(F.count("*").alias("events"), F.count_if(attack("=1>")).alias("hits"), F.count_if(attack("_=1>")).alias("others"))


@query("SELECT * FROM (VALUES ('frobnicate(x)', 'f(n)', true), ('union(x)', 'n(n)', false)) AS v(payload, fingerprint, is_injection)")
def sqli_own_dictionary(spark, sf_dir):
    words = collected(spark.createDataFrame([("FROBNICATE", "f"), ("SELECT", "E"), ("F(N)", "F")], "word string, type string"))
    rows = spark.createDataFrame([("frobnicate(x)",), ("union(x)",)], "payload string")
    return rows.select("payload", columns.detect_sqli("payload", 0, words).alias("r")).select("payload", "r.fingerprint", "r.is_injection")


@query("SELECT '0.1.1' AS version")
def library_version(spark, sf_dir):
    return spark.range(1).select(columns.version().alias("version"))


# ---------------------------------------------------------------- files, written and read again


def _lines(spark, sf_dir) -> str:
    """The folder of one file with three lines for each item of the benchmark: a payload within blanks, a blank one, a comment."""
    path = scratch_path(spark, "lines")
    items = _table(spark, sf_dir, "benchmark").orderBy("item_id").coalesce(1)
    items.select(F.format_string("  p%d \n\n# c%d", "item_id", "item_id")).write.text(path)
    return path


@query("SELECT 'p' || item_id AS text FROM benchmark UNION ALL SELECT '# c' || item_id FROM benchmark")
def line_source(spark, sf_dir):
    return payloads.lines(spark, _lines(spark, sf_dir)).select(F.col("payload").cast("string").alias("text"))


@query("SELECT CAST(3 * row_number() OVER (ORDER BY item_id) - 2 AS INTEGER) AS line_no, '  p' || item_id || ' ' AS text FROM benchmark")
def batch_source(spark, sf_dir):
    return payloads.batch(spark, _lines(spark, sf_dir)).select("line_no", F.col("payload").cast("string").alias("text"))


@query("SELECT item_id, CAST(octet_length(encode(text)) + 1 AS INTEGER) AS length FROM benchmark")
def file_source(spark, sf_dir):
    path = scratch_path(spark, "files")
    _table(spark, sf_dir, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(path)
    found = payloads.files(spark, path, "part-*.txt")
    return found.select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long").alias("item_id"), F.octet_length("payload").alias("length"))


@query("SELECT 'a é' AS text")
def single_source(spark, sf_dir):
    return payloads.single(spark, "a é").select(F.col("payload").cast("string").alias("text"))


_CSV_ROWS = [(0, "s", "x,y", 1, 3, '"', '"'), (1, "s", 'p"q', 7, 3, "'", "'")]


@query(f"SELECT * FROM {_values(_CSV_ROWS, 'token_index, token_type, value, position, length, str_open, str_close')}")
def csv_file(spark, sf_dir):
    path = scratch_path(spark, "csv")
    tokens = payloads.single(spark, "\"x,y\" 'p\"q'").select(columns.sqli_tokens("payload").alias("tokens"))
    sinks.write_csv(sinks.token_rows(tokens), path)
    return spark.read.schema("token_index int, token_type string, value string, position int, length int, str_open string, str_close string").csv(path, header=True, quote='"', escape='"')


#: Lexer cases that a text file can hold and that are read in the default dialect.
_GOLDEN_CASES = [(rule, payload, tokens) for rule, payload, flags, tokens in rules.LEXER if flags == 8 and not payload.startswith("hex:")]


@query(f"SELECT rule, count(*) AS cases, count(*) AS passed FROM {_values(_GOLDEN_CASES, 'rule, payload, tokens')} GROUP BY rule")
def golden_files(spark, sf_dir):
    """Golden files of token cases: written, parsed, run through the scanner and compared line by line."""
    path = scratch_path(spark, "golden")
    texts = [(i, f"--TEST--\n{rule}\n--INPUT--\n{payload}\n--EXPECTED--\n" + tokens.replace(" ~ ", "\n")) for i, (rule, payload, tokens) in enumerate(_GOLDEN_CASES)]
    spark.createDataFrame(texts, "i int, value string").write.partitionBy("i").text(path)
    cases = payloads.golden_cases(spark, path, "tokens")
    shown = cases.withColumn("found", F.transform(columns.sqli_tokens("input", 8), sinks.token_text))
    differing = compare.array_diff(shown, "found", "expected").withColumn("wrong", F.filter("diff", lambda d: ~d["same"]))
    return differing.groupBy(F.col("name").alias("rule")).agg(F.count("*").alias("cases"), F.count_if(F.size("wrong") == 0).alias("passed"))


@query(f"""SELECT level, category, file, tests, tests AS matches, CAST(0 AS BIGINT) AS mismatches, 100.0::DOUBLE AS rate, 'excellent' AS grade FROM
  (SELECT CASE grouping(category, file) WHEN 0 THEN 'file' WHEN 1 THEN 'category' ELSE 'total' END AS level, category, file, count(*) AS tests FROM
  (SELECT CASE WHEN bad THEN 'attacks' ELSE 'plain' END AS category, 'template' || template AS file FROM {_EVENTS} e
  JOIN {_values([(i, x) for i, (_, x, _) in enumerate(TEMPLATES)], 'i, bad')} ON e.template = v.i) GROUP BY ROLLUP (category, file))""")
def corpus_report(spark, sf_dir):
    """Corpora in files, URL-encoded and with comments; read, judged, held against what their category says, and reported by file and category."""
    path = scratch_path(spark, "corpora")
    events = _events(spark, sf_dir)
    bad = F.element_at(F.array(*(F.lit(x) for _, x, _ in TEMPLATES)), F.col("template") + 1)
    line = F.replace(F.url_encode(F.col("payload").cast("string")), F.lit("+"), F.lit("%20"))
    written = events.select(F.when(bad, "attacks").otherwise("plain").alias("category"), F.format_string("template%d", "template").alias("file"), line.alias("value"))
    notes = written.select("category", "file", F.lit("# note").alias("value")).distinct()
    written.unionByName(notes).write.partitionBy("category", "file").text(path)
    read = [payloads.corpus(spark, f"{path}/category={c}", c, expected) for c, expected in (("attacks", True), ("plain", False))]
    rows = read[0].unionByName(read[1]).withColumn("file", F.regexp_extract("file", "file=([^/]+)", 1))
    judged = rows.select("category", "file", (columns.detect_sqli("payload")["is_injection"] == F.col("expect_injection")).alias("match"))
    return report.category_report(judged)
