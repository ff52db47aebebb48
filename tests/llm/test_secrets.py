import hashlib
import math
import re

from siftstone.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= 24]
    spans.sort()
    joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
    counts = [sum(x[1] == i for x in spans) for i in range(3)]
    return (*counts, hashlib.sha256(joined.encode()).hexdigest()), joined


def check(rows, got):
    texts = {}
    for row in rows:
        texts.setdefault(row[0], []).append(brute(row[1]))
    assert len(got) == len(rows)
    for r in got:
        want = [w for w, joined in texts[r.doc_id] if set(joined.split(",")) - {""} <= set(r.spans.split(","))]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) in want


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], secrets.digests(docs).collect())


KEY = "AKIA" + "Q7ZX2M4N8P1R5T9W"
HEXA = "0123456789abcdef01234567"
ROWS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, f"é PassWord = '{'x' * 6}' token:short api-key=zzzzzz APIKEY: q1w2e3r4t5y6u7", "en", "b"),
    (4, f"{KEY} and {HEXA}", "en", "c"), (4, f"{KEY} and {HEXA}", "en", "c"), (5, f"token={HEXA}", "fr", "d"), (6, HEXA.upper(), None, None),
    (None, f"secret: {HEXA}{HEXA}", "en", "e"), (8, f"x{HEXA}x", "en", "f"), (9, "paſſword=abcdefgh toKen=abcdefgh", "en", "g"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_edge_cases_against_brute_force(spark):
    check(ROWS, secrets.digests(frame(spark, ROWS)).collect())
    assert secrets.digests(frame(spark, [])).collect() == []


def test_widely_copied_values_are_examples_and_owned_ones_live(spark):
    shared, own = "Zk81Mq0pLx27Vt", "Yw94Bd6sRj35Nc"
    rows = [(i, f"token={shared}", "en", f"s{i % 4}") for i in range(40)] + [(99, f"password: {own}", "en", "s0")]
    got = {r.doc_id: r.spans for r in secrets.digests(frame(spark, rows)).collect()}
    assert got[99] == "assign:0:24,live:10:24"
    assert all(got[i] == "assign:0:20,example:6:20" for i in range(40))
    hidden = {r.doc_id: r.text for r in secrets.redact(frame(spark, rows)).collect()}
    assert hidden[99] == "[secret]" and hidden[0] == f"token={shared}"


def judged(rows):
    """Live and example spans by counting plainly: (doc_id, kind, start, end)."""
    values, spans = {}, []
    for d, text, lang, source in rows:
        for m in ASSIGN.finditer(text or ""):
            if len(m[2]) >= 6:
                spans.append((d, m.start(2), m.end(2), m[2], "/".join(x for x in (source, lang) if x is not None), source or ""))
        for m in [*ACCESS.finditer(text or ""), *HEX.finditer(text or "")]:
            if len(m[0]) >= (20 if m[0].startswith("AKIA") else 24):
                spans.append((d, m.start(), m.end(), m[0], "/".join(x for x in (source, lang) if x is not None), source or ""))
    for _, _, _, value, repo, owner in spans:
        values.setdefault(value, set()).add((repo, owner))
    out = set()
    for d, start, end, value, _, _ in spans:
        owners, repos = len({o for _, o in values[value]}), len(values[value])
        bits = -sum(value.count(c) / len(value) * math.log2(value.count(c) / len(value)) for c in set(value))
        if owners >= 3 or owners > 1 and repos >= 5:
            out.add((d, "example", start, end))
        elif owners == 1 and repos <= 2 and len(value) >= 12 and bits >= 2.5:
            out.add((d, "live", start, end))
    return out


def added(got):
    found = [(r.doc_id, *s.split(":")) for r in got for s in r.spans.split(",") if s]
    return {(d, k, int(s), int(e)) for d, k, s, e in found if k in ("live", "example")}


def test_live_and_example_spans_against_plain_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    assert added(secrets.digests(docs).collect()) == judged([tuple(r) for r in docs.collect()])
    value = "Zk81Mq0pLx27Vt"
    for places in ([("a", "en")], [("a", "en"), ("a", "de")], [("a", x) for x in ("en", "de", "fr")], [("a", "en"), ("b", "de")], [(s, x) for s in "ab" for x in ("en", "de", "fr")], [(s, None) for s in "abc"]):
        rows = [(i, f"token={value}", lang, source) for i, (source, lang) in enumerate(places)]
        assert added(secrets.digests(frame(spark, rows)).collect()) == judged(rows), places


def test_a_text_of_very_many_secrets_and_tables_without_owners(spark):
    text = " ".join(f"token=Zk81Mq0pLx27Vt{i:06d}" for i in range(30_000))
    rows = [(1, text, "en", "a"), (2, "x", "en", "a")]
    got = {r.doc_id: r.text for r in secrets.redact(frame(spark, rows)).collect()}
    assert got == {1: " ".join(["[secret]"] * 30_000), 2: "x"}
    bare = spark.createDataFrame([(1, f"password={HEXA}", 1.5), (2, None, 2.5)], "doc_id long, text string, `a.b` double")
    assert sorted(map(tuple, secrets.redact(bare).collect())) == [(1, "[secret]", 1.5), (2, None, 2.5)]
    assert secrets.redact(bare.limit(0)).collect() == [] and secrets.digests(bare).count() == 2


def test_redaction_keeps_rows_and_the_rest_of_the_text(spark):
    rows = [(1, f"keep {KEY} this é {HEXA}.", "en", "a"), (2, None, "en", "a"), (3, "plain", "en", "a"), (3, "plain", "en", "a")]
    got = sorted(map(tuple, secrets.redact(frame(spark, rows)).collect()), key=lambda r: r[0])
    assert got[0][1] == "keep [secret] this é [secret]."
    assert got[1:] == [(2, None, "en", "a"), (3, "plain", "en", "a"), (3, "plain", "en", "a")]
