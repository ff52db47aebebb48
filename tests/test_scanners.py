import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftstone.functions import htmlscan, sqlscan
from siftstone.functions.lexicon import load
from siftstone.plans import golden


@pytest.mark.parametrize("case", golden.SQLI, ids=lambda c: c[0])
def test_sqli_golden(case):
    _, payload, flags, fingerprint, injection = case
    hit, found, _ = sqlscan.detect(golden.data(payload), flags)
    assert hit == injection, found
    if fingerprint is not None:
        assert found == fingerprint


@pytest.mark.parametrize("case", golden.FOLDS, ids=lambda c: c[0])
def test_folds(case):
    assert sqlscan.Fold(golden.data(case[1]), case[2]).fingerprint == case[3]


@pytest.mark.parametrize("case", golden.XSS, ids=lambda c: c[0])
def test_xss_golden(case):
    assert (htmlscan.detect(golden.data(case[1])) is not None) == case[2]


def raw(payload, flags=8):
    data = payload if isinstance(payload, bytes) else payload.encode()
    return [(t.type, t.val.decode("latin-1")) for t in sqlscan.Lexer(data, flags, load())]


@pytest.mark.parametrize(
    "payload, tokens",
    [
        ("SELECT x'1234';", [("E", "SELECT"), ("1", "x'1234'"), (";", ";")]),
        ("@ @@ @version @@version", [("v", "@"), ("v", "@@"), ("v", "@version"), ("v", "@@version")]),
        ("<=> <> := :: :a", [("o", "<=>"), ("o", "<>"), ("o", ":="), ("o", "::"), (":", ":"), ("n", "a")]),
        ("? ] ( ) , ; { } % ^ + ~ ! || &&", [("?", "?"), ("?", "]"), *[(c, c) for c in "(),;{}"], *[("o", c) for c in "%^+~!"], ("&", "||"), ("&", "&&")]),
        ("# a", [("o", "#"), ("n", "a")]),
        ("1 -- x\n2", [("1", "1"), ("c", "-- x"), ("1", "2")]),
        ("--x\n2", [("c", "--x"), ("1", "2")]),
        ("-1 /2", [("o", "-"), ("1", "1"), ("o", "/"), ("1", "2")]),
        ("/* a */1", [("c", "/* a */"), ("1", "1")]),
        ("/* /* */1", [("X", "/* /* */"), ("1", "1")]),
        ("/* /*/1", [("X", "/* /*/"), ("1", "1")]),
        ("/*!1*/", [("X", "/*!1*/")]),
        ("/* /* open", [("c", "/* /* open")]),
        ("\\N \\n", [("1", "\\N"), ("\\", "\\"), ("n", "n")]),
        ("'a''b\\'c' 'open", [("s", "a''b\\'c"), ("s", "open")]),
        ("'a''", [("s", "a''")]),
        ("E'x' N'y' e'", [("s", "x"), ("s", "y"), ("n", "e"), ("s", "")]),
        ("U&'x' u&x", [("s", "x"), ("n", "u"), ("o", "&"), ("n", "x")]),
        ("q'[a]b]' Q'xyx' nq'(z)'", [("s", "a]b"), ("s", "y"), ("s", "z")]),
        ("b'01' b'2'", [("1", "b'01'"), ("n", "b"), ("s", "2")]),
        ("[a b] [open", [("n", "[a b]"), ("n", "[open")]),
        ("dbms_lock.sleep select.x", [("f", "dbms_lock.sleep"), ("E", "select"), (".", "."), ("n", "x")]),
        ("`sleep` `x`", [("f", "sleep"), ("n", "x")]),
        ("@`a` @@'b'", [("v", "a"), ("v", "b")]),
        ("$ $1,000.5 $.a $$a$$ $t$a$t$ $t", [("n", "$"), ("1", "$1,000.5"), ("n", "$.a"), ("s", "a"), ("s", "a"), ("n", "$"), ("n", "t")]),
        ("0x 0xF 0b1 0b 1.5e3 1e .5 . 2f 3d; 1fUNION 4fx", [
            ("n", "0x"), ("1", "0xF"), ("1", "0b1"), ("n", "0b"), ("1", "1.5e3"), ("n", "1e"), ("1", ".5"), (".", "."), ("1", "2f"), ("1", "3d"), (";", ";"),
            ("1", "1f"), ("U", "UNION"), ("1", "4"), ("n", "fx"),
        ]),
        ("a" * 40, [("n", "a" * 31)]),
        (b"x\xa0y", [("n", "x"), ("n", "y")]),
    ],
)
def test_productions(payload, tokens):
    assert raw(payload) == tokens


def test_simulated_quotes():
    token = next(iter(sqlscan.Lexer(b"a\\'b''c' d", 2 | 8, load())))
    assert (token.type, token.val, token.open, token.close) == ("s", b"a\\'b''c", 0, ord("'"))
    assert [t.val for t in sqlscan.Lexer(b"no quote", 4 | 16, load())] == [b"no quote"]


def test_dialects_count_comments():
    for flags, hashes, kind in ((8, 1, "o"), (16, 2, "c")):
        lexer = sqlscan.Lexer(b"#x", flags, load())
        assert next(iter(lexer)).type == kind and lexer.comments["hash"] == hashes
    assert [t.type for t in sqlscan.Lexer(b"--x", 16, load())] == ["o", "o", "n"]
    check = sqlscan.Fold(golden.data("hex:2d2d312d4061232a03"), 8)
    assert check.comments["ddx"] > 0


@pytest.mark.parametrize(
    "payload, fingerprint",
    [
        ("'a' 'b'", "s"), ("1;;2", "1;1"), ("1 + - 2", "1"), ("1,2,3", "1"), ("a.b.c", "n"), ("1 = (1)", "1"), ("x = (y)", "n"), ("select - 1", "E1"),
        ("group by x", "Bn"), ("1 in (2)", "1"), ("x in y", "nnn"), ("x like 'y'", "nos"), ("like('y')", "f(s)"), ("password(x)", "f(n)"), ("user(x)", "n(n)"),
        ("user()", "f()"), ("1::int", "1"), ("int x", "n"), ("((1))", "1)"), ("{foo 1}", "1"), (";if(1)", ";T(1)"), ("x collate a_b", "nAt"), ("\\%1", "1"),
        ("not not 1", "1"), ("1 and 1 and 1", "1&1"), ("select . a", "En"), ("/* a */ 1 /* b */", "1c"), ("(((", ""), ("@a = 1", "v"), (", -1", ""),
    ],
)
def test_folding_rules(payload, fingerprint):
    assert sqlscan.Fold(payload.encode(), 0).fingerprint == fingerprint


sql_bytes = st.lists(
    st.sampled_from([b"'", b'"', b"`", b" ", b"--", b"/*", b"*/", b"#", b"1", b"a", b"or", b"union", b"select", b"(", b")", b",", b";", b"=", b"\\", b"@", b"$", b"{", b"}", b".", b"\xff", b"\xa0", b"!", b"N", b"q", b"x", b"\n"]),
    max_size=14,
).map(b"".join)


@settings(max_examples=400, deadline=None)
@given(sql_bytes, st.integers(0, 31))
def test_sql_invariants(data, flags):
    fold = sqlscan.Fold(data, flags)
    assert len(fold.fingerprint) <= 5 and ("X" not in fold.fingerprint or fold.fingerprint == "X")
    tokens = list(sqlscan.Lexer(data, flags, load()))
    assert fold.pulled <= len(tokens)
    assert all(len(t.val) <= 31 for t in tokens)
    hit, _, _ = sqlscan.detect(data, flags)
    if data.isalpha() and data.isascii():
        assert not hit


html_bytes = st.lists(
    st.sampled_from([b"<", b">", b"/", b"=", b"'", b'"', b"`", b" ", b"!", b"--", b"-", b"a", b"script", b"svg", b"href", b"onclick", b"style", b"javascript:", b"&#106;", b"&#x6a", b"\0", b"\xff", b"%", b"?", b"[CDATA[", b"]]>", b"DOCTYPE", b"xml"]),
    max_size=14,
).map(b"".join)


@settings(max_examples=400, deadline=None)
@given(html_bytes, st.integers(0, 4))
def test_html_invariants(data, context):
    end = 0
    for token in htmlscan.Scanner(data, context):
        assert token.pos >= end - 1 and data[token.pos : token.pos + len(token.val)] == token.val
        end = token.pos + len(token.val)
    if b"<" not in data and b"=" not in data:
        assert htmlscan.detect(data) is None


def test_deep_nesting_needs_no_stack():
    assert htmlscan.detect(b"</></>" * 50_000) is None
    assert list(htmlscan.Scanner(b"<a " + b"/ " * 50_000))


@pytest.mark.parametrize(
    "data, tokens",
    [
        (b"foo", [("DATA_TEXT", b"foo")]),
        (b"<a href='x' b=c d>t</a>", [
            ("TAG_NAME_OPEN", b"a"), ("ATTR_NAME", b"href"), ("ATTR_VALUE", b"x"), ("ATTR_NAME", b"b"), ("ATTR_VALUE", b"c"), ("ATTR_NAME", b"d"),
            ("TAG_NAME_CLOSE", b">"), ("DATA_TEXT", b"t"), ("TAG_CLOSE", b"a"),
        ]),
        (b"<br/>x", [("TAG_NAME_OPEN", b"br"), ("TAG_NAME_SELFCLOSE", b"/>"), ("DATA_TEXT", b"x")]),
        (b"<!-- a -!>b", [("TAG_COMMENT", b" a "), ("DATA_TEXT", b"b")]),
        (b"<!x><?y><%z%>", [("TAG_COMMENT", b"x"), ("TAG_COMMENT", b"y"), ("TAG_COMMENT", b"z")]),
        (b"<![CDATA[a]]><!doctype q>", [("DATA_TEXT", b"a"), ("DOCTYPE", b"doctype q")]),
        (b"<1", [("DATA_TEXT", b"<"), ("DATA_TEXT", b"1")]),
    ],
)
def test_html_tokens(data, tokens):
    assert [(t.type, t.val) for t in htmlscan.Scanner(data)] == tokens


def test_entities_and_schemes():
    lexicon = load()
    assert list(htmlscan.decoded(b"a&#98;c&#x64;&amp;&#")) == list(b"abcd&amp;&#")
    assert list(htmlscan.decoded(b"&#98;&#x63;&#9999999999;")) == [98, 99, *b"&#9999999999;"]
    assert htmlscan.bad_url(b" \x01java\nscript:x", lexicon) and htmlscan.bad_url(b"&#106;ava", lexicon)
    assert not htmlscan.bad_url(b"http://java", lexicon) and not htmlscan.bad_url(b"&#" + b"9" * 9000, lexicon)


def test_a_dictionary_is_a_parameter(tmp_path):
    path = tmp_path / "words.tsv"
    path.write_text("SELECT\tE\nFROBNICATE\tf\nS&SOS\tF\nBLINK\ttag\nONE\tevent\nGOPHER\tscheme\nSRC\turl\n")
    lexicon = load(str(path))
    assert lexicon.word(b"frobnicate") == "f" and lexicon.word(b"union") == "n"
    assert lexicon.blacklisted("s&sos") and not lexicon.blacklisted("1UEnk")
    assert htmlscan.first_hit(b"<blink>", 0, lexicon) and not htmlscan.first_hit(b"<script>", 0, lexicon)
    assert htmlscan.first_hit(b"<a src='gopher:x'>", 0, lexicon)


def test_all_listed_events():
    assert len(load().events) == 298
    for name in (b"unhandledrejection", b"slotchange", b"textinput", b"timeout", b"domactivate", b"compositionstart"):
        assert htmlscan.detect(b"<x on" + name + b"=alert(1)>"), name
    assert not htmlscan.detect(b"<x onbeforedeactivates=alert(1)>")


def test_the_listed_dictionary():
    lexicon = load()
    assert len(lexicon.fingerprints) == 8367 and len(lexicon.words) == 985
    kinds = {"TRUNCATE": "f", "ORD": "f", "ELT": "f", "MAKE_SET": "f", "ANY": "f", "ALTER TABLE": "k", "HANDLER": "T", "PROCEDURE ANALYSE": "f", "_UTF8": "t"}
    assert {w: lexicon.word(w.lower().encode()) for w in kinds} == kinds
    assert all(map(lexicon.blacklisted, ("1nU(E", "1ok(v", "soN1U", "vttnt", "E1s;", "1vs;"))) and not lexicon.blacklisted("")


@pytest.mark.parametrize(
    "payload, hit, fingerprint",
    [
        ("1 a union (select", True, "1nU(E"), ("1 = any(@a", True, "1of(v"), ("'a'=b 1 union select", True, "son1U"), ("select 1 'a';", True, "E1s;"),
        ("-1 procedure analyse(1)", True, "1f(1)"), ("1;truncate table x", False, "1;fnn"),
    ],
)
def test_verdicts_of_listed_fingerprints(payload, hit, fingerprint):
    assert sqlscan.detect(payload.encode())[:2] == (hit, fingerprint)
