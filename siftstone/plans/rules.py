"""One or more payloads for each production, rule and state, with what they give.

Fixed values, written by hand from what the rules say.  Payloads are text, or
hexadecimal after ``hex:``.
"""

#: rule, payload, flags, raw tokens as type and text.
LEXER = [
    ("white", "hex:20090a0b0c0d7fa0003120", 8, "1 1"),
    ("operator1", "% ^ + ~", 8, "o % ~ o ^ ~ o + ~ o ~"),
    ("operator2", "<=> <> := :: !=", 8, "o <=> ~ o <> ~ o := ~ o :: ~ o !="),
    ("operator2", "&& || :a !a", 8, "& && ~ & || ~ : : ~ n a ~ o ! ~ n a"),
    ("other", "? ]", 8, "? ? ~ ? ]"),
    ("single", "( ) , ; { }", 8, "( ( ~ ) ) ~ , , ~ ; ; ~ { { ~ } }"),
    ("hash", "# a", 8, "o # ~ n a"),
    ("hash", "# a", 16, "c # a"),
    ("dash", "1 -- x", 8, "1 1 ~ c -- x"),
    ("dash", "--x", 8, "c --x"),
    ("dash", "--x", 16, "o - ~ o - ~ n x"),
    ("dash", "-1", 8, "o - ~ 1 1"),
    ("slash", "1/2", 8, "1 1 ~ o / ~ 1 2"),
    ("c_comment", "/* a */1", 8, "c /* a */ ~ 1 1"),
    ("c_comment", "/* /* */1", 8, "X /* /* */ ~ 1 1"),
    ("c_comment", "/*!1*/", 8, "X /*!1*/"),
    ("c_comment", "/* /* open", 8, "c /* /* open"),
    ("eol_comment", "hex:2d2d20780a32", 8, "c -- x ~ 1 2"),
    ("backslash", "\\N \\n", 8, "1 \\N ~ \\ \\ ~ n n"),
    ("string", "'a''b\\'c' 'open", 8, "s 'a''b\\'c' ~ s 'open"),
    ("string", "\"a\" 'b'", 8, "s \"a\" ~ s 'b'"),
    ("simulated_quote", "a\\'b''c' d", 10, "s a\\'b''c' ~ n d"),
    ("simulated_quote", "no quote", 12, "s no quote"),
    ("e_string", "E'x' e'y' ex", 8, "s 'x' ~ s 'y' ~ n ex"),
    ("u_string", "U&'x' u&x", 8, "s uxu ~ n u ~ o & ~ n x"),
    ("q_string", "q'[a]b]' Q'xyx' q'(z", 8, "s qa]bq ~ s qyq ~ s qz"),
    ("nq_string", "N'y' nq'<z>'", 8, "s 'y' ~ s qzq"),
    ("b_string", "b'01' b'2'", 8, "1 b'01' ~ n b ~ s '2'"),
    ("x_string", "x'1F' X'g'", 8, "1 x'1F' ~ n X ~ s 'g'"),
    ("bracket_word", "[a b] [open", 8, "n [a b] ~ n [open"),
    ("word", "dbms_lock.sleep select.x plain", 8, "f dbms_lock.sleep ~ E select ~ . . ~ n x ~ n plain"),
    ("word", "sleep`x`", 8, "f sleep ~ n x"),
    ("tick", "`sleep` `x`", 8, "f sleep ~ n x"),
    ("variable", "@ @@ @version @@version", 8, "v @ ~ v @@ ~ v @version ~ v @@version"),
    ("variable", "@`a` @@'b'", 8, "v @`a` ~ v @@'b'"),
    ("money", "$ $1,000.5 $.a $t", 8, "n $ ~ 1 $1,000.5 ~ n $.a ~ n $ ~ n t"),
    ("dollar_string", "$$a$$ $$open", 8, "s $a$ ~ s $open"),
    ("tagged_string", "$t$a$u$b$t$", 8, "s $a$u$b$"),
    ("number", "0x 0xF 0b1 0b 1.5e3 1e .5 .", 8, "n 0x ~ 1 0xF ~ 1 0b1 ~ n 0b ~ 1 1.5e3 ~ n 1e ~ 1 .5 ~ . ."),
    ("number", "2f 3d; 1fUNION 4fx", 8, "1 2f ~ 1 3d ~ ; ; ~ 1 1f ~ U UNION ~ 1 4 ~ n fx"),
    ("lookup", "UnIoN sLeEp nonsense", 8, "U UnIoN ~ f sLeEp ~ n nonsense"),
    ("kept_bytes", "a" * 40, 8, "n " + "a" * 31),
]

#: rule, payload, fingerprint in the default context.
FOLDING = [
    ("R2.1", "'a' 'b'", "s"), ("R2.2", "1;;2", "1;1"), ("R2.3", "1 + - 2", "1"), ("R2.3", "not not 1", "1"), ("R2.4", "select (-1", "E(1"),
    ("R2.5", "group by x", "Bn"), ("R2.5", "union all select", "UE"), ("R2.6", ";if(1)", ";T(1)"), ("R2.7", "password(x)", "f(n)"), ("R2.7", "User_Id(x)", "f(n)"),
    ("R2.8", "1 in (2)", "1"), ("R2.8", "x in y", "nnn"), ("R2.9", "x like 'y'", "nos"), ("R2.9", "like('y')", "f(s)"), ("R2.10", "x = int 1", "n"),
    ("R2.11", "x collate a_b", "nAt"), ("R2.11", "x collate ab", "nAn"), ("R2.12", "\\%1", "1"), ("R2.12", "1 \\ x", "1n"), ("R2.13", "select ((1", "E(1"),
    ("R2.14", "((1))", "1)"), ("R2.15", "{foo 1}", "1"), ("R2.15", "0{`", "X"), ("R2.16", "1 }", "1"),
    ("R3.1", "1 + 2", "1"), ("R3.2", "* 1 * 2", "o1"), ("R3.3", "&& x && y", "&n"), ("R3.3", "1 and 1 and 1", "1&1"), ("R3.4", "@a = 1", "v"), ("R3.5", "x = 1", "n"),
    ("R3.6", "'1'::int", "s"), ("R3.7", "1,2,3", "1"), ("R3.8", "select - (1", "E(1"), ("R3.9", "select - 1", "E1"), ("R3.10", ", -1", ""), ("R3.11", ", - sleep(1)", ",f(1)"),
    ("R3.12", "a.b.c", "n"), ("R3.13", "select . a", "En"), ("R3.14", "user(x)", "n(n)"), ("R3.14", "user()", "f()"),
    ("R5.1", "1 = (1)", "1"), ("R5.1", "1,(1)", "1"), ("R5.2", "x = (y)", "n"), ("R5.2", "x = (1)", "n"), ("R5.3", "1),(1", "1"), ("R5.4", "a)=(b", "n"),
    ("skipped", "/* a */ ((int - 1", "1"), ("comment", "/* a */ 1 /* b */", "1c"), ("nothing", "(((", ""), ("evil", "1 /*! 2", "X"), ("five", "select a from b where", "Enknk"),
]

#: rule, payload, flags, fingerprint, verdict in that one context.
WHITELIST = [
    ("W1", "x -- sp_password", 9, "nc", True), ("W1", "x -- SP_Password", 9, "nc", True), ("W2", "1 union", 9, "1U", False), ("W2", "1/**/union", 9, "1U", True),
    ("W3", "x #c", 17, "nc", False), ("W3", "1 #c", 17, "1c", False), ("W4", "x -- c", 9, "nc", False), ("W5", "1 /*x*/", 9, "1c", True), ("W6", "1,2--x", 9, "1c", True),
    ("W7", "1 -- x", 9, "1c", True), ("W7", "1-- x", 9, "1c", True), ("W7", "hex:1b382d2d", 9, "1c", False), ("W7", "hex:38a02d2d", 9, "1c", True),
    ("W8", "'a' -- x", 9, "sc", False), ("W8", "@a --x", 9, "vc", False), ("W9", "'a' --", 9, "sc", True), ("W9", "@a /*x*/", 9, "vc", True), ("W9", "x /*x*/", 9, "nc", True),
    ("W10", "'a' + 'b'", 9, "sos", False), ("W10", "a' or 'b", 10, "s&s", True), ("W11", "1 and 1", 9, "1&1", False), ("W11", "1 /**/ and 1", 9, "1&1", True),
    ("W12", "x into outfile y", 9, "nkn", False), ("W13", "x INTO OUTFILE y", 9, "nkn", True), ("W13", "0{`", 9, "X", True), ("unlisted", "SELECT * FROM users", 9, "Eokn", False),
]

#: payload, the flags of the passes that are tried.
SCHEDULE = [
    ("x", "9"), ("x --y", "9,17"), ("x 'y", "9,10"), ('x "y', "9,20"), ("1' OR '1'='1", "9,10"), ("a'#", "9,10,18"), ("0{`", "9"), ("a'b\"c", "9,10,20"), ("", ""),
]

#: state, payload, context, tokens as type, length and text.
STATES = [
    ("start", "x=y", 1, "ATTR_NAME,1,x ~ ATTR_VALUE,1,y"),
    ("start", "a'b", 2, "ATTR_VALUE,1,a ~ ATTR_NAME,1,b"),
    ("start", 'a">b', 3, "ATTR_VALUE,1,a ~ TAG_NAME_CLOSE,1,> ~ DATA_TEXT,1,b"),
    ("start", "a`/>", 4, "ATTR_VALUE,1,a ~ TAG_NAME_SELFCLOSE,2,/>"),
    ("data", "foo", 0, "DATA_TEXT,3,foo"),
    ("tag_open", "<1", 0, "DATA_TEXT,1,< ~ DATA_TEXT,1,1"),
    ("tag_open", "<?y><%z%>", 0, "TAG_COMMENT,1,y ~ TAG_COMMENT,1,z"),
    ("tag_name", "<a >b</a>", 0, "TAG_NAME_OPEN,1,a ~ TAG_NAME_CLOSE,1,> ~ DATA_TEXT,1,b ~ TAG_CLOSE,1,a"),
    ("end_tag_open", "</>x", 0, "DATA_TEXT,2,>x"),
    ("end_tag_open", "</1>", 0, "TAG_COMMENT,1,1"),
    ("bare_close", "<a b=c>", 0, "TAG_NAME_OPEN,1,a ~ ATTR_NAME,1,b ~ ATTR_VALUE,1,c ~ TAG_NAME_CLOSE,1,>"),
    ("self_closing", "<a/ b>", 0, "TAG_NAME_OPEN,1,a ~ ATTR_NAME,1,b ~ TAG_NAME_CLOSE,1,>"),
    ("attr_name", "<a =b>", 0, "TAG_NAME_OPEN,1,a ~ ATTR_NAME,2,=b ~ TAG_NAME_CLOSE,1,>"),
    ("after_name", "<a b c=d e >", 0, "TAG_NAME_OPEN,1,a ~ ATTR_NAME,1,b ~ ATTR_NAME,1,c ~ ATTR_VALUE,1,d ~ ATTR_NAME,1,e ~ TAG_NAME_CLOSE,1,>"),
    ("after_name", "<a b = c/>", 0, "TAG_NAME_OPEN,1,a ~ ATTR_NAME,1,b ~ ATTR_VALUE,2,c/ ~ TAG_NAME_CLOSE,1,>"),
    ("quoted_double", '<a b="c d">', 0, "TAG_NAME_OPEN,1,a ~ ATTR_NAME,1,b ~ ATTR_VALUE,3,c d ~ TAG_NAME_CLOSE,1,>"),
    ("quoted_single", "<a b='c'd>", 0, "TAG_NAME_OPEN,1,a ~ ATTR_NAME,1,b ~ ATTR_VALUE,1,c ~ ATTR_NAME,1,d ~ TAG_NAME_CLOSE,1,>"),
    ("quoted_back", "<a b=`c`/>", 0, "TAG_NAME_OPEN,1,a ~ ATTR_NAME,1,b ~ ATTR_VALUE,1,c ~ TAG_NAME_SELFCLOSE,2,/>"),
    ("end_byte", "hex:3c6120623dff3e", 0, "TAG_NAME_OPEN,1,a ~ ATTR_NAME,1,b"),
    ("doctype", "<!dOctype q>x", 0, "DOCTYPE,9,dOctype q ~ DATA_TEXT,1,x"),
    ("markup", "<![CDATA[a]]><![cdata[b]]>", 0, "DATA_TEXT,1,a ~ TAG_COMMENT,10,[cdata[b]]"),
    ("comment", "<!-- a -!>b<!--c", 0, "TAG_COMMENT,3, a  ~ DATA_TEXT,1,b ~ TAG_COMMENT,1,c"),
]

#: rule, payload, verdict.
XSS = [
    ("X1", "x' onclick=1", True), ("X1", "onclick=1", True), ("X1", "x onclick", False), ("X2", "<!doctype html>", True), ("X3", "<XmL>", True), ("X3", "hex:3c73637200697074 3e".replace(" ", ""), True),
    ("X3", "<b>", False), ("X4", "<svgx>", True), ("X4", "hex:3c730076673e", False), ("X5", "<b onload=1>", True), ("X5", "<b onloads=1>", False), ("X5", "hex:3c62206f6e6c006f61643d313e", True),
    ("X6", "<b xmlns:q=1>", True), ("X6", "<b xlink:q=1>", True), ("X6", "<b xml=1>", False), ("X7", "<b datasrc=1>", True), ("X7", "<b title=1>", False), ("X8", "<b style=''>", True),
    ("X9", "<a href='java:1'>", True), ("X9", "<a href='http:1'>", False), ("X10", "<set attributename=href>", True), ("X10", "<set attributename=id>", False),
    ("X11", "<!-- ` -->", True), ("X11", "<!--[iF x-->", True), ("X11", "<!--xml x-->", True), ("X11", "<!--entity-->", True), ("X11", "<!--plain-->", False),
    ("X12", "hex:3c6120687265663d226a006176613a223e", True), ("X13", "hex:3c6120687265663d2220096a610a76613a223e", True), ("X13", "<a href='xjava:'>", False),
    ("X14", "<a href='&#106;ava:'>", True), ("X14", "<a href='&#x6A;ava:'>", True), ("X14", "<a href='&#9999999999;java:'>", False), ("reset", "<a style>x=1", False),
]
