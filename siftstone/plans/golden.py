"""Payloads with known results, as asserted for this kind of classifier.

Fixed values: payloads (text, or hexadecimal after ``hex:``), flags, verdicts
and fingerprints.  A None isn't known.
"""

SQLI = [
    # id, payload, flags, fingerprint in the last context tried, injection
    ("plain", "hello world", 0, None, False),
    ("or_true", "1' OR '1'='1", 0, "s&sos", True),
    ("or_true_single", "1' OR '1'='1", 10, None, True),
    ("comment_out", "admin'--", 0, "sc", True),
    ("union", "1 UNION SELECT password FROM users", 0, "1UEnk", True),
    ("select", "SELECT * FROM users", 0, "Eokn", False),
    ("select_where", "SELECT * FROM users WHERE id = 1", 0, "Eoknk", True),
    ("and_plain", "1 and 1", 0, "1&1", False),
    ("skv", "As@'As@'j@Qsj@Qs", 8, "skv", False),
    ("dq_detect", "hex:d824ff2a22221c22223260", 8, None, False),
    ("quote_ctx", "hex:23fe227e22", 0, "sos", True),
    ("fc222322", "hex:fc222322", 8, None, False),
    ("evil_brace", "hex:307b60", 8, "X", True),
    ("mysql_cond", "hex:272f2a2123f1fe22", 8, "X", True),
    ("reparse", "hex:2d2d312d4061232a03", 0, None, True),
    ("ff_chars", "hex:24382d2dff29ff03ff29", 0, None, True),
    ("whitelist_bug", "hex:1b382d2d", 8, "1c", False),
    ("evil_ff", "hex:ffffffffffffffffffff6523235c66efffffffffffffffffffff2b9afb7b60", 0, "X", True),
    ("dd7a369a", "hex:5c2a5c5c4173405c5c5cd02121d0215c2134342134ffffff21ffff316aff21402b2a212b", 0, None, False),
    ("d1ff5132", "hex:24385c22223e222222", 0, None, True),
    ("1a0", "hex:31a02d2d02", 0, None, True),
    ("percent", "hex:25252525252525252525252525252525252525252525232a23fe220e2525715d2f2f2a21f12723267e23612f", 0, None, False),
    ("quote_nl", "hex:7127ff27ffffffffffffffff270a2b272723", 0, None, False),
    ("backslash", "hex:5c5c5c5c5c5c5c5c5c225c5c5c5c5c5c5c5c225d222f2a215c225e2a", 0, None, False),
]

#: id, payload, flags, fingerprint in that one context.
FOLDS = [
    ("float_version", "SELECT float @@version;", 9, "Ev;"),
    ("dq_mysql", "hex:d824ff2a22221c22223260", 20, "s"),
    ("quote_ctx_ansi", "hex:23fe227e22", 9, "ons"),
    ("quote_ctx_dq", "hex:23fe227e22", 12, "sos"),
    ("php_backquote", "1 OR 1`", 8, "1&1c"),
    ("evil_brace", "hex:307b60", 8, "X"),
]

XSS = [
    ("text", "Hello world", False),
    ("paragraph", "<p>Normal text</p>", False),
    ("class", '<div class="safe">Content</div>', False),
    ("empty", "", False),
    ("script", "<script>alert(1)</script>", True),
    ("script_mixed", "<ScRiPt>alert(1)</ScRiPt>", True),
    ("onclick", '<img onclick="alert(1)">', True),
    ("onload", '<div onload="alert(1)">', True),
    ("onerror", '<input onerror="alert(1)">', True),
    ("href_js", '<a href="javascript:alert(1)">', True),
    ("src_data", '<img src="data:text/html,<script>alert(1)</script>">', True),
    ("src_vbs", '<iframe src="vbscript:alert(1)">', True),
    ("style", '<p style="color:red">', True),
    ("object", '<object data="http://evil.com">', True),
    ("embed", '<embed src="http://evil.com">', True),
    ("svg", '<svg onload="alert(1)">', True),
    ("svg_prefix", "<svgtest>", True),
    ("comment", "<!-- Normal comment -->", False),
    ("conditional", "<!--[if IE]><script>alert(1)</script><![endif]-->", True),
    ("tick_comment", "<!-- Comment with ` backtick -->", True),
    ("import", "<!--IMPORT foo-->", True),
    ("doctype", "<!DOCTYPE html>", True),
    ("bare_href", "<a href=javascript:alert(1)>", True),
    (
        "8ce9746b",
        "hex:3c703c700a2f600222602f0d3c2f0d0d0d602f546f2fff4320203e84013c700a2f6002226020203e013c703e897d0d3c2f0d3c2f0d0d0d6060203e84013c700a2f600222602022",
        False,
    ),
    (
        "472cde1c",
        "hex:2f5d222f5d2260d62d35202f3e3c74ff6666666627600a270a5a7f3c700a7860aa54282f3c273dff3e602f3c21696969696969696969696969696969693d27d43d3d270d74ffffffff"
        "ffffffffff6666666666ff3427a7013d60602f0d60272d35202f3e3c74ff66666666665b666066666627a7013d60602f0d",
        False,
    ),
    (
        "0d735373",
        "hex:6060aa54ed2760270d0d60ff60602e0d6027272d35202f40ff3e6a2f3c2f3e3c74a701272d3527ff27215b0d880a58c3d22d35202f27a7a701272d35202f3e3c74666666ff6660d427"
        "0d665b3b666666ca0227a7996027ff3e602f602fff3c735667563effff602f602fff3c7356563effff3c7360aa013d603d6054ed28ff3e602f602fff3c73565699996027ff3e6001546060",
        True,
    ),
    ("001c6f03", "hex:e63d2291223d220960913d222209092767023d27033d2760023d2767014e023d3d27033d2760023d27784d4c4e53023b3d203d2760023d276701fb0928", True),
]


def data(payload: str) -> bytes:
    return bytes.fromhex(payload[4:]) if payload.startswith("hex:") else payload.encode()
