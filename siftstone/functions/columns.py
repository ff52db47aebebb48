"""Column functions over payloads (binary, or strings as UTF-8).

Each is one Arrow function whose struct result can be taken apart without
running it again.  A null payload gives null.  Equal payloads of a batch are
looked at once.  ``dictionary`` is the path of a dictionary, readable where the
tasks run, or its (word, type) pairs; without it the built-in lexicon is used.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from siftstone.functions import htmlscan, sqlscan
from siftstone.functions.lexicon import Dictionary, load

VERSION = "0.1.1"

SQL_TOKEN = "struct<type:string,pos:int,len:int,val:binary,str_open:string,str_close:string,count:int>"
HTML_TOKEN = "struct<type:string,pos:int,len:int,val:binary>"
STATS = "struct<tokens:int,comment_c:int,comment_ddw:int,comment_ddx:int,comment_hash:int>"
VERDICT = "struct<injection_type:string,is_injection:boolean,fingerprint:string,confidence:float,flags:int>"
CHECKED = f"struct<is_injection:boolean,fingerprint:string,tokens:array<{SQL_TOKEN}>,stats:{STATS}>"
XSS = "struct<injection_type:string,is_injection:boolean,context:string,rule:string,pos:int>"

_I, _S, _B = pa.int32(), pa.string(), pa.binary()
_SQL_TOKEN = pa.struct([("type", _S), ("pos", _I), ("len", _I), ("val", _B), ("str_open", _S), ("str_close", _S), ("count", _I)])
_HTML_TOKEN = pa.struct([("type", _S), ("pos", _I), ("len", _I), ("val", _B)])
_STATS = pa.struct([(n, _I) for n in ("tokens", "comment_c", "comment_ddw", "comment_ddx", "comment_hash")])
_VERDICT = pa.struct([("injection_type", _S), ("is_injection", pa.bool_()), ("fingerprint", _S), ("confidence", pa.float32()), ("flags", _I)])
_CHECKED = pa.struct([("is_injection", pa.bool_()), ("fingerprint", _S), ("tokens", pa.list_(_SQL_TOKEN)), ("stats", _STATS)])
_XSS = pa.struct([("injection_type", _S), ("is_injection", pa.bool_()), ("context", _S), ("rule", _S), ("pos", _I)])


def _kernel(look: Callable, kind: pa.DataType, declared: str):
    """An Arrow function of (payload, number), which calls ``look`` once for each distinct pair of a batch."""

    @arrow_udf(declared)
    def run(payload: pa.Array, number: pa.Array) -> pa.Array:
        seen: dict = {}
        out = []
        for data, n in zip(payload.to_pylist(), number.to_pylist()):
            if data is None or n is None:
                out.append(None)
                continue
            if (key := (data, n)) not in seen:
                seen[key] = look(data, n)
            out.append(seen[key])
        return pa.array(out, kind)

    return run


def _applied(look: Callable, kind: pa.DataType, declared: str, payload: Column | str, number: Column | int) -> Column:
    payload = F.col(payload) if isinstance(payload, str) else payload
    number = F.lit(number).cast("int") if isinstance(number, int) else number.cast("int")
    return _kernel(look, kind, declared)(payload.cast("binary"), number)


def _stats(fold: sqlscan.Fold) -> dict:
    return {"tokens": fold.pulled} | {f"comment_{k}": v for k, v in fold.comments.items()}


def _checked(hit: bool, fold: sqlscan.Fold) -> dict:
    return {"is_injection": hit, "fingerprint": fold.fingerprint, "tokens": [t.row() for t in fold.tokens], "stats": _stats(fold)}


def detect_sqli(payload: Column | str, flags: Column | int = 0, dictionary: Dictionary | None = None) -> Column:
    """Verdict over all contexts, with the fingerprint and flags of the last one tried."""

    def look(data: bytes, flags: int) -> dict:
        hit, fingerprint, used = sqlscan.detect(data, flags, load(dictionary))
        return {"injection_type": "SQL Injection", "is_injection": hit, "fingerprint": fingerprint, "confidence": float(hit), "flags": used}

    return _applied(look, _VERDICT, VERDICT, payload, flags)


def sqli_check(payload: Column | str, flags: Column | int = 0, dictionary: Dictionary | None = None) -> Column:
    """Verdict, fingerprint, folded tokens and counts in one context."""

    def look(data: bytes, flags: int) -> dict:
        return _checked(*sqlscan.check(data, flags, load(dictionary)))

    return _applied(look, _CHECKED, CHECKED, payload, flags)


def sqli_fingerprint(payload: Column | str, flags: Column | int = 0, dictionary: Dictionary | None = None) -> Column:
    return _applied(lambda data, flags: sqlscan.Fold(data, flags, load(dictionary)).fingerprint, _S, "string", payload, flags)


def sqli_fold(payload: Column | str, flags: Column | int = 0, dictionary: Dictionary | None = None) -> Column:
    """At most five folded tokens."""
    return _applied(
        lambda data, flags: [t.row() for t in sqlscan.Fold(data, flags, load(dictionary)).tokens], pa.list_(_SQL_TOKEN), f"array<{SQL_TOKEN}>", payload, flags
    )


def sqli_tokens(payload: Column | str, flags: Column | int = 0, dictionary: Dictionary | None = None) -> Column:
    """All raw tokens."""
    return _applied(
        lambda data, flags: [t.row() for t in sqlscan.Lexer(data, flags, load(dictionary))], pa.list_(_SQL_TOKEN), f"array<{SQL_TOKEN}>", payload, flags
    )


def sqli_token_types(payload: Column | str, flags: Column | int = 0, dictionary: Dictionary | None = None) -> Column:
    """The types of all raw tokens, end to end."""
    return _applied(lambda data, flags: "".join(t.type for t in sqlscan.Lexer(data, flags, load(dictionary))), _S, "string", payload, flags)


def sqli_word_type(word: Column | str, dictionary: Dictionary | None = None) -> Column:
    """The type of a whole word or phrase in any case; ``n`` for one that isn't known."""
    return _applied(lambda data, _: load(dictionary).word(data), _S, "string", word, 0)


def sqli_passes(payload: Column | str, flags: Column | int = 0, dictionary: Dictionary | None = None) -> Column:
    """The contexts that were tried, in order: flags, verdict, fingerprint, folded tokens and counts."""
    kind = pa.list_(pa.struct([("flags", _I), *_CHECKED]))

    def look(data: bytes, flags: int) -> list[dict]:
        return [{"flags": f} | _checked(hit, fold) for f, hit, fold in sqlscan.passes(data, flags, load(dictionary))]

    return _applied(look, kind, f"array<{CHECKED.replace('<', '<flags:int,', 1)}>", payload, flags)


def detect_xss(payload: Column | str, dictionary: Dictionary | None = None) -> Column:
    """Verdict over all contexts, with the first context and rule that hit.

    A payload that ``may_be_xss`` rules out doesn't leave the JVM.
    """

    def look(data: bytes, _: int) -> dict:
        hit = htmlscan.detect(data, load(dictionary))
        found = {"context": htmlscan.CONTEXTS[hit[0]], "rule": hit[1], "pos": hit[2].pos} if hit else {}
        return {"injection_type": "XSS", "is_injection": hit is not None} | found

    payload = F.col(payload) if isinstance(payload, str) else payload
    safe = F.struct(F.lit("XSS").alias("injection_type"), F.lit(False).alias("is_injection"), *(F.lit(None).cast(k).alias(n) for n, k in (("context", "string"), ("rule", "string"), ("pos", "int"))))
    possible = may_be_xss(payload)
    return F.coalesce(_applied(look, _XSS, XSS, F.when(possible, payload.cast("binary")), 0), F.when(~possible, safe))


def xss_check(payload: Column | str, context: Column | int = htmlscan.DATA, dictionary: Dictionary | None = None) -> Column:
    """Verdict in one context."""
    return _applied(lambda data, context: htmlscan.first_hit(data, context, load(dictionary)) is not None, pa.bool_(), "boolean", payload, context)


def html5_tokens(payload: Column | str, context: Column | int = htmlscan.DATA) -> Column:
    """All tokens in one context."""
    return _applied(lambda data, context: [t.row() for t in htmlscan.Scanner(data, context)], pa.list_(_HTML_TOKEN), f"array<{HTML_TOKEN}>", payload, context)


def html_decode(payload: Column | str) -> Column:
    """Code of each character after numeric entities are decoded."""
    return _applied(lambda data, _: list(htmlscan.decoded(data)), pa.list_(_I), "array<int>", payload, 0)


def bad_url(payload: Column | str, dictionary: Dictionary | None = None) -> Column:
    return _applied(lambda data, _: htmlscan.bad_url(data, load(dictionary)), pa.bool_(), "boolean", payload, 0)


def version() -> Column:
    return F.lit(VERSION)


# Necessary conditions that the optimizer can push down: a payload without them is safe.


def may_be_sqli(payload: Column) -> Column:
    """False only where the payload is one plain word, which folds to one token."""
    return ~payload.cast("string").rlike("^[A-Za-z_]+$")


def may_be_xss(payload: Column) -> Column:
    """False only where there is neither a tag nor an attribute's value.

    Contexts that begin within a quoted value can reach a name, but a hit needs
    a tag, a comment or a value, and so ``<`` or ``=``.
    """
    return payload.cast("string").contains("<") | payload.cast("string").contains("=")


def register(spark: SparkSession, dictionary: Dictionary | None = None) -> None:
    """SQL functions of a binary payload: detect_sqli, sqli_fingerprint, sqli_tokens and sqli_fold (payload, flags), xss_check and html5_tokens (payload, context), siftstone_version()."""
    kernels = {
        "detect_sqli": _kernel(
            lambda data, flags: dict(zip(("is_injection", "fingerprint", "flags"), sqlscan.detect(data, flags, load(dictionary)))),
            pa.struct([("is_injection", pa.bool_()), ("fingerprint", _S), ("flags", _I)]),
            "struct<is_injection:boolean,fingerprint:string,flags:int>",
        ),
        "sqli_fingerprint": _kernel(lambda data, flags: sqlscan.Fold(data, flags, load(dictionary)).fingerprint, _S, "string"),
        "sqli_tokens": _kernel(
            lambda data, flags: [t.row() for t in sqlscan.Lexer(data, flags, load(dictionary))], pa.list_(_SQL_TOKEN), f"array<{SQL_TOKEN}>"
        ),
        "sqli_fold": _kernel(
            lambda data, flags: [t.row() for t in sqlscan.Fold(data, flags, load(dictionary)).tokens], pa.list_(_SQL_TOKEN), f"array<{SQL_TOKEN}>"
        ),
        "xss_check": _kernel(lambda data, context: htmlscan.first_hit(data, context, load(dictionary)) is not None, pa.bool_(), "boolean"),
        "html5_tokens": _kernel(lambda data, context: [t.row() for t in htmlscan.Scanner(data, context)], pa.list_(_HTML_TOKEN), f"array<{HTML_TOKEN}>"),
    }
    for name, kernel in kernels.items():
        spark.udf.register(name, kernel)
    spark.sql("drop temporary function if exists siftstone_version")
    spark.sql(f"create temporary function siftstone_version() returns string return '{VERSION}'")
