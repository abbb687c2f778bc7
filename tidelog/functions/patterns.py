"""LIKE, SIMILAR TO and POSIX patterns in Java regular-expression terms.

Literal patterns are translated once, on the driver. Patterns that come from a
column are rewritten with built-in functions where one pass can do it, and with an
Arrow UDF for SIMILAR TO.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: POSIX classes and escapes with their Java counterparts.
POSIX = {"[:alnum:]": "\\p{Alnum}", "[:alpha:]": "\\p{Alpha}", "[:blank:]": "\\p{Blank}", "[:cntrl:]": "\\p{Cntrl}", "[:digit:]": "\\p{Digit}", "[:graph:]": "\\p{Graph}", "[:lower:]": "\\p{Lower}", "[:print:]": "\\p{Print}", "[:punct:]": "\\p{Punct}", "[:space:]": "\\s", "[:upper:]": "\\p{Upper}", "[:xdigit:]": "\\p{XDigit}", "\\m": "\\b(?=\\w)", "\\M": "\\b(?<=\\w)", "\\y": "\\b", "\\Y": "\\B"}
_LITERAL_IN_SIMILAR = ".^$"


def like_literal(pattern: str) -> str:
    """A backslash quotes any character; Spark allows it before %, _ and itself only."""
    out, chars = [], iter(pattern)
    for c in chars:
        if c != "\\":
            out.append(c)
            continue
        quoted = next(chars, None)
        if quoted is None:
            raise ValueError("LIKE pattern must not end with an escape character")
        out.append("\\" + quoted if quoted in "%_\\" else quoted)
    return "".join(out)


def like_column(pattern: Column) -> Column:
    return F.regexp_replace(pattern, r"(\\[%_\\])|\\(.)", "$1$2")


def similar_regex(pattern: str | None) -> str | None:
    """SQL regular expression to an anchored Java one."""
    if pattern is None:
        return None
    out, chars, bracket = [], iter(pattern), False
    for c in chars:
        if c == "\\":
            quoted = next(chars, "\\")
            out.append(quoted if quoted.isalnum() or quoted == "_" else "\\" + quoted)
        elif bracket:
            bracket = c != "]"
            out.append(c)
        elif c == "[":
            bracket = True
            out.append(c)
        else:
            out.append({"%": ".*", "_": "."}.get(c, "\\" + c if c in _LITERAL_IN_SIMILAR else c))
    return posix_literal("(?s)^(?:" + "".join(out) + ")$")


def similar_column(pattern: Column) -> Column:
    @F.pandas_udf("string")
    def translate(patterns: pd.Series) -> pd.Series:
        known = {p: similar_regex(p) for p in patterns.dropna().unique()}
        return patterns.map(known)

    return translate(pattern)


def posix_literal(pattern: str) -> str:
    for name, java in POSIX.items():
        pattern = pattern.replace(name, java)
    return pattern


def posix_column(pattern: Column) -> Column:
    for name, java in POSIX.items():
        pattern = F.replace(pattern, F.lit(name), F.lit(java))
    return pattern
