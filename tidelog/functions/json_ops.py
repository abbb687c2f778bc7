"""JSON operators on text columns that hold JSON.

Members are given in the document's own spelling (1.10 stays 1.10, spaces and key order
stay), which none of Spark's JSON functions does, so access runs in Arrow UDFs, as
containment does.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Step = str | int


def text_array(literal: str) -> list[str]:
    """Elements of a text array literal such as {a,b,0}; double quotes may enclose one."""
    body = literal.strip()
    if not (body.startswith("{") and body.endswith("}")):
        raise ValueError(f"malformed array literal {literal!r}")
    out, current, quoted, chars = [], "", False, iter(body[1:-1])
    for c in chars:
        if c == "\\":
            current += next(chars, "")
        elif c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            out.append(current)
            current = ""
        else:
            current += c
    return [*out, current] if body[1:-1] else []


_DECODER = json.JSONDecoder()
_SPACES = " \t\n\r"


def _after(text: str, at: int) -> int:
    while at < len(text) and text[at] in _SPACES:
        at += 1
    return at


def _members(text: str, at: int) -> dict | list | None:
    """(from, to) of every member's text in the object or array at a place; of equal keys the last. None: neither."""
    if text[at] not in "{[":
        return None
    close, out = ("}", {}) if text[at] == "{" else ("]", [])
    at = _after(text, at + 1)
    while text[at] != close:
        if close == "}":
            key, at = json.decoder.scanstring(text, at + 1)
            at = _after(text, _after(text, at) + 1)
        end = _DECODER.raw_decode(text, at)[1]
        if close == "}":
            out[key] = (at, end)
        else:
            out.append((at, end))
        at = _after(text, end)
        at = _after(text, at + 1) if text[at] == "," else at
    return out


def _spelled(document: str, steps: list[Step]) -> str:
    """The text of a member that is there."""
    at, end = _after(document, 0), len(document.rstrip(_SPACES))
    for s in steps:
        members = _members(document, at)
        at, end = members[int(s)] if isinstance(members, list) else members[s]
    return document[at:end]


def walk(document: str | None, steps: list[Step], as_text: bool) -> str | None:
    """What PostgreSQL's member operators give, in the document's own spelling; a number-like step indexes an array."""
    if document is None or any(s is None for s in steps):
        return None
    value = json.loads(document)
    for s in steps:
        if isinstance(value, list):
            if isinstance(s, str) and not s.lstrip("-").isdigit() or not -len(value) <= int(s) < len(value):
                return None
            value = value[int(s)]
        elif isinstance(value, dict) and isinstance(s, str) and s in value:
            value = value[s]
        else:
            return None
    # values with one spelling need no search for it
    if value is None:
        return None if as_text else "null"
    if isinstance(value, str):
        return value if as_text else f'"{value}"' if "\\" not in document else _spelled(document, steps)
    if isinstance(value, int) and value:
        return "true" if value is True else str(value)
    return _spelled(document, steps)


def get(document: Column, steps: list[Step], *, as_text: bool) -> Column:
    """-> and #> (as_text False), ->> and #>> (True), with known steps."""
    return get_dynamic(document, F.array(*[F.lit(str(s)) for s in steps]), as_text=as_text, indexes=[isinstance(s, int) for s in steps])


def get_dynamic(document: Column, steps: Column, *, as_text: bool, indexes: list[bool] | None = None) -> Column:
    @F.pandas_udf("string")
    def run(documents: pd.Series, keys: pd.Series) -> pd.Series:
        def one(d: str | None, k: object) -> str | None:
            if d is None or k is None:
                return None
            return walk(d, [int(s) if indexes and indexes[i] and s is not None else s for i, s in enumerate(k)], as_text)

        return pd.Series([one(d, k) for d, k in zip(documents, keys, strict=True)], dtype=object)

    return run(document, steps)


def contains_value(a: object, b: object, top: bool = True) -> bool:
    """JSONB containment: objects by member, arrays by element in any order; at the top an array contains a bare element."""
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and contains_value(a[k], v, False) for k, v in b.items())
    if isinstance(a, list) and isinstance(b, list):
        return all(any(contains_value(x, y, False) for x in a) for y in b)
    if isinstance(a, list) and top and not isinstance(b, dict):
        return any(contains_value(x, b, False) for x in a)
    return type(a) is type(b) and a == b or (a == b and not isinstance(a, bool) and not isinstance(b, bool) and isinstance(a, int | float) and isinstance(b, int | float))


def contains(container: Column, part: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known = {x: json.loads(x) for x in pd.concat([a, b]).dropna().unique()}
        return pd.Series([None if x is None or y is None else contains_value(known[x], known[y]) for x, y in zip(a, b, strict=True)], dtype=object)

    return run(container, part)


def canonical(document: Column) -> Column:
    """JSONB text: keys sorted, the last of equal keys kept, no spare white space."""

    @F.pandas_udf("string")
    def run(documents: pd.Series) -> pd.Series:
        return documents.map(lambda d: None if d is None else json.dumps(json.loads(d), sort_keys=True, separators=(",", ":"), ensure_ascii=False))

    return run(document)
