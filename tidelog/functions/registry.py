"""Scalar functions by their PostgreSQL names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Function:
    make: Callable[..., Column]
    least: int
    most: int
    result: str  # a type name, or "first" / "common" (of the arguments)
    typed: bool = False  # make takes the kind of its first argument before the arguments


def _substr(s: Column, start: Column, n: Column | None = None) -> Column:
    """Positions before 1 count towards the length, as in PostgreSQL."""
    if n is None:
        return F.substr(s, F.greatest(start, F.lit(1)))
    end = start + n
    return F.substr(s, F.greatest(start, F.lit(1)), F.greatest(end - F.greatest(start, F.lit(1)), F.lit(0)))


def _trim(how: Callable) -> Callable:
    return lambda s, chars=None: how(s, F.lit(" ") if chars is None else chars)


def _round(kind: str, x: Column, n: Column | None = None) -> Column:
    """Halves of floating-point numbers go to the even neighbour, those of exact numbers away from zero."""
    if n is not None:
        return F.round(x, n)
    return F.rint(x) if kind in ("real", "double precision") else F.round(x)


def _defined(make: Callable[[Column], Column], wrong: Callable[[Column], Column], message: str) -> Callable[[Column], Column]:
    """A function that fails on values for which it has no result."""
    return lambda x: F.when(wrong(x), F.raise_error(F.lit(message))).otherwise(make(x))


def _date_part(kind: str, what: Column, t: Column) -> Column:
    """A field of a moment by its PostgreSQL name."""
    if kind in ("interval", "time"):
        return F.date_part(what, t).cast("double")
    at = t.cast("timestamp")
    seconds = F.date_part(F.lit("second"), at).cast("double")
    year = F.year(at)
    fields = {
        "year": year,
        "month": F.month(at),
        "day": F.day(at),
        "hour": F.hour(at),
        "minute": F.minute(at),
        "second": seconds,
        "milliseconds": seconds * 1000,
        "microseconds": seconds * 1_000_000,
        "dow": F.dayofweek(at) - 1,
        "isodow": F.weekday(at) + 1,
        "doy": F.dayofyear(at),
        "week": F.weekofyear(at),
        "isoyear": F.date_part(F.lit("yearofweek"), at),
        "quarter": F.quarter(at),
        "decade": F.floor(year / 10),
        "century": F.ceil(year / 100),
        "millennium": F.ceil(year / 1000),
        "epoch": F.unix_micros(at) / 1_000_000,
    }
    name = F.lower(what)
    out = F.when(name.isNull() | t.isNull(), F.lit(None).cast("double"))
    for field, value in fields.items():
        out = out.when(name == field, value.cast("double"))
    return out.otherwise(F.raise_error(F.concat(F.lit("unit not recognized: "), what)))


def _trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


FUNCTIONS: dict[str, Function] = {
    "coalesce": Function(F.coalesce, 1, 99, "common"),
    "nullif": Function(F.nullif, 2, 2, "first"),
    "greatest": Function(lambda *a: F.greatest(*a) if len(a) > 1 else a[0], 1, 99, "common"),
    "least": Function(lambda *a: F.least(*a) if len(a) > 1 else a[0], 1, 99, "common"),
    "lower": Function(F.lower, 1, 1, "text"),
    "upper": Function(F.upper, 1, 1, "text"),
    "length": Function(F.length, 1, 1, "int"),
    "char_length": Function(F.length, 1, 1, "int"),
    "octet_length": Function(F.octet_length, 1, 1, "int"),
    "btrim": Function(_trim(F.btrim), 1, 2, "text"),
    "trim": Function(_trim(F.btrim), 1, 2, "text"),
    "ltrim": Function(_trim(F.ltrim), 1, 2, "text"),
    "rtrim": Function(_trim(F.rtrim), 1, 2, "text"),
    "substr": Function(_substr, 2, 3, "text"),
    "substring": Function(_substr, 2, 3, "text"),
    "left": Function(lambda s, n: F.when(n >= 0, F.left(s, n)).otherwise(F.left(s, F.greatest(F.length(s) + n, F.lit(0)))), 2, 2, "text"),
    "right": Function(lambda s, n: F.when(n >= 0, F.right(s, n)).otherwise(F.right(s, F.greatest(F.length(s) + n, F.lit(0)))), 2, 2, "text"),
    "replace": Function(F.replace, 3, 3, "text"),
    "concat": Function(lambda *a: F.concat(*[F.coalesce(x.cast("string"), F.lit("")) for x in a]), 1, 99, "text"),
    "strpos": Function(F.instr, 2, 2, "int"),
    "lpad": Function(lambda s, n, p=None: F.lpad(s, n, F.lit(" ") if p is None else p), 2, 3, "text"),
    "rpad": Function(lambda s, n, p=None: F.rpad(s, n, F.lit(" ") if p is None else p), 2, 3, "text"),
    "md5": Function(F.md5, 1, 1, "text"),
    "starts_with": Function(F.startswith, 2, 2, "boolean"),
    "reverse": Function(F.reverse, 1, 1, "text"),
    "repeat": Function(F.repeat, 2, 2, "text"),
    "split_part": Function(F.split_part, 3, 3, "text"),
    "abs": Function(F.abs, 1, 1, "first"),
    "ceil": Function(F.ceil, 1, 1, "first"),
    "floor": Function(F.floor, 1, 1, "first"),
    "round": Function(_round, 1, 2, "first", typed=True),
    "trunc": Function(_trunc, 1, 1, "first"),
    "sqrt": Function(_defined(F.sqrt, lambda x: x < 0, "cannot take square root of a negative number"), 1, 1, "double precision"),
    "power": Function(F.pow, 2, 2, "double precision"),
    "exp": Function(F.exp, 1, 1, "double precision"),
    "ln": Function(_defined(F.ln, lambda x: x <= 0, "cannot take logarithm of zero or a negative number"), 1, 1, "double precision"),
    "sign": Function(F.sign, 1, 1, "double precision"),
    "mod": Function(lambda a, b: a % b, 2, 2, "common"),
    "now": Function(F.current_timestamp, 0, 0, "timestamptz"),
    "clock_timestamp": Function(lambda: F.call_function("reflect", F.lit("java.time.Instant"), F.lit("now")).cast("timestamp"), 0, 0, "timestamptz"),
    "to_timestamp": Function(lambda s: F.timestamp_micros(F.round(s.cast("double") * 1_000_000).cast("long")), 1, 1, "timestamptz"),
    "date_trunc": Function(lambda what, t: F.call_function("date_trunc", what, t), 2, 2, "timestamptz"),
    "date_part": Function(_date_part, 2, 2, "double precision", typed=True),
    "make_date": Function(F.make_date, 3, 3, "date"),
    "jsonb_array_length": Function(F.json_array_length, 1, 1, "int"),
    "jsonb_typeof": Function(lambda j: _json_type(j), 1, 1, "text"),
}
#: Aggregates are no scalar functions; a stream's expressions may not call them.
AGGREGATES = frozenset("count sum avg min max string_agg array_agg bool_and bool_or".split())


def _json_type(document: Column) -> Column:
    first = F.substring(F.ltrim(document), 1, 1)
    names = F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null")
    return F.when(document.isNotNull(), names.otherwise("number"))
