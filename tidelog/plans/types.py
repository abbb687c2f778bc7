"""Types of the language: Spark types, promotion and casts with PostgreSQL's results."""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import json_ops
from ..lang.ast import DataType

INTS = ("smallint", "int", "integer", "bigint")
DECIMALS = ("decimal", "numeric")
FLOATS = ("real", "double precision")
TEXTS = ("char", "varchar", "text")
MOMENTS = ("date", "timestamp", "timestamptz")
UNKNOWN = DataType("unknown")
INTERVAL = "struct<months:int,days:int,micros:bigint>"
#: Spark spelling of types without parameters.
SPARK = {"smallint": "smallint", "int": "int", "integer": "int", "bigint": "bigint", "real": "float", "double precision": "double", "boolean": "boolean", "char": "string", "varchar": "string", "text": "string", "date": "date", "time": "time(6)", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "interval": INTERVAL, "json": "string", "jsonb": "string", "uuid": "string", "unknown": "string"}
_RANK = {"smallint": 0, "int": 1, "integer": 1, "bigint": 2, "decimal": 3, "numeric": 3, "real": 4, "double precision": 5}
#: Texts that cast to a boolean.
TRUE_TEXTS, FALSE_TEXTS = ("t", "tr", "tru", "true", "y", "ye", "yes", "on", "1"), ("f", "fa", "fal", "fals", "false", "n", "no", "of", "off", "0")
_INTERVAL_UNITS = {"microsecond": (0, 0, 1), "millisecond": (0, 0, 1000), "second": (0, 0, 1_000_000), "sec": (0, 0, 1_000_000), "minute": (0, 0, 60_000_000), "min": (0, 0, 60_000_000), "hour": (0, 0, 3_600_000_000), "day": (0, 1, 0), "week": (0, 7, 0), "month": (1, 0, 0), "mon": (1, 0, 0), "year": (12, 0, 0)}


class TypeMismatch(ValueError):
    pass


@dataclass(frozen=True)
class Typed:
    column: Column
    type: DataType
    text: str | None = None  # of a string literal

    @property
    def kind(self) -> str:
        return self.type.name


def spark_type(t: DataType) -> str:
    if t.name in DECIMALS:
        if not t.args:
            return "decimal(38,18)"
        if t.args[0] > 38:
            raise TypeMismatch(f"{t}: precision above 38 is not supported")
        return f"decimal({t.args[0]},{t.args[1] if len(t.args) > 1 else 0})"
    return SPARK[t.name]


def is_numeric(t: DataType) -> bool:
    return t.name in _RANK


def promoted(a: DataType, b: DataType) -> DataType:
    """The numeric type that holds both; a decimal beside a float becomes a double."""
    hi = max(a, b, key=lambda t: _RANK[t.name])
    lo = min(a, b, key=lambda t: _RANK[t.name])
    if hi.name == "real" and lo.name != "real":
        return DataType("double precision")
    return DataType("numeric") if hi.name in DECIMALS else DataType("int") if hi.name == "integer" else hi


def parse_interval(text: str) -> tuple[int, int, int]:
    """(months, days, microseconds) of texts such as '1 day 02:30:00' or '2 months -3 hours'."""
    months = days = micros = 0
    rest = text.strip().lower()
    for number, unit in re.findall(r"([+-]?\d+(?:\.\d+)?)\s*([a-z]+)", rest):
        parts = _INTERVAL_UNITS.get(unit) or _INTERVAL_UNITS.get(unit.rstrip("s"))
        if not parts:
            raise TypeMismatch(f"invalid interval {text!r}")
        n = Decimal(number)
        months, days, micros = months + int(n * parts[0]), days + int(n * parts[1]), micros + int(n * parts[2])
    if m := re.search(r"([+-]?)(\d+):(\d+)(?::(\d+(?:\.\d+)?))?", rest):
        span = int((int(m[2]) * 3600 + int(m[3]) * 60 + Decimal(m[4] or 0)) * 1_000_000)
        micros += -span if m[1] == "-" else span
    elif not re.search(r"\d\s*[a-z]", rest):
        raise TypeMismatch(f"invalid interval {text!r}")
    return months, days, micros


def interval_literal(text: str) -> Column:
    months, days, micros = parse_interval(text)
    return F.struct(F.lit(months).cast("int").alias("months"), F.lit(days).cast("int").alias("days"), F.lit(micros).cast("bigint").alias("micros"))


def interval_micros(interval: Column) -> Column:
    """For comparison: months of 30 days, days of 24 hours."""
    days = (interval["months"].cast("bigint") * 30 + interval["days"]) * 86_400_000_000
    return days + interval["micros"]


def as_interval(interval: Column) -> Column:
    return F.make_interval(F.lit(0), interval["months"], F.lit(0), interval["days"], F.lit(0), F.lit(0), (interval["micros"] / F.lit(1_000_000)).cast("decimal(18,6)"))


def cast(value: Typed, to: DataType) -> Typed:
    """An explicit cast; results are PostgreSQL's, errors Spark's (ANSI)."""
    column, source = value.column, value.type
    kind = spark_type(to)
    if source.name == "unknown" and value.text is None:
        return Typed(F.lit(None).cast(kind), to)
    if to.name in INTS:
        if source.name in DECIMALS:
            column = F.round(column)
        elif source.name in FLOATS:
            column = F.rint(column)
        elif source.name == "boolean" or source.name in (*TEXTS, "unknown"):
            column = F.trim(column) if source.name != "boolean" else column
    elif to.name == "boolean" and source.name in (*TEXTS, "unknown"):
        word = F.lower(F.trim(column))
        column = F.when(word.isin(*TRUE_TEXTS), True).when(word.isin(*FALSE_TEXTS), False).when(word.isNotNull(), F.raise_error(F.concat(F.lit("invalid boolean: "), column)).cast("boolean"))
        return Typed(column, to)
    elif to.name in TEXTS:
        text = F.rtrim(column) if source.name == "char" and to.name != "char" else column.cast("string")
        length = to.args[0] if to.args else 1 if to.name == "char" else None
        if length is not None:
            text = F.substring(text, 1, length)
            text = F.rpad(text, length, " ") if to.name == "char" else text
        return Typed(text, to, value.text if to.name == "text" else None)
    elif to.name == "interval":
        if source.name == "interval":
            return Typed(column, to)
        if value.text is None:
            raise TypeMismatch("only literals cast to INTERVAL")
        return Typed(interval_literal(value.text), to)
    elif to.name == "jsonb" and source.name != "jsonb":
        return Typed(json_ops.canonical(column), to)
    elif to.name == "json":
        checked = F.when(column.isNull() | F.try_parse_json(column).isNotNull(), column)
        return Typed(F.coalesce(checked, F.when(column.isNotNull(), F.raise_error(F.lit("invalid JSON")).cast("string"))), to)
    elif to.name == "uuid":
        plain = F.lower(F.regexp_replace(column, "[{}]", ""))
        fine = plain.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
        return Typed(F.when(column.isNull() | fine, plain).otherwise(F.raise_error(F.concat(F.lit("invalid uuid: "), column)).cast("string")), to)
    return Typed(column.cast(kind), to)


def coerce(value: Typed, to: DataType) -> Typed:
    """An untyped literal takes the type that its place asks for; other values stay."""
    return cast(value, to) if value.kind == "unknown" else value
