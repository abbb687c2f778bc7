"""Expressions to Spark columns.

Types are computed here, by PostgreSQL's rules, before a column is built: integer
division truncates and keeps its type, casts round, CHAR compares without its
padding. What is left to Spark is one column expression that Catalyst can fold,
prune and push down.
"""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import json_ops, patterns
from ..functions.registry import AGGREGATES, FUNCTIONS
from ..lang import ast
from ..lang.ast import DataType
from ..lang.errors import AnalysisError, Issue
from ..lang.parser import parse_expression
from .types import DECIMALS, FLOATS, INTS, MOMENTS, TEXTS, UNKNOWN, TypeMismatch, Typed, as_interval, cast, coerce, interval_micros, is_numeric, promoted, spark_type

BOOLEAN, TEXT, INT = DataType("boolean"), DataType("text"), DataType("int")
_COMPARE = {"=": "__eq__", "<>": "__ne__", "!=": "__ne__", "<": "__lt__", ">": "__gt__", "<=": "__le__", ">=": "__ge__"}
_REGEX = {"~": (False, False), "~*": (False, True), "!~": (True, False), "!~*": (True, True)}
_JSON = {"->": False, "->>": True, "#>": False, "#>>": True}


class Compiler:
    """Compiles against columns: name to type. The frame's columns bear the same names."""

    def __init__(self, columns: Mapping[str, DataType]):
        self.columns = columns

    def column(self, expr: ast.Expr | str) -> Column:
        return self.typed(expr).column

    def typed(self, expr: ast.Expr | str) -> Typed:
        if isinstance(expr, str):
            expr = parse_expression(expr)
        return getattr(self, "_" + type(expr).__name__.lower())(expr)

    # ------------------------------------------------------------ leaves
    def _literal(self, e: ast.Literal) -> Typed:
        if e.kind == "integer":
            n = int(e.text)
            kind = "int" if n < 1 << 31 else "bigint" if n < 1 << 63 else None
            if kind:
                return Typed(F.lit(n).cast(kind), DataType(kind))
        if e.kind in ("integer", "numeric"):
            return Typed(F.lit(Decimal(e.text if not e.text.endswith(".") else e.text[:-1])), DataType("numeric"))
        if e.kind == "boolean":
            return Typed(F.lit(e.text == "true"), BOOLEAN)
        return Typed(F.lit(e.text), UNKNOWN, e.text) if e.kind == "string" else Typed(F.lit(None), UNKNOWN)

    def _columnref(self, e: ast.ColumnRef) -> Typed:
        if e.name not in self.columns:
            raise AnalysisError([Issue("UnknownColumnReference", e.name)])
        return Typed(F.col("`" + e.name.replace("`", "``") + "`"), self.columns[e.name])

    def _call(self, e: ast.Call) -> Typed:
        name = e.name.lower()
        if name in AGGREGATES:
            raise AnalysisError([Issue("AggregateNotAllowed", name)])
        f = FUNCTIONS.get(name)
        if f is None or not f.least <= len(e.args) <= f.most:
            raise AnalysisError([Issue("UnknownFunction", name, f"with {len(e.args)} arguments")])
        args = [self.typed(a) for a in e.args]
        if f.result == "common":
            args, kind = self._common(args)
        else:
            args = [Typed(a.column, TEXT, a.text) if a.kind == "unknown" and a.text is not None else a for a in args]
            kind = (args[0].type if args else TEXT) if f.result == "first" else DataType(f.result)
        # the moment of date_part stands second
        kinds = [args[-1].kind if name == "date_part" else args[0].kind] if f.typed else []
        return Typed(f.make(*kinds, *[a.column for a in args]), kind)

    def _common(self, args: list[Typed]) -> tuple[list[Typed], DataType]:
        known = [a.type for a in args if a.kind != "unknown"]
        kind = known[0] if known else TEXT
        for t in known[1:]:
            if is_numeric(kind) and is_numeric(t):
                kind = promoted(kind, t)
        return [coerce(a, kind) for a in args], kind

    # ------------------------------------------------------------ operators
    def _unary(self, e: ast.Unary) -> Typed:
        x = self.typed(e.operand)
        if e.op == "not":
            return Typed(~coerce(x, BOOLEAN).column, BOOLEAN)
        if e.op == "~":
            if x.kind not in INTS:
                raise TypeMismatch(f"~ on {x.type}")
            return Typed(F.bitwise_not(x.column), x.type)
        if not is_numeric(x.type) and x.kind != "interval":
            raise TypeMismatch(f"{e.op} on {x.type}")
        return x if e.op == "+" else Typed(-x.column, x.type)

    def _binary(self, e: ast.Binary) -> Typed:
        a, b = self.typed(e.left), self.typed(e.right)
        if e.op in ("and", "or"):
            a, b = coerce(a, BOOLEAN).column, coerce(b, BOOLEAN).column
            return Typed(a & b if e.op == "and" else a | b, BOOLEAN)
        if e.op in _COMPARE:
            a, b = self._comparable(a, b)
            return Typed(getattr(a, _COMPARE[e.op])(b), BOOLEAN)
        if e.op in _REGEX:
            return self._regex(e.op, a, b)
        if e.op in _JSON:
            return self._member(e.op, a, b, e.right)
        if e.op in ("@>", "<@"):
            a, b = (a, b) if e.op == "@>" else (b, a)
            return Typed(json_ops.contains(a.column, b.column), BOOLEAN)
        if e.op == "||":
            if "jsonb" in (a.kind, b.kind):
                raise TypeMismatch("|| on JSONB is not supported")
            texts = [F.rtrim(x.column) if x.kind == "char" else x.column.cast("string") for x in (a, b)]
            return Typed(F.concat(*texts), TEXT)
        if e.op in ("&", "|", "#", "<<", ">>"):
            return self._bits(e.op, a, b)
        return self._arithmetic(e.op, a, b)

    def _comparable(self, a: Typed, b: Typed) -> tuple[Column, Column]:
        if a.kind == "unknown" and b.kind != "unknown":
            a = cast(a, b.type if b.kind not in TEXTS else TEXT)
        elif b.kind == "unknown" and a.kind != "unknown":
            b = cast(b, a.type if a.kind not in TEXTS else TEXT)
        if "json" in (a.kind, b.kind):
            raise TypeMismatch("JSON has no comparison; use JSONB")
        sides = [F.rtrim(x.column) if "char" in (a.kind, b.kind) and x.kind in TEXTS else interval_micros(x.column) if x.kind == "interval" else x.column for x in (a, b)]
        groups = [("number" if is_numeric(x.type) else "text" if x.kind in TEXTS else "moment" if x.kind in MOMENTS else x.kind) for x in (a, b)]
        if groups[0] != groups[1] and "unknown" not in groups:
            raise TypeMismatch(f"{a.type} does not compare with {b.type}")
        return sides[0], sides[1]

    def _arithmetic(self, op: str, a: Typed, b: Typed) -> Typed:
        if "interval" in (a.kind, b.kind) or a.kind in MOMENTS or b.kind in MOMENTS:
            return self._moments(op, a, b)
        a, b = (coerce(a, b.type), b) if a.kind == "unknown" else (a, coerce(b, a.type))
        if not (is_numeric(a.type) and is_numeric(b.type)):
            raise TypeMismatch(f"{a.type} {op} {b.type}")
        kind = promoted(a.type, b.type)
        if op == "^":
            power = F.pow(a.column.cast("double"), b.column.cast("double"))
            return Typed(power.cast("decimal(38,18)"), kind) if kind.name in DECIMALS else Typed(power, DataType("double precision"))
        if kind.name in (*INTS, *FLOATS):
            x, y = a.column.cast(spark_type(kind)), b.column.cast(spark_type(kind))
        else:
            x, y = a.column, b.column
        if op == "/" and kind.name in INTS:
            return Typed(F.call_function("div", x, y).cast(spark_type(kind)), kind)
        out = {"+": x.__add__, "-": x.__sub__, "*": x.__mul__, "/": x.__truediv__, "%": x.__mod__}[op](y)
        return Typed(out.cast(spark_type(kind)) if kind.name in (*INTS, *FLOATS) else out, kind)

    def _moments(self, op: str, a: Typed, b: Typed) -> Typed:
        interval = DataType("interval")
        if a.kind in MOMENTS and b.kind == "unknown":
            b = cast(b, interval if op == "+" else a.type)
        if op == "+" and b.kind in MOMENTS and a.kind not in MOMENTS:
            a, b = b, a
        if a.kind == "date" and b.kind in INTS and op in "+-":
            days = b.column.cast("int")
            return Typed(F.date_add(a.column, days if op == "+" else -days), a.type)
        if a.kind in MOMENTS and b.kind == "interval" and op in "+-":
            moment = a.column.cast("timestamp_ntz") if a.kind == "date" else a.column
            span = as_interval(b.column)
            return Typed(moment + span if op == "+" else moment - span, DataType("timestamp") if a.kind == "date" else a.type)
        if a.kind == b.kind == "date" and op == "-":
            return Typed(F.datediff(a.column, b.column), INT)
        if a.kind in MOMENTS and b.kind in MOMENTS and op == "-":
            micros = F.unix_micros(a.column.cast("timestamp")) - F.unix_micros(b.column.cast("timestamp"))
            day = F.lit(86_400_000_000)
            days = F.when(micros < 0, -F.floor(-micros / day)).otherwise(F.floor(micros / day)).cast("int")
            return Typed(F.struct(F.lit(0).alias("months"), days.alias("days"), (micros - days.cast("long") * day).alias("micros")), interval)
        if a.kind == b.kind == "interval" and op in "+-":
            sign = 1 if op == "+" else -1
            return Typed(F.struct(*[(a.column[k] + sign * b.column[k]).alias(k) for k in ("months", "days", "micros")]), interval)
        raise TypeMismatch(f"{a.type} {op} {b.type}")

    def _bits(self, op: str, a: Typed, b: Typed) -> Typed:
        if a.kind not in INTS or b.kind not in INTS:
            raise TypeMismatch(f"{a.type} {op} {b.type}")
        if op in ("<<", ">>"):
            shift = F.call_function("shiftleft" if op == "<<" else "shiftright", a.column, b.column.cast("int"))
            return Typed(shift, a.type)
        kind = promoted(a.type, b.type)
        name = {"&": "bitwiseAND", "|": "bitwiseOR", "#": "bitwiseXOR"}[op]
        return Typed(getattr(a.column.cast(spark_type(kind)), name)(b.column.cast(spark_type(kind))), kind)

    def _regex(self, op: str, a: Typed, b: Typed) -> Typed:
        negated, fold = _REGEX[op]
        pattern = F.lit(patterns.posix_literal(b.text)) if b.text is not None else patterns.posix_column(b.column)
        pattern = F.concat(F.lit("(?i)"), pattern) if fold else pattern
        found = F.rlike(a.column, pattern)
        return Typed(~found if negated else found, BOOLEAN)

    def _member(self, op: str, a: Typed, b: Typed, right: ast.Expr) -> Typed:
        kind = TEXT if _JSON[op] else a.type if a.kind in ("json", "jsonb") else DataType("json")
        if op.startswith("#"):
            if b.text is None:
                raise TypeMismatch(f"{op} takes a literal path")
            steps = [int(s) if s.lstrip("-").isdigit() else s for s in json_ops.text_array(b.text)]
            return Typed(json_ops.get(a.column, steps, as_text=_JSON[op]), kind)
        if b.text is not None:
            return Typed(json_ops.get(a.column, [b.text], as_text=_JSON[op]), kind)
        index = b.kind in INTS
        if index and isinstance(right, ast.Literal):
            return Typed(json_ops.get(a.column, [int(right.text)], as_text=_JSON[op]), kind)
        return Typed(json_ops.get_dynamic(a.column, F.array(b.column.cast("string")), as_text=_JSON[op], indexes=[index]), kind)

    def _cast(self, e: ast.Cast) -> Typed:
        return cast(self.typed(e.operand), e.type)

    # ------------------------------------------------------------ predicates
    def _between(self, e: ast.Between) -> Typed:
        low = self._binary(ast.Binary(">=", e.operand, e.low)).column
        inside = low & self._binary(ast.Binary("<=", e.operand, e.high)).column
        return Typed(~inside if e.negated else inside, BOOLEAN)

    def _inlist(self, e: ast.InList) -> Typed:
        pairs = [self._comparable(self.typed(e.operand), self.typed(i)) for i in e.items]
        left = pairs[0][0]
        found = left.isin(*[p[1] for p in pairs]) if len({str(p[0]) for p in pairs}) == 1 else self._any([a == b for a, b in pairs])
        return Typed(~found if e.negated else found, BOOLEAN)

    @staticmethod
    def _any(columns: list[Column]) -> Column:
        out = columns[0]
        for c in columns[1:]:
            out = out | c
        return out

    def _like(self, e: ast.Like) -> Typed:
        a, b = self.typed(e.operand), self.typed(e.pattern)
        if e.kind == "similar":
            pattern = F.lit(patterns.similar_regex(b.text)) if b.text is not None else patterns.similar_column(b.column)
            found = F.rlike(a.column, pattern)
        else:
            pattern = F.lit(patterns.like_literal(b.text)) if b.text is not None else patterns.like_column(b.column)
            found = F.call_function(e.kind, a.column, pattern)
        return Typed(~found if e.negated else found, BOOLEAN)

    def _is(self, e: ast.Is) -> Typed:
        x = self.typed(e.operand)
        found = x.column.isNull() if e.what == "null" else coerce(x, BOOLEAN).column.eqNullSafe(F.lit(e.what == "true"))
        return Typed(~found if e.negated else found, BOOLEAN)

    def _isdistinct(self, e: ast.IsDistinct) -> Typed:
        a, b = self._comparable(self.typed(e.left), self.typed(e.right))
        same = a.eqNullSafe(b)
        return Typed(same if e.negated else ~same, BOOLEAN)
