"""Syntax trees; positions are not part of them, so equal text with other spacing gives equal trees."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class DataType:
    name: str
    args: tuple[int, ...] = ()

    def __str__(self) -> str:
        return self.name + (f"({', '.join(map(str, self.args))})" if self.args else "")


class Expr:
    """Any scalar expression."""


@dataclass(frozen=True)
class Literal(Expr):
    kind: str  # integer, numeric, string, boolean, null
    text: str = ""


@dataclass(frozen=True)
class ColumnRef(Expr):
    name: str


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class Unary(Expr):
    op: str  # + - ~ not
    operand: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Cast(Expr):
    operand: Expr
    type: DataType


@dataclass(frozen=True)
class Between(Expr):
    operand: Expr
    low: Expr
    high: Expr
    negated: bool = False


@dataclass(frozen=True)
class InList(Expr):
    operand: Expr
    items: tuple[Expr, ...]
    negated: bool = False


@dataclass(frozen=True)
class Like(Expr):
    kind: str  # like, ilike, similar
    operand: Expr
    pattern: Expr
    negated: bool = False


@dataclass(frozen=True)
class Is(Expr):
    operand: Expr
    what: str  # null, true, false
    negated: bool = False


@dataclass(frozen=True)
class IsDistinct(Expr):
    left: Expr
    right: Expr
    negated: bool = False


@dataclass(frozen=True)
class Check:
    name: str
    predicate: Expr


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: DataType
    optional: bool = False
    default: Expr | None = None
    generated: Expr | None = None
    storage: str | None = None  # stored, virtual
    checks: tuple[Check, ...] = ()


@dataclass(frozen=True)
class CreateStream:
    name: str
    columns: tuple[ColumnDef, ...] = ()
    checks: tuple[Check, ...] = ()
    elements: tuple[ColumnDef | Check, ...] = ()  # columns and checks as they were written


@dataclass(frozen=True)
class AddColumn:
    column: ColumnDef


@dataclass(frozen=True)
class DropColumn:
    name: str


@dataclass(frozen=True)
class AlterType:
    name: str
    type: DataType


@dataclass(frozen=True)
class AddConstraint:
    check: Check


@dataclass(frozen=True)
class DropConstraint:
    name: str


Action = AddColumn | DropColumn | AlterType | AddConstraint | DropConstraint


@dataclass(frozen=True)
class AlterStream:
    name: str
    actions: tuple[Action, ...] = ()


class Default:
    """The bare DEFAULT of a value row."""

    def __repr__(self) -> str:
        return "DEFAULT"


DEFAULT = Default()


@dataclass(frozen=True)
class Returning:
    star: bool = False
    expr: Expr | None = None
    alias: str | None = None


@dataclass(frozen=True)
class Insert:
    stream: str
    columns: tuple[str, ...]
    rows: tuple[tuple[Expr | Default, ...], ...]
    on_conflict_do_nothing: bool = False
    returning: tuple[Returning, ...] = field(default=())


Statement = CreateStream | AlterStream | Insert


def column_refs(expr: object) -> list[str]:
    """Names of the columns that an expression reads, in order of appearance."""
    if isinstance(expr, ColumnRef):
        return [expr.name]
    if isinstance(expr, tuple):
        return [n for e in expr for n in column_refs(e)]
    if isinstance(expr, Expr):
        return [n for v in vars(expr).values() for n in column_refs(v)]
    return []
