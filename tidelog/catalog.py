"""Catalog: immutable schemas of streams, with physical column ids for evolution."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from .lang import ast
from .lang.ast import Check, ColumnDef, DataType
from .plans.types import spark_type

SYSTEM_PREFIX = "_sys_"
HLC, HLC_TIMESTAMP, HLC_COUNT, HLC_NODE, CREATED = (SYSTEM_PREFIX + n for n in ("hlc", "hlc_timestamp", "hlc_count", "hlc_node_id", "created_at"))
#: Every stream starts with these, in this order.
SYSTEM_COLUMNS = (
    ColumnDef(HLC, DataType("char", (15,))),
    ColumnDef(HLC_TIMESTAMP, DataType("timestamptz")),
    ColumnDef(HLC_COUNT, DataType("integer")),
    ColumnDef(HLC_NODE, DataType("integer")),
    ColumnDef(CREATED, DataType("timestamptz"), default=ast.Call("clock_timestamp")),
)
SYSTEM_NAMES = tuple(c.name for c in SYSTEM_COLUMNS)


@dataclass(frozen=True)
class Field:
    """A user column with its id; a dropped and re-added name gets a new one."""

    id: int
    column: ColumnDef

    @property
    def physical(self) -> str:
        return f"c{self.id}"


@dataclass(frozen=True)
class StreamSchema:
    name: str
    fields: tuple[Field, ...] = ()
    checks: tuple[Check, ...] = ()
    next_id: int = 1
    hashes: tuple[str, ...] = ()

    @property
    def columns(self) -> tuple[ColumnDef, ...]:
        return tuple(f.column for f in self.fields)

    def column(self, name: str) -> ColumnDef | None:
        return next((c for c in self.columns if c.name == name), None)

    @property
    def types(self) -> dict[str, DataType]:
        return {c.name: c.type for c in (*SYSTEM_COLUMNS, *self.columns)}

    @property
    def user_types(self) -> dict[str, DataType]:
        return {c.name: c.type for c in self.columns}

    @property
    def all_checks(self) -> tuple[Check, ...]:
        return self.checks + tuple(k for c in self.columns for k in c.checks)

    def struct(self) -> T.StructType:
        """Spark schema with default and generated expressions as metadata."""
        out = T.StructType()
        for c in (*SYSTEM_COLUMNS, *self.columns):
            notes = {k: repr(v) for k, v in (("default", c.default), ("generated", c.generated)) if v is not None} | {"type": str(c.type)}
            out.add(T.StructField(c.name, T.DataType.fromDDL(spark_type(c.type)), c.optional or c.generated is not None, notes))
        return out

    def with_column(self, column: ColumnDef) -> StreamSchema:
        return replace(self, fields=(*self.fields, Field(self.next_id, column)), next_id=self.next_id + 1)

    def without_column(self, name: str) -> StreamSchema:
        return replace(self, fields=tuple(f for f in self.fields if f.column.name != name))

    def retyped(self, name: str, kind: DataType) -> StreamSchema:
        return replace(self, fields=tuple(replace(f, column=replace(f.column, type=kind)) if f.column.name == name else f for f in self.fields))

    def without_check(self, name: str) -> StreamSchema:
        kept = tuple(replace(f, column=replace(f.column, checks=tuple(k for k in f.column.checks if k.name != name))) for f in self.fields)
        return replace(self, fields=kept, checks=tuple(k for k in self.checks if k.name != name))


@dataclass(frozen=True)
class Catalog:
    streams: Mapping[str, StreamSchema] = field(default_factory=dict)

    @staticmethod
    def empty() -> Catalog:
        return Catalog()

    def get(self, name: str) -> StreamSchema | None:
        return self.streams.get(name)

    def put(self, schema: StreamSchema) -> Catalog:
        return Catalog({**self.streams, schema.name: schema})
