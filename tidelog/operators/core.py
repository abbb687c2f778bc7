"""Runtime operators as plain DataFrame functions.

events have the HLC key; pending has (aggregator, event_hlc).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import HLC, StreamSchema
from ..lang import ast
from ..lang.ast import DataType
from ..plans.compiler import Compiler
from ..plans.types import Typed, cast, spark_type

AGGREGATOR, EVENT = "aggregator_node_id", "event_hlc"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


# ---------------------------------------------------------------- rows in
def assigned(value: Typed, to: DataType) -> tuple[Column, Column | None]:
    """(value as a column of a type, what is wrong with it or None): too long a text is an error on assignment, not cut."""
    if to.name in ("varchar", "char") and (to.args or to.name == "char"):
        limit = to.args[0] if to.args else 1
        text = cast(value, DataType("text")).column
        column = F.rpad(text, limit, " ") if to.name == "char" else text
        return F.when(F.length(F.rtrim(text)) <= limit, column), F.when(F.length(F.rtrim(text)) > limit, F.lit("too long"))
    if value.type == to or spark_type(value.type) == spark_type(to) and to.name not in ("json", "jsonb", "uuid"):
        return value.column, None
    return cast(value, to).column, None


def default_of(column: ast.ColumnDef) -> Typed:
    return Compiler({}).typed(column.default if column.default is not None else ast.Literal("null"))


def completed(rows: DataFrame, schema: StreamSchema, given: Sequence[str]) -> DataFrame:
    """rows with every user column: given ones cast to their type, others by default, then generated ones.

    __issue names the first thing wrong with a row, or is null.
    """
    from_rows = {c.name: (Typed(F.col(quoted(c.name)), c.type) if c.name in given else default_of(c)) for c in schema.columns if c.generated is None}
    issues, columns = [], {}
    for c in schema.columns:
        if c.generated is None:
            columns[c.name], wrong = assigned(from_rows[c.name], c.type)
            if wrong is not None:
                issues.append(F.when(wrong.isNotNull(), F.concat(F.lit(f"{c.name}: "), wrong)))
    others = [x for x in rows.columns if x not in columns]
    out = rows.select(*[F.col(quoted(x)) for x in others], *[v.alias(k) for k, v in columns.items()], F.coalesce(*issues, F.lit(None).cast("string")).alias("__issue"))
    # a generated column may not read another; so all come from the same row
    base = Compiler({**schema.types})
    generated = {c.name: cast(base.typed(c.generated), c.type).column for c in schema.columns if c.generated is not None}
    out = out.withColumns(generated) if generated else out
    nulls = [F.when(F.col(quoted(c.name)).isNull(), F.lit(f"{c.name}: null")) for c in schema.columns if not c.optional and c.generated is None]
    checks = [F.when(violated(k, schema), F.lit(f"{k.name}: violated")) for k in schema.all_checks]
    return out.withColumn("__issue", F.coalesce("__issue", *nulls, *checks)) if nulls or checks else out


def violated(check: ast.Check, schema: StreamSchema) -> Column:
    """A row fails a check only where it is false; null passes."""
    return ~F.coalesce(Compiler(schema.types).column(check.predicate), F.lit(True))


def accepted(incoming: DataFrame, stored: DataFrame | None, key: str = HLC, order: str | None = None) -> DataFrame:
    """ON CONFLICT DO NOTHING: of equal incoming keys the first by `order` (else any), and none that is stored."""
    if order is None:
        once = incoming.dropDuplicates([key])
    else:
        first = F.min_by(F.struct(*[F.col(quoted(c)) for c in incoming.columns if c != key]), F.col(quoted(order)))
        once = incoming.groupBy(key).agg(first.alias("__first")).select(key, "__first.*").select(*[quoted(c) for c in incoming.columns])
    return once if stored is None else once.join(stored.select(key), key, "left_anti")


def conflicts(incoming: DataFrame, stored: DataFrame | None, key: str = HLC) -> DataFrame:
    """Keys that a plain insert must fail on."""
    twice = incoming.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    return twice if stored is None else twice.union(stored_keys(incoming, stored, key))


def stored_keys(incoming: DataFrame, stored: DataFrame, key: str = HLC) -> DataFrame:
    return incoming.select(key).join(stored.select(key), key, "left_semi")


def returning(rows: DataFrame, items: Sequence[ast.Returning], schema: StreamSchema) -> DataFrame:
    out: list[Column] = []
    for i, item in enumerate(items):
        if item.star:
            out += [F.col(quoted(c)) for c in schema.types]
            continue
        name = item.alias or (item.expr.name if isinstance(item.expr, ast.ColumnRef | ast.Call) else f"column{i + 1}")
        out.append(Compiler(schema.types).column(item.expr).alias(name))
    return rows.select(*out)


# ---------------------------------------------------------------- fan-out and delivery
def fan_out(rows: DataFrame, aggregators: Sequence[int], key: str = HLC) -> DataFrame:
    """A pending row an event and aggregator; no join, the ids are part of the plan."""
    ids = F.array(*[F.lit(a).cast("int") for a in aggregators]) if aggregators else F.array().cast("array<int>")
    return rows.select(F.explode(ids).alias(AGGREGATOR), F.col(quoted(key)).alias(EVENT))


def oldest(pending: DataFrame, aggregator: int, limit: int | None = None) -> DataFrame:
    """An aggregator's pending keys, oldest first; a limit is a top-k, not a full sort."""
    out = pending.where(F.col(AGGREGATOR) == aggregator).select(EVENT).orderBy(EVENT)
    return out if limit is None else out.limit(limit)


def batch(events: DataFrame, pending: DataFrame, aggregator: int, limit: int | None = None, key: str = HLC) -> DataFrame:
    """The events to deliver, in key order."""
    keys = oldest(pending, aggregator, limit).withColumnRenamed(EVENT, key)
    return events.join(keys, key, "left_semi").orderBy(key)


def acknowledged(pending: DataFrame, aggregator: int, keys: DataFrame) -> DataFrame:
    """pending without an aggregator's acknowledged keys."""
    done = keys.select(F.lit(aggregator).alias(AGGREGATOR), F.col(EVENT))
    return pending.join(done, [AGGREGATOR, EVENT], "left_anti")


# ---------------------------------------------------------------- retention and statistics
def undelivered(events: DataFrame, pending: DataFrame, key: str = HLC) -> DataFrame:
    """events with how many aggregators still wait for each; counted before the join, so events without any stay."""
    counts = pending.groupBy(F.col(EVENT).alias(key)).agg(F.count("*").alias("__waiting"))
    return events.join(counts, key, "left").withColumn("__waiting", F.coalesce("__waiting", F.lit(0)))


def expired(events: DataFrame, pending: DataFrame, aggregators: int, threshold: int, *, before: Column | None = None, created: str | None = None, key: str = HLC) -> DataFrame:
    """Keys of events that `threshold` of the aggregators have, and where asked are older than a moment."""
    old = events if before is None else events.where(F.col(quoted(created)) < before)
    return undelivered(old, pending, key).where(F.col("__waiting") <= aggregators - threshold).select(key)


def survivors(events: DataFrame, gone: DataFrame, key: str = HLC) -> DataFrame:
    return events.join(gone, key, "left_anti")


def cascaded(pending: DataFrame, gone: DataFrame, key: str = HLC) -> DataFrame:
    """pending without rows of events that are gone."""
    return pending.join(gone.withColumnRenamed(key, EVENT), EVENT, "left_anti").select(AGGREGATOR, EVENT)


def pending_counts(pending: DataFrame) -> DataFrame:
    return pending.groupBy(AGGREGATOR).agg(F.count("*").alias("pending"))


def stream_stats(pending: DataFrame, aggregators: Sequence[int]) -> DataFrame:
    """A row a configured aggregator, 0 where nothing waits."""
    known = pending.sparkSession.createDataFrame([(a,) for a in aggregators], f"{AGGREGATOR} int")
    return known.join(pending_counts(pending), AGGREGATOR, "left").select(AGGREGATOR, F.coalesce("pending", F.lit(0)).alias("pending"))
