"""The engine: catalog, clock and stream logs behind one object.

Every change of a stream (rows, pending rows, tombstones, schema, clock, batch
number) is one commit of its log, so a failure leaves either all of it or nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import CREATED, HLC, HLC_COUNT, HLC_NODE, HLC_TIMESTAMP, SYSTEM_COLUMNS, SYSTEM_NAMES, Catalog, StreamSchema
from .functions import hlc
from .lang import ast, semantics
from .lang.ast import DataType
from .lang.errors import AnalysisError, ConstraintError, Issue, MigrationError
from .lang.hashing import statement_hash
from .lang.parser import parse, parse_with_text
from .operators import core
from .plans.compiler import Compiler
from .plans.types import cast, spark_type
from .sources.log import VERSION, Segment, State, StreamLog

SESSION = {"spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.timeType.enabled": "true"}
VALUES_CHUNK = 200
_INDEX = "__index"
#: The place of a row in its statement, which decides between rows of one key.
_PLACE = "__place"


def _utc_now() -> datetime:
    return datetime.now(timezone.utc)


class Engine:
    def __init__(self, spark: SparkSession, root: str, node: int = 0, now: Callable[[], int] | None = None):
        for k, v in SESSION.items():
            spark.conf.set(k, v)
        self.spark, self.root, self.node, self.now = spark, root.rstrip("/"), node, now
        self.catalog = Catalog.empty()
        self.aggregators: dict[str, list[int]] = {}
        self.clocks: dict[str, hlc.HlcClock] = {}
        self.logs: dict[str, StreamLog] = {}

    # ------------------------------------------------------------ logs
    def log(self, stream: str) -> StreamLog:
        if stream not in self.logs:
            self.logs[stream] = StreamLog(self.spark, f"{self.root}/{stream}")
        return self.logs[stream]

    def _clock(self, stream: str, state: State) -> hlc.HlcClock:
        """The stream's clock; after a restart it goes on from the later of its last state and the wall clock."""
        if stream not in self.clocks:
            self.clocks[stream] = hlc.HlcClock(self.node, self.now, tuple(state.clock) if state.clock else None)
        return self.clocks[stream]

    def _schema(self, stream: str) -> StreamSchema:
        schema = self.catalog.get(stream)
        if schema is None:
            raise AnalysisError([Issue("UnknownStream", stream)])
        return schema

    # ------------------------------------------------------------ schema
    def ddl(self, source: str) -> Catalog:
        """Apply schema statements, all or none."""
        statements = parse_with_text(source)
        catalog = semantics.apply_ddl(self.catalog, [s for s, _ in statements])
        for name in dict.fromkeys(s.name for s, _ in statements):
            new, state = [(s, text) for s, text in statements if s.name == name], self.log(name).state()
            if not self.catalog.get(name) and state.hashes:
                raise AnalysisError([Issue("DuplicateStream", name)])
            history = state.source + "".join(f"{text};\n" for _, text in new)
            self._commit_schema(catalog.get(name), self.catalog.get(name), [s for s, _ in new], state, history)
        self.catalog = catalog
        return catalog

    def load(self, stream: str) -> StreamSchema:
        """Put a stored stream into the catalog, from the history in its log."""
        state = self.log(stream).state()
        if not state.hashes:
            raise AnalysisError([Issue("UnknownStream", stream)])
        schema, _, _ = semantics.replay(stream, state.source, state.hashes)
        self.catalog = self.catalog.put(schema)
        return schema

    def migrate(self, stream: str, source: str) -> list[str]:
        """Bring a stream to its whole history; returns the hashes. Applied statements must be its prefix."""
        if self.catalog.get(stream):
            raise MigrationError("structural_error", f"{stream} is in the catalog already")
        state = self.log(stream).state()
        schema, new, hashes = semantics.replay(stream, source, state.hashes)
        if new:
            done = parse(source)[: len(state.hashes)]
            before = semantics.apply_ddl(Catalog.empty(), done).get(stream) if done else None
            self._commit_schema(schema, before, new, state, source)
        self.catalog = self.catalog.put(schema)
        return hashes

    def _commit_schema(self, schema: StreamSchema, before: StreamSchema | None, new: Sequence[ast.Statement], state: State, source: str) -> None:
        hashes = [*state.hashes, *(statement_hash(s) for s in new)]
        added = [k for k in schema.all_checks if before is None or k not in before.all_checks]
        if before is not None and added:
            rows = self._read(schema, state, len(state.hashes))
            for k in added:
                if not rows.where(core.violated(k, schema)).isEmpty():
                    raise ConstraintError(f"stored rows of {schema.name} violate {k.name}")
        self.log(schema.name).commit(state, hashes=hashes, source=source)

    def migration_history(self, stream: str) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(self.log(stream).state().hashes)), "seq int, hash string").orderBy("seq")

    # ------------------------------------------------------------ reads
    def _evolved(self, schema: StreamSchema) -> Callable[[DataFrame, int], DataFrame]:
        """Rows of any schema number under the current columns: widened, defaulted, generated or null."""

        def evolve(df: DataFrame, _: int) -> DataFrame:
            out = df.select(*SYSTEM_NAMES, VERSION, *[self._stored(f, df).alias(f.column.name) for f in schema.fields])
            compiler = Compiler(schema.types)
            late = {f.column.name: cast(compiler.typed(f.column.generated), f.column.type).column for f in schema.fields if f.column.generated is not None and f.physical not in df.columns}
            return out.withColumns(late) if late else out

        return evolve

    @staticmethod
    def _stored(field, df: DataFrame) -> Column:
        kind = spark_type(field.column.type)
        if field.physical in df.columns:
            return F.col(field.physical).cast(kind)
        if field.column.generated is not None or field.column.default is None:
            return F.lit(None).cast(kind)
        return cast(core.default_of(field.column), field.column.type).column

    def _read(self, schema: StreamSchema, state: State, _: int | None = None) -> DataFrame:
        rows = self.log(schema.name).table(state.tables.get("events", []), self._evolved(schema))
        if rows is None:
            fields = [f"`{c.name}` {spark_type(c.type)}" for c in (*SYSTEM_COLUMNS, *schema.columns)]
            return self.spark.createDataFrame([], ", ".join(fields))
        shown = self.log(schema.name).hidden(rows, state.tombstones.get("events", []), [HLC])
        return shown.select(*[F.col(core.quoted(c)) for c in schema.types])

    def stream(self, name: str) -> DataFrame:
        """A stream as a DataFrame; also registered as a temporary view of its name."""
        df = self._read(self._schema(name), self.log(name).state())
        df.createOrReplaceTempView(core.quoted(name))
        return df

    def pending(self, stream: str, state: State | None = None) -> DataFrame:
        log = self.log(stream)
        state = state or log.state()
        rows = log.table(state.tables.get("pending", []), lambda df, _: df)
        if rows is None:
            return self.spark.createDataFrame([], f"{core.AGGREGATOR} int, {core.EVENT} string")
        shown = log.hidden(rows, state.tombstones.get("pending", []), [core.AGGREGATOR, core.EVENT])
        shown = log.hidden(shown.withColumnRenamed(core.EVENT, HLC), state.tombstones.get("events", []), [HLC])
        return shown.select(core.AGGREGATOR, F.col(HLC).alias(core.EVENT))

    # ------------------------------------------------------------ writes
    def execute(self, source: str) -> list[DataFrame | int]:
        """Run INSERT statements; each gives its RETURNING rows or the number of rows inserted.

        All are checked before the first runs; each is one commit.
        """
        statements = parse(source)
        if not all(isinstance(s, ast.Insert) for s in statements):
            self.ddl(source)
            return []
        checked = [(s, semantics.check_insert(self.catalog, s)) for s in statements]
        return [self._insert(s, schema) for s, schema in checked]

    def _insert(self, s: ast.Insert, schema: StreamSchema) -> DataFrame | int:
        compiler, frames = Compiler({}), []
        for at in range(0, len(s.rows), VALUES_CHUNK):
            structs = []
            for i, row in enumerate(s.rows[at : at + VALUES_CHUNK], at):
                values = []
                for name, value in zip(s.columns, row, strict=True):
                    column = schema.column(name)
                    typed = core.default_of(column) if value is ast.DEFAULT else compiler.typed(value)
                    # lengths are checked with all other rules, on the rows as a whole
                    ready = cast(typed, DataType("text")).column if column.type.name in ("char", "varchar") else core.assigned(typed, column.type)[0]
                    values.append(ready.cast(spark_type(column.type)).alias(name))
                structs.append(F.struct(F.lit(i).cast("long").alias(_INDEX), *values))
            frames.append(self.spark.range(1).select(F.inline(F.array(*structs))))
        rows = frames[0]
        for f in frames[1:]:
            rows = rows.union(f)
        written = self._append(schema, rows, s.columns, len(s.rows), skip=s.on_conflict_do_nothing)
        return core.returning(written, s.returning, schema) if s.returning else written.count()

    def append(self, stream: str, df: DataFrame, order_by: Sequence[str], *, batch: tuple[str, int] | None = None) -> int:
        """Insert a DataFrame's rows, stamped in a given total order; returns how many were inserted.

        A micro-batch (query, number) that was committed before is skipped.
        """
        schema = self._schema(stream)
        given = [c for c in df.columns if schema.column(c)]
        unknown = [c for c in df.columns if c not in given and c not in order_by]
        if unknown:
            raise AnalysisError([Issue("InsertUnknownColumn", c) for c in unknown])
        missing = [c.name for c in schema.columns if c.name not in given and not c.optional and c.default is None and c.generated is None]
        if missing:
            raise AnalysisError([Issue("InsertMissingRequiredColumn", c) for c in missing])
        state = self.log(stream).state()
        if batch and state.batches.get(batch[0], -1) >= batch[1]:
            return 0
        rows, n = hlc.indexed(df, [F.col(c) for c in order_by], _INDEX)
        return self._append(schema, rows.select(_INDEX, *given), given, n, batch=batch).count() if n else 0

    def _append(self, schema: StreamSchema, rows: DataFrame, given: Sequence[str], n: int, *, skip: bool = False, batch: tuple[str, int] | None = None) -> DataFrame:
        state = self.log(schema.name).state()
        clock = self._clock(schema.name, state)
        before = (clock.ms, clock.counter)
        ms, first = clock.reserve(n)
        stamp = hlc.stamp_columns(F.col(_INDEX), ms, first, self.node)
        out = core.completed(rows, schema, given)
        system = {HLC: stamp["hlc"], HLC_TIMESTAMP: F.timestamp_millis(stamp["ms"]), HLC_COUNT: stamp["counter"], HLC_NODE: stamp["node"], CREATED: F.lit(_utc_now())}
        try:
            return self._commit_rows(schema, state, out.withColumns(system), skip=skip, clock=[clock.ms, clock.counter], batch=batch, stamped=True)
        except Exception:
            clock.ms, clock.counter = before
            raise

    def _commit_rows(self, schema: StreamSchema, state: State, rows: DataFrame, *, skip: bool, clock: list[int] | None = None, batch: tuple[str, int] | None = None, stamped: bool = False) -> DataFrame:
        """stamped: the keys are one reserve() of the clock, so no two are equal."""
        log, version = self.log(schema.name), state.version + 1
        # a column that no row gives is null without a type; all segments have the column's
        physical = [F.col(core.quoted(f.column.name)).cast(spark_type(f.column.type)).alias(f.physical) for f in schema.fields]
        place = F.col(_INDEX) if _INDEX in rows.columns else F.monotonically_increasing_id()
        kept = rows.select(*SYSTEM_NAMES, *physical, "__issue", place.alias(_PLACE))
        segments = state.tables.get("events", [])
        segment, wrong = log.write_told(kept, version, len(schema.hashes), HLC, "__issue")
        written = self.spark.read.parquet(segment.path)
        try:
            if wrong:
                raise ConstraintError(f"{schema.name}: {wrong}")
            # only segments whose key range meets the new one can hold a conflict
            met = [s for s in segments if s.rows and segment.rows and s.low <= segment.high and segment.low <= s.high]
            stored = log.table(met, lambda df, _: df.select(HLC, VERSION))
            stored = log.hidden(stored, state.tombstones.get("events", []), [HLC]) if stored is not None else None
            if skip:
                fresh = core.accepted(written, stored, order=_PLACE)
                unique = stamped or written.select(HLC).distinct().count() == segment.rows
                if stored is not None or not unique:
                    old, segment = segment, log.write(fresh.drop(VERSION), version, len(schema.hashes), HLC)
                    log.delete(old.path)
                    written = self.spark.read.parquet(segment.path)
            elif not stamped and not (clash := core.conflicts(written, stored)).isEmpty() or stamped and stored is not None and not (clash := core.stored_keys(written, stored)).isEmpty():
                raise ConstraintError(f"{schema.name}: key {clash.first()[0]} is there already")
        except Exception:
            log.delete(segment.path)
            raise
        add = [("events", vars(segment))]
        if targets := self.aggregators.get(schema.name):
            pending = core.fan_out(written, targets)
            add.append(("pending", vars(log.write(pending, version, 0, core.EVENT))))
        log.commit(state, add=add, **({"clock": clock} if clock else {}), **({"batch": {batch[0]: batch[1]}} if batch else {}))
        shown = self._evolved(schema)(written, len(schema.hashes))
        return shown.select(*[F.col(core.quoted(c)) for c in schema.types])

    def receive(self, stream: str, rows: DataFrame, *, batch: tuple[str, int] | None = None) -> int:
        """Forwarded rows, with their system columns: idempotent by key, with this node's own fan-out."""
        schema = self._schema(stream)
        missing = [c for c in (HLC, HLC_TIMESTAMP, HLC_COUNT, HLC_NODE) if c not in rows.columns] + [c.name for c in schema.columns if c.name not in rows.columns and not c.optional and c.default is None and c.generated is None]
        if missing:
            raise ConstraintError(f"forwarded rows lack {', '.join(missing)}")
        if batch is None and rows.isEmpty():
            raise ConstraintError("no forwarded rows")
        state = self.log(stream).state()
        if batch and state.batches.get(batch[0], -1) >= batch[1]:
            return 0
        given = [c.name for c in schema.columns if c.name in rows.columns and c.generated is None]
        system = [c for c in SYSTEM_NAMES if c in rows.columns]
        out = core.completed(rows.select(*system, *[F.col(core.quoted(g)) for g in given]), schema, given)
        if CREATED not in system:
            out = out.withColumn(CREATED, F.lit(_utc_now()))
        return self._commit_rows(schema, state, out, skip=True, batch=batch).count()

    # ------------------------------------------------------------ delivery and retention
    def deliver(self, stream: str, aggregator: int, send: Callable[[DataFrame], bool], limit: int | None = None) -> int:
        """Send an aggregator's oldest pending events in key order; only a true answer acknowledges them."""
        log, schema = self.log(stream), self._schema(stream)
        state = log.state()
        keys = core.oldest(self.pending(stream, state), aggregator, limit)
        segment = log.write(keys.withColumn(core.AGGREGATOR, F.lit(aggregator)), state.version + 1, 0, core.EVENT)
        chosen = self.spark.read.parquet(segment.path).select(F.col(core.EVENT).alias(HLC))
        rows = self._read(schema, state).join(chosen, HLC, "left_semi").orderBy(HLC)
        sent = False
        try:
            sent = segment.rows > 0 and bool(send(rows.select(*[F.col(core.quoted(c)) for c in schema.types])))
        finally:
            if not sent:
                log.delete(segment.path)
        if sent:
            log.commit(state, remove=[("pending", vars(segment))])
        return segment.rows if sent else 0

    def sweep(self, stream: str, aggregators: int, threshold: int, interval_ms: int | None = None, now: datetime | None = None) -> int:
        """Delete events that `threshold` aggregators have (and that are old enough), their pending rows with them."""
        log, schema = self.log(stream), self._schema(stream)
        state = log.state()
        before = F.lit((now or _utc_now()) - timedelta(milliseconds=interval_ms)) if interval_ms is not None else None
        gone = core.expired(self._read(schema, state), self.pending(stream, state), aggregators, threshold, before=before, created=CREATED)
        segment = log.write(gone, state.version + 1, 0, HLC)
        if segment.rows:
            log.commit(state, remove=[("events", vars(segment))])
        else:
            log.delete(segment.path)
        return segment.rows

    def stats(self, stream: str) -> DataFrame:
        """(stream, events, migrations, aggregator_node_id, pending), a row a configured aggregator."""
        state = self.log(stream).state()
        events = self._read(self._schema(stream), state).agg(F.count("*").alias("events"))
        counts = core.stream_stats(self.pending(stream, state), self.aggregators.get(stream, []))
        return counts.crossJoin(F.broadcast(events)).select(F.lit(stream).alias("stream"), "events", F.lit(len(state.hashes)).alias("migrations"), core.AGGREGATOR, "pending")

    def compact(self, stream: str) -> None:
        """Rewrite what is visible as one segment a table; earlier files stay for readers that hold them."""
        log, schema = self.log(stream), self._schema(stream)
        state, add = log.state(), []
        rows = self._read(schema, state)
        physical = [F.col(core.quoted(f.column.name)).alias(f.physical) for f in schema.fields]
        kept = rows.repartitionByRange(HLC).sortWithinPartitions(HLC).select(*SYSTEM_NAMES, *physical)
        add.append(("events", vars(log.write(kept, state.version + 1, len(schema.hashes), HLC))))
        add.append(("pending", vars(log.write(self.pending(stream, state), state.version + 1, 0, core.EVENT))))
        log.commit(state, compacted=True, add=add)


__all__ = ["Engine", "Segment"]
