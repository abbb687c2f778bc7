"""Event store: a configured engine with delivery, retention and background loops."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import SYSTEM_COLUMNS
from .config import StoreConfig, effective_retention, parse_config
from .engine import Engine
from .lang.errors import ConstraintError, LanguageError
from .lang.hashing import statement_hash
from .lang.parser import parse
from .plans.types import spark_type

#: Rows of a post where the strategy names no batch size.
POST_ROWS = 1000

#: (url, path, body) to (status, body); HTTP by default.
Transport = Callable[[str, str, object], tuple[int, object]]


class RegistrationError(RuntimeError):
    pass


def _http(url: str, path: str, body: object) -> tuple[int, object]:
    from .sources.http import post

    return post(url, path, body)


def _hashes(migration: object) -> list[str] | None:
    try:
        return [statement_hash(s) for s in parse(str(migration))]
    except LanguageError:
        return None


class EventStore:
    def __init__(self, engine: Engine, config: StoreConfig, transport: Transport = _http):
        self.engine, self.config, self.transport = engine, config, transport
        self._stop, self._threads, self._lock = threading.Event(), [], threading.RLock()

    @classmethod
    def start(cls, spark: SparkSession, raw: str | dict | StoreConfig, transport: Transport = _http, *, register: bool = True) -> EventStore:
        """Migrate every stream, then register with every aggregator that does not share the database."""
        config = raw if isinstance(raw, StoreConfig) else parse_config(raw)
        engine = Engine(spark, config.database_url, config.node_id)
        store = cls(engine, config, transport)
        for name, s in config.streams.items():
            engine.migrate(name, s.migration)
            # an aggregator on the same database never waits; it counts as delivered
            engine.aggregators[name] = [a.node_id for a in s.aggregators if a.aggregation.kind != "sharedDatabase"]
        for name, s in config.streams.items() if register else ():
            for node in engine.aggregators[name]:
                status, told = transport(config.aggregators[node], f"/streams/{quote(name, safe='')}/register", None)
                # histories are compared statement by statement, so spelling and white space may differ
                if status // 100 != 2 or not isinstance(told, dict) or _hashes(told.get("migration")) != _hashes(s.migration):
                    raise RegistrationError(f"aggregator {node} does not have the same history of {name}")
        return store

    def create_events(self, source: str) -> list[DataFrame | int]:
        with self._lock:
            return self.engine.execute(source)

    def stream_stats(self, name: str) -> DataFrame:
        return self.engine.stats(name)

    def all_stream_stats(self) -> dict[str, list[dict]]:
        return {n: [r.asDict() for r in self.engine.stats(n).collect()] for n in self.config.streams}

    def deliver_pending_for(self, name: str, node: int) -> int:
        member = next(a for a in self.config.streams[name].aggregators if a.node_id == node)
        if member.aggregation.kind == "sharedDatabase":
            return 0

        def send(rows: DataFrame) -> bool:
            body = [json.loads(r) for r in rows.toJSON().collect()]  # a batch, so bounded
            status, _ = self.transport(self.config.aggregators[node], f"/streams/{quote(name, safe='')}/events", {"rows": body})
            return status // 100 == 2

        if member.aggregation.size:
            with self._lock:
                return self.engine.deliver(name, node, send, member.aggregation.size)
        # without a size all that waits leaves, in posts of POST_ROWS, each acknowledged on its own
        total, sent = 0, POST_ROWS
        while sent == POST_ROWS:
            with self._lock:
                sent = self.engine.deliver(name, node, send, POST_ROWS)
            total += sent
        return total

    def receive_rows(self, name: str, rows: list[dict]) -> int:
        """Forwarded rows as JSON objects, in their order; idempotent by key."""
        if not rows:
            raise ConstraintError("no forwarded rows")
        schema = self.engine._schema(name)
        given = {k for r in rows for k in r}
        fields = [f"`{c.name}` {spark_type(c.type)}" for c in (*SYSTEM_COLUMNS, *schema.columns) if c.name in given]
        if not fields:
            raise ConstraintError("forwarded rows have no column of the stream")
        texts = self.engine.spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "at bigint, row string").coalesce(1).sortWithinPartitions("at")
        parsed = texts.select(F.from_json("row", ", ".join(fields), {"mode": "FAILFAST"}).alias("r")).select("r.*")
        with self._lock:
            return self.engine.receive(name, parsed)

    def sweep_all(self) -> dict[str, int]:
        out = {}
        for name, s in self.config.streams.items():
            rule = effective_retention([a.retention for a in s.aggregators])
            with self._lock:
                out[name] = 0 if rule.kind == "indefinite" else self.engine.sweep(name, len(s.aggregators), rule.threshold, rule.interval_ms)
        return out

    def start_background_loops(self) -> None:
        def every(seconds: float, act: Callable[[], object]) -> None:
            def loop() -> None:
                while not self._stop.wait(seconds):
                    act()

            thread = threading.Thread(target=loop, daemon=True)
            thread.start()
            self._threads.append(thread)

        every(self.config.sweep_interval_ms / 1000, self.sweep_all)
        for name, s in self.config.streams.items():
            for a in s.aggregators:
                if a.aggregation.kind != "sharedDatabase":
                    seconds = a.aggregation.interval_ms / 1000 if a.aggregation.kind == "batchByTime" else 1.0
                    every(seconds, lambda name=name, node=a.node_id: self.deliver_pending_for(name, node))

    def close(self) -> None:
        self._stop.set()
        for t in self._threads:
            t.join(timeout=10)
