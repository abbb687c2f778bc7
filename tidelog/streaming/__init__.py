"""Structured Streaming ingest, forwarding and delivery.

A micro-batch is one commit that bears its number, so a batch that runs again after
a failure is skipped: exactly once into the log. Delivery is at least once, and the
receiver drops keys that it has.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import Strategy
from ..engine import Engine


def _run(source: DataFrame, act: Callable[[DataFrame, int], object], checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return source.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingest(engine: Engine, stream: str, source: DataFrame, order_by: Sequence[str], checkpoint: str, *, query: str = "ingest", trigger: dict | None = None) -> StreamingQuery:
    """Insert a streaming source's rows, stamped in order within each batch."""
    return _run(source, lambda df, n: engine.append(stream, df, order_by, batch=(query, n)), checkpoint, trigger)


def forward(engine: Engine, stream: str, source: DataFrame, checkpoint: str, *, query: str = "forward", trigger: dict | None = None) -> StreamingQuery:
    """Receive forwarded rows; any age is accepted, keys that are there are dropped."""
    return _run(source, lambda df, n: engine.receive(stream, df, batch=(query, n)), checkpoint, trigger)


def trigger_of(strategy: Strategy) -> dict | None:
    """The trigger that stands for an aggregation strategy; None where nothing is sent."""
    if strategy.kind == "sharedDatabase":
        return None
    if strategy.kind == "batchByTime":
        return {"processingTime": f"{strategy.interval_ms} milliseconds"}
    return {"processingTime": "0 seconds"}
