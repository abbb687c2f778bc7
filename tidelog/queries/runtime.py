"""Queries of the runtime: clock, schema, insert, delivery, retention and streaming.

The clock stands at P and the node is NODE; events are stamped in event_id order.
Aggregators 7, 12 and 19 have acknowledged the events whose id is a multiple of 2, 3
and 5.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import HLC_COUNT, HLC_NODE
from ..config import Strategy, effective_retention
from ..engine import Engine
from ..functions import hlc
from ..lang import semantics
from ..lang.errors import ConstraintError
from ..lang.parser import parse
from ..operators import core
from ..sources import cli, http
from ..sources.paths import new_root
from ..store import EventStore
from ..streaming import ingest

P, NODE = 1_700_000_000_000, 7
AGGREGATORS = {7: 2, 12: 3, 19: 5}
KEY = "event_id"
EVENT_LOG = "CREATE STREAM event_log (event_id BIGINT, occurred TIMESTAMP, user_id BIGINT, event_type VARCHAR(16), amount DOUBLE PRECISION, props JSON OPTIONAL, CHECK amount_range (amount >= 0))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine(spark: SparkSession, name: str = "query") -> Engine:
    return Engine(spark, new_root(spark, name), NODE, lambda: P)


def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ms, counter, node and hlc."""
    rows, _ = hlc.indexed(table(spark, sf_dir, "events").select("event_id", "event_type"), [F.col("event_id")], "i")
    clock = hlc.HlcClock(NODE, lambda: P)
    return rows.withColumns(hlc.stamp_columns(F.col("i"), *clock.reserve(0), NODE)).drop("i")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = core.fan_out(events(spark, sf_dir), list(AGGREGATORS), KEY)
    done = reduce(lambda a, b: a | b, [(F.col(core.AGGREGATOR) == a) & (F.col(core.EVENT) % k == 0) for a, k in AGGREGATORS.items()])
    return every.where(~done)


# SQL parts
_DIGITS = f"'{hlc.ALPHABET}'"


def _sql62(value: str, width: int) -> str:
    return "(" + " || ".join(f"substr({_DIGITS}, CAST(({value}) // {62**i} % 62 + 1 AS BIGINT), 1)" for i in reversed(range(width))) + ")"


_K = "(row_number() OVER (ORDER BY event_id))"
_STAMPS = f"SELECT event_id, event_type, {P} + {_K} // 3844 AS ms, CAST({_K} % 3844 AS INTEGER) AS counter FROM events"
_STAMPED = f"SELECT event_id, event_type, ms, counter, CAST({NODE} AS INTEGER) AS node, {_sql62('ms', 8)} || {_sql62('counter', 2)} || {_sql62(str(NODE), 5)} AS hlc FROM ({_STAMPS})"
_PENDING = " UNION ALL ".join(f"SELECT CAST({a} AS INTEGER) AS aggregator_node_id, event_id AS event_hlc FROM events WHERE event_id % {k} <> 0" for a, k in AGGREGATORS.items())
_WAITING = f"SELECT e.*, (SELECT count(*) FROM ({_PENDING}) p WHERE p.event_hlc = e.event_id) AS waiting FROM events e"
_EXPIRED = f"SELECT event_id FROM ({_WAITING}) WHERE waiting <= 1"

SQL: dict[str, str] = {}


def _q(sql: str | None = None):
    def keep(f):
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ---------------------------------------------------------------- clock
@_q(f"SELECT event_id, {_sql62('event_id * 1000003', 8)} AS v, {_sql62('event_id', 4)} AS w FROM events")
def base62_encode(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", hlc.encode_column(F.col("event_id") * 1_000_003, 8).alias("v"), hlc.encode_column(F.col("event_id"), 4).alias("w"))


@_q("SELECT event_id, event_id * 1000003 AS v FROM events")
def base62_decode(spark, sf_dir):
    text = hlc.encode_column(F.col("event_id") * 1_000_003, 8)
    return events(spark, sf_dir).select("event_id", hlc.decode_column(text).alias("v"))


@_q(_STAMPED)
def hlc_stamp(spark, sf_dir):
    return stamped(spark, sf_dir)


@_q(f"SELECT event_id, {_sql62('epoch_us(ts) // 1000', 8)} || {_sql62('event_id % 3844', 2)} || {_sql62('user_id', 5)} AS hlc FROM events")
def hlc_encode(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", F.concat(hlc.encode_column(ms, 8), hlc.encode_column(F.col("event_id") % 3844, 2), hlc.encode_column(F.col("user_id"), 5)).alias("hlc"))


@_q(f"SELECT event_id, ms, counter, CAST({NODE} AS INTEGER) AS node FROM ({_STAMPS})")
def hlc_decode(spark, sf_dir):
    return stamped(spark, sf_dir).select("event_id", *[c.alias(k) for k, c in hlc.parts(F.col("hlc")).items()])


@_q("SELECT CAST(0 AS BIGINT) AS out_of_order, count(*) AS n FROM events")
def hlc_order(spark, sf_dir):
    """Neighbours by text that are not neighbours by (ms, counter)."""
    by_text, _ = hlc.indexed(stamped(spark, sf_dir).select("event_id", "ms", "counter", "hlc"), [F.col("hlc")], "place")
    by_parts, _ = hlc.indexed(stamped(spark, sf_dir).select("event_id", "ms", "counter"), [F.col("ms"), F.col("counter")], "other")
    both = by_text.select("event_id", "place").join(by_parts.select("event_id", "other"), "event_id")
    return both.agg(F.count_if(F.col("place") != F.col("other")).alias("out_of_order"), F.count("*").alias("n"))


@_q(f"SELECT 'same' AS remote, {P} AS ms, CAST(1 AS INTEGER) AS counter UNION ALL SELECT 'ahead', {P} + 5, CAST(10 AS INTEGER) UNION ALL SELECT 'full', {P} + 6, CAST(0 AS INTEGER)")
def hlc_merge(spark, sf_dir):
    clock, out = hlc.HlcClock(NODE, lambda: P), []
    for name, remote in (("same", hlc.Stamp(P, 0, 3)), ("ahead", hlc.Stamp(P + 5, 9, 3)), ("full", hlc.Stamp(P + 5, 3843, 3))):
        s = clock.merge(str(remote))
        out.append((name, s.ms, s.counter))
    return spark.createDataFrame(out, "remote string, ms bigint, counter int")


# ---------------------------------------------------------------- schema
def _stream_of(spark, sf_dir, *statements: str) -> Engine:
    """supplier as a stream: rows under the first statement, then the others."""
    e = engine(spark)
    e.ddl(statements[0])
    e.append("s", table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")), ["id"])
    for more in statements[1:]:
        e.ddl(more)
    return e


_SUPPLIER = "CREATE STREAM s (id BIGINT, name VARCHAR(25), nation INT, balance DOUBLE PRECISION OPTIONAL, CHECK nation_range (nation >= 0))"


@_q("SELECT * FROM (VALUES ('_sys_hlc', 'string'), ('_sys_hlc_timestamp', 'timestamp'), ('_sys_hlc_count', 'int'), ('_sys_hlc_node_id', 'int'), ('_sys_created_at', 'timestamp'), ('id', 'bigint'), ('name', 'string'), ('nation', 'int'), ('balance', 'double')) t(name, type)")
def ddl_create_schema(spark, sf_dir):
    catalog = semantics.apply_ddl(engine(spark).catalog, parse(_SUPPLIER))
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in catalog.get("s").struct()], "name string, type string")


@_q("SELECT s_suppkey AS id, s_name AS name, CAST(s_nationkey AS BIGINT) AS nation, CAST(NULL AS INTEGER) AS note, CAST(9 AS INTEGER) AS grade, CAST(s_nationkey * 2 AS BIGINT) AS twice FROM supplier")
def ddl_alter_evolved_read(spark, sf_dir):
    e = _stream_of(spark, sf_dir, _SUPPLIER, "ALTER STREAM s ADD COLUMN note INT OPTIONAL, ADD COLUMN grade INT DEFAULT 9, ALTER COLUMN nation TYPE BIGINT, DROP COLUMN balance", "ALTER STREAM s ADD COLUMN twice BIGINT GENERATED ALWAYS AS (nation * 2) VIRTUAL")
    return e.stream("s").select("id", "name", "nation", "note", "grade", "twice")


@_q("SELECT s_suppkey AS id, CAST(5 AS INTEGER) AS grade FROM supplier")
def alter_add_column(spark, sf_dir):
    return _stream_of(spark, sf_dir, _SUPPLIER, "ALTER STREAM s ADD COLUMN grade INT DEFAULT 2 + 3").stream("s").select("id", "grade")


@_q("SELECT s_suppkey AS id, CAST(NULL AS DOUBLE) AS balance FROM supplier")
def alter_drop_column(spark, sf_dir):
    """A column that is added again under a dropped name has no old values."""
    return _stream_of(spark, sf_dir, _SUPPLIER, "ALTER STREAM s DROP COLUMN balance", "ALTER STREAM s ADD COLUMN balance DOUBLE PRECISION OPTIONAL").stream("s").select("id", "balance")


@_q("SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS nation FROM supplier")
def alter_widen_type(spark, sf_dir):
    return _stream_of(spark, sf_dir, _SUPPLIER, "ALTER STREAM s ALTER COLUMN nation TYPE BIGINT, ALTER COLUMN name TYPE VARCHAR(60)").stream("s").select("id", "nation")


@_q("SELECT s_suppkey AS id FROM supplier WHERE s_acctbal < 0")
def alter_add_check(spark, sf_dir):
    """Stored rows that a new constraint would be refused for."""
    e = _stream_of(spark, sf_dir, _SUPPLIER)
    catalog = semantics.apply_ddl(e.catalog, parse("ALTER STREAM s ADD CONSTRAINT CHECK solvent (balance >= 0)"))
    schema = catalog.get("s")
    return e.stream("s").where(core.violated(schema.checks[-1], schema)).select("id")


@_q("SELECT event_id FROM events WHERE NOT coalesce(value > 0 AND value <= 100, true)")
def check_violations(spark, sf_dir):
    schema = semantics.apply_ddl(engine(spark).catalog, parse("CREATE STREAM e (event_id BIGINT, value DOUBLE PRECISION, CHECK in_range (value > 0 AND value <= 100))")).get("e")
    return events(spark, sf_dir).where(core.violated(schema.checks[0], schema)).select("event_id")


@_q("SELECT CAST(i AS INTEGER) AS seq, CAST(64 AS INTEGER) AS digits FROM range(3) t(i)")
def migration_history(spark, sf_dir):
    e = engine(spark)
    e.migrate("s", f"{_SUPPLIER}; ALTER STREAM s ADD COLUMN a INT OPTIONAL; ALTER STREAM s ADD COLUMN b INT OPTIONAL")
    return e.migration_history("s").select("seq", F.length("hash").alias("digits"))


@_q("SELECT CAST(3 AS BIGINT) AS steps")
def migration_step_count(spark, sf_dir):
    return migration_history(spark, sf_dir).agg(F.count("*").alias("steps"))


# ---------------------------------------------------------------- insert
@_q("SELECT * FROM (VALUES (1, 'celsius', CAST(5 AS INTEGER)), (2, 'kelvin', CAST(7 AS INTEGER)), (3, 'celsius', CAST(5 AS INTEGER))) t(counter, units, n)")
def insert_values(spark, sf_dir):
    e = engine(spark)
    e.ddl("CREATE STREAM r (units VARCHAR(32), n INT DEFAULT 5)")
    e.execute("INSERT INTO r (units, n) VALUES ('celsius', DEFAULT), ('kelvin', 3 + 4); INSERT INTO r (units) VALUES ('celsius')")
    return e.stream("r").select(F.col(HLC_COUNT).alias("counter"), "units", "n")


def _defaults(spark, sf_dir, columns: str) -> DataFrame:
    schema = semantics.apply_ddl(engine(spark).catalog, parse(f"CREATE STREAM e (event_id BIGINT, value DOUBLE PRECISION, {columns})")).get("e")
    return core.completed(events(spark, sf_dir).select("event_id", "value"), schema, ["event_id", "value"])


@_q("SELECT event_id, CAST(5 AS INTEGER) AS a, CAST(NULL AS VARCHAR) AS b, 'x' AS c FROM events")
def insert_default(spark, sf_dir):
    return _defaults(spark, sf_dir, "a INT DEFAULT 2 + 3, b TEXT OPTIONAL, c VARCHAR(4) DEFAULT 'x'").select("event_id", "a", "b", "c")


@_q("SELECT event_id, CAST(event_id // 10 AS BIGINT) AS tens, value > 50 AS high FROM events")
def generated_col(spark, sf_dir):
    return _defaults(spark, sf_dir, "tens BIGINT GENERATED ALWAYS AS (event_id / 10) STORED, high BOOLEAN GENERATED ALWAYS AS (value > 50) VIRTUAL").select("event_id", "tens", "high")


def _halves(spark, sf_dir):
    rows = events(spark, sf_dir)
    return rows.where("event_id % 10 < 6"), rows.where("event_id % 10 >= 4")


@_q("SELECT event_id, event_type FROM events WHERE event_id % 10 >= 6")
def on_conflict_anti_join(spark, sf_dir):
    stored, incoming = _halves(spark, sf_dir)
    return core.accepted(incoming.union(incoming.where("event_id % 20 = 7")), stored, KEY).select("event_id", "event_type")


@_q("SELECT user_id, arg_min(event_id, event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events WHERE user_id % 3 <> 0 GROUP BY user_id")
def on_conflict_first(spark, sf_dir):
    """Of rows that share a key the first in order stays, whatever partition it lies in."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    stored = rows.where("user_id % 3 = 0").select("user_id").distinct()
    return core.accepted(rows.repartition(7, "event_type"), stored, "user_id", order="event_id")


@_q("SELECT event_id FROM events WHERE event_id % 10 IN (4, 5)")
def insert_conflicts(spark, sf_dir):
    stored, incoming = _halves(spark, sf_dir)
    return core.conflicts(incoming, stored, KEY)


_R = "CREATE STREAM r (a INT, b TEXT OPTIONAL, g INT GENERATED ALWAYS AS (a * 2) STORED)"


@_q(f"SELECT CAST({NODE} AS INTEGER) AS _sys_hlc_node_id, * FROM (VALUES (1, 1, 'x', 2), (2, 5, NULL, 10)) t(_sys_hlc_count, a, b, g)")
def returning_star(spark, sf_dir):
    e = engine(spark)
    e.ddl(_R)
    return e.execute("INSERT INTO r (a, b) VALUES (1, 'x'), (5, DEFAULT) RETURNING *")[0].select(HLC_NODE, HLC_COUNT, "a", "b", "g")


@_q("SELECT * FROM (VALUES (1, 3, 'x!'), (5, 15, NULL)) t(a, total, mark)")
def returning_exprs(spark, sf_dir):
    e = engine(spark)
    e.ddl(_R)
    return e.execute("INSERT INTO r (a, b) VALUES (1, 'x'), (5, NULL) ON CONFLICT DO NOTHING RETURNING a, a + g AS total, b || '!' AS mark")[0]


@_q("SELECT CAST(3 AS BIGINT) AS inserted, CAST(6 AS BIGINT) AS pending")
def insert_count(spark, sf_dir):
    e = engine(spark)
    e.ddl(_R)
    e.aggregators["r"] = [7, 12]
    n = e.execute("INSERT INTO r (a) VALUES (1), (2), (3)")[0]
    return e.pending("r").agg(F.lit(n).cast("bigint").alias("inserted"), F.count("*").alias("pending"))


@_q("SELECT event_id FROM events")
def insert_bulk(spark, sf_dir):
    """All events through the log: stamped, checked, fanned out, read back in key order."""
    return _logged(spark, sf_dir).stream("event_log").select("event_id")


def _source(df: DataFrame) -> DataFrame:
    return df.select("event_id", F.col("ts").alias("occurred"), "user_id", "event_type", F.col("value").alias("amount"), "props")


def _logged(spark, sf_dir) -> Engine:
    e = engine(spark)
    e.ddl(EVENT_LOG)
    e.aggregators["event_log"] = list(AGGREGATORS)
    e.append("event_log", _source(table(spark, sf_dir, "events")), ["event_id"])
    return e


@_q("SELECT count(*) AS stored, 3 * count(*) AS pending, count(*) AS first_time, CAST(0 AS BIGINT) AS second_time FROM events")
def forwarded_insert(spark, sf_dir):
    """The same rows sent twice: the second time, nothing is stored and nothing waits."""
    there, here = _logged(spark, sf_dir), engine(spark, "receiver")
    here.ddl(EVENT_LOG)
    here.aggregators["event_log"] = list(AGGREGATORS)
    rows = there.stream("event_log")
    counts = [here.receive("event_log", rows) for _ in range(2)]
    stored = here.stream("event_log").agg(F.count("*").alias("stored"))
    waiting = here.pending("event_log").agg(F.count("*").alias("pending"))
    return stored.crossJoin(F.broadcast(waiting)).select("stored", "pending", F.lit(counts[0]).cast("bigint").alias("first_time"), F.lit(counts[1]).cast("bigint").alias("second_time"))


# ---------------------------------------------------------------- delivery
@_q("SELECT event_id, event_type, value FROM events")
def stream_scan(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", "event_type", "value")


@_q(f"SELECT aggregator_node_id, event_hlc FROM ({' UNION ALL '.join(f'SELECT CAST({a} AS INTEGER) AS aggregator_node_id, event_id AS event_hlc FROM events' for a in AGGREGATORS)})")
def fanout_pending(spark, sf_dir):
    return core.fan_out(events(spark, sf_dir), list(AGGREGATORS), KEY)


@_q(f"SELECT event_hlc FROM ({_PENDING}) WHERE aggregator_node_id = 12")
def pending_for_aggregator(spark, sf_dir):
    return core.oldest(pending(spark, sf_dir), 12)


@_q(f"SELECT event_hlc FROM ({_PENDING}) WHERE aggregator_node_id = 7 ORDER BY event_hlc LIMIT 100")
def deliver_topk(spark, sf_dir):
    return core.oldest(pending(spark, sf_dir), 7, 100)


@_q(f"SELECT event_id, event_type FROM events WHERE event_id IN (SELECT event_hlc FROM ({_PENDING}) WHERE aggregator_node_id = 19 ORDER BY event_hlc LIMIT 250)")
def deliver_batch(spark, sf_dir):
    return core.batch(events(spark, sf_dir), pending(spark, sf_dir), 19, 250, KEY).select("event_id", "event_type")


@_q(f"SELECT aggregator_node_id, event_hlc FROM ({_PENDING}) WHERE NOT (aggregator_node_id = 7 AND event_hlc IN (SELECT event_hlc FROM ({_PENDING}) WHERE aggregator_node_id = 7 ORDER BY event_hlc LIMIT 100))")
def ack_pending(spark, sf_dir):
    p = pending(spark, sf_dir)
    return core.acknowledged(p, 7, core.oldest(p, 7, 100))


@_q(f"SELECT aggregator_node_id, count(*) AS pending FROM ({_PENDING}) GROUP BY aggregator_node_id")
def pending_counts(spark, sf_dir):
    return core.pending_counts(pending(spark, sf_dir))


@_q("SELECT count(*) AS events FROM events")
def stream_event_count(spark, sf_dir):
    return events(spark, sf_dir).agg(F.count("*").alias("events"))


@_q(f"SELECT CAST(a AS INTEGER) AS aggregator_node_id, (SELECT count(*) FROM ({_PENDING}) p WHERE p.aggregator_node_id = a) AS pending FROM (VALUES (7), (12), (19), (31)) t(a)")
def stream_stats(spark, sf_dir):
    return core.stream_stats(pending(spark, sf_dir), [*AGGREGATORS, 31])


# ---------------------------------------------------------------- retention
@_q(_EXPIRED)
def retention_candidates(spark, sf_dir):
    return core.expired(events(spark, sf_dir), pending(spark, sf_dir), 3, 2, key=KEY)


@_q(f"SELECT event_id FROM ({_WAITING}) WHERE waiting <= 1 AND ts < (SELECT max(ts) FROM events) - INTERVAL 5 DAY")
def retention_time_limited(spark, sf_dir):
    rows = events(spark, sf_dir)
    before = rows.agg(F.max("ts")).first()[0]
    return core.expired(rows, pending(spark, sf_dir), 3, 2, before=F.lit(before) - F.expr("INTERVAL 5 DAYS"), created="ts", key=KEY)


@_q(f"SELECT event_id, event_type FROM events WHERE event_id NOT IN ({_EXPIRED})")
def retention_survivors(spark, sf_dir):
    return core.survivors(events(spark, sf_dir), retention_candidates(spark, sf_dir), KEY).select("event_id", "event_type")


@_q(f"SELECT aggregator_node_id, event_hlc FROM ({_PENDING}) WHERE event_hlc NOT IN ({_EXPIRED})")
def cascade_pending(spark, sf_dir):
    return core.cascaded(pending(spark, sf_dir), retention_candidates(spark, sf_dir), KEY)


@_q("SELECT CAST(100 AS BIGINT) AS sent, CAST(0 AS BIGINT) AS refused, 3 * count(*) - 100 AS waiting, count(*) - 100 AS left_for_7 FROM events")
def deliver_cycle(spark, sf_dir):
    """At least once: a refused batch stays, an accepted one is acknowledged."""
    e = _logged(spark, sf_dir)
    refused = e.deliver("event_log", 7, lambda rows: False, 100)
    sent = e.deliver("event_log", 7, lambda rows: rows.count() == 100, 100)
    p = e.pending("event_log")
    return p.agg(F.lit(sent).cast("bigint").alias("sent"), F.lit(refused).cast("bigint").alias("refused"), F.count("*").alias("waiting"), F.count_if(F.col(core.AGGREGATOR) == 7).alias("left_for_7"))


@_q("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def streaming_ingest(spark, sf_dir):
    """A file stream of events into the log, exactly once."""
    e = engine(spark, "stream")
    e.ddl(EVENT_LOG)
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    for _ in range(2):  # the second run finds nothing new
        ingest(e, "event_log", _source(source), ["event_id"], f"{e.root}/checkpoint").awaitTermination()
    return e.stream("event_log").groupBy("event_type").agg(F.count("*").alias("n"))


@_q("SELECT event_id, value FROM events")
def ddl_drop_constraint(spark, sf_dir):
    """A check that many events violate; once it is dropped, all are taken."""
    e = engine(spark, "drop")
    e.ddl("CREATE STREAM c (event_id BIGINT, value DOUBLE PRECISION, CHECK low (value < 10))")
    rows = events(spark, sf_dir).select("event_id", "value")
    try:
        e.append("c", rows, ["event_id"])
    except ConstraintError:
        e.ddl("ALTER STREAM c DROP CONSTRAINT low")
    e.append("c", rows, ["event_id"])
    return e.stream("c").select("event_id", "value")


_CANONICAL = '{"stmt":"create_stream","name":"s","elements":[{"kind":"column","column":{"name":"a","data_type":{"type":"int"},"optional":true,"default":{"expr":"binary_op","op":"add","left":{"expr":"int_literal","text":"1"},"right":{"expr":"int_literal","text":"2"}},"generated":null,"checks":[{"name":"k","expr":{"expr":"binary_op","op":"cmp_gt","left":{"expr":"column_ref","name":"a"},"right":{"expr":"int_literal","text":"0"}}}]}}]}'


@_q(f"SELECT CAST(0 AS INTEGER) AS seq, sha256('{_CANONICAL}') AS hash")
def statement_hashes(spark, sf_dir):
    e = engine(spark, "hash")
    e.ddl("CREATE STREAM s (a INT OPTIONAL DEFAULT 1 + 2 CHECK k (a > 0))")
    return e.migration_history("s")


@_q("SELECT event_id, event_type, value FROM events WHERE event_id <= 40")
def http_events(spark, sf_dir):
    """INSERT text of the first events through the HTTP adapter, its answer and the stream."""
    first = events(spark, sf_dir).where("event_id <= 40").orderBy("event_id").collect()
    stream = "CREATE STREAM h (event_id BIGINT, event_type VARCHAR(16), value DOUBLE PRECISION)"
    store = EventStore.start(spark, {"nodeId": NODE, "databaseUrl": new_root(spark, "http"), "aggregators": {}, "streams": {"h": {"migration": stream, "aggregators": []}}})
    rows = ", ".join(f"({r['event_id']}, '{r['event_type']}', {r['value']})" for r in first)
    status, told = http.answer(store, "POST", "/api/events", f"INSERT INTO h (event_id, event_type, value) VALUES {rows}")
    if (status, told) != (200, [{"count": len(first)}]):
        raise RuntimeError(f"{status}: {told}")
    return store.engine.stream("h").select("event_id", "event_type", "value")


@_q("SELECT event_id FROM events WHERE event_id <= 20")
def stdin_lines(spark, sf_dir):
    """The same from lines of text; a broken line is told and passed over."""
    e = engine(spark, "lines")
    first = [r["event_id"] for r in events(spark, sf_dir).where("event_id <= 20").select("event_id").collect()]
    half = len(first) // 2
    lines = ["CREATE STREAM l (event_id BIGINT)", "INSERT nonsense", *(f"INSERT INTO l (event_id) VALUES {', '.join(f'({i})' for i in part)}" for part in (first[:half], first[half:]) if part)]
    said = list(cli.run(e, lines))
    if not said[1].startswith("error"):
        raise RuntimeError(said[1])
    return e.stream("l").select("event_id")


@_q("SELECT 'timeLimited' AS kind, CAST(3 AS INTEGER) AS threshold, CAST(90000 AS BIGINT) AS interval_ms")
def retention_effective(spark, sf_dir):
    rule = effective_retention([Strategy("removedAfterAggregation", threshold=3), Strategy("timeLimited", threshold=1, interval_ms=60_000), Strategy("timeLimited", threshold=2, interval_ms=90_000)])
    return spark.createDataFrame([(rule.kind, rule.threshold, rule.interval_ms)], "kind string, threshold int, interval_ms bigint")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declare a stream, insert all events, fan out, and count what waits for each aggregator."""
    return core.pending_counts(_logged(spark, sf_dir).pending("event_log"))


SQL["flagship"] = "SELECT CAST(a AS INTEGER) AS aggregator_node_id, (SELECT count(*) FROM events) AS pending FROM (VALUES (7), (12), (19)) t(a)"


def queries() -> dict:
    return {name: globals()[name] for name in SQL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


