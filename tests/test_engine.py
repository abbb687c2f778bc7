from __future__ import annotations

import json
import os
import urllib.request
from datetime import datetime, timedelta, timezone
from threading import Thread

import pytest

import tidelog.store
from tidelog.catalog import HLC
from tidelog.engine import Engine
from tidelog.lang.errors import AnalysisError, ConstraintError, MigrationError
from tidelog.operators import core
from tidelog.sources import cli, http
from tidelog.sources.log import CommitConflict, StreamLog
from tidelog.sources.paths import new_root
from tidelog.store import EventStore, RegistrationError

NOW = 1_700_000_000_000
SENSOR = "CREATE STREAM r (reading REAL CHECK in_range (reading > 0 AND reading <= 100), units VARCHAR(8), note TEXT OPTIONAL)"


@pytest.fixture
def engine(spark):
    e = Engine(spark, new_root(spark, "test"), 7, lambda: NOW)
    e.ddl(SENSOR)
    e.aggregators["r"] = [7, 12]
    return e


def test_insert_returns_counts_and_rows(engine):
    assert engine.execute("INSERT INTO r (reading, units) VALUES (1, 'a'), (2, 'b'), (3, 'c')") == [3]
    rows = engine.execute("INSERT INTO r (reading, units) VALUES (4, 'd'), (5, 'e') RETURNING *")[0].orderBy(HLC).collect()
    assert [(r["_sys_hlc_count"], r["units"]) for r in rows] == [(4, "d"), (5, "e")]
    assert len({r[HLC] for r in rows}) == 2
    assert engine.pending("r").count() == 10


@pytest.mark.parametrize("values", ["(400, 'a')", "(1, 'far too long')", "(1, NULL)", "(1, 'a'), (0, 'b')"])
def test_refused_rows_leave_nothing(engine, values):
    with pytest.raises(ConstraintError):
        engine.execute(f"INSERT INTO r (reading, units) VALUES {values}")
    assert engine.stream("r").count() == engine.pending("r").count() == 0
    assert engine.execute("INSERT INTO r (reading, units) VALUES (1, 'a') RETURNING _sys_hlc_count AS n")[0].first()["n"] == 1


def test_a_batch_is_checked_before_it_runs(engine):
    with pytest.raises(AnalysisError):
        engine.execute("INSERT INTO r (reading, units) VALUES (1, 'a'); INSERT INTO r (nope) VALUES (1)")
    assert engine.stream("r").count() == 0


def test_receive_is_idempotent_and_a_deleted_key_may_return(engine, spark):
    engine.execute("INSERT INTO r (reading, units) VALUES (1, 'a'), (2, 'b')")
    other = Engine(spark, new_root(spark, "other"), 9, lambda: NOW)
    other.ddl(SENSOR)
    other.aggregators["r"] = [31]
    sent = engine.stream("r")
    assert [other.receive("r", sent), other.receive("r", sent.union(sent))] == [2, 0]
    assert other.pending("r").count() == 2
    assert other.sweep("r", 1, 0) == 2
    assert other.stream("r").count() == other.pending("r").count() == 0
    assert other.receive("r", sent) == 2 and other.stream("r").count() == 2
    with pytest.raises(ConstraintError):
        other.receive("r", sent.drop(HLC))


def test_a_plain_insert_of_a_stored_key_fails(engine):
    engine.execute("INSERT INTO r (reading, units) VALUES (1, 'a')")
    rows = engine.stream("r")
    assert core.conflicts(rows, rows).count() == 1
    assert core.conflicts(rows.union(rows), None).count() == 1


def test_delivery_is_at_least_once(engine):
    engine.execute("INSERT INTO r (reading, units) VALUES (1, 'a'), (2, 'b'), (3, 'c')")
    seen = []
    assert engine.deliver("r", 7, lambda df: False, 2) == 0
    with pytest.raises(RuntimeError):
        engine.deliver("r", 7, lambda df: (_ for _ in ()).throw(RuntimeError("down")), 2)
    assert engine.pending("r").count() == 6
    assert engine.deliver("r", 7, lambda df: seen.extend(r["units"] for r in df.collect()) or True, 2) == 2
    assert seen == ["a", "b"] and engine.pending("r").count() == 4
    assert engine.deliver("r", 7, lambda df: True) == 1 and engine.deliver("r", 7, lambda df: True) == 0
    inserted, delivered = 3, 3
    assert engine.pending("r").count() + delivered == inserted * 2


def test_retention(engine):
    engine.execute("INSERT INTO r (reading, units) VALUES (1, 'a'), (2, 'b')")
    engine.deliver("r", 7, lambda df: True, 1)
    later = datetime.now(timezone.utc) + timedelta(hours=1)
    assert engine.sweep("r", 2, 1, interval_ms=7_200_000, now=later) == 0
    assert engine.sweep("r", 2, 1, interval_ms=60_000, now=later) == 1
    assert [r["units"] for r in engine.stream("r").collect()] == ["b"]
    assert engine.pending("r").count() == 2
    engine.compact("r")
    assert engine.stats("r").orderBy("aggregator_node_id").collect()[0].asDict() == {"stream": "r", "events": 1, "migrations": 1, "aggregator_node_id": 7, "pending": 1}


def test_schema_evolution_on_read(engine):
    engine.execute("INSERT INTO r (reading, units, note) VALUES (95, 'a', 'x')")
    engine.ddl("ALTER STREAM r ADD COLUMN cal VARCHAR(24) OPTIONAL, ALTER COLUMN units TYPE VARCHAR(64), ADD COLUMN n INT DEFAULT 3, ADD COLUMN g INT GENERATED ALWAYS AS (n * 2) STORED, DROP COLUMN note")
    assert engine.stream("r").select("reading", "units", "cal", "n", "g").first()[:] == (95.0, "a", None, 3, 6)
    with pytest.raises(ConstraintError):
        engine.ddl("ALTER STREAM r DROP CONSTRAINT in_range, ADD CONSTRAINT CHECK in_range (reading <= 90)")
    engine.ddl("ALTER STREAM r ADD COLUMN note TEXT OPTIONAL")
    assert engine.stream("r").first()["note"] is None


def test_migration_is_append_only_and_survives_a_restart(spark):
    root = new_root(spark, "migrate")
    first, more = "CREATE STREAM s (a INT); ", "ALTER STREAM s ADD COLUMN b INT DEFAULT 4"
    one = Engine(spark, root, 7, lambda: NOW)
    one.migrate("s", first)
    one.execute("INSERT INTO s (a) VALUES (1)")
    two = Engine(spark, root, 7, lambda: NOW)
    assert len(two.migrate("s", first + more)) == 2
    two.execute("INSERT INTO s (a) VALUES (2)")
    assert [(r["_sys_hlc_count"], r["a"], r["b"]) for r in two.stream("s").orderBy(HLC).collect()] == [(1, 1, 4), (2, 2, 4)]
    with pytest.raises(MigrationError, match="is not the one"):
        Engine(spark, root, 7).migrate("s", "CREATE STREAM s (a BIGINT); " + more)


def test_streams_are_loaded_from_their_logs(spark):
    root = new_root(spark, "load")
    one = Engine(spark, root, 7, lambda: NOW)
    one.ddl("CREATE STREAM a (x INT); CREATE STREAM b (y INT) -- two streams\n; ALTER STREAM a ADD COLUMN z INT DEFAULT 2")
    one.execute("INSERT INTO a (x) VALUES (1)")
    two = Engine(spark, root, 7, lambda: NOW)
    with pytest.raises(AnalysisError):
        two.ddl("CREATE STREAM a (x INT)")
    assert [c.name for c in two.load("a").columns] == ["x", "z"] and [c.name for c in two.load("b").columns] == ["y"]
    two.ddl("ALTER STREAM a ADD COLUMN w INT OPTIONAL")
    assert len(two.migration_history("a").collect()) == 3
    assert two.stream("a").select("x", "z", "w").first()[:] == (1, 2, None)
    with pytest.raises(AnalysisError):
        two.load("nope")


def test_one_writer_wins_a_version(spark):
    log = StreamLog(spark, new_root(spark, "log"))
    state = log.state()
    log.commit(state, hashes=["x"])
    with pytest.raises(CommitConflict):
        log.commit(state, hashes=["y"])
    assert log.state().hashes == ["x"]


def test_a_crash_before_the_commit_leaves_the_stream_as_it_was(engine, monkeypatch):
    engine.execute("INSERT INTO r (reading, units) VALUES (1, 'a')")
    monkeypatch.setattr(StreamLog, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        engine.execute("INSERT INTO r (reading, units) VALUES (2, 'b')")
    monkeypatch.undo()
    assert engine.stream("r").count() == 1 and engine.pending("r").count() == 2


CONFIG = {
    "nodeId": 1,
    "aggregators": {"7": {"baseUrl": "a"}, "12": {"baseUrl": "b"}},
    "streams": {
        "r": {
            "migration": SENSOR,
            "aggregators": [
                {"nodeId": 7, "aggregationStrategy": {"kind": "batchBySize", "size": 2}, "retentionStrategy": {"kind": "removedAfterAggregation", "threshold": 2}},
                {"nodeId": 12, "aggregationStrategy": {"kind": "sharedDatabase"}, "retentionStrategy": {"kind": "removedAfterAggregation", "threshold": 1}},
            ],
        }
    },
}


def test_store_and_http(spark):
    posts = []

    def transport(url, path, body):
        posts.append((url, path, body))
        return 200, {"migration": SENSOR.replace(" ", "  ")}

    store = EventStore.start(spark, CONFIG | {"databaseUrl": new_root(spark, "store")}, transport)
    server = http.server(store)
    Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def call(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, body and body.encode())) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    assert call("/api/events", "INSERT INTO r (reading, units) VALUES (1, 'a'), (2, 'b'), (3, 'c')") == (200, [{"count": 3}])
    assert call("/api/events", "INSERT INTO r (nope) VALUES (1)")[0] == 400
    assert call("/api/admin")[1]["r"] == [{"stream": "r", "events": 3, "migrations": 1, "aggregator_node_id": 7, "pending": 3}]
    assert store.deliver_pending_for("r", 7) == 2 and store.deliver_pending_for("r", 12) == 0
    assert [x["units"] for x in posts[-1][2]["rows"]] == ["a", "b"]
    assert store.sweep_all() == {"r": 2}
    server.shutdown()
    store.close()
    with pytest.raises(RegistrationError):
        EventStore.start(spark, CONFIG | {"databaseUrl": new_root(spark, "store")}, lambda *a: (200, {"migration": "CREATE STREAM r (other INT)"}))


def test_two_stores_talk(spark, monkeypatch):
    """Registration, delivery in bounded posts and idempotent receive, over HTTP."""
    monkeypatch.setattr(tidelog.store, "POST_ROWS", 2)
    upper = {"nodeId": 7, "aggregators": {}, "streams": {"r": {"migration": SENSOR, "aggregators": []}}, "databaseUrl": new_root(spark, "upper")}
    aggregator = EventStore.start(spark, upper)
    server = http.server(aggregator)
    Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    lower = json.loads(json.dumps(CONFIG))
    lower["aggregators"] = {"7": {"baseUrl": base}}
    lower["streams"]["r"]["aggregators"] = [{"nodeId": 7, "aggregationStrategy": {"kind": "sentImmediately"}, "retentionStrategy": {"kind": "indefinite"}}]
    collector = EventStore.start(spark, lower | {"databaseUrl": new_root(spark, "lower")})
    collector.create_events("INSERT INTO r (reading, units) VALUES (1, 'a'), (2, 'b'), (3, 'c'), (4, 'd'), (5, 'e')")
    assert collector.deliver_pending_for("r", 7) == 5 and collector.deliver_pending_for("r", 7) == 0
    same = [[tuple(x) for x in s.engine.stream("r").select("reading", "units", "_sys_hlc").orderBy("_sys_hlc").collect()] for s in (collector, aggregator)]
    assert same[0] == same[1] and len(same[0]) == 5
    rows = [json.loads(x) for x in collector.engine.stream("r").toJSON().collect()]
    assert http.post(base, "/streams/r/events", {"rows": rows}) == (200, {"count": 0})
    assert http.post(base, "/streams/r/events", {"rows": []})[0] == 400
    assert http.post(base, "/streams/none/events", {"rows": rows})[0] == 404 and http.post(base, "/streams/none/register", None)[0] == 404
    server.shutdown()
    server.server_close()
    assert http.post(base, "/streams/r/register", None) == (503, None)


def test_a_commit_is_whole_or_absent(engine, monkeypatch):
    """Two writers of one version: one wins; a writer that dies midway leaves no file in the log."""
    log = engine.log("r")
    state = log.state()
    log.commit(state, clock=[1, 2])
    with pytest.raises(CommitConflict):
        log.commit(state, clock=[3, 4])
    assert log.state().clock == [1, 2]
    link = os.link
    monkeypatch.setattr(os, "link", lambda *a: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(CommitConflict):
        log.commit(log.state(), clock=[5, 6])
    monkeypatch.setattr(os, "link", link)
    assert log.state().clock == [1, 2]
    log.commit(log.state(), clock=[7, 8])
    assert log.state().clock == [7, 8]


def test_of_forwarded_rows_the_first_of_a_key_stays(engine):
    engine.execute("INSERT INTO r (reading, units) VALUES (1, 'a')")
    from pyspark.sql import functions as F

    row = engine.stream("r").withColumn("_sys_hlc", F.lit("0000000000000zz"))
    rows = row.union(row.withColumn("units", F.lit("b"))).union(row.withColumn("units", F.lit("c"))).coalesce(1)
    assert engine.receive("r", rows) == 1
    assert engine.stream("r").where("_sys_hlc = '0000000000000zz'").first()["units"] == "a"
    with pytest.raises(ConstraintError, match="no forwarded rows"):
        engine.receive("r", rows.limit(0))


def test_command_line(spark):
    e = Engine(spark, new_root(spark, "cli"), 7, lambda: NOW)
    said = list(cli.run(e, ["CREATE STREAM c (a INT)", "INSERT INTO c (a) VALUES (1), (2)", "nonsense", "INSERT INTO c (a) VALUES (3) RETURNING a", "~quit", "never"]))
    assert said[:2] == ["ok", "2 inserted"] and said[2].startswith("error") and said[3] == "1 rows"
