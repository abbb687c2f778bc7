from __future__ import annotations

import pytest

from tidelog.config import ConfigError, Strategy, effective_retention, parse_config

GOOD = {
    "databaseUrl": "file:///tmp/x",
    "nodeId": 1,
    "aggregators": {"7": {"baseUrl": "http://a"}},
    "streams": {"s": {"migration": "CREATE STREAM s ()", "aggregators": [{"nodeId": 7, "aggregationStrategy": {"kind": "batchBySize", "size": 100}, "retentionStrategy": {"kind": "removedAfterAggregation", "threshold": 1}}]}},
}


def test_valid():
    c = parse_config(GOOD)
    assert c.streams["s"].aggregators[0].aggregation == Strategy("batchBySize", size=100)
    assert c.aggregators == {7: "http://a"} and c.sweep_interval_ms == 60_000


def test_all_issues_are_collected():
    bad = {"nodeId": 916132832, "aggregators": {"x": {}, "8": {}}, "streams": {"s": {"migration": "", "aggregators": [{"nodeId": 9, "aggregationStrategy": {"kind": "batchByTime"}, "retentionStrategy": {"kind": "removedAfterAggregation", "threshold": 5}}]}, "t": {}}}
    with pytest.raises(ConfigError) as e:
        parse_config(bad)
    assert len(e.value.issues) == 8
    with pytest.raises(ConfigError):
        parse_config("{")


def test_effective_retention():
    by_count, timed = Strategy("removedAfterAggregation", threshold=1), Strategy("timeLimited", threshold=2, interval_ms=50)
    assert effective_retention([]).kind == effective_retention([by_count, Strategy("indefinite")]).kind == "indefinite"
    assert effective_retention([by_count, Strategy("removedAfterAggregation", threshold=3)]) == Strategy("removedAfterAggregation", threshold=3)
    assert effective_retention([by_count, timed, Strategy("timeLimited", threshold=1, interval_ms=90)]) == Strategy("timeLimited", threshold=2, interval_ms=90)
