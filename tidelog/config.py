"""Event store configuration; every problem is reported, not just the first."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from .functions.hlc import MAX_NODE_ID

#: Settings of each strategy besides its kind.
AGGREGATION = {"sentImmediately": (), "batchBySize": ("size",), "batchByTime": ("intervalMs",), "sharedDatabase": ()}
RETENTION = {"indefinite": (), "removedAfterAggregation": ("threshold",), "timeLimited": ("threshold", "intervalMs")}
SWEEP_INTERVAL_MS = 60_000


class ConfigError(ValueError):
    def __init__(self, issues: list[str]):
        super().__init__("; ".join(issues))
        self.issues = issues


@dataclass(frozen=True)
class Strategy:
    kind: str
    size: int | None = None
    threshold: int | None = None
    interval_ms: int | None = None


@dataclass(frozen=True)
class StreamAggregator:
    node_id: int
    aggregation: Strategy
    retention: Strategy


@dataclass(frozen=True)
class StreamConfig:
    migration: str
    aggregators: tuple[StreamAggregator, ...] = ()


@dataclass(frozen=True)
class StoreConfig:
    database_url: str
    node_id: int
    streams: dict[str, StreamConfig] = field(default_factory=dict)
    aggregators: dict[int, str] = field(default_factory=dict)
    sweep_interval_ms: int = SWEEP_INTERVAL_MS


def _whole(value: object, low: int = 0, high: int | None = None) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and value >= low and (high is None or value <= high)


def _strategy(raw: object, kinds: dict[str, tuple[str, ...]], at: str, issues: list[str]) -> Strategy:
    kind = raw.get("kind") if isinstance(raw, dict) else None
    if kind not in kinds:
        issues.append(f"{at}.kind must be one of {', '.join(kinds)}")
        return Strategy("")
    values = {}
    for name in kinds[kind]:
        if _whole(raw.get(name), 1):
            values["interval_ms" if name == "intervalMs" else name] = raw[name]
        else:
            issues.append(f"{at}.{name} must be a positive integer")
    return Strategy(kind, **values)


def parse_config(raw: str | dict) -> StoreConfig:
    issues: list[str] = []
    if isinstance(raw, str):
        try:
            raw = json.loads(raw)
        except ValueError as e:
            raise ConfigError([f"not JSON: {e}"]) from e
    if not isinstance(raw, dict):
        raise ConfigError(["the configuration must be an object"])
    if not isinstance(raw.get("databaseUrl"), str) or not raw["databaseUrl"]:
        issues.append("databaseUrl must be a text")
    if not _whole(raw.get("nodeId"), 0, MAX_NODE_ID):
        issues.append(f"nodeId must be an integer in 0..{MAX_NODE_ID}")
    urls: dict[int, str] = {}
    for name, a in (raw.get("aggregators") or {}).items():
        if not name.isdigit() or int(name) > MAX_NODE_ID:
            issues.append(f"aggregators.{name} must be a node id")
        elif not isinstance(a, dict) or not isinstance(a.get("baseUrl"), str):
            issues.append(f"aggregators.{name}.baseUrl must be a text")
        else:
            urls[int(name)] = a["baseUrl"]
    streams: dict[str, StreamConfig] = {}
    if not isinstance(raw.get("streams", {}), dict):
        issues.append("streams must be an object")
        raw = {**raw, "streams": {}}
    for name, s in raw.get("streams", {}).items():
        at = f"streams.{name}"
        if not isinstance(s, dict) or not isinstance(s.get("migration"), str):
            issues.append(f"{at}.migration must be a text")
            continue
        listed, members = s.get("aggregators", []), []
        for i, a in enumerate(listed):
            here = f"{at}.aggregators[{i}]"
            if not isinstance(a, dict) or not _whole(a.get("nodeId"), 0, MAX_NODE_ID):
                issues.append(f"{here}.nodeId must be an integer in 0..{MAX_NODE_ID}")
                continue
            if a["nodeId"] not in urls:
                issues.append(f"{here}.nodeId {a['nodeId']} has no entry in aggregators")
            if a["nodeId"] in [m.node_id for m in members]:
                issues.append(f"{here}.nodeId {a['nodeId']} is listed twice")
            member = StreamAggregator(a["nodeId"], _strategy(a.get("aggregationStrategy"), AGGREGATION, f"{here}.aggregationStrategy", issues), _strategy(a.get("retentionStrategy"), RETENTION, f"{here}.retentionStrategy", issues))
            if member.retention.threshold and member.retention.threshold > len(listed):
                issues.append(f"{here}.retentionStrategy.threshold is above the number of aggregators")
            members.append(member)
        streams[name] = StreamConfig(s["migration"], tuple(members))
    sweep = raw.get("sweepIntervalMs", SWEEP_INTERVAL_MS)
    if not _whole(sweep, 1):
        issues.append("sweepIntervalMs must be a positive integer")
    if issues:
        raise ConfigError(issues)
    return StoreConfig(raw["databaseUrl"], raw["nodeId"], streams, urls, sweep)


def effective_retention(strategies: list[Strategy]) -> Strategy:
    """One rule for a stream: indefinite if any or none, else the largest threshold, and the largest interval if any has one."""
    if not strategies or any(s.kind == "indefinite" for s in strategies):
        return Strategy("indefinite")
    threshold = max(s.threshold for s in strategies)
    spans = [s.interval_ms for s in strategies if s.kind == "timeLimited"]
    return Strategy("timeLimited", threshold=threshold, interval_ms=max(spans)) if spans else Strategy("removedAfterAggregation", threshold=threshold)
