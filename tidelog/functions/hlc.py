"""Hybrid logical clock: base 62, the clock on the driver, and both as columns.

A value is 15 characters: 8 of milliseconds, 2 of a counter, 5 of the node id, each
base 62 with the digits in ASCII order, so string order is (ms, counter, node) order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.paths import new_root

#: Fixed values of the encoding.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MS_WIDTH, COUNTER_WIDTH, NODE_WIDTH = 8, 2, 5
WIDTH = MS_WIDTH + COUNTER_WIDTH + NODE_WIDTH
COUNTERS = 62**COUNTER_WIDTH
MAX_NODE_ID = 62**NODE_WIDTH - 1


class HlcError(ValueError):
    pass


def encode(value: int, width: int) -> str:
    if not 1 <= width <= 8:
        raise HlcError(f"width {width} is not in 1..8")
    if value < 0:
        raise HlcError(f"{value} is negative")
    if value >= 62**width:
        raise HlcError(f"{value} does not fit {width} digits")
    out = ""
    for _ in range(width):
        value, digit = divmod(value, 62)
        out = ALPHABET[digit] + out
    return out


def decode(text: str) -> int:
    value = 0
    for i, c in enumerate(text):
        digit = ALPHABET.find(c)
        if digit < 0 or not c:
            raise HlcError(f"invalid character {c!r} at {i}")
        value = value * 62 + digit
    return value


@dataclass(frozen=True, order=True)
class Stamp:
    ms: int
    counter: int
    node: int

    def __str__(self) -> str:
        return encode(self.ms, MS_WIDTH) + encode(self.counter, COUNTER_WIDTH) + encode(self.node, NODE_WIDTH)

    @staticmethod
    def parse(text: str) -> Stamp:
        if len(text) != WIDTH:
            raise HlcError(f"{text!r} does not have {WIDTH} characters")
        return Stamp(decode(text[:8]), decode(text[8:10]), decode(text[10:]))


class HlcClock:
    """The clock of one node; reserve() draws many stamps at once, in closed form."""

    def __init__(self, node: int, now: Callable[[], int] | None = None, state: tuple[int, int] | None = None):
        if not 0 <= node <= MAX_NODE_ID:
            raise HlcError(f"node id {node} is not in 0..{MAX_NODE_ID}")
        self.node = node
        self.now = now or (lambda: time.time_ns() // 1_000_000)
        self.ms, self.counter = state or (self.now(), 0)

    def reserve(self, n: int) -> tuple[int, int]:
        """(ms, first): stamp i of n has ms + (first + i) div 3844 and counter (first + i) mod 3844."""
        wall = self.now()
        ms, first = (wall, 0) if wall > self.ms else (self.ms, self.counter + 1)
        if n:
            last = first + n - 1
            self.ms, self.counter = ms + last // COUNTERS, last % COUNTERS
        return ms, first

    def next(self) -> Stamp:
        self.reserve(1)
        return Stamp(self.ms, self.counter, self.node)

    def merge(self, remote: str) -> Stamp:
        """Take note of a remote stamp; a malformed one leaves the clock as it was."""
        other, wall = Stamp.parse(remote), self.now()
        ms = max(self.ms, other.ms, wall)
        held = [c for at, c in ((self.ms, self.counter), (other.ms, other.counter)) if at == ms]
        counter = max(held) + 1 if held else 0
        self.ms, self.counter = ms + counter // COUNTERS, counter % COUNTERS
        return Stamp(self.ms, self.counter, self.node)


# ---------------------------------------------------------------- columns
def encode_column(value: Column, width: int) -> Column:
    """Base 62 of a non-negative bigint below 62 ** width."""
    digit = lambda i: F.substring(F.lit(ALPHABET), (F.call_function("div", value, F.lit(62**i)) % 62 + 1).cast("int"), F.lit(1))
    return F.concat(*[digit(i) for i in reversed(range(width))])


def decode_column(text: Column) -> Column:
    """The number of a text; a character that is no digit is an error."""
    digits = F.filter(F.split(text, ""), lambda c: c != "")
    value = F.aggregate(digits, F.lit(0).cast("long"), lambda acc, c: acc * 62 + F.instr(F.lit(ALPHABET), c) - 1)
    return F.when(text.rlike("[^0-9A-Za-z]"), F.raise_error(F.concat(F.lit("invalid character in "), text))).otherwise(value)


def stamp_columns(index: Column, ms: int, first: int, node: int) -> dict[str, Column]:
    """ms, counter, node and text of stamp number `index` (from 0) of a reserve()."""
    k = index + F.lit(first)
    at = (F.lit(ms) + F.floor(k / COUNTERS)).cast("long")
    counter = (k % COUNTERS).cast("int")
    text = F.concat(encode_column(at, MS_WIDTH), encode_column(counter, COUNTER_WIDTH), F.lit(encode(node, NODE_WIDTH)))
    return {"hlc": text, "ms": at, "counter": counter, "node": F.lit(node)}


def parts(text: Column) -> dict[str, Column]:
    return {"ms": decode_column(F.substring(text, 1, 8)), "counter": decode_column(F.substring(text, 9, 2)).cast("int"), "node": decode_column(F.substring(text, 11, 5)).cast("int")}


def indexed(rows: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """rows with their place in a total order, from 0, and how many there are.

    Rows are range-partitioned, sorted and written once to the shared folder with
    their partition and their place in it: sorting again could draw other bounds. A
    partition's offset comes from the counts, a row a partition, so no task sees all
    rows.
    """
    spark = rows.sparkSession
    path = new_root(spark, "order")
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__inside", inside).write.parquet(path)
    placed = spark.read.parquet(path)
    counts = {r["__part"]: r["count"] for r in placed.groupBy("__part").count().collect()}
    starts, total = [], 0
    for part in sorted(counts):
        starts.append((part, total))
        total += counts[part]
    offsets = spark.createDataFrame(starts, "__part int, __start bigint")
    out = placed.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__start") + F.col("__inside"))
    return out.drop("__part", "__inside", "__start"), total
