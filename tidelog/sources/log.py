"""Stream log: immutable Parquet segments under numbered JSON commits.

A commit is one file, written whole beside the log and then given its number: by a hard
link on a local disk, by a rename that keeps what is there elsewhere. Both fail where
the number is taken, so one writer wins a version, and a crash leaves no half commit,
on any store whose rename is atomic (local disks, HDFS; not on object stores that copy).
A commit may add
segments, tombstones, a new schema history, the clock's state and a micro-batch
number, all at once. Rows carry the version that added them; a tombstone hides only
rows of lower versions, so a key that was deleted may be inserted again.
"""

from __future__ import annotations

import copy
import json
import os
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "__version"


class CommitConflict(RuntimeError):
    pass


@dataclass
class Segment:
    path: str
    version: int
    schema: int  # how many statements of the history the rows were written under
    rows: int = 0
    low: str | None = None
    high: str | None = None


@dataclass
class State:
    """The log as of its last commit."""

    version: int = 0
    source: str = ""
    hashes: list[str] = field(default_factory=list)
    clock: list[int] | None = None
    batches: dict[str, int] = field(default_factory=dict)
    tables: dict[str, list[Segment]] = field(default_factory=dict)
    tombstones: dict[str, list[Segment]] = field(default_factory=dict)


class StreamLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/log"))
        self._seen = State()

    # ------------------------------------------------------------ files
    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _create(self, path: str, text: str) -> None:
        """The file appears whole, or not at all if there is one of its name."""
        jvm, beside = self.spark._jvm, self._path(f"{self.root}/tmp/{uuid.uuid4().hex}")
        out = self._fs.create(beside, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            if self._fs.getScheme() == "file":
                os.link(beside.toUri().getPath(), self._path(path).toUri().getPath())
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(beside, self._path(path), getattr(jvm, "org.apache.hadoop.fs.Options$Rename").NONE)
        except Exception as e:
            raise CommitConflict(path) from e
        finally:
            self._fs.delete(beside, False)

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    # ------------------------------------------------------------ commits
    def state(self) -> State:
        """The last commit's state; commits that were read before are not read again."""
        known, state = f"{self._seen.version:010d}.json", copy.deepcopy(self._seen)
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/log")))
        for name in names:
            if name <= known:
                continue
            c = json.loads(self._read(f"{self.root}/log/{name}"))
            state.version = c["version"]
            state.source, state.hashes = c.get("source", state.source), c.get("hashes", state.hashes)
            state.clock = c.get("clock", state.clock)
            state.batches |= c.get("batch", {})
            if c.get("compacted"):
                state.tables, state.tombstones = {}, {}
            for kind, into in (("add", state.tables), ("remove", state.tombstones)):
                for table, s in c.get(kind, []):
                    into.setdefault(table, []).append(Segment(**s))
        self._seen = copy.deepcopy(state)
        return state

    def commit(self, after: State, **parts: object) -> int:
        version = after.version + 1
        self._create(f"{self.root}/log/{version:010d}.json", json.dumps({"version": version, **parts}))
        return version

    # ------------------------------------------------------------ segments
    def write(self, df: DataFrame, version: int, schema: int, key: str | None = None) -> Segment:
        return self.write_told(df, version, schema, key)[0]

    def write_told(self, df: DataFrame, version: int, schema: int, key: str | None = None, tell: str | None = None) -> tuple[Segment, object]:
        """A new segment, and the least value of a column of it; one pass tells rows, bounds and that."""
        path = f"{self.root}/segments/{uuid.uuid4().hex}"
        df.withColumn(VERSION, F.lit(version)).write.parquet(path)
        written = self.spark.read.parquet(path)
        stats = written.agg(F.count("*"), *([F.min(key), F.max(key)] if key else []), *([F.min(tell)] if tell else [])).first()
        return Segment(path, version, schema, stats[0], *(stats[1:3] if key else ())), stats[-1] if tell else None

    def table(self, segments: list[Segment], evolve) -> DataFrame | None:
        """Union of segments; evolve(frame, schema number) gives each the current columns."""
        by_schema: dict[int, list[str]] = {}
        for s in segments:
            if s.rows:
                by_schema.setdefault(s.schema, []).append(s.path)
        frames = [evolve(self.spark.read.parquet(*paths), schema) for schema, paths in sorted(by_schema.items())]
        return reduce(DataFrame.unionByName, frames) if frames else None

    def hidden(self, rows: DataFrame, tombstones: list[Segment], keys: list[str]) -> DataFrame:
        """rows without those that a later tombstone names."""
        marks = [s.path for s in tombstones if s.rows]
        if not marks:
            return rows
        gone = self.spark.read.parquet(*marks).groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max(VERSION).alias("__gone"))
        same = reduce(lambda a, b: a & b, [rows[k] == gone[f"__{k}"] for k in keys])
        return rows.join(gone, same & (rows[VERSION] < gone["__gone"]), "left_anti")
