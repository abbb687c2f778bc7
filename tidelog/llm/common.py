"""Helpers shared by the corpus operators: shared storage, row keys, text classes."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    It is read from the session. Only where it is unset (a single-machine test)
    a local folder is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is unset; on a cluster it names the folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidelog-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidelog-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def remove_tables(spark: SparkSession) -> None:
    """Delete the tables that this application's operators wrote; call it when their results are stored."""
    _delete(spark, _own(spark))


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def session_conf(spark: SparkSession, **settings: str):
    """Set session settings (dots as double underscores) and put the old ones back."""
    pairs = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in pairs}
    try:
        for k, v in pairs.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: the lineage ends there.

    A lost executor then costs a re-read, and the shuffle files behind the table
    are released as soon as it is written.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._tidelog_path = path
    return table


def materialize_dealt(df: DataFrame, name: str, column: str) -> DataFrame:
    """Like :func:`materialize`, dealt by the hash of a column into as many files as a shuffle has partitions.

    Joins on the column read it as it lies, without an exchange, so rows as large as
    whole texts are shuffled once however often they are joined. A join has to compare
    the plain column with ``==``. Spark knows such tables by name only; the name goes
    from the catalog as soon as it is resolved, the files stay until they are released.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    table_name = f"tidelog_{uuid.uuid4().hex}"
    parts = min(int(spark.conf.get(f"spark.sql.{k}")) for k in ("shuffle.partitions", "sources.bucketing.maxBuckets"))
    with session_conf(spark, **{_CLEANUP: "true"}):
        df.repartition(parts, column).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(parts, column).saveAsTable(table_name)
    table = spark.table(table_name)
    spark.sql(f"DROP TABLE {table_name}")
    table._tidelog_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote and that no plan reads any more."""
    for table in tables:
        _delete(table.sparkSession, table._tidelog_path)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    Text of ASCII only takes the byte-wise lower(); the rest is translated.
    """
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def strip_ascii(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def hash_pair(value: Column) -> tuple[Column, Column]:
    """Two independently seeded 64-bit hashes: 128 bits against collisions."""
    return F.xxhash64(value), F.xxhash64(F.lit("second"), value)


def unnested(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a Generate, which the optimizer never merges into a
    later projection; an array built here is built once a row, even where a
    lambda refers to it.
    """
    named = F.struct(*[c.alias(k) for k, c in columns.items()])
    return df.select("*", F.explode(F.array(named)).alias("__u")).select(*df.columns, *[F.col(f"__u.{k}").alias(k) for k in columns])


def without_lines(text: Column, dropped: Column) -> Column:
    """A text without the lines at the positions in dropped; each line is looked at once."""
    lines = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
    flag = lambda keep: lambda i: F.struct(i.alias("i"), F.lit(keep).alias("keep"))
    flags = F.array_sort(F.concat(F.transform(kept, flag(True)), F.transform(dropped, flag(False))))
    return F.array_join(F.zip_with(lines, flags, lambda line, f: F.when(f["keep"], line)), "\n")


def row_key(*columns: Column) -> Column:
    """Hash that tells apart rows which share a document id."""
    return F.xxhash64(*columns)
