"""The durable placement records: a log of committed batches with versions and compare-and-set.

A record is created once, changed and deleted only by a writer that names the version it
saw. A batch of writes is decided against the log by one join; of writes to one cell in a
batch only the first can name the current version, so the others are refused. Refused
writes are logged too, which is where a batch's answers are read from.

A batch counts once its commit file is there: files are numbered, and one is created only if no other writer
has it, so of two that decided against the same state one is told to decide again. `compact` commits the current records as a
new beginning, behind which no reader looks.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMA = "shard_id bigint, x int, y int, node_id string, region string, version bigint, deleted boolean, seq bigint, batch string, refusal string"
CELL = ["shard_id", "x", "y"]
#: Tenths of a second for which a commit that is being written is waited for.
WAIT = 50
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def address(shard_id, x, y):
    return F.format_string("gridloom_placement:%d:%d:%d", shard_id, x, y)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_commits")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)
    return files, where


def _said(spark: SparkSession, files, where) -> str:
    """What a commit file says. One that is empty is being written; if it stays so, its writer has died and it says nothing."""
    for _ in range(WAIT):
        stream = files.open(where)
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        if text:
            return text
        time.sleep(0.1)
    return ""


def _commits(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The last commit's number, and the batches from the last compaction on."""
    files, where = _files(spark, path)
    held = {int(s.getPath().getName()): _said(spark, files, s.getPath()) for s in files.listStatus(where)}
    first = max([n for n, said in held.items() if said.startswith("base ")], default=0)
    return max(held, default=0), [said.split()[1] for n, said in sorted(held.items()) if said and n >= first]


def _commit(spark: SparkSession, path: str, number: int, batch: str, kind: str) -> bool:
    """Whether this writer got the number: a file system creates a file for one of them only."""
    files, where = _files(spark, path)
    try:
        stream = files.create(spark._jvm.org.apache.hadoop.fs.Path(where, f"{number:012d}"), False)
    except Exception as error:
        if "AlreadyExists" in str(error) or "already exists" in str(error):
            return False
        raise
    try:
        stream.write(bytearray(f"{kind} {batch}".encode()))
    finally:
        stream.close()
    return True


def _read(spark: SparkSession, path: str, batches: list[str]) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(*[f"{path}/{b}" for b in batches]) if batches else spark.createDataFrame([], SCHEMA)


def _current(rows: DataFrame) -> DataFrame:
    return rows.filter("refusal is null").groupBy(*CELL).agg(F.max_by(F.struct("node_id", "region", "version", "deleted"), "version").alias("r")).select(*CELL, "r.*")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The current record of each cell, deleted ones included."""
    return _current(_read(spark, path, _commits(spark, path)[1]))


def decide(current: DataFrame, writes: DataFrame) -> DataFrame:
    """`writes` (seq, shard_id, x, y, node_id, region, expect bigint: null to create, delete boolean) with refusal and version."""
    rows = writes.join(current.select(*CELL, F.col("version").alias("held"), F.col("deleted").alias("gone")), CELL, "left")
    here = F.col("held").isNotNull() & ~F.col("gone")
    fits = F.when(F.col("expect").isNull(), ~here).otherwise(here & (F.col("held") == F.col("expect")))
    first = F.row_number().over(Window.partitionBy(*CELL).orderBy((~fits).cast("int"), "seq")) == 1
    refusal = F.when(~fits, F.when(F.col("expect").isNull(), "exists").otherwise("version")).when(~first, "version")
    return rows.withColumn("refusal", refusal).withColumn("version", F.when(refusal.isNull(), F.coalesce("held", F.lit(0)) + 1))


def write(spark: SparkSession, path: str, writes: DataFrame, tries: int = 20) -> DataFrame:
    """Commit the writes that fit; returns seq and refusal of each."""
    for _ in range(tries):
        number, batches = _commits(spark, path)
        batch = uuid.uuid4().hex
        rows = decide(_current(_read(spark, path, batches)), writes).withColumn("batch", F.lit(batch)).withColumn("deleted", F.col("delete"))
        rows = rows.withColumns({c: F.when(~F.col("delete"), F.col(c)) for c in ("node_id", "region")})
        rows.select(*_COLUMNS).write.parquet(f"{path}/{batch}")
        if _commit(spark, path, number + 1, batch, "log"):
            return _read(spark, path, [batch]).select("seq", "refusal")
    raise RuntimeError(f"other writers were first {tries} times")


def compact(spark: SparkSession, path: str) -> bool:
    """Commit the current records as the new beginning of the log; false if another writer was first."""
    number, batches = _commits(spark, path)
    batch = uuid.uuid4().hex
    rows = _current(_read(spark, path, batches)).withColumns({"seq": F.lit(None).cast("bigint"), "batch": F.lit(batch), "refusal": F.lit(None).cast("string")})
    rows.select(*_COLUMNS).write.parquet(f"{path}/{batch}")
    return _commit(spark, path, number + 1, batch, "base")
