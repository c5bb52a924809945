"""Tables that cut a job's lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local one of this session only where that is unset, as in tests."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set(SETTING, folder)
    return folder.rstrip("/")


_written: list[str] = []


def kept(df: DataFrame) -> DataFrame:
    """The rows, written once as Parquet in the shared folder and read from there.

    Results are lazy, so the tables stay until their owner, the caller of the operator, has written what
    it wants and calls `discard` (or clears the folder).
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gridloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in time for `discard`."""
    return len(_written)


def discard(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables that this process has kept since a mark; the number of them. Frames that read them can't be used any more."""
    paths, _written[since:] = _written[since:], []
    for path in paths:
        _delete(spark, path)
    return len(paths)


def dropped(df: DataFrame) -> None:
    """Delete the tables behind a kept frame that nothing reads any more."""
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for path in [p for p in _written if any(f.endswith(p.split(":", 1)[-1]) for f in folders)]:
        _delete(df.sparkSession, path)
        _written.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
