"""Session files: JSON arrays of messages, read whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import MESSAGE, VARIANTS


def read_session(spark: SparkSession, path: str | None) -> DataFrame:
    """seq (place in the array) and one non-null variant struct per message; no path: no messages.

    Bad JSON, a missing file, or an element with an unknown or with several variants fails the read.
    """
    if path is None:
        return spark.createDataFrame([], T.StructType([T.StructField("seq", T.LongType()), *MESSAGE.fields]))
    return messages(spark.read.text(path, wholetext=True))


def messages(texts: DataFrame) -> DataFrame:
    """Decode a column `value` of JSON arrays."""
    names = F.from_json("value", "array<map<string,string>>", {"mode": "FAILFAST"})
    typed = F.from_json("value", T.ArrayType(MESSAGE), {"mode": "FAILFAST"})
    rows = texts.select(F.posexplode(F.arrays_zip(names.alias("names"), typed.alias("typed"))).alias("seq", "m"))
    known = F.map_keys("m.names")
    ok = (F.size(known) == 1) & F.arrays_overlap(known, F.array(*[F.lit(v) for v in VARIANTS]))
    checked = F.when(ok, F.col("m.typed")).otherwise(F.raise_error(F.concat(F.lit("unknown message variant: "), F.array_join(known, ","))))
    return rows.select(F.col("seq").cast("bigint").alias("seq"), checked.alias("m")).select("seq", "m.*")


def encode(messages: DataFrame) -> DataFrame:
    """seq and the JSON text of each message."""
    return messages.select("seq", F.to_json(F.struct(*VARIANTS)).alias("value"))
