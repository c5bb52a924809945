"""Rules that need the rows of a key one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def folded(rows: DataFrame, keys: list[str], order: list[str], run, schema: str) -> DataFrame:
    """`run` over rows that come sorted, all of one key in a row: a key's state is all that a task holds, however many rows a key has.

    The rows are dealt by a hash of the keys, by which no input is dealt already. Dealt by the keys themselves, a union of parts
    that are dealt by them would be taken as it is, and adaptive execution may then merge the parts' partitions differently.
    """
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
