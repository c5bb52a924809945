"""Rates from monotone counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring as S


def intervals(snapshots: DataFrame, millis_per_second: int = 1000) -> DataFrame:
    """Each snapshot after a node's first with the interval's outcome.

    `outcome` is baseline (a node's first), skipped (a counter fell or no time passed) or sampled.
    """
    w = Window.partitionBy("node_id").orderBy("taken_at_ms")
    before = {c: F.lag(c).over(w) for c in ("taken_at_ms", "reads_total", "writes_total")}
    rows = snapshots.withColumns({f"before_{c}": v for c, v in before.items()})
    seconds = (F.col("taken_at_ms") - F.col("before_taken_at_ms")) / float(millis_per_second)
    fell = (F.col("reads_total") < F.col("before_reads_total")) | (F.col("writes_total") < F.col("before_writes_total"))
    outcome = F.when(F.col("before_taken_at_ms").isNull(), "baseline").when(fell | (seconds <= 0), "skipped").otherwise("sampled")
    return rows.withColumn("seconds", seconds).withColumn("outcome", outcome)


def counter_rates(snapshots: DataFrame, millis_per_second: int = 1000) -> DataFrame:
    """node_id, taken_at_ms and rates of the sampled intervals."""
    rows = intervals(snapshots, millis_per_second).filter("outcome = 'sampled'")
    reads, writes = (F.col("reads_total") - F.col("before_reads_total")) / F.col("seconds"), (F.col("writes_total") - F.col("before_writes_total")) / F.col("seconds")
    return rows.select("node_id", "taken_at_ms", reads.alias("reads_per_second"), writes.alias("writes_per_second"), (reads + writes).alias("operations_per_second"), S.queue_units(F.col("in_flight"), F.col("max_concurrent")).alias("queue_depth"))


def cell_rates(before: DataFrame, after: DataFrame, seconds: float) -> DataFrame:
    """Rates of the cells of `after`: a cell not in `before` counts from 0, a fallen counter as 0, a vanished cell is dropped."""
    keys = ["x", "y", "z", "q"]
    figures = ["reads", "writes", "bytes_read", "bytes_written"]
    old = before.select(*keys, *[F.col(c).alias(f"old_{c}") for c in figures])
    rate = lambda c: (F.greatest(F.col(c) - F.coalesce(f"old_{c}", F.lit(0)), F.lit(0)) / F.lit(seconds)).alias(f"{c}_per_second")
    return after.join(old, keys, "left").select(*keys, *[rate(c) for c in figures]).withColumn("_busy", F.col("reads_per_second") + F.col("writes_per_second")).orderBy(F.desc("_busy"), *keys).drop("_busy")
