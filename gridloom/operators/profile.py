"""Profiles of cells: latest samples, ratios, pressure, predictions and views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import grid
from ..functions import scoring as S

LOAD = ["cpu_utilization", "memory_utilization", "queue_depth", "read_latency_us", "write_latency_us"]


def latest(df: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The last row to arrive for each key, whatever its timestamp."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("row")).select(*keys, "row.*")


def with_profile(samples: DataFrame) -> DataFrame:
    """Samples with operations, ratios, pressure, level and is_hot; operations are reads plus writes."""
    total = F.col("reads") + F.col("writes")
    scored = samples.withColumns({"operations": total, "read_ratio": S.ratio(F.col("reads"), total), "write_ratio": S.ratio(F.col("writes"), total), "pressure": S.pressure(*[F.col(c) for c in LOAD])})
    return scored.withColumn("level", S.level(F.col("pressure"))).withColumn("is_hot", F.col("level").isin("high", "critical"))


def with_prediction(profiles: DataFrame, threshold: float = S.HOT_THRESHOLD) -> DataFrame:
    """Profiles with probability, likely_hot, anomaly and anomalous; the threshold is held within 0 and 1."""
    load = [F.col(c) for c in LOAD]
    out = profiles.withColumns({"probability": S.hotspot(F.col("pressure"), *load), "anomaly": S.anomaly(*load)})
    return out.withColumns({"likely_hot": F.col("probability") >= min(max(threshold, 0.0), 1.0), "anomalous": F.col("anomaly") >= S.ANOMALY_THRESHOLD})


def raw_heat(samples: DataFrame) -> DataFrame:
    """Flags of a sample's own figures."""
    cpu, memory, queue = F.col("cpu_utilization") >= 0.80, F.col("memory_utilization") >= 0.80, F.col("queue_depth") >= 10_000
    return samples.withColumns({"cpu_hot": cpu, "memory_hot": memory, "queue_hot": queue, "any_hot": cpu | memory | queue})


def off_grid(placements: DataFrame, observations: DataFrame) -> DataFrame:
    """Distinct coordinates (x, y) of either that lie outside the grid."""
    return placements.select("x", "y").union(observations.select("x", "y")).distinct().filter(~grid.on_grid(F.col("x"), F.col("y")))


def status_counts(placements: DataFrame, profiles: DataFrame, observations: DataFrame) -> DataFrame:
    """One row: placements, profiles, observations, hot."""
    counts = [placements.agg(F.count("*").alias("placements")), profiles.agg(F.count("*").alias("profiles"), F.count_if("is_hot").alias("hot")), observations.agg(F.count("*").alias("observations"))]
    return counts[0].join(counts[1]).join(counts[2])


def recent(rows: DataFrame, keys: list[str], most: int = 1024) -> DataFrame:
    """What a memory of the last rows (by seq) holds that drops its older half whenever it is full: by key, from how many have come."""
    n = F.count("*").over(Window.partitionBy(*keys))
    half = most // 2
    held = F.when(n <= most, n).otherwise(most - half + (n - most - 1) % half + 1)
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seq")))
    return rows.withColumns({"_held": held, "_back": back}).filter("_back <= _held").drop("_held", "_back")
