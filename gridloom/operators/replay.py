"""A session's messages folded into the fleet's state, as of its last message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grid
from .profile import latest, off_grid, with_prediction, with_profile


def registrations(messages: DataFrame) -> DataFrame:
    return messages.filter("RegisterNode is not null").select("seq", "RegisterNode.*")


def heartbeats(messages: DataFrame) -> DataFrame:
    return messages.filter("Heartbeat is not null").select("seq", "Heartbeat.*")


def placements(messages: DataFrame) -> DataFrame:
    """shard_id, x, y, node_id, region, seq of the latest placement of each cell.

    A message's placement names no shard: the cell's grid index stands for it.
    """
    rows = messages.filter("Topology is not null").select("seq", F.posexplode("Topology.placements").alias("pos", "p"))
    x, y = F.col("p.coordinate.x"), F.col("p.coordinate.y")
    flat = rows.select(F.struct("seq", "pos").alias("seq"), grid.cell_index(x, y).cast("bigint").alias("shard_id"), x.alias("x"), y.alias("y"), F.col("p.dbms_id").alias("node_id"), F.col("p.region").alias("region"))
    return latest(flat, ["shard_id", "x", "y"])


def observations(messages: DataFrame) -> DataFrame:
    """Every sample with node_id, shard_id, x, y; those of light workload messages have shard 0 and no resource figures.

    Reads and writes are the total by its ratios; storage and network rates aren't carried.
    """
    rows = messages.filter("Telemetry is not null").select("seq", "Telemetry.*").select("seq", "timestamp_ms", "node_id", F.col("shard.id").alias("shard_id"), F.posexplode("samples").alias("pos", "s"))
    total = F.col("s.operations_per_second")
    full = rows.select(
        F.struct("seq", "pos").alias("seq"), "timestamp_ms", "node_id", "shard_id", F.col("s.coordinate.x").alias("x"), F.col("s.coordinate.y").alias("y"),
        (total * F.col("s.read_ratio")).alias("reads"), (total * F.col("s.write_ratio")).alias("writes"), *[F.col(f"s.{c}").alias(c) for c in ("cpu_utilization", "memory_utilization", "queue_depth", "read_latency_us", "write_latency_us")],
    )
    light = messages.filter("Workload is not null").select("seq", "Workload.*")
    none = {c: F.lit(0.0) for c in ("cpu_utilization", "memory_utilization", "read_latency_us", "write_latency_us")}
    thin = light.select(
        F.struct("seq", F.lit(0).alias("pos")).alias("seq"), "timestamp_ms", "node_id", F.lit(0).cast("bigint").alias("shard_id"), F.col("coordinate.x").alias("x"), F.col("coordinate.y").alias("y"),
        (F.col("operations_per_second") * F.col("read_ratio")).alias("reads"), (F.col("operations_per_second") * F.col("write_ratio")).alias("writes"),
    ).withColumns(none | {"queue_depth": F.lit(0).cast("bigint")})
    return full.unionByName(thin)


def profiles(messages: DataFrame) -> DataFrame:
    """Scored profile of each (shard, cell); a cell that moved has one profile and two observations."""
    return with_prediction(with_profile(latest(observations(messages), ["shard_id", "x", "y"])))


def latest_observations(messages: DataFrame) -> DataFrame:
    return latest(observations(messages), ["node_id", "shard_id", "x", "y"])


def clock(messages: DataFrame) -> DataFrame:
    """The latest time of any message but registrations."""
    return messages.agg(F.max(F.coalesce("Heartbeat.timestamp_ms", "Topology.timestamp_ms", "Telemetry.timestamp_ms", "Workload.timestamp_ms")).alias("clock_ms"))


def validate(messages: DataFrame) -> DataFrame:
    """Coordinates outside the grid, by index."""
    return off_grid(placements(messages), observations(messages)).withColumn("cell_index", grid.cell_index(F.col("x"), F.col("y"))).orderBy("cell_index")


def status(messages: DataFrame) -> DataFrame:
    """One row: clock_ms, placements, profiles, observations, hot."""
    scored = profiles(messages)
    counts = [clock(messages), placements(messages).agg(F.count("*").alias("placements")), scored.agg(F.count("*").alias("profiles"), F.count_if("is_hot").alias("hot")), latest_observations(messages).agg(F.count("*").alias("observations"))]
    return counts[0].join(counts[1]).join(counts[2]).join(counts[3])


