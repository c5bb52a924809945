"""Deterministic synthetic fleets: cells, load, node response and observations.

A draw is a function of the seed and its number, so every cell and tick is computed on its
own and in parallel; the same seed gives the same rows wherever they are computed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import simulation as M
from ..functions.grid import WIDTH
from ..functions.scoring import clamp


@dataclass(frozen=True)
class Spec:
    # The generator's defaults.
    seed: int = 20260904
    regions: tuple = ("us-east", "us-west")
    nodes_per_region: int = 2
    shards_per_node: int = 1
    cells_per_shard: int = 4
    classes: tuple = ("ReadHeavy", "Mixed")
    node_capacity_ops: float = 4000.0
    placement_capacity: int = 64
    period_ms: int = 600_000
    tick_ms: int = 1000
    start_ms: int = 0
    hot: dict = field(default_factory=dict)  # (shard, cell) -> (multiplier, from_ms, until_ms)


def cells(spark: SparkSession, spec: Spec) -> DataFrame:
    """cell_no, shard_id, cell_index, x, y, node_id, region, class, scale, phase_ms: three draws a cell, in order."""
    per_shard = min(spec.cells_per_shard, 156)
    shards = len(spec.regions) * spec.nodes_per_region * spec.shards_per_node
    n = F.col("cell_no")
    shard, node = F.floor(n / per_shard), F.floor(n / (per_shard * spec.shards_per_node))
    of_region = F.element_at(F.array(*[F.lit(r) for r in spec.regions]), (F.floor(node / spec.nodes_per_region) + 1).cast("int"))
    rows = spark.range(shards * per_shard).select(F.col("id").alias("cell_no"))
    drawn = rows.select("cell_no", M.draw_below(spec.seed, n * 3, len(spec.classes)).alias("class_no"), M.draw_unit(spec.seed, n * 3 + 1).alias("unit"), M.draw_below(spec.seed, n * 3 + 2, max(spec.period_ms, 1)).alias("phase_ms"))
    return drawn.select(
        "cell_no",
        (shard + 1).cast("bigint").alias("shard_id"),
        (n % per_shard).cast("int").alias("cell_index"),
        (n % per_shard % WIDTH).cast("int").alias("x"),
        F.floor(n % per_shard / WIDTH).cast("int").alias("y"),
        F.concat(of_region, F.lit("-db-"), (node % spec.nodes_per_region).cast("string")).alias("node_id"),
        of_region.alias("region"),
        F.element_at(F.array(*[F.lit(c) for c in spec.classes]), (F.col("class_no") + 1).cast("int")).alias("class"),
        (F.lit(0.5) + F.col("unit") * (1.5 - 0.5)).alias("scale"),
        "phase_ms",
    )


def jitter_seed(seed: int) -> int:
    """The load's own stream is the second fork of the seed's."""
    return M.word(seed, 1)


def load(spark: SparkSession, spec: Spec, ticks: int) -> DataFrame:
    """tick, at_ms and the operations, reads and writes of every cell."""
    of_class = F.broadcast(M.classes(spark))
    fleet = cells(spark, spec)
    count = len(spec.regions) * spec.nodes_per_region * spec.shards_per_node * min(spec.cells_per_shard, 156)
    rows = fleet.withColumn("tick", F.explode(F.sequence(F.lit(0), F.lit(ticks - 1)))).withColumn("at_ms", F.lit(spec.start_ms) + (F.col("tick") + 1) * spec.tick_ms).join(of_class, "class")
    unit = M.draw_unit(jitter_seed(spec.seed), F.col("tick").cast("bigint") * count + F.col("cell_no"))
    hot = F.lit(1.0)
    for (shard, cell), (multiplier, start, until) in spec.hot.items():
        hot = F.when((F.col("shard_id") == shard) & (F.col("cell_index") == cell) & (F.col("at_ms") >= start) & (F.col("at_ms") < until), float(multiplier)).otherwise(hot)
    rows = rows.withColumn("jitter", F.lit(M.JITTER_LOW) + unit * (M.JITTER_HIGH - M.JITTER_LOW))
    rows = rows.withColumn("operations", F.col("base_ops") * F.col("scale") * hot * M.diurnal(F.col("at_ms"), spec.period_ms, F.col("phase_ms")) * F.col("jitter"))
    rows = rows.withColumn("reads", F.col("operations") * F.col("read_ratio")).withColumn("writes", F.col("operations") - F.col("reads"))
    return rows.select("tick", "at_ms", "cell_no", "shard_id", "cell_index", "x", "y", "node_id", "region", "operations", "reads", "writes", "read_latency_us", "write_latency_us")


def node_state(faults: DataFrame, ticks: DataFrame) -> DataFrame:
    """node_id, at_ms, online, reachable: the last fault at or before each tick (node_id, at_ms, online, reachable)."""
    marks = faults.select("node_id", "at_ms", F.struct("online", "reachable").alias("state"), F.lit(0).alias("is_tick")).unionByName(ticks.select("node_id", "at_ms", F.lit(None).cast("struct<online:boolean,reachable:boolean>").alias("state"), F.lit(1).alias("is_tick")))
    w = Window.partitionBy("node_id").orderBy("at_ms", "is_tick")
    out = marks.withColumn("state", F.last("state", ignorenulls=True).over(w)).filter("is_tick = 1")
    return out.select("node_id", "at_ms", F.coalesce("state.online", F.lit(True)).alias("online"), F.coalesce("state.reachable", F.lit(True)).alias("reachable"))


def observations(spark: SparkSession, spec: Spec, ticks: int, faults: DataFrame | None = None) -> DataFrame:
    """What each online and reachable owner reports of its cells: load, cpu, memory, queue and latencies under load."""
    rows = load(spark, spec, ticks)
    if faults is not None:
        state = node_state(faults, rows.select("node_id", "at_ms").distinct())
        rows = rows.join(state, ["node_id", "at_ms"])
    else:
        rows = rows.withColumns({"online": F.lit(True), "reachable": F.lit(True)})
    served = rows.filter("online").groupBy("tick", "node_id").agg(F.sum(F.col("reads") + F.col("writes")).alias("served"), F.count("*").alias("hosted"))
    cpu = clamp(F.col("served") / spec.node_capacity_ops)
    served = served.withColumn("cpu", cpu).withColumn("memory", clamp(F.lit(0.10) + F.col("hosted") / float(spec.placement_capacity) * 0.35 + F.col("cpu") * 0.45))
    served = served.withColumn("queue_depth", F.when(F.col("cpu") > 0.75, (F.col("cpu") - 0.75) / 0.25 * 25_000).otherwise(F.col("cpu") * 400).cast("bigint"))
    slow = F.lit(1.0) + F.greatest(F.col("cpu") - 0.6, F.lit(0.0)) * 8.0
    return rows.filter("online and reachable").join(served, ["tick", "node_id"]).select("tick", "at_ms", "shard_id", "x", "y", "node_id", "operations", "reads", "writes", F.col("cpu").alias("cpu_utilization"), F.col("memory").alias("memory_utilization"), "queue_depth", (F.col("read_latency_us") * slow).alias("read_latency_us"), (F.col("write_latency_us") * slow).alias("write_latency_us"))
