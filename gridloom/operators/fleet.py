"""The fleet of nodes and where a cell may go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring as S


def fleet_view(nodes: DataFrame, placements: DataFrame, observations: DataFrame) -> DataFrame:
    """Each node with hosted cells, its highest cpu and memory among all latest observations, headroom and is_full.

    Observations of cells that left a node still count for it.
    """
    hosted = placements.groupBy("node_id").agg(F.count("*").alias("hosted"))
    load = observations.groupBy("node_id").agg(F.max("cpu_utilization").alias("cpu"), F.max("memory_utilization").alias("memory"))
    rows = nodes.join(hosted, "node_id", "left").join(load, "node_id", "left").fillna({"hosted": 0, "cpu": 0.0, "memory": 0.0})
    return rows.withColumns({"utilization": F.greatest("cpu", "memory"), "headroom": F.greatest(F.col("capacity") - F.col("hosted"), F.lit(0)), "is_full": F.col("hosted") >= F.col("capacity"), "accepts": F.col("condition") == "healthy"})


def fleet_from_placements(placements: DataFrame) -> DataFrame:
    """Nodes known only from what they hold: least region name, hosted cells, capacity unknown (0)."""
    return placements.groupBy("node_id").agg(F.min("region").alias("region"), F.count("*").alias("hosted")).withColumns({"capacity": F.lit(0).cast("bigint"), "accepts": F.lit(True), "utilization": F.lit(0.0)})


def candidates(fleet: DataFrame) -> DataFrame:
    """Nodes that may take a cell; a capacity of 0 is unknown and leaves room."""
    return fleet.filter("accepts and (capacity = 0 or hosted < capacity)")


def best_destinations(fleet: DataFrame) -> DataFrame:
    """For each source node the best destination, elsewhere in the fleet (`nearest`) and away from the source's region (`away`).

    Only the two best of the whole fleet and of each region can be any source's first choice, so the
    fleet is ranked once and a source looks at these few.
    """
    order = [F.col("utilization"), F.col("hosted"), F.col("node_id")]
    able = candidates(fleet).select("node_id", "region", "utilization", "hosted")
    ranked = able.withColumn("of_region", F.row_number().over(Window.partitionBy("region").orderBy(*order))).filter("of_region <= 2")
    key = F.struct(F.col("utilization"), F.col("hosted"), F.col("node_id"), F.col("region"))
    list_ = ranked.agg(F.sort_array(F.collect_list(key)).alias("options"))
    sources = fleet.select("node_id", "region").join(list_)
    other = F.filter("options", lambda o: o["node_id"] != F.col("node_id"))
    far = F.filter(other, lambda o: o["region"] != F.col("region"))
    nearest = F.try_element_at(other, F.lit(1))["node_id"]
    return sources.select("node_id", nearest.alias("nearest"), F.coalesce(F.try_element_at(far, F.lit(1))["node_id"], nearest).alias("away"))


def destination_ranking(fleet: DataFrame) -> DataFrame:
    """All destinations of each source in order, away from its region first."""
    able = candidates(fleet).select(F.col("node_id").alias("destination"), F.col("region").alias("to_region"), "utilization", "hosted")
    pairs = fleet.select(F.col("node_id").alias("source"), "region").join(able, F.col("source") != F.col("destination"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy((F.col("to_region") == F.col("region")).cast("int"), "utilization", "hosted", "destination"))
    return pairs.select("source", "destination", rank.cast("bigint").alias("rank"))


def decisions(predicted: DataFrame, placements: DataFrame, fleet: DataFrame) -> DataFrame:
    """What to do about each predicted profile: action, target_node, expected_gain, estimated_cost, confidence, score, executable."""
    best = best_destinations(fleet)
    where = placements.select("shard_id", "x", "y", F.col("node_id").alias("held_by")).join(best.withColumnRenamed("node_id", "held_by"), "held_by", "left")
    rows = predicted.join(where, ["shard_id", "x", "y"], "left")
    p = F.col("probability")
    hot, placed = F.col("likely_hot"), F.col("held_by").isNotNull()
    reads, writes = F.col("read_ratio") >= 0.70, F.col("write_ratio") >= 0.70
    replicate = hot & placed & reads & F.col("away").isNotNull()
    isolate = hot & placed & ~reads & writes
    move = hot & placed & ~reads & ~writes & F.col("nearest").isNotNull()
    case = lambda r, i, m, stuck, calm: F.when(~hot, calm).when(replicate, r).when(isolate, i).when(move, m).otherwise(stuck)
    none = F.lit(None).cast("string")
    out = rows.withColumns(
        {
            "action": case(F.lit("replicate"), F.lit("isolate"), F.lit("move"), F.lit("no_action"), F.lit("no_action")),
            "target_node": case(F.col("away"), none, F.col("nearest"), none, none),
            "expected_gain": case(p * 1.20, p, p * 0.90, F.lit(0.0), F.lit(0.0)),
            "estimated_cost": case(F.lit(0.35), F.lit(0.45), F.lit(0.50), F.lit(1.0), F.lit(0.0)),
            "confidence": case(p, p, p, F.lit(0.0), F.lit(1.0) - p),
        }
    )
    out = out.withColumn("score", F.col("expected_gain") - F.col("estimated_cost"))
    return out.withColumn("executable", (F.col("action") != "no_action") & (F.col("score") > 0) & (F.col("confidence") >= S.CONFIDENCE_THRESHOLD))


def observed_at(samples: DataFrame) -> DataFrame:
    """shard_id, x, y and observed_at_ms: the newest observation of a cell by whatever node."""
    return samples.groupBy("shard_id", "x", "y").agg(F.max("timestamp_ms").alias("observed_at_ms"))
