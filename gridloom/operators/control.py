"""From decisions to admitted actions and measured outcomes."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import folded


@dataclass(frozen=True)
class Policy:
    # The controller's default limits.
    min_confidence: float = 0.80
    max_age_ms: int = 15_000
    max_in_flight: int = 8
    max_per_node: int = 2
    max_utilization: float = 0.85
    settle_ms: int = 30_000
    deadline_ms: int = 300_000
    noise: float = 0.02
    cooldown_ms: int = 300_000


def validate(decisions: DataFrame, placements: DataFrame, fleet: DataFrame, active: DataFrame, now_ms: int, generation: int, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """`decisions` with `refusal`, the first of the rules that fails, or null.

    decisions: shard_id, x, y, action, target_node, confidence, score, observed_at_ms, generation, by_operator.
    active: shard_id, x, y (null: the whole shard), node_id of each action under way.
    """
    held = placements.select("shard_id", "x", "y", F.col("node_id").alias("source_node"))
    load = active.groupBy("node_id").agg(F.count("*").alias("load"))
    cells = active.filter("x is not null").select("shard_id", "x", "y").distinct().withColumn("cell_busy", F.lit(True))
    shards = active.filter("x is null").select("shard_id").distinct().withColumn("shard_busy", F.lit(True))
    count = active.agg(F.count("*").alias("in_flight"))
    target = fleet.select(F.col("node_id").alias("target_node"), F.col("condition").alias("target_condition"), F.col("is_full").alias("target_full"), F.col("utilization").alias("target_utilization"))
    rows = (
        decisions.join(held, ["shard_id", "x", "y"], "left").join(cells, ["shard_id", "x", "y"], "left").join(shards, "shard_id", "left").join(count)
        .join(load.select(F.col("node_id").alias("source_node"), F.col("load").alias("source_load")), "source_node", "left")
        .join(load.select(F.col("node_id").alias("target_node"), F.col("load").alias("target_load")), "target_node", "left")
        .join(target, "target_node", "left")
    )
    named = F.col("target_node").isNotNull()
    refusal = (
        F.when(F.col("action") == "no_action", "no_action")
        .when(~(F.col("x").between(0, 11) & F.col("y").between(0, 12)), "invalid_coordinate")
        .when(~F.col("by_operator") & ((F.col("confidence") < policy.min_confidence) | (F.col("score") <= 0)), "below_threshold")
        .when(F.col("observed_at_ms") > now_ms, "from_the_future")
        .when(F.lit(now_ms) - F.col("observed_at_ms") > policy.max_age_ms, "stale")
        .when(F.col("generation") != generation, "superseded")
        .when(F.col("in_flight") >= policy.max_in_flight, "too_many_in_flight")
        .when(F.col("cell_busy"), "conflicting_action")
        .when(F.col("shard_busy"), "shard_busy")
        .when(F.col("source_node").isNull(), "unknown_placement")
        .when(F.coalesce("source_load", F.lit(0)) >= policy.max_per_node, "source_overloaded")
        .when((F.col("action") == "colocate") & ~named, "colocate_target_missing")
        .when(named & F.col("target_condition").isNull(), "unknown_destination")
        .when(named & (F.col("target_node") == F.col("source_node")), "destination_is_source")
        .when(named & (F.col("target_condition") != "healthy"), "destination_unhealthy")
        .when(named & F.col("target_full"), "destination_at_capacity")
        .when(named & (F.col("target_utilization") > policy.max_utilization), "destination_saturated")
        .when(named & (F.coalesce("target_load", F.lit(0)) >= policy.max_per_node), "destination_overloaded")
    )
    return rows.withColumn("refusal", refusal).select(*decisions.columns, "source_node", "refusal")


def counters(validated: DataFrame) -> DataFrame:
    """proposed, admitted, refused and last_refusal (by seq; of one seq by cell)."""
    order = F.struct("seq", "shard_id", "x", "y")
    last = F.max_by("refusal", F.when(F.col("refusal").isNotNull(), order))
    return validated.agg(F.count("*").alias("proposed"), F.count_if(F.col("refusal").isNull()).alias("admitted"), F.count_if(F.col("refusal").isNotNull()).alias("refused"), last.alias("last_refusal"))


def colocate_targets(decisions: DataFrame, placements: DataFrame) -> DataFrame:
    """`decisions` with target_node of those to colocate: the node that holds their cell (beside_x, beside_y) of the same shard, or null."""
    held = placements.select(F.col("shard_id").alias("_s"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("node_id").alias("_held"))
    there = (F.col("action") == "colocate") & (F.col("shard_id") == F.col("_s")) & (F.col("beside_x") == F.col("_x")) & (F.col("beside_y") == F.col("_y"))
    target = F.when(F.col("action") == "colocate", F.col("_held")).otherwise(F.col("target_node"))
    return decisions.join(held, there, "left").withColumn("target_node", target).select(decisions.columns)


def cooling(decisions: DataFrame, concluded: DataFrame, now_ms: int, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """Decisions whose cell had no action concluded within the cooldown."""
    recent = concluded.groupBy("shard_id", "x", "y").agg(F.max("concluded_at_ms").alias("at")).filter(F.lit(now_ms) - F.col("at") < policy.cooldown_ms)
    return decisions.join(recent, ["shard_id", "x", "y"], "left_anti")


def admit(validated: DataFrame, active: DataFrame | None = None, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """`controller_id, seq, admitted, refusal` of decisions in order: each admitted one counts against those after it.

    `validated` has controller_id, seq, shard_id, x, y, source_node, target_node, refusal; `active` the same but seq and refusal, of the actions that are
    under way before. What a controller's limits admit is a few actions, so its state is small.
    """
    columns = ["controller_id", "seq", "shard_id", "x", "y", "source_node", "target_node", "refusal"]
    rows = validated.select(*columns)
    if active is not None:
        rows = rows.unionByName(active.select("controller_id", F.lit(-1).cast("bigint").alias("seq"), *columns[2:7], F.lit(None).cast("string").alias("refusal")))

    def run(batches):
        now, held, load = None, set(), {}
        for b in batches:
            out = []
            for controller, seq, shard, x, y, source, target, refusal in zip(*[b[c].tolist() for c in columns]):
                if controller != now:
                    now, held, load = controller, set(), {}
                cell, nodes = (shard, x, y), [n for n in (source, target) if isinstance(n, str)]
                why = refusal if isinstance(refusal, str) else None
                if seq >= 0 and why is None:
                    if len(held) >= policy.max_in_flight:
                        why = "too_many_in_flight"
                    elif cell in held:
                        why = "conflicting_action"
                    elif any(load.get(n, 0) >= policy.max_per_node for n in nodes):
                        why = "node_overloaded"
                if why is None:
                    held.add(cell)
                    for n in nodes:
                        load[n] = load.get(n, 0) + 1
                if seq >= 0:
                    out.append((controller, seq, why is None, why))
            yield pd.DataFrame(out, columns=["controller_id", "seq", "admitted", "refusal"])

    return folded(rows, ["controller_id"], ["seq", "shard_id", "x", "y"], run, "controller_id bigint, seq bigint, admitted boolean, refusal string")


def measure(pairs: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """Outcomes of `pairs` (pressure_before, pressure_after, worst latencies, operations, expected_gain)."""
    gain = F.col("pressure_before") - F.col("pressure_after")
    return pairs.withColumns(
        {
            "realized_gain": gain,
            "gain_ratio": F.when(F.col("expected_gain") > 0, gain / F.col("expected_gain")).otherwise(F.lit(0.0)),
            "prediction_error": gain - F.col("expected_gain"),
            "latency_delta_us": F.col("latency_after") - F.col("latency_before"),
            "throughput_delta": F.col("operations_after") - F.col("operations_before"),
            "verdict": F.when(gain > policy.noise, "improved").when(gain < -policy.noise, "regressed").otherwise("unchanged"),
        }
    )


def measurement(actions: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """`actions` with measured: too_soon before they have settled, measured once there is a pressure_after, else awaiting until the deadline and not_measured after it.

    Needs committed_at_ms, now_ms and pressure_after.
    """
    elapsed = F.greatest(F.col("now_ms") - F.col("committed_at_ms"), F.lit(0))
    out = F.when(elapsed < policy.settle_ms, "too_soon").when(F.col("pressure_after").isNotNull(), "measured").when(elapsed > policy.deadline_ms, "not_measured")
    return actions.withColumn("measured", out.otherwise("awaiting"))


def outcome_report(actions: DataFrame) -> DataFrame:
    """A row for each action that is over (state, verdict, failure): what came of it, failures with their reason."""
    result = F.when(F.col("state") == "failed", F.concat(F.lit("failed: "), F.coalesce("failure", F.lit("unknown")))).when(F.col("state") == "rolled_back", "rolled_back").when(F.col("state") == "completed", F.coalesce("verdict", F.lit("not_measured")))
    return actions.withColumn("result", result).filter("result is not null")


def placement_changes(concluded: DataFrame) -> DataFrame:
    """shard_id, x, y, from_node and to_node of the concluded actions that cut over; of several of a cell the last (by seq)."""
    moved = concluded.filter(F.col("has_cut_over") & (F.col("target_node") != F.col("source_node")))
    return moved.groupBy("shard_id", "x", "y").agg(F.max_by("source_node", "seq").alias("from_node"), F.max_by("target_node", "seq").alias("to_node"))


def moved_placements(placements: DataFrame, changes: DataFrame) -> DataFrame:
    """`placements` after changes; one of a cell that has no placement changes nothing."""
    cell = ["shard_id", "x", "y"]
    return placements.join(changes.select(*cell, "to_node"), cell, "left").withColumn("node_id", F.coalesce("to_node", "node_id")).select(placements.columns)


def to_persist(before: DataFrame, after: DataFrame) -> DataFrame:
    """shard_id, x, y, expected (the node that the durable record must still name; null: none) and node_id of placements that changed."""
    cell = ["shard_id", "x", "y"]
    rows = after.select(*cell, "node_id").join(before.select(*cell, F.col("node_id").alias("expected")), cell, "left")
    return rows.filter(~F.col("node_id").eqNullSafe(F.col("expected"))).select(*cell, "expected", "node_id")


def status_snapshot(fleet: DataFrame, placements: DataFrame, counted: DataFrame, in_flight: DataFrame, now_ms: int) -> DataFrame:
    """One row: the control plane's state as JSON (`status`), of bounded size: nodes by name, and counts of all that grows."""
    nodes = fleet.agg(F.sort_array(F.collect_list(F.struct("node_id", "region", "condition", "hosted", "is_full", "accepts"))).alias("nodes"))
    held = placements.agg(F.count("*").alias("placements"), F.count_distinct("shard_id").alias("shards"))
    active = in_flight.agg(F.count("*").alias("in_flight"))
    rows = nodes.join(held).join(active).join(counted.select(F.struct("*").alias("decisions")))
    return rows.select(F.to_json(F.struct(F.lit(now_ms).alias("now_ms"), "placements", "shards", "in_flight", "decisions", "nodes")).alias("status"))


def check_plan(plans: DataFrame, healthy: DataFrame, floor: int = 1) -> DataFrame:
    """plan_id and problem of plans (holders, adds, removes as arrays of nodes, has_cutover).

    The projected holders are a set: those held and added, without those removed.
    """
    able = healthy.agg(F.collect_set("node_id").alias("able"))
    after = F.array_except(F.array_union("holders", "adds"), F.col("removes"))
    problem = (
        F.when((F.size("adds") == 0) & (F.size("removes") == 0), "empty_plan")
        .when((F.size("removes") > 0) & ~F.col("has_cutover"), "removal_without_cutover")
        .when(F.size(F.array_except("adds", "able")) > 0, "destination_unhealthy")
        .when(F.size(F.array_except("removes", F.array_union("holders", "adds"))) > 0, "removes_not_held")
        .when(F.size(after) < floor, "below_replica_floor")
    )
    return plans.join(able).select("plan_id", after.alias("projected"), problem.alias("problem"))
