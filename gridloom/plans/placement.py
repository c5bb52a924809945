"""Queries on what to move where: fleet, decisions, validation, outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import control, fleet
from ..operators.profile import latest
from ..sources import tables as T
from . import parts as P
from .registry import query
from .telemetry import CELL, profiles


def _fleet(spark, sf_dir):
    held = latest(T.cell_telemetry(spark, sf_dir), CELL)
    return fleet.fleet_view(T.fleet_nodes(spark, sf_dir).drop("shard_id"), held, held), held


def _decisions(spark, sf_dir, of_latest=False):
    nodes, held = _fleet(spark, sf_dir)
    return fleet.decisions(profiles(spark, sf_dir, latest=of_latest), held, nodes)


_OUT = ["shard_id", "x", "y", "seq", "probability", "action", "target_node", "expected_gain", "estimated_cost", "confidence", "score", "executable"]


@query(P.cells("days") + "SELECT node_id, region, condition, capacity, hosted, cpu, memory, utilization, headroom, is_full, accepts FROM fleet")
def fleet_view(spark, sf_dir):
    return _fleet(spark, sf_dir)[0]


@query(P.cells("days") + "SELECT node_id, min(region) AS region, count(*) AS hosted FROM placements GROUP BY node_id")
def fleet_from_placements(spark, sf_dir):
    return fleet.fleet_from_placements(_fleet(spark, sf_dir)[1]).select("node_id", "region", "hosted")


@query(P.cells("days") + "SELECT source, destination, away_rank AS rank FROM ranked")
def destination_ranking(spark, sf_dir):
    return fleet.destination_ranking(_fleet(spark, sf_dir)[0])


@query(P.cells("days") + "SELECT " + ", ".join(_OUT) + " FROM decisions")
def placement_decisions(spark, sf_dir):
    return _decisions(spark, sf_dir).select(*_OUT)


@query(P.cells("latest") + "SELECT " + ", ".join(_OUT) + " FROM decisions")
def latest_placement_decisions(spark, sf_dir):
    return _decisions(spark, sf_dir, True).select(*_OUT)


@query(P.cells("days") + "SELECT " + ", ".join(_OUT) + " FROM decisions WHERE executable AND is_hot")
def executable_decisions(spark, sf_dir):
    return _decisions(spark, sf_dir).filter("executable and is_hot").select(*_OUT)


@query(P.cells("days") + "SELECT action, count(*) AS decisions, max(score) AS best_score FROM decisions GROUP BY action")
def decisions_by_action(spark, sf_dir):
    return _decisions(spark, sf_dir).groupBy("action").agg(F.count("*").alias("decisions"), F.max("score").alias("best_score"))


_NOW = 1_706_000_000_000
_ACTIVE = "active AS (SELECT * FROM (VALUES (0, 3, 0, 'NATION_0'), (1, 0, 0, 'NATION_1'), (1, 1, 0, 'NATION_1'), (5, NULL, NULL, 'NATION_4')) t(shard_id, x, y, node_id))"


def _asked(spark, sf_dir):
    """Each decision as asked for: its age, generation and who asked vary with its cell."""
    rows = _decisions(spark, sf_dir)
    now = F.lit(_NOW)
    return rows.select(
        "shard_id", "x", "y", "seq", "action", F.when(F.col("seq") % 29 == 0, "NOWHERE").otherwise(F.col("target_node")).alias("target_node"), "confidence", "score",
        (now - F.col("seq") % 17_000 + F.when(F.col("seq") % 31 == 0, 20_000).otherwise(0)).cast("bigint").alias("observed_at_ms"),
        F.when(F.col("seq") % 23 == 0, 6).otherwise(7).cast("bigint").alias("generation"), (F.col("seq") % 5 == 0).alias("by_operator"),
    )


_ASKED = f"""asked AS (SELECT shard_id, x, y, seq, action, CASE WHEN seq % 29 = 0 THEN 'NOWHERE' ELSE target_node END AS target_node, confidence, score,
  {_NOW} - seq % 17000 + CASE WHEN seq % 31 = 0 THEN 20000 ELSE 0 END AS observed_at_ms, CASE WHEN seq % 23 = 0 THEN 6 ELSE 7 END AS generation, seq % 5 = 0 AS by_operator
  FROM decisions)"""
_VALID = f"""judged AS (SELECT a.shard_id, a.x, a.y, a.seq, a.action, CASE
  WHEN a.action = 'no_action' THEN 'no_action'
  WHEN NOT (a.x BETWEEN 0 AND 11 AND a.y BETWEEN 0 AND 12) THEN 'invalid_coordinate'
  WHEN NOT a.by_operator AND (a.confidence < {P.d(0.8)} OR a.score <= 0) THEN 'below_threshold'
  WHEN a.observed_at_ms > {_NOW} THEN 'from_the_future'
  WHEN {_NOW} - a.observed_at_ms > 15000 THEN 'stale'
  WHEN a.generation <> 7 THEN 'superseded'
  WHEN (SELECT count(*) FROM active) >= 8 THEN 'too_many_in_flight'
  WHEN EXISTS (FROM active c WHERE c.shard_id = a.shard_id AND c.x = a.x AND c.y = a.y) THEN 'conflicting_action'
  WHEN EXISTS (FROM active c WHERE c.shard_id = a.shard_id AND c.x IS NULL) THEN 'shard_busy'
  WHEN p.node_id IS NULL THEN 'unknown_placement'
  WHEN (SELECT count(*) FROM active c WHERE c.node_id = p.node_id) >= 2 THEN 'source_overloaded'
  WHEN a.target_node IS NOT NULL AND f.node_id IS NULL THEN 'unknown_destination'
  WHEN a.target_node = p.node_id THEN 'destination_is_source'
  WHEN f.condition <> 'healthy' THEN 'destination_unhealthy'
  WHEN f.is_full THEN 'destination_at_capacity'
  WHEN f.utilization > {P.d(0.85)} THEN 'destination_saturated'
  WHEN (SELECT count(*) FROM active c WHERE c.node_id = a.target_node) >= 2 THEN 'destination_overloaded' END AS refusal, p.node_id AS source_node, a.target_node
  FROM asked a LEFT JOIN placements p ON p.shard_id = a.shard_id AND p.x = a.x AND p.y = a.y LEFT JOIN fleet f ON f.node_id = a.target_node)"""


def _validated(spark, sf_dir):
    nodes, held = _fleet(spark, sf_dir)
    active = spark.createDataFrame([(0, 3, 0, "NATION_0"), (1, 0, 0, "NATION_1"), (1, 1, 0, "NATION_1"), (5, None, None, "NATION_4")], "shard_id bigint, x int, y int, node_id string")
    return control.validate(_asked(spark, sf_dir), held, nodes, active, _NOW, 7)


@query(P.cells("days", _ACTIVE, _ASKED, _VALID) + "SELECT shard_id, x, y, seq, action, refusal FROM judged")
def validate_decisions(spark, sf_dir):
    return _validated(spark, sf_dir).select("shard_id", "x", "y", "seq", "action", "refusal")


@query(P.cells("days", _ACTIVE, _ASKED, _VALID) + "SELECT count(*) AS proposed, count(*) FILTER (refusal IS NULL) AS admitted, count(*) FILTER (refusal IS NOT NULL) AS refused, arg_max(refusal, (seq, shard_id, x, y)) FILTER (refusal IS NOT NULL) AS last_refusal FROM judged")
def decision_counters(spark, sf_dir):
    return control.counters(_validated(spark, sf_dir))


@query()
def admission_fold(spark, sf_dir):
    """Each day's decisions admitted in order by one controller per region of seq."""
    rows = _validated(spark, sf_dir).withColumn("controller_id", F.floor(F.col("seq") / 5000).cast("bigint"))
    active = spark.createDataFrame([(0, 0, 3, 0, "NATION_0", None)], "controller_id bigint, shard_id bigint, x int, y int, source_node string, target_node string")
    return control.admit(rows, active)


@query(P.cells("days", "concluded AS (SELECT shard_id, x, y, seq AS concluded_at FROM cell_days WHERE queue_depth > 0)") + "SELECT d.shard_id, d.x, d.y, d.seq FROM decisions d WHERE d.likely_hot AND NOT EXISTS (FROM (SELECT shard_id, x, y, max(concluded_at) AS at FROM concluded GROUP BY ALL) c WHERE c.shard_id = d.shard_id AND c.x = d.x AND c.y = d.y AND 100000 - c.at < 60000)")
def cooldown_filter(spark, sf_dir):
    concluded = T.cell_telemetry(spark, sf_dir).filter("queue_depth > 0").select("shard_id", "x", "y", F.col("seq").alias("concluded_at_ms"))
    hot = _decisions(spark, sf_dir).filter("likely_hot").select("shard_id", "x", "y", "seq")
    return control.cooling(hot, concluded, 100_000, control.Policy(cooldown_ms=60_000))


_PAIRS = f"""pairs AS (SELECT shard_id, x, y, seq, pressure AS pressure_after, operations AS operations_after, greatest(read_latency_us, write_latency_us) AS latency_after,
  lag(pressure) OVER w AS pressure_before, lag(operations) OVER w AS operations_before, lag(greatest(read_latency_us, write_latency_us)) OVER w AS latency_before, lag(probability) OVER w * {P.d(0.9)} AS expected_gain
  FROM predicted WINDOW w AS (PARTITION BY shard_id, x, y ORDER BY seq))"""


@query(P.cells("days", _PAIRS) + f"""SELECT shard_id, x, y, seq, pressure_before - pressure_after AS realized_gain, CASE WHEN expected_gain > 0 THEN (pressure_before - pressure_after) / expected_gain ELSE {P.d(0)} END AS gain_ratio,
(pressure_before - pressure_after) - expected_gain AS prediction_error, latency_after - latency_before AS latency_delta_us, operations_after - operations_before AS throughput_delta,
CASE WHEN pressure_before - pressure_after > {P.d(0.02)} THEN 'improved' WHEN pressure_before - pressure_after < {P.d(-0.02)} THEN 'regressed' ELSE 'unchanged' END AS verdict FROM pairs WHERE pressure_before IS NOT NULL""")
def outcome_verdicts(spark, sf_dir):
    w = Window.partitionBy(*CELL).orderBy("seq")
    rows = profiles(spark, sf_dir).withColumn("latency", F.greatest("read_latency_us", "write_latency_us"))
    pairs = rows.select(
        *CELL, "seq", F.col("pressure").alias("pressure_after"), F.col("operations").alias("operations_after"), F.col("latency").alias("latency_after"),
        F.lag("pressure").over(w).alias("pressure_before"), F.lag("operations").over(w).alias("operations_before"), F.lag("latency").over(w).alias("latency_before"), (F.lag("probability").over(w) * 0.9).alias("expected_gain"),
    ).filter("pressure_before is not null")
    return control.measure(pairs).select(*CELL, "seq", "realized_gain", "gain_ratio", "prediction_error", "latency_delta_us", "throughput_delta", "verdict")


@query("""SELECT CAST(i AS BIGINT) AS plan_id, CASE WHEN i % 5 = 0 THEN 'empty_plan' WHEN i % 4 = 1 AND i % 3 = 0 THEN 'removal_without_cutover' WHEN i % 7 = 0 THEN 'destination_unhealthy' WHEN i % 4 = 1 AND i % 11 = 0 THEN 'removes_not_held' END AS problem,
array_to_string(list_filter(list_concat(['a', 'b'], CASE WHEN i % 5 = 0 THEN [] WHEN i % 7 = 0 THEN ['sick'] ELSE ['c'] END), lambda h: NOT (h = 'a' AND i % 5 <> 0 AND i % 4 = 1 AND i % 11 <> 0)), ',') AS projected FROM (SELECT o_orderkey AS i FROM orders)""")
def plan_checks(spark, sf_dir):
    i = F.col("id")
    empty = F.array().cast("array<string>")
    plans = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).select(
        i.alias("plan_id"), F.array(F.lit("a"), F.lit("b")).alias("holders"),
        F.when(i % 5 == 0, empty).when(i % 7 == 0, F.array(F.lit("sick"))).otherwise(F.array(F.lit("c"))).alias("adds"),
        F.when((i % 5 == 0) | (i % 4 != 1), empty).when(i % 11 == 0, F.array(F.lit("z"))).otherwise(F.array(F.lit("a"))).alias("removes"), (i % 3 != 0).alias("has_cutover"),
    )
    return control.check_plan(plans, spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")).select("plan_id", "problem", F.array_join("projected", ",").alias("projected"))


@query(P.cells("days") + "SELECT shard_id, x, y, max(timestamp_ms) AS observed_at_ms FROM cell_days GROUP BY ALL")
def observed_at(spark, sf_dir):
    """When each cell was last observed by any node."""
    return fleet.observed_at(T.cell_telemetry(spark, sf_dir))


_LATEST = "held AS (SELECT shard_id, x, y, arg_max(node_id, seq) AS node_id FROM cell_days GROUP BY ALL)"


@query(P.cells("days", _LATEST) + "SELECT c.shard_id, c.x, c.y, c.seq, h.node_id AS target_node FROM cell_days c LEFT JOIN held h ON h.shard_id = c.shard_id AND h.x = (c.x + 1) % 12 AND h.y = c.y")
def colocate_targets(spark, sf_dir):
    """Every sample's cell as one to be put beside its right neighbour."""
    days = T.cell_telemetry(spark, sf_dir)
    asked = days.select(*CELL, "seq", F.lit("colocate").alias("action"), ((F.col("x") + 1) % 12).alias("beside_x"), F.col("y").alias("beside_y"), F.lit(None).cast("string").alias("target_node"))
    return control.colocate_targets(asked, latest(days, CELL)).select(*CELL, "seq", "target_node")


_DAY = 86_400_000
_GATED = f"""gated AS (SELECT shard_id, x, y, seq, lag(timestamp_ms) OVER w AS committed, timestamp_ms AS now, lag(pressure) OVER w - pressure AS gain, x % 3 > 0 AS seen FROM predicted WINDOW w AS (PARTITION BY shard_id, x, y ORDER BY seq)),
judged AS (SELECT *, CASE WHEN now - committed < {2 * _DAY} THEN 'too_soon' WHEN seen THEN 'measured' WHEN now - committed > {5 * _DAY} THEN 'not_measured' ELSE 'awaiting' END AS measured FROM gated WHERE committed IS NOT NULL)"""


def _gated(spark, sf_dir):
    w = Window.partitionBy(*CELL).orderBy("seq")
    rows = profiles(spark, sf_dir).select(*CELL, "seq", F.lag("timestamp_ms").over(w).alias("committed_at_ms"), F.col("timestamp_ms").alias("now_ms"), F.lag("pressure").over(w).alias("pressure_before"), F.when(F.col("x") % 3 > 0, F.col("pressure")).alias("pressure_after"))
    return control.measurement(rows.filter("committed_at_ms is not null"), control.Policy(settle_ms=2 * _DAY, deadline_ms=5 * _DAY))


@query(P.cells("days", _GATED) + "SELECT shard_id, x, y, seq, measured FROM judged")
def measurement_gates(spark, sf_dir):
    """Each sample as an action's first look at what it did, with two days to settle and a deadline of five."""
    return _gated(spark, sf_dir).select(*CELL, "seq", "measured")


@query(P.cells("days", _GATED) + f"SELECT result, count(*) AS actions FROM (SELECT CASE WHEN seq % 11 = 0 THEN 'failed: lost' WHEN measured = 'not_measured' THEN measured WHEN measured = 'measured' THEN CASE WHEN gain > {P.d(0.02)} THEN 'improved' WHEN gain < {P.d(-0.02)} THEN 'regressed' ELSE 'unchanged' END END AS result FROM judged) WHERE result IS NOT NULL GROUP BY result")
def outcome_reports(spark, sf_dir):
    """What came of all actions that are over, by result."""
    rows = control.measure(_gated(spark, sf_dir).withColumns({"expected_gain": F.lit(0.0), "latency_before": F.lit(0.0), "latency_after": F.lit(0.0), "operations_before": F.lit(0.0), "operations_after": F.lit(0.0)}))
    over = F.col("measured").isin("measured", "not_measured")
    state = F.when(F.col("seq") % 11 == 0, "failed").when(over, "completed").otherwise("awaiting")
    rows = rows.select("seq", state.alias("state"), F.when(F.col("measured") == "measured", F.col("verdict")).alias("verdict"), F.lit("lost").alias("failure"))
    return control.outcome_report(rows).groupBy("result").agg(F.count("*").alias("actions"))


_MOVES = _LATEST + """, moves AS (SELECT shard_id, x, y, arg_max(target_node, seq) AS to_node FROM decisions d JOIN (SELECT shard_id, x, y, node_id AS source FROM held) USING (shard_id, x, y) WHERE target_node IS NOT NULL AND target_node <> source GROUP BY ALL)"""


@query(P.cells("days", _MOVES) + "SELECT h.shard_id, h.x, h.y, h.node_id AS expected, to_node AS node_id FROM held h JOIN moves USING (shard_id, x, y)")
def persisted_moves(spark, sf_dir):
    """The durable records to change once every decision that names a destination is concluded."""
    nodes, held = _fleet(spark, sf_dir)
    asked = fleet.decisions(profiles(spark, sf_dir, latest=False), held, nodes).filter("target_node is not null").select(*CELL, "seq", "target_node")
    concluded = asked.join(held.select(*CELL, F.col("node_id").alias("source_node")), CELL).withColumn("has_cut_over", F.lit(True))
    after = control.moved_placements(held, control.placement_changes(concluded))
    return control.to_persist(held, after)


@query(P.cells("days", _ACTIVE) + "SELECT (SELECT count(*) FROM placements) AS placements, (SELECT count(DISTINCT shard_id) FROM placements) AS shards, 4::BIGINT AS in_flight, (SELECT count(*) FROM fleet) AS nodes")
def status_snapshot(spark, sf_dir):
    """The state of the control plane as JSON, read back."""
    nodes, held = _fleet(spark, sf_dir)
    counted = control.counters(_validated(spark, sf_dir))
    active = spark.range(4)
    made = control.status_snapshot(nodes, held, counted, active, _NOW)
    field = lambda n: F.get_json_object("status", f"$.{n}")
    return made.select(field("placements").cast("bigint").alias("placements"), field("shards").cast("bigint").alias("shards"), field("in_flight").cast("bigint").alias("in_flight"), F.json_array_length(field("nodes")).cast("bigint").alias("nodes"))
