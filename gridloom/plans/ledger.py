"""Queries on registries, actions under way, demand and tails of history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger
from ..sources import tables as T
from .registry import query

_OPS = """WITH ops AS (SELECT event_id AS seq, CASE WHEN event_type = 'signup' THEN 'place' WHEN event_type = 'error' THEN 'remove' ELSE 'move' END AS op, user_id % 25 AS shard_id, CAST(user_id % 12 AS INTEGER) AS x, CAST(user_id % 13 AS INTEGER) AS y, 'n' || event_id % 9 AS node_id FROM events) """


@query(_OPS + """, lives AS (SELECT *, last_value(CASE WHEN op IN ('place', 'remove') THEN op END IGNORE NULLS) OVER (PARTITION BY shard_id, x, y ORDER BY seq) AS life FROM ops)
SELECT shard_id, x, y, node_id FROM (SELECT *, row_number() OVER (PARTITION BY shard_id, x, y ORDER BY seq DESC) AS k FROM lives WHERE life = 'place' OR op = 'remove') WHERE k = 1 AND op <> 'remove'""")
def placement_registry(spark, sf_dir):
    e, kind = T.table(spark, sf_dir, "events"), F.col("event_type")
    op = F.when(kind == "signup", "place").when(kind == "error", "remove").otherwise("move")
    return ledger.registry(e.select(F.col("event_id").alias("seq"), op.alias("op"), (F.col("user_id") % 25).alias("shard_id"), (F.col("user_id") % 12).cast("int").alias("x"), (F.col("user_id") % 13).cast("int").alias("y"), F.concat(F.lit("n"), F.col("event_id") % 9).alias("node_id")))


_STATE = {"signup": "seeding", "view": "in_sync", "click": "lagging", "purchase": "in_sync", "error": "failed"}


@query("WITH s AS (SELECT user_id % 25 AS shard_id, 'n' || user_id AS node_id, event_id AS seq, CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _STATE.items()) + " END AS state FROM events), c AS (SELECT *, lag(state) OVER (PARTITION BY shard_id, node_id ORDER BY seq) AS before FROM s) SELECT shard_id, node_id, seq, before, state FROM c WHERE before <> state AND (before, state) NOT IN (" + ", ".join(f"('{a}', '{b}')" for a, b in ledger.TRANSITIONS) + ")")
def illegal_transitions(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    state = F.lit(None).cast("string")
    for a, b in _STATE.items():
        state = F.when(F.col("event_type") == a, b).otherwise(state)
    return ledger.illegal_transitions(e.select((F.col("user_id") % 25).alias("shard_id"), F.concat(F.lit("n"), "user_id").alias("node_id"), F.col("event_id").alias("seq"), state.alias("state")))


@query("WITH a AS (SELECT 'n' || l_suppkey % 17 AS s, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 'n' || l_partkey % 17 END AS t, l_linenumber % 4 = 0 AS done FROM lineitem) SELECT node_id, count(*) AS in_flight FROM (SELECT s AS node_id FROM a WHERE NOT done UNION ALL SELECT t FROM a WHERE NOT done AND t IS NOT NULL AND t <> s) GROUP BY node_id")
def actions_in_flight(spark, sf_dir):
    n = F.lit("n")
    return ledger.load_of(T.table(spark, sf_dir, "lineitem").select(F.concat(n, F.col("l_suppkey") % 17).alias("source_node"), F.when(F.col("l_linenumber") % 3 != 0, F.concat(n, F.col("l_partkey") % 17)).alias("target_node"), (F.col("l_linenumber") % 4 == 0).alias("concluded")))


@query("""WITH c AS (SELECT o_orderkey AS k, CAST(o_custkey % 6 AS DOUBLE) AS reads, CAST(o_orderkey % 4 AS DOUBLE) AS writes FROM orders),
h AS (SELECT k, reads, writes, list_distinct(['n' || k % 5, 'n' || (k + 2) % 5]) AS own, ['n' || (k + 1) % 5] AS staged FROM c),
u AS (SELECT *, list_filter(own, lambda n: n <> 'n3') AS up FROM h)
SELECT node_id, sum(d) AS demand FROM (SELECT unnest(up) AS node_id, reads / len(up) + writes AS d FROM u UNION ALL SELECT staged[1], writes FROM u WHERE staged[1] <> 'n3') GROUP BY node_id""")
def node_demand(spark, sf_dir):
    k, n = F.col("o_orderkey"), F.lit("n")
    cells = T.table(spark, sf_dir, "orders").select(F.array_distinct(F.array(F.concat(n, k % 5), F.concat(n, (k + 2) % 5))).alias("holders"), F.array(F.concat(n, (k + 1) % 5)).alias("staging"), (F.col("o_custkey") % 6).cast("double").alias("reads"), (k % 4).cast("double").alias("writes"))
    return ledger.demand(cells, spark.createDataFrame([(f"n{i}",) for i in (0, 1, 2, 4)], "node_id string"))


@query("SELECT o_orderkey AS action_id, CASE WHEN o_orderkey % 5 = 0 THEN 'measured' WHEN o_orderkey % 3 = 0 THEN 'unmeasured' WHEN o_orderkey % 2 = 0 THEN 'abandoned' ELSE 'rolled_back' END AS drained FROM orders")
def drain_classes(spark, sf_dir):
    k = F.col("o_orderkey")
    return ledger.drain(T.table(spark, sf_dir, "orders").select(k.alias("action_id"), F.when(k % 3 == 0, "awaiting_measurement").otherwise("running").alias("phase"), (k % 2 == 0).alias("cut_over"), (k % 5 == 0).alias("measured")))


@query("SELECT event_id AS seq, user_id % 25 AS shard_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 25 ORDER BY event_id DESC) <= 50")
def history_tail(spark, sf_dir):
    return ledger.tail(T.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 25).alias("shard_id")), ["shard_id"], 50)


@query("""WITH p AS (SELECT 'n' || n AS node_id, CAST(r AS BIGINT) AS round, CASE WHEN (n + r) % 6 = 0 THEN 'failed' WHEN r = 0 THEN 'baseline' WHEN (n + r) % 7 = 0 THEN 'skipped' ELSE 'sampled' END AS outcome, CASE WHEN r >= n THEN '2' ELSE '1' END AS version FROM range(20) a(n) CROSS JOIN range(30) b(r)),
q AS (SELECT *, lag(version) OVER (PARTITION BY node_id ORDER BY round) AS before FROM p)
SELECT node_id, round, 0 AS step, 'register' AS message FROM q WHERE before IS NULL OR before <> version UNION ALL SELECT node_id, round, 1, CASE WHEN outcome = 'failed' THEN 'unhealthy' ELSE 'healthy' END FROM q UNION ALL SELECT node_id, round, 2, 'telemetry' FROM q WHERE outcome = 'sampled'""")
def poll_messages(spark, sf_dir):
    polls = spark.range(600).select(F.floor(F.col("id") / 30).alias("n"), (F.col("id") % 30).alias("round"))
    n, r = F.col("n"), F.col("round")
    outcome = F.when((n + r) % 6 == 0, "failed").when(r == 0, "baseline").when((n + r) % 7 == 0, "skipped").otherwise("sampled")
    return ledger.poll_messages(polls.select(F.concat(F.lit("n"), n).alias("node_id"), "round", outcome.alias("outcome"), F.when(r >= n, "2").otherwise("1").alias("version")))
