"""Queries on keys, requests, routes, replicas and migrations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import keyspace, migration, replication, requests, routing
from ..sources import tables as T
from . import parts as P
from .registry import query

_RULES = [("kind", "Order", 1), ("prefix", "Order:", 1), ("kind", "Customer", 2), ("prefix", "Customer:", 2), ("kind", "Part", 3), ("prefix", "Part:", 3), ("kind", "Supplier", 4), ("prefix", "Order:1", 5)]


def _rules(spark, fallback=None):
    return spark.createDataFrame(_RULES + ([("fallback", "", fallback)] if fallback is not None else []), keyspace.RULES)


_S = "WITH " + P.NODES + " "
_BY = "CASE kind WHEN 'Order' THEN 1 WHEN 'Customer' THEN 2 WHEN 'Part' THEN 3 WHEN 'Supplier' THEN 4 END"
_PREFIX = "CASE WHEN starts_with(address, 'Order:1') THEN 5 WHEN starts_with(address, 'Order:') THEN 1 WHEN starts_with(address, 'Customer:') THEN 2 WHEN starts_with(address, 'Part:') THEN 3 END"


@query(_S + f"SELECT address, CAST(CASE WHEN k <> p THEN NULL ELSE coalesce(k, p) END AS BIGINT) AS shard_id, CASE WHEN k <> p THEN 'inconsistent' WHEN coalesce(k, p) IS NULL THEN 'unmapped' END AS miss FROM (SELECT address, {_BY} AS k, {_PREFIX} AS p FROM store)")
def keyspace_resolution(spark, sf_dir):
    return keyspace.resolve(T.store_nodes(spark, sf_dir).select("address", "kind"), _rules(spark)).select("address", "shard_id", "miss")


@query(_S + f"SELECT address, CAST(coalesce({_PREFIX}, 0) AS BIGINT) AS shard_id FROM store")
def keyspace_by_address(spark, sf_dir):
    """Longest prefix alone, with a fallback."""
    rows = T.store_nodes(spark, sf_dir).select("address", F.lit(None).cast("string").alias("kind"))
    return keyspace.resolve(rows, _rules(spark, fallback=0)).select("address", "shard_id")


@query("SELECT * FROM (VALUES ('kind', 'Order', 'duplicate'), ('prefix', ' ', 'empty')) t(rule, pattern, problem)")
def keyspace_conflicts(spark, sf_dir):
    return keyspace.conflicts(_rules(spark).union(spark.createDataFrame([("kind", "Order", 9), ("prefix", " ", 9)], keyspace.RULES)))


@query("SELECT CAST(NULL AS BIGINT) AS spanning_key UNION ALL SELECT 7")
def spanning_key(spark, sf_dir):
    return keyspace.spanning_key(_rules(spark, fallback=0)).union(keyspace.spanning_key(spark.createDataFrame([("kind", "A", 7), ("prefix", "B:", 7), ("fallback", "", 7)], keyspace.RULES)))


@query(_S + "SELECT kind, count(*) FILTER (starts_with(address, 'Order:1')) AS in_cell_5, count(*) FILTER (kind = 'Customer' OR starts_with(address, 'Customer:')) AS in_cell_2 FROM store GROUP BY kind")
def cell_scope(spark, sf_dir):
    nodes, rules = T.store_nodes(spark, sf_dir).select("address", "kind"), _rules(spark, fallback=0)
    five = keyspace.in_scope(nodes, rules, 5).withColumnRenamed("in_scope", "in_5")
    both = keyspace.in_scope(five, rules, 2)
    return both.groupBy("kind").agg(F.count_if("in_5").alias("in_cell_5"), F.count_if("in_scope").alias("in_cell_2"))


# request: method, path, query, body; then plan, refusal, status, shard, node.
_REQUESTS = [
    ("GET", "/", None, None, "broadcast", None, None, None, None),
    ("POST", "/node", None, '{"kind":"Order","address":"Order:2"}', "colocated", None, None, 1, "n1"),
    ("POST", "/node", None, '{"kind":"Order","address":"Order:12"}', "refuse", "keyspace", 421, None, None),
    ("POST", "/node", None, "{bad", "refuse", "malformed_body", 400, None, None),
    ("GET", "/node/Part%3A9", None, None, "colocated", None, None, 3, "n1"),
    ("GET", "/node/Part%3A9/history", None, None, "colocated", None, None, 3, "n1"),
    ("GET", "/node/Order:1/edges/out", None, None, "colocated", None, None, 5, "n2"),
    ("GET", "/node//Order:1//edges/in", None, None, "colocated", None, None, 5, "n2"),
    ("PUT", "/node/Customer:1", None, "{}", "colocated", None, None, 2, "n2"),
    ("DELETE", "/node/Nothing:1", None, None, "refuse", "keyspace", 421, None, None),
    ("POST", "/node/Order:2/claim", None, None, "colocated", None, None, 1, "n1"),
    ("POST", "/sequence/Order:ids/next", None, None, "colocated", None, None, 1, "n1"),
    ("GET", "/nodes", "limit=5&kind=Supplier", None, "colocated", None, None, 4, "n2"),
    ("GET", "/nodes", "limit=5", None, "refuse", "not_proxyable", 421, None, None),
    ("POST", "/nodes/query", None, '{"kind":"Part"}', "colocated", None, None, 3, "n1"),
    ("POST", "/nodes/count", None, "{}", "refuse", "not_proxyable", 421, None, None),
    ("POST", "/nodes/aggregate_by", None, '{"kind":"Customer"}', "colocated", None, None, 2, "n2"),
    ("POST", "/nodes/multiget", None, '{"addresses":["Order:2","Part:1"]}', "colocated", None, None, 1, "n1"),
    ("POST", "/nodes/multiget", None, '{"addresses":["Order:2","Customer:1"]}', "refuse", "spans_backends", 421, None, None),
    ("POST", "/nodes/multiget", None, '{"addresses":[]}', "refuse", "not_proxyable", 421, None, None),
    ("POST", "/nodes/multiget", None, "{}", "refuse", "malformed_body", 400, None, None),
    ("POST", "/edge", None, '{"from":"Order:2","to":"Part:1"}', "colocated", None, None, 1, "n1"),
    ("DELETE", "/edge", None, '{"from":"Order:2"}', "refuse", "malformed_body", 400, None, None),
    ("POST", "/transaction", None, '{"operations":[{"type":"insert_node","kind":"Order","address":"Order:2"},{"type":"insert_edge","from":"Order:2","to":"Part:4"}]}', "colocated", None, None, 1, "n1"),
    ("POST", "/transaction", None, '{"operations":[{"type":"fly"}]}', "refuse", "malformed_body", 400, None, None),
    ("POST", "/transaction", None, '{"operations":[{"type":"clear_kind","kind":"Customer"},{"type":"delete_node","address":"Order:2"}]}', "refuse", "spans_backends", 421, None, None),
    ("POST", "/transaction", None, '{"operations":[]}', "refuse", "not_proxyable", 421, None, None),
    ("GET", "/events", None, None, "subscribe", None, None, None, None),
    ("POST", "/publish", None, '{"channel":"Customer"}', "colocated", None, None, 2, "n2"),
    ("POST", "/publish", None, "{}", "refuse", "malformed_body", 400, None, None),
    ("GET", "/changes", "after=3", None, "refuse", "not_proxyable", 421, None, None),
    ("GET", "/stats", None, None, "refuse", "not_proxyable", 421, None, None),
    ("POST", "/admin/users", None, "{}", "refuse", "not_proxyable", 421, None, None),
    ("DELETE", "/admin/users/7", None, None, "refuse", "not_proxyable", 421, None, None),
    ("GET", "/admin/indexes", None, None, "broadcast", None, None, None, None),
    ("DELETE", "/admin/references/r", None, None, "broadcast", None, None, None, None),
    ("GET", "/nowhere", None, None, "refuse", "unknown_route", 404, None, None),
    ("PATCH", "/node/Order:1", None, None, "refuse", "unknown_route", 404, None, None),
]


def _sql(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def _requests(spark):
    rows = [(i, *r[:4]) for i, r in enumerate(_REQUESTS)]
    return spark.createDataFrame(rows, "request_id bigint, method string, path string, query string, body string")


@query("SELECT CAST(request_id AS BIGINT) AS request_id, plan, refusal, CAST(status AS INTEGER) AS status, CAST(shard_id AS BIGINT) AS shard_id, node_id FROM (VALUES " + ", ".join(f"({i}, " + ", ".join(map(_sql, r[4:])) + ")" for i, r in enumerate(_REQUESTS)) + ") t(request_id, plan, refusal, status, shard_id, node_id)")
def request_plans(spark, sf_dir):
    owners = spark.createDataFrame([(1, "n1"), (2, "n2"), (3, "n1"), (4, "n2"), (5, "n2")], "shard_id bigint, node_id string")
    return requests.plan(_requests(spark), _rules(spark), owners)


@query("""SELECT CAST(r AS BIGINT) AS request_id, CAST(p AS INTEGER) AS position, kind, address, problem FROM (VALUES
(23, 0, 'Order', 'Order:2', NULL), (23, 1, NULL, 'Order:2', NULL), (23, 2, NULL, 'Part:4', NULL), (24, 0, NULL, NULL, 'malformed_body'), (25, 0, 'Customer', NULL, NULL), (25, 1, NULL, 'Order:2', NULL)) t(r, p, kind, address, problem)""")
def transaction_keys(spark, sf_dir):
    return requests.touched_keys(_requests(spark).filter("path = '/transaction'"))


@query("SELECT error, CAST(status AS INTEGER) AS status, retryable FROM (VALUES " + ", ".join(f"('{k}', {s}, {str(r).lower()})" for k, (s, r) in requests.ROUTING_STATUS.items()) + ") t(error, status, retryable)")
def routing_status(spark, sf_dir):
    return spark.createDataFrame([(k, s, r) for k, (s, r) in requests.ROUTING_STATUS.items()], "error string, status int, retryable boolean")


@query("""SELECT CAST(i AS BIGINT) AS request_id, CAST(CASE WHEN i % 11 = 0 THEN 502 WHEN i % 7 = 0 THEN 500 WHEN i % 5 = 0 AND i % 2 = 0 THEN 409 ELSE 200 END AS INTEGER) AS status FROM range(1, 500) t(i)""")
def broadcast_merge(spark, sf_dir):
    i, p = F.col("id"), F.col("position")
    rows = spark.range(1, 500).withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(2))))
    status = F.when((i % 11 == 0) & (p == 2), None).when((i % 7 == 0) & (p == 1), 500).otherwise(200)
    body = F.when((i % 5 == 0) & (p == 1), F.lit('[{"a":9}]')).when(p == 0, F.lit('[{"a":1},{"b":2}]')).otherwise(F.lit('[{"b":2},{"a":1}]'))
    return requests.merge_answers(rows.select(i.alias("request_id"), p, status.alias("status"), body.alias("body"), (i % 2 == 0).alias("agree"))).select("request_id", "status")


@query("SELECT CAST(i AS BIGINT) AS request_id, 1 AS position FROM range(5, 500, 5) t(i)")
def answers_agree(spark, sf_dir):
    i, p = F.col("id"), F.col("position")
    rows = spark.range(1, 500).withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(2))))
    body = F.when((i % 5 == 0) & (p == 1), F.lit('[{"a":9}]')).when(p == 0, F.lit('[{"a":1},{"b":2}]')).otherwise(F.lit('[{"b":2},{"a":1}]'))
    return requests.first_disagreement(rows.select(i.alias("request_id"), p, F.lit(200).alias("status"), body.alias("body")))


def _overrides(spark, sf_dir):
    """Every customer's number moves a cell to another node."""
    c = T.table(spark, sf_dir, "customer")
    nodes = T.regions(spark, sf_dir)
    cells = c.select((F.col("c_custkey") % 25).alias("shard_id"), (F.floor(F.col("c_custkey") / 25) % 156).cast("int").alias("cell"), F.col("c_nationkey").cast("bigint").alias("to")).groupBy("shard_id", "cell").agg(F.min("to").alias("to"))
    return cells.join(F.broadcast(nodes.select(F.col("shard_id").alias("to"), "node_id")), "to").select("shard_id", (F.col("cell") % 12).alias("x"), F.floor(F.col("cell") / 12).cast("int").alias("y"), "node_id")


_CELLS = """WITH moved AS (SELECT c_custkey % 25 AS shard_id, CAST(c_custkey // 25 % 156 AS INTEGER) AS cell_index, min(c_nationkey) AS to_key FROM customer GROUP BY 1, 2),
owned AS (SELECT n.n_nationkey AS shard_id, i AS cell_index, coalesce(t.n_name, n.n_name) AS node_id FROM nation n CROSS JOIN range(156) r(i) LEFT JOIN moved m ON m.shard_id = n.n_nationkey AND m.cell_index = i LEFT JOIN nation t ON t.n_nationkey = m.to_key),
marked AS (SELECT *, sum(new) OVER (PARTITION BY shard_id ORDER BY cell_index) AS segment FROM (SELECT *, CASE WHEN node_id = lag(node_id) OVER (PARTITION BY shard_id ORDER BY cell_index) THEN 0 ELSE 1 END AS new FROM owned WHERE {})) """
_SEGMENTS = "SELECT CAST(shard_id AS BIGINT) AS shard_id, CAST(segment AS BIGINT) AS segment, min(node_id) AS node_id, CAST(min(cell_index) AS INTEGER) AS first_cell, CAST(max(cell_index) AS INTEGER) AS last_cell, count(*) AS cells FROM marked GROUP BY shard_id, segment"


def _served(spark, sf_dir):
    topology = T.regions(spark, sf_dir).select("shard_id", "node_id", F.lit(0).alias("position"))
    return routing.owners(topology, _overrides(spark, sf_dir)).withColumn("served_by", F.lit("shard_owner"))


@query(_CELLS.format("true") + _SEGMENTS)
def scan_segments(spark, sf_dir):
    return routing.segments(_served(spark, sf_dir)).drop("served_by")


@query(_CELLS.format("shard_id = 3 AND cell_index BETWEEN 20 AND 90") + _SEGMENTS)
def range_segments(spark, sf_dir):
    return routing.segments(_served(spark, sf_dir).filter("shard_id = 3 and cell_index between 20 and 90")).drop("served_by")


def _replicas(spark, sf_dir):
    """Three copies a shard on neighbouring nodes; state, lag and last report vary with shard and copy."""
    nodes = T.regions(spark, sf_dir)
    copies = nodes.select("shard_id").withColumn("i", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("holder", (F.col("shard_id") + F.element_at(F.array(F.lit(0), F.lit(1), F.lit(7)), F.col("i") + 1)) % 25)
    k = F.col("shard_id") + F.col("i")
    state = F.element_at(F.array(*[F.lit(s) for s in _STATES]), (k % 5 + 1).cast("int"))
    rows = copies.join(F.broadcast(nodes.select(F.col("shard_id").alias("holder"), "node_id", "region")), "holder")
    return rows.select("shard_id", "node_id", "region", F.when(F.col("i") == 0, "primary").otherwise("secondary").alias("role"), state.alias("state"), F.when(k % 4 == 0, 3).otherwise(0).cast("bigint").alias("pending_writes"), (k * 150 % 2000).cast("bigint").alias("apply_lag_ms"), F.when(k % 9 == 8, None).otherwise(F.lit(100_000) - k * 3000 % 40_000).cast("bigint").alias("last_report_ms"))


_STATES = ["in_sync", "in_sync", "lagging", "in_sync", "failed"]
_REPLICAS = """WITH copies AS (SELECT n_nationkey AS shard_id, i, (n_nationkey + CASE i WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 7 END) % 25 AS holder, n_nationkey + i AS k FROM nation CROSS JOIN range(3) r(i)),
replicas AS (SELECT CAST(shard_id AS BIGINT) AS shard_id, n_name AS node_id, r_name AS region, CASE WHEN i = 0 THEN 'primary' ELSE 'secondary' END AS role, ['in_sync', 'in_sync', 'lagging', 'in_sync', 'failed'][CAST(k % 5 + 1 AS INTEGER)] AS state,
  CASE WHEN k % 4 = 0 THEN 3 ELSE 0 END AS pending_writes, k * 150 % 2000 AS apply_lag_ms, CASE WHEN k % 9 = 8 THEN NULL ELSE 100000 - k * 3000 % 40000 END AS last_report_ms
  FROM copies JOIN nation ON n_nationkey = holder JOIN region ON r_regionkey = n_regionkey) """


@query(_REPLICAS + "SELECT shard_id, count(*) AS replicas, count(*) FILTER (state = 'in_sync') AS effective, count(*) FILTER (state IN ('in_sync', 'lagging')) AS readable, count(*) FILTER (state = 'failed') AS failed, min(CASE WHEN state = 'in_sync' AND role = 'primary' THEN node_id END) AS write_target FROM replicas GROUP BY shard_id")
def replica_health(spark, sf_dir):
    return replication.replica_health(_replicas(spark, sf_dir))


@query(_REPLICAS + """, judged AS (SELECT *, CASE WHEN state <> 'in_sync' THEN 1 WHEN last_report_ms IS NULL THEN 1 WHEN 100000 - last_report_ms > 30000 THEN 1 WHEN pending_writes > 0 THEN 1 WHEN apply_lag_ms > 1000 THEN 1 ELSE 0 END AS bad FROM replicas),
sets AS (SELECT shard_id, coalesce(bool_or(role = 'primary' AND (state <> 'in_sync' OR 100000 - last_report_ms > 30000)), false) AS needs,
  min(CASE WHEN role <> 'primary' AND bad = 0 THEN {p: pending_writes, l: apply_lag_ms, n: node_id} END) AS best, bool_or(role <> 'primary' AND state = 'in_sync') AS has_some FROM judged GROUP BY shard_id)
SELECT shard_id, needs AS needs_replacement, CASE WHEN needs THEN best.n END AS promote, CASE WHEN NOT needs THEN 'primary_still_serving' WHEN best IS NULL THEN CASE WHEN has_some THEN 'every_candidate_ineligible' ELSE 'no_in_sync_secondary' END END AS blocker, needs AND best IS NULL AS stuck FROM sets""")
def failover_assessment(spark, sf_dir):
    return replication.failover(_replicas(spark, sf_dir), 100_000)


@query(_REPLICAS + "SELECT shard_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY node_id DESC) AS k FROM replicas JOIN (SELECT shard_id, count(*) - 1 AS excess FROM replicas WHERE state = 'in_sync' GROUP BY 1) USING (shard_id) WHERE state = 'in_sync' AND role <> 'primary') WHERE k <= excess")
def replica_surplus(spark, sf_dir):
    return replication.surplus(_replicas(spark, sf_dir), 1)


@query()
def replica_plan(spark, sf_dir):
    """Copies to add so that each shard has four live ones, regions spread."""
    fleet = T.fleet_nodes(spark, sf_dir).select("node_id", "region", (F.col("condition") == "healthy").alias("serviceable"), (F.col("shard_id") % 4).alias("hosted"))
    return replication.placement_plan(_replicas(spark, sf_dir), fleet, 4)


@query()
def replica_report_fold(spark, sf_dir):
    """Events as health reports on the replicas."""
    e = T.table(spark, sf_dir, "events").join(F.broadcast(T.regions(spark, sf_dir)), F.col("user_id") % 25 == F.col("shard_id"))
    reports = e.select("shard_id", "node_id", F.col("event_id").alias("seq"), (F.unix_millis(F.col("ts").cast("timestamp")) - F.when(F.col("event_id") % 13 == 0, 600_000).otherwise(0)).alias("timestamp_ms"), (F.col("value") * 4).cast("bigint").alias("pending_writes"), (F.col("value") * 10).cast("bigint").alias("apply_lag_ms"), (F.col("event_type") != "error").alias("reachable"))
    return replication.fold_reports(_replicas(spark, sf_dir), reports)


_TOPOLOGY = _REPLICAS + """, entries AS (SELECT CAST(n_nationkey AS BIGINT) AS shard_id, n_name AS owner FROM nation),
sets AS (SELECT * FROM replicas WHERE shard_id % 3 <> 2),
moves AS (SELECT CAST(a.n_nationkey AS BIGINT) AS shard_id, a.n_name AS source, b.n_name AS destination, CASE WHEN a.n_nationkey % 12 = 0 THEN NULL WHEN a.n_nationkey % 8 = 0 THEN b.n_name ELSE a.n_name END AS write_owner, a.n_nationkey % 8 = 0 AS has_cut_over
  FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 1) % 25 WHERE a.n_nationkey % 4 = 0) """


def _topology(spark, sf_dir):
    nodes = T.regions(spark, sf_dir)
    entries = nodes.select("shard_id", F.col("node_id").alias("owner"), "region")
    k = F.col("shard_id")
    moves = nodes.filter("shard_id % 4 = 0").select("shard_id", F.col("node_id").alias("source")).join(F.broadcast(nodes.select(F.col("shard_id").alias("to"), F.col("node_id").alias("destination"))), (k + 1) % 25 == F.col("to"))
    moves = moves.select("shard_id", "source", "destination", F.when(k % 12 == 0, None).when(k % 8 == 0, F.col("destination")).otherwise(F.col("source")).alias("write_owner"), (k % 8 == 0).alias("has_cut_over"))
    return entries, _replicas(spark, sf_dir).filter("shard_id % 3 <> 2"), moves


@query(_TOPOLOGY + """, rows AS (SELECT e.shard_id, e.owner, m.*EXCLUDE (shard_id), s.shard_id IS NOT NULL AS with_set, s.writable, m.source IS NOT NULL AND (s.prim IS NULL OR s.prim IN (m.source, m.destination)) AS moving FROM entries e LEFT JOIN moves m USING (shard_id)
  LEFT JOIN (SELECT shard_id, min(CASE WHEN role = 'primary' THEN node_id END) AS prim, min(CASE WHEN role = 'primary' AND state = 'in_sync' THEN node_id END) AS writable FROM sets GROUP BY 1) s USING (shard_id)),
judged AS (SELECT *, CASE WHEN moving AND write_owner IS NULL THEN 'write_fenced' WHEN NOT moving AND with_set AND writable IS NULL THEN 'no_writable_replica' END AS error FROM rows)
SELECT shard_id, CASE WHEN error IS NULL THEN CASE WHEN moving THEN write_owner WHEN with_set THEN writable ELSE owner END END AS node_id,
CASE WHEN error IS NULL THEN CASE WHEN moving THEN CASE WHEN write_owner = destination THEN 'migration_destination' ELSE 'migration_source' END WHEN with_set THEN 'primary' ELSE 'shard_owner' END END AS served_by, error FROM judged""")
def write_targets(spark, sf_dir):
    entries, replicas, moves = _topology(spark, sf_dir)
    return routing.write_targets(entries.drop("region"), replicas, moves)


_CANDIDATES = """, base AS (SELECT shard_id, node_id, CASE WHEN role = 'primary' THEN 'primary' ELSE 'secondary' END AS served_by, CASE WHEN role = 'primary' THEN 0 ELSE 1 END AS a FROM sets WHERE state = 'in_sync'
  UNION ALL SELECT shard_id, owner, 'shard_owner', 0 FROM entries WHERE shard_id NOT IN (SELECT shard_id FROM sets)),
stays AS (SELECT b.shard_id, b.node_id, b.a, CASE WHEN m.has_cut_over AND b.node_id = m.destination THEN 'migration_destination' WHEN NOT m.has_cut_over AND b.node_id = m.source THEN 'migration_source' ELSE b.served_by END AS served_by
  FROM base b LEFT JOIN moves m USING (shard_id) WHERE m.source IS NULL OR (m.has_cut_over AND b.node_id <> m.source) OR (NOT m.has_cut_over AND b.node_id <> m.destination)),
listed AS (SELECT * FROM stays UNION ALL SELECT shard_id, destination, -1, 'migration_destination' FROM moves m WHERE has_cut_over AND NOT EXISTS (FROM stays s WHERE s.shard_id = m.shard_id AND s.node_id = m.destination)
  UNION ALL SELECT shard_id, source, -1, 'migration_source' FROM moves m WHERE NOT has_cut_over AND NOT EXISTS (FROM stays s WHERE s.shard_id = m.shard_id)),
everything AS (SELECT l.*, r_name AS region FROM listed l JOIN nation ON n_name = l.node_id JOIN region ON r_regionkey = n_regionkey)
"""


@query(_TOPOLOGY + _CANDIDATES + ", ranked AS (SELECT shard_id, row_number() OVER (PARTITION BY shard_id ORDER BY a, node_id) AS rank, node_id, served_by FROM everything) SELECT e.shard_id, rank, node_id, served_by, CASE WHEN node_id IS NULL THEN 'no_readable_replica' END AS error FROM entries e LEFT JOIN ranked r ON r.shard_id = e.shard_id")
def read_candidates(spark, sf_dir):
    return routing.read_candidates(*_topology(spark, sf_dir))


@query(_TOPOLOGY + _CANDIDATES + """, ranked AS (SELECT shard_id, row_number() OVER (PARTITION BY shard_id ORDER BY CASE WHEN region = 'ASIA' THEN 0 ELSE 1 END, a, node_id) AS rank, node_id, served_by FROM everything),
judged AS (SELECT e.shard_id, rank, node_id, served_by, coalesce(n.n_nationkey % 11 <> 10, false) AS routable FROM entries e LEFT JOIN ranked r ON r.shard_id = e.shard_id LEFT JOIN nation n ON n.n_name = r.node_id)
SELECT *, CASE WHEN node_id IS NULL THEN 'no_readable_replica' WHEN NOT bool_or(routable) OVER (PARTITION BY shard_id) THEN 'no_live_owner' END AS error FROM judged""")
def region_routes(spark, sf_dir):
    """Read candidates that prefer one region, with which of them can be routed to."""
    nodes = T.fleet_nodes(spark, sf_dir).select("node_id", "region", F.when(F.col("condition") == "healthy", "serviceable").when(F.col("condition") == "degraded", "unknown").otherwise("unreachable").alias("availability"))
    return routing.routes(routing.read_candidates(*_topology(spark, sf_dir), preference="prefer_region", region="ASIA", nodes=nodes), nodes)


def _cell_moves(spark, sf_dir):
    """Each supplier's migration of a cell, each part brand's of a shard; most have cut over."""
    s, nodes = T.table(spark, sf_dir, "supplier"), T.regions(spark, sf_dir)
    k = F.col("s_suppkey")
    cell = F.floor(k / 25) % 156
    rows = s.select((k % 25).alias("shard_id"), F.when(k % 10 > 0, cell % 12).cast("int").alias("x"), F.when(k % 10 > 0, F.floor(cell / 12)).cast("int").alias("y"), F.col("s_nationkey").cast("bigint").alias("to"), k.cast("bigint").alias("seq"), F.when(k % 4 == 0, "copying").when(k % 4 == 1, "aborted").otherwise("completed").alias("phase"), (k % 4 > 1).alias("has_cut_over"))
    return rows.join(nodes.select(F.col("shard_id").alias("to"), F.col("node_id").alias("destination")), "to")


@query("""WITH moves AS (SELECT s_suppkey % 25 AS shard_id, CASE WHEN s_suppkey % 10 > 0 THEN s_suppkey // 25 % 156 % 12 END AS x, CASE WHEN s_suppkey % 10 > 0 THEN s_suppkey // 25 % 156 // 12 END AS y, n_name AS destination, s_suppkey AS seq FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 4 > 1),
last AS (SELECT shard_id, x, y, arg_max(destination, seq) AS node_id FROM moves GROUP BY ALL),
held AS (SELECT n_nationkey AS shard_id, NULL AS x, NULL AS y, n_name AS node_id FROM nation UNION ALL SELECT shard_id, cell_index % 12, cell_index // 12, n_name FROM (SELECT c_custkey % 25 AS shard_id, CAST(c_custkey // 25 % 156 AS INTEGER) AS cell_index, min(c_nationkey) AS to_key FROM customer GROUP BY 1, 2) JOIN nation ON n_nationkey = to_key)
SELECT CAST(coalesce(h.shard_id, l.shard_id) AS BIGINT) AS shard_id, CAST(coalesce(h.x, l.x) AS INTEGER) AS x, CAST(coalesce(h.y, l.y) AS INTEGER) AS y, coalesce(l.node_id, h.node_id) AS node_id
FROM held h FULL JOIN last l ON l.shard_id = h.shard_id AND l.x IS NOT DISTINCT FROM h.x AND l.y IS NOT DISTINCT FROM h.y""")
def published_owners(spark, sf_dir):
    """Owners and overrides once ended migrations are folded into them."""
    topology = T.regions(spark, sf_dir).select("shard_id", "node_id", F.lit(0).alias("position"))
    return routing.published(topology, _overrides(spark, sf_dir), _cell_moves(spark, sf_dir))


@query("""WITH cells AS (SELECT DISTINCT user_id % 25 AS shard_id, CAST(user_id // 25 % 156 % 12 AS INTEGER) AS x, CAST(user_id // 25 % 156 // 12 AS INTEGER) AS y FROM events),
moves AS (SELECT s_suppkey % 25 AS shard_id, CASE WHEN s_suppkey % 10 > 0 THEN CAST(s_suppkey // 25 % 156 % 12 AS INTEGER) END AS x, CASE WHEN s_suppkey % 10 > 0 THEN CAST(s_suppkey // 25 % 156 // 12 AS INTEGER) END AS y, n_name AS destination, s_suppkey AS seq FROM supplier JOIN nation ON n_nationkey = s_nationkey),
of_cell AS (SELECT shard_id, x, y, arg_max(destination, seq) AS destination FROM moves WHERE x IS NOT NULL GROUP BY ALL), of_shard AS (SELECT shard_id, arg_max(destination, seq) AS destination FROM moves WHERE x IS NULL GROUP BY ALL)
SELECT c.shard_id, c.x, c.y, k.destination IS NOT NULL AS cell_scope, coalesce(k.destination, s.destination) AS destination FROM cells c LEFT JOIN of_cell k USING (shard_id, x, y) LEFT JOIN of_shard s ON s.shard_id = c.shard_id""")
def scoped_migrations(spark, sf_dir):
    """The migration that holds for each cell: its own, else its shard's."""
    e = T.table(spark, sf_dir, "events")
    cell = F.floor(F.col("user_id") / 25) % 156
    cells = e.select((F.col("user_id") % 25).alias("shard_id"), (cell % 12).cast("int").alias("x"), F.floor(cell / 12).cast("int").alias("y")).distinct()
    moves = _cell_moves(spark, sf_dir).groupBy("shard_id", "x", "y").agg(F.max_by("destination", "seq").alias("destination"))
    return routing.scoped(cells, moves.filter("x is not null"), moves.filter("x is null"), ["destination"])


@query("SELECT l_orderkey AS shard_id, CAST(least(c, 2) AS BIGINT) AS replicas, CAST(CASE WHEN c > 1 THEN c - 1 ELSE 5 END AS BIGINT) AS refused FROM (SELECT l_orderkey, count(DISTINCT l_linenumber) AS c FROM lineitem GROUP BY 1)")
def replica_operations(spark, sf_dir):
    """Each order's lines as copies to add, of which all but two repeat a node; then the second is seeded, put in sync and promoted, the first can be removed no more
    once it is promoted again, and the set is counted."""
    line = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("shard_id"), "l_linenumber").distinct()
    line = line.select("shard_id", F.row_number().over(Window.partitionBy("shard_id").orderBy("l_linenumber")).cast("bigint").alias("n"))
    adds = line.select("shard_id", F.col("n").alias("seq"), F.lit("add").alias("op"), F.when(F.col("n") == 1, "a").otherwise("b").alias("node"))
    script = F.array(*[F.struct(F.lit(100 + i).cast("bigint").alias("seq"), F.lit(op).alias("op"), F.lit(node).alias("node")) for i, (op, node) in enumerate([("begin_seed", "b"), ("mark_in_sync", "b"), ("promote", "b"), ("promote", "a"), ("remove", "a")])])
    rest = line.select("shard_id").distinct().select("shard_id", F.explode(script).alias("s")).select("shard_id", "s.*")
    done = replication.fold_operations(adds.unionByName(rest))
    out = done.groupBy("shard_id").agg(F.max_by("replicas", "seq").alias("last"), F.count_if(F.col("refusal").isNotNull()).alias("refused"))
    return out.select("shard_id", F.size(F.split("last", ",")).cast("bigint").alias("replicas"), "refused")


@query()
def migration_fold(spark, sf_dir):
    """Each order's migration: its lines are writes, then copy, catch-up and cutover."""
    lines = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("migration_id"), F.col("l_linenumber").cast("bigint").alias("n"))
    o = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("migration_id"), (F.col("o_orderkey") % 4).alias("k"))
    script = [("begin_copy", None, 10), ("copied", 5, 11), ("copied", 3, 12), ("catch_up", None, 13), ("copied", 8, 14), ("catch_up", None, 15), ("applied", 1, 16), ("begin_cutover", None, 17), ("write", 99, 18), ("complete_cutover", None, 19), ("complete", None, 20), ("abort", None, 21)]
    steps = F.array(*[F.struct(F.lit(a).alias("op"), F.lit(b).cast("bigint").alias("n"), F.lit(c).cast("bigint").alias("seq")) for a, b, c in script])
    rest = o.select("migration_id", F.explode(F.slice(steps, 1, len(script) - F.col("k").cast("int"))).alias("s")).select("migration_id", "s.*")
    writes = lines.select("migration_id", F.lit("write").alias("op"), "n", F.col("n").alias("seq"))
    rows = writes.unionByName(rest).withColumns({"atoms_total": F.lit(8), "source": F.lit("a"), "destination": F.lit("b")})
    return migration.fold(rows)


@query("""SELECT phase, CAST(copied AS BIGINT) AS copied, CASE phase WHEN 'copying' THEN copied / 8::DOUBLE * 0.80::DOUBLE WHEN 'catching_up' THEN 0.85::DOUBLE WHEN 'cutover' THEN 0.95::DOUBLE WHEN 'cleanup' THEN 0.98::DOUBLE WHEN 'completed' THEN 1::DOUBLE ELSE 0::DOUBLE END AS done
FROM (VALUES ('planned'), ('copying'), ('catching_up'), ('cutover'), ('cleanup'), ('completed'), ('aborted')) p(phase) CROSS JOIN range(0, 9) r(copied)""")
def migration_progress(spark, sf_dir):
    phases = spark.createDataFrame([(p,) for p in ("planned", "copying", "catching_up", "cutover", "cleanup", "completed", "aborted")], "phase string")
    rows = phases.withColumn("copied", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(8).cast("bigint"))))
    return rows.select("phase", "copied", migration.overall_fraction(F.col("phase"), F.col("copied"), F.lit(8.0)).alias("done"))
