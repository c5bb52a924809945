"""DuckDB forms of the derived inputs, from which the oracles are put together."""

CELLS = """
cell_days AS (
  SELECT e.*, n.n_name AS node_id, r.r_name AS region, CAST(e.cell_index % 12 AS INTEGER) AS x, CAST(e.cell_index // 12 AS INTEGER) AS y FROM (
    SELECT user_id % 25 AS shard_id, CAST((user_id // 25) % 156 AS INTEGER) AS cell_index, date_trunc('day', ts) AS day,
      max(event_id) AS seq, epoch_us(max(ts)) // 1000 AS timestamp_ms,
      CAST(count(*) FILTER (event_type IN ('view', 'click', 'error')) AS DOUBLE) AS reads,
      CAST(count(*) FILTER (event_type IN ('signup', 'purchase')) AS DOUBLE) AS writes,
      least(CAST(1 AS DOUBLE), CAST(sum(CAST(floor(value * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT)) AS DOUBLE) / CAST(30000 AS DOUBLE)) AS cpu_utilization,
      least(CAST(1 AS DOUBLE), max(value) / CAST(250 AS DOUBLE)) AS memory_utilization,
      coalesce(max(CASE WHEN event_type IN ('view', 'click', 'error') THEN value END) * CAST(400 AS DOUBLE), CAST(0 AS DOUBLE)) AS read_latency_us,
      coalesce(max(CASE WHEN event_type IN ('signup', 'purchase') THEN value END) * CAST(400 AS DOUBLE), CAST(0 AS DOUBLE)) AS write_latency_us,
      CAST(count(*) FILTER (event_type = 'error') * 5000 AS BIGINT) AS queue_depth
    FROM events GROUP BY ALL) e
  JOIN nation n ON n.n_nationkey = e.shard_id JOIN region r ON r.r_regionkey = n.n_regionkey)"""


def clamp(x: str) -> str:
    return f"least(greatest({x}, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE))"


def d(x) -> str:
    return f"CAST({x} AS DOUBLE)"


LATENCY = clamp(f"greatest(read_latency_us, write_latency_us) / {d(100000)}")
QUEUE = clamp(f"queue_depth / {d(10000)}")
PRESSURE = f"({clamp('cpu_utilization')} * {d(0.35)} + {clamp('memory_utilization')} * {d(0.20)} + {QUEUE} * {d(0.25)} + {LATENCY} * {d(0.20)})"
LEVEL = f"CASE WHEN pressure >= {d(0.90)} THEN 'critical' WHEN pressure >= {d(0.75)} THEN 'high' WHEN pressure >= {d(0.50)} THEN 'elevated' ELSE 'normal' END"
PROBABILITY = clamp(f"pressure * {d(0.45)} + {LATENCY} * {d(0.15)} + {QUEUE} * {d(0.20)} + (cpu_utilization * {d(0.60)} + memory_utilization * {d(0.40)}) * {d(0.20)}")
_OVER = "greatest(({} - {}) / {}, CAST(0 AS DOUBLE))".format
ANOMALY = clamp(
    f"{_OVER('cpu_utilization', d(0.8), d(0.2))} * {d(0.30)} + {_OVER('memory_utilization', d(0.8), d(0.2))} * {d(0.20)} + "
    f"{_OVER('queue_depth', d(10000), d(10000))} * {d(0.25)} + {_OVER('greatest(read_latency_us, write_latency_us)', d(50000), d(50000))} * {d(0.25)}"
)
PROFILES = f"""
profiles AS (SELECT *, pressure >= {d(0.75)} AS is_hot, {LEVEL} AS level FROM (
  SELECT *, reads + writes AS operations, CASE WHEN reads + writes > 0 THEN reads / (reads + writes) ELSE {d(0)} END AS read_ratio,
    CASE WHEN reads + writes > 0 THEN writes / (reads + writes) ELSE {d(0)} END AS write_ratio, {PRESSURE} AS pressure FROM source_cells))"""
PREDICTED = f"predicted AS (SELECT *, probability >= {d(0.75)} AS likely_hot, anomaly >= {d(0.80)} AS anomalous FROM (SELECT *, {PROBABILITY} AS probability, {ANOMALY} AS anomaly FROM profiles))"
DAYS = "source_cells AS (SELECT * FROM cell_days)"
LATEST = "source_cells AS (SELECT * FROM cell_days QUALIFY row_number() OVER (PARTITION BY shard_id, x, y ORDER BY seq DESC) = 1)"
LATEST_ROWS = LATEST.replace("source_cells", "latest_cells")
FLEET = f"""
placements AS (SELECT shard_id, x, y, node_id, region FROM latest_cells),
nodes AS (SELECT n_name AS node_id, r_name AS region, CASE WHEN n_nationkey % 11 = 10 THEN 'unreachable' WHEN n_nationkey % 7 = 6 THEN 'degraded' ELSE 'healthy' END AS condition, CAST(64 AS BIGINT) AS capacity FROM nation JOIN region ON r_regionkey = n_regionkey),
fleet AS (SELECT *, greatest(cpu, memory) AS utilization, greatest(capacity - hosted, 0) AS headroom, hosted >= capacity AS is_full, condition = 'healthy' AS accepts FROM (
  SELECT n.*, coalesce(h.hosted, 0) AS hosted, coalesce(o.cpu, {d(0)}) AS cpu, coalesce(o.memory, {d(0)}) AS memory FROM nodes n
  LEFT JOIN (SELECT node_id, count(*) AS hosted FROM placements GROUP BY 1) h USING (node_id)
  LEFT JOIN (SELECT node_id, max(cpu_utilization) AS cpu, max(memory_utilization) AS memory FROM latest_cells GROUP BY 1) o USING (node_id))),
ranked AS (SELECT s.node_id AS source, t.node_id AS destination,
  row_number() OVER (PARTITION BY s.node_id ORDER BY CASE WHEN t.region = s.region THEN 1 ELSE 0 END, t.utilization, t.hosted, t.node_id) AS away_rank,
  row_number() OVER (PARTITION BY s.node_id ORDER BY t.utilization, t.hosted, t.node_id) AS near_rank
  FROM fleet s JOIN fleet t ON s.node_id <> t.node_id AND t.accepts AND t.hosted < t.capacity)"""
_CASE = "CASE WHEN NOT likely_hot THEN {calm} WHEN placed IS NOT NULL AND read_ratio >= CAST(0.70 AS DOUBLE) AND away IS NOT NULL THEN {r} WHEN placed IS NOT NULL AND read_ratio < CAST(0.70 AS DOUBLE) AND write_ratio >= CAST(0.70 AS DOUBLE) THEN {i} WHEN placed IS NOT NULL AND read_ratio < CAST(0.70 AS DOUBLE) AND write_ratio < CAST(0.70 AS DOUBLE) AND nearest IS NOT NULL THEN {m} ELSE {stuck} END".format
DECISIONS = f"""
located AS (SELECT p.*, l.node_id AS placed, a.destination AS away, n.destination AS nearest FROM predicted p
  LEFT JOIN placements l ON l.shard_id = p.shard_id AND l.x = p.x AND l.y = p.y
  LEFT JOIN ranked a ON a.source = l.node_id AND a.away_rank = 1 LEFT JOIN ranked n ON n.source = l.node_id AND n.near_rank = 1),
decisions AS (SELECT *, action <> 'no_action' AND score > 0 AND confidence >= {d(0.80)} AS executable FROM (SELECT *, expected_gain - estimated_cost AS score FROM (SELECT *,
  {_CASE(calm="'no_action'", r="'replicate'", i="'isolate'", m="'move'", stuck="'no_action'")} AS action,
  {_CASE(calm="NULL", r="away", i="NULL", m="nearest", stuck="NULL")} AS target_node,
  {_CASE(calm=d(0), r=f"probability * {d(1.20)}", i="probability", m=f"probability * {d(0.90)}", stuck=d(0))} AS expected_gain,
  {_CASE(calm=d(0), r=d(0.35), i=d(0.45), m=d(0.50), stuck=d(1))} AS estimated_cost,
  {_CASE(calm=f"{d(1)} - probability", r="probability", i="probability", m="probability", stuck=d(0))} AS confidence FROM located)))"""


def cells(rows: str, *more: str) -> str:
    """WITH clause from the events to profiles (of all days, or of the latest per cell)."""
    return "WITH " + ",\n".join([CELLS, LATEST_ROWS, {"days": DAYS, "latest": LATEST}[rows], PROFILES, PREDICTED, FLEET, DECISIONS, *more]) + "\n"


NODES = """
store AS (
  SELECT 'Order:' || o_orderkey AS address, 'Order' AS kind, 'Customer:' || o_custkey AS owner, o_orderstatus AS status, CAST(o_totalprice AS DOUBLE) AS amount FROM orders
  UNION ALL SELECT 'Customer:' || c_custkey, 'Customer', n_name, c_mktsegment, CAST(c_acctbal AS DOUBLE) FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT 'Part:' || p_partkey, 'Part', p_brand, p_type, CAST(p_retailprice AS DOUBLE) FROM part
  UNION ALL SELECT 'Supplier:' || s_suppkey, 'Supplier', n_name, NULL, CAST(s_acctbal AS DOUBLE) FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""
EDGES = "edges AS (SELECT 'Order:' || l_orderkey AS \"from\", 'Part:' || l_partkey AS \"to\", 'contains' AS kind FROM lineitem)"
LOG = "log AS (SELECT event_id AS seq, 'User:' || user_id AS address, user_id, CASE WHEN event_type IN ('signup', 'purchase') THEN 'set' WHEN event_type IN ('view', 'click') THEN 'read' ELSE 'delete' END AS op, value FROM events)"
