"""Queries over telemetry: cells, profiles, predictions, counters, liveness, the generator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import grid, simulation, wire
from ..operators import generator, profile, rates
from ..sources import tables as T
from ..streaming import fold
from . import parts as P
from .registry import query

CELL = ["shard_id", "x", "y"]


def profiles(spark, sf_dir, latest=False):
    rows = T.cell_telemetry(spark, sf_dir)
    return profile.with_prediction(profile.with_profile(profile.latest(rows, CELL) if latest else rows))


@query("SELECT 'atom-' || i AS atom_id, CAST(i AS INTEGER) AS cell_index, CAST(i % 12 AS INTEGER) AS x, CAST(i // 12 AS INTEGER) AS y FROM range(156) t(i)")
def grid_cells(spark, sf_dir):
    return grid.grid(spark)


@query("SELECT CAST(i AS INTEGER) AS cell_index, CAST(i // 12 * 12 + i % 12 AS INTEGER) AS again, i < 156 AS on_grid FROM range(200) t(i)")
def grid_roundtrip(spark, sf_dir):
    i = F.col("id").cast("int")
    x, y = i % 12, F.floor(i / 12).cast("int")
    return spark.range(200).select(i.alias("cell_index"), grid.cell_index(x, y).alias("again"), grid.on_grid(x, y).alias("on_grid"))


def _sql(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


@query("""WITH k AS (SELECT event_id, event_id % 8 AS form, user_id AS s, user_id % 12 AS x, event_id % 13 AS y FROM events)
SELECT event_id, CASE form WHEN 0 THEN s || '/' || x || ',' || y WHEN 1 THEN ' +' || s || ' / ' || x || ' ,' || chr(9) || y || ' ' WHEN 2 THEN s::VARCHAR WHEN 3 THEN 'abc/' || x WHEN 4 THEN 'abc/' || x || ',' || y WHEN 5 THEN s || '/' || (300 + x) || ',' || y WHEN 6 THEN s || '/' || x || ',' || y || ',1' ELSE s || '/' || (12 + x) || ',' || y END AS text,
CASE WHEN form < 2 THEN s END AS shard_id, CASE WHEN form < 2 THEN CAST(x AS INTEGER) END AS x, CASE WHEN form < 2 THEN CAST(y AS INTEGER) END AS y, [NULL, NULL, 'missing_slash', 'missing_comma', 'bad_shard', 'bad_x', 'bad_y', 'off_grid'][form + 1] AS error FROM k""")
def routing_key_parse(spark, sf_dir):
    """Keys of every event in eight forms, six of them wrong in one way each."""
    # Dealt anew: a large file may have few parts to read, and each row is dear.
    e = T.table(spark, sf_dir, "events").select("event_id", "user_id").repartition("event_id")
    s, x, y, form = F.col("user_id"), F.col("user_id") % 12, F.col("event_id") % 13, F.col("event_id") % 8
    t = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    texts = [t(s, "/", x, ",", y), t(" +", s, " / ", x, " ,\t", y, " "), s.cast("string"), t("abc/", x), t("abc/", x, ",", y), t(s, "/", x + 300, ",", y), t(s, "/", x, ",", y, ",1"), t(s, "/", x + 12, ",", y)]
    text = F.element_at(F.array(*texts), (form + 1).cast("int"))
    return e.select("event_id", text.alias("text")).withColumn("k", grid.parse_key(F.col("text"))).select("event_id", "text", "k.*")


_METRICS = ["shard_id", "x", "y", "seq", "timestamp_ms", "node_id", "region", "reads", "writes", "cpu_utilization", "memory_utilization", "read_latency_us", "write_latency_us", "queue_depth"]


@query("WITH " + P.CELLS + " SELECT " + ", ".join(_METRICS) + " FROM cell_days")
def cell_metrics(spark, sf_dir):
    return T.cell_telemetry(spark, sf_dir).select(*_METRICS)


_PROFILE = ["shard_id", "x", "y", "seq", "operations", "read_ratio", "write_ratio", "pressure", "level", "is_hot"]


@query(P.cells("latest") + "SELECT " + ", ".join(_PROFILE) + " FROM profiles")
def latest_profiles(spark, sf_dir):
    return profiles(spark, sf_dir, latest=True).select(*_PROFILE)


@query(P.cells("days") + "SELECT level, count(*) AS cells, min(pressure) AS lowest, max(pressure) AS highest FROM profiles GROUP BY level")
def pressure_levels(spark, sf_dir):
    return profiles(spark, sf_dir).groupBy("level").agg(F.count("*").alias("cells"), F.min("pressure").alias("lowest"), F.max("pressure").alias("highest"))


@query(P.cells("days") + "SELECT shard_id, x, y, seq, pressure FROM profiles WHERE is_hot")
def hot_cells(spark, sf_dir):
    return profiles(spark, sf_dir).filter("is_hot").select("shard_id", "x", "y", "seq", "pressure")


@query(P.cells("days") + "SELECT shard_id, x, y, seq, cpu_utilization >= 0.8::DOUBLE AS cpu_hot, memory_utilization >= 0.8::DOUBLE AS memory_hot, queue_depth >= 10000 AS queue_hot, cpu_utilization >= 0.8::DOUBLE OR memory_utilization >= 0.8::DOUBLE OR queue_depth >= 10000 AS any_hot FROM cell_days")
def raw_heat_flags(spark, sf_dir):
    return profile.raw_heat(T.cell_telemetry(spark, sf_dir)).select("shard_id", "x", "y", "seq", "cpu_hot", "memory_hot", "queue_hot", "any_hot")


@query(P.cells("latest") + "SELECT (SELECT count(*) FROM placements) AS placements, (SELECT count(*) FROM profiles) AS profiles, (SELECT count(*) FROM profiles WHERE is_hot) AS hot, (SELECT count(*) FROM latest_cells) AS observations")
def status_counts(spark, sf_dir):
    rows = profiles(spark, sf_dir, latest=True)
    return profile.status_counts(rows, rows, rows)


@query(P.cells("latest") + "SELECT node_id, count(*) AS cells, max(cpu_utilization) AS cpu, max(memory_utilization) AS memory, max(timestamp_ms) AS observed_at_ms FROM latest_cells GROUP BY node_id")
def latest_observations_by_node(spark, sf_dir):
    latest = profile.latest(T.cell_telemetry(spark, sf_dir), ["node_id", *CELL])
    return latest.groupBy("node_id").agg(F.count("*").alias("cells"), F.max("cpu_utilization").alias("cpu"), F.max("memory_utilization").alias("memory"), F.max("timestamp_ms").alias("observed_at_ms"))


@query("SELECT epoch_us(max(ts)) // 1000 AS clock_ms FROM events")
def message_clock(spark, sf_dir):
    return fold.clock(T.table(spark, sf_dir, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms")))


@query(P.cells("days") + "SELECT shard_id, x, y, seq, probability, likely_hot FROM predicted")
def hotspot_predictions(spark, sf_dir):
    return profiles(spark, sf_dir).select("shard_id", "x", "y", "seq", "probability", "likely_hot")


@query(P.cells("days") + "SELECT shard_id, x, y, seq, anomaly, anomalous FROM predicted")
def anomaly_scores(spark, sf_dir):
    return profiles(spark, sf_dir).select("shard_id", "x", "y", "seq", "anomaly", "anomalous")


@query(P.cells("days") + "SELECT shard_id, x, y, seq, operations AS operations_per_second, reads AS reads_per_second, writes AS writes_per_second, CAST(queue_depth AS DOUBLE) AS queue_depth, cpu_utilization, memory_utilization, pressure FROM profiles")
def feature_vectors(spark, sf_dir):
    return profiles(spark, sf_dir).select("shard_id", "x", "y", "seq", F.col("operations").alias("operations_per_second"), F.col("reads").alias("reads_per_second"), F.col("writes").alias("writes_per_second"), F.col("queue_depth").cast("double").alias("queue_depth"), "cpu_utilization", "memory_utilization", "pressure")


_SNAPSHOTS = """WITH days AS (SELECT n_name AS node_id, date_trunc('day', ts) AS day, count(*) FILTER (event_type IN ('view', 'click', 'error')) AS r, count(*) FILTER (event_type IN ('signup', 'purchase')) AS w, count(*) FILTER (event_type = 'error') AS in_flight
  FROM events JOIN nation ON n_nationkey = user_id % 25 GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY day) - 1 AS day_no FROM days),
snapshots AS (SELECT node_id, epoch_ms(CAST(day AS TIMESTAMP)) AS taken_at_ms, in_flight, sum(r) OVER e AS reads_total, sum(w) OVER e AS writes_total FROM numbered WINDOW e AS (PARTITION BY node_id, day_no // 10 ORDER BY day)),
steps AS (SELECT *, lag(taken_at_ms) OVER n AS before_ms, lag(reads_total) OVER n AS r0, lag(writes_total) OVER n AS w0 FROM snapshots WINDOW n AS (PARTITION BY node_id ORDER BY taken_at_ms)),
outcomes AS (SELECT *, (taken_at_ms - before_ms) / 3600000::DOUBLE AS seconds, CASE WHEN before_ms IS NULL THEN 'baseline' WHEN reads_total < r0 OR writes_total < w0 OR taken_at_ms <= before_ms THEN 'skipped' ELSE 'sampled' END AS outcome FROM steps)
"""
_HOUR = 3_600_000


@query(_SNAPSHOTS + "SELECT node_id, taken_at_ms, CAST(reads_total - r0 AS DOUBLE) / seconds AS reads_per_second, CAST(writes_total - w0 AS DOUBLE) / seconds AS writes_per_second, CAST(reads_total - r0 AS DOUBLE) / seconds + CAST(writes_total - w0 AS DOUBLE) / seconds AS operations_per_second, CAST(round(least(in_flight / 8::DOUBLE, 1::DOUBLE) * 10000) AS BIGINT) AS queue_depth FROM outcomes WHERE outcome = 'sampled'")
def counter_rates(spark, sf_dir):
    return rates.counter_rates(T.counter_snapshots(spark, sf_dir), _HOUR)


@query(_SNAPSHOTS + "SELECT node_id, outcome, count(*) AS intervals FROM outcomes GROUP BY node_id, outcome")
def poll_outcomes(spark, sf_dir):
    return rates.intervals(T.counter_snapshots(spark, sf_dir), _HOUR).groupBy("node_id", "outcome").agg(F.count("*").alias("intervals"))


@query(_SNAPSHOTS + "SELECT node_id, taken_at_ms FROM outcomes WHERE outcome = 'skipped'")
def restart_dropped_intervals(spark, sf_dir):
    return rates.intervals(T.counter_snapshots(spark, sf_dir), _HOUR).filter("outcome = 'skipped'").select("node_id", "taken_at_ms")


_HALF = "SELECT CAST(user_id % 12 AS INTEGER) AS x, CAST(user_id % 13 AS INTEGER) AS y, 0 AS z, 0 AS q, count(*) FILTER (event_type IN ('view', 'click', 'error')) AS reads, count(*) FILTER (event_type IN ('signup', 'purchase')) AS writes, sum(length(props)) AS bytes_read, sum(length(event_type)) AS bytes_written FROM events WHERE {} GROUP BY 1, 2"


def _counts(events):
    return events.groupBy((F.col("user_id") % 12).cast("int").alias("x"), (F.col("user_id") % 13).cast("int").alias("y")).agg(F.count_if(F.col("event_type").isin(T.READS)).alias("reads"), F.count_if(F.col("event_type").isin(T.WRITES)).alias("writes"), F.sum(F.length("props")).cast("bigint").alias("bytes_read"), F.sum(F.length("event_type")).cast("bigint").alias("bytes_written")).withColumns({"z": F.lit(0), "q": F.lit(0)})


@query(f"WITH a AS ({_HALF.format('ts <= (SELECT max(ts) - INTERVAL 15 DAY FROM events)')}), b AS ({_HALF.format('true')}) SELECT b.x, b.y, b.z, b.q, " + ", ".join(f"CAST(greatest(b.{c} - coalesce(a.{c}, 0), 0) AS DOUBLE) / 15::DOUBLE AS {c}_per_second" for c in ("reads", "writes", "bytes_read", "bytes_written")) + " FROM b LEFT JOIN a USING (x, y, z, q)")
def cell_breakdown_rates(spark, sf_dir):
    """Cumulative counts now and fifteen days before; a day stands for a second."""
    events = T.table(spark, sf_dir, "events")
    last = events.agg((F.max("ts") - F.expr("interval 15 days")).alias("before"))
    return rates.cell_rates(_counts(events.join(last, F.col("ts") <= F.col("before"))), _counts(events), 15.0)


_BEATS = """WITH beats AS (SELECT event_id AS seq, n_name AS node_id, epoch_us(ts) // 1000 AS timestamp_ms, event_type <> 'error' AS healthy FROM events JOIN nation ON n_nationkey = user_id % 25),
registered AS (SELECT n_name AS node_id, CAST(n_nationkey * 400 AS BIGINT) AS seq FROM nation WHERE n_nationkey < 20),
clock AS (SELECT max(timestamp_ms) AS now_ms FROM beats)
"""


def _beats(spark, sf_dir):
    nodes = T.regions(spark, sf_dir)
    beats = T.table(spark, sf_dir, "events").join(F.broadcast(nodes), F.col("user_id") % 25 == F.col("shard_id")).select(F.col("event_id").alias("seq"), "node_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), (F.col("event_type") != "error").alias("healthy"))
    return beats, nodes.filter("shard_id < 20").select("node_id", (F.col("shard_id") * 400).alias("seq"))


@query(_BEATS + """SELECT r.node_id, count(b.seq) AS beats, (SELECT now_ms FROM clock) - max(b.timestamp_ms) AS silence_ms,
CASE WHEN count(b.seq) = 0 OR (SELECT now_ms FROM clock) - max(b.timestamp_ms) > 3600000 THEN 'unreachable' WHEN NOT arg_max(b.healthy, b.seq) THEN 'degraded' ELSE 'healthy' END AS health
FROM registered r LEFT JOIN beats b ON b.node_id = r.node_id AND b.seq > r.seq GROUP BY r.node_id""")
def node_liveness(spark, sf_dir):
    beats, registered = _beats(spark, sf_dir)
    return fold.liveness(registered, beats, deadline_ms=3_600_000)


@query(_BEATS + "SELECT b.seq, b.node_id, b.timestamp_ms FROM beats b LEFT JOIN registered r USING (node_id) WHERE r.seq IS NULL OR b.seq < r.seq")
def unregistered_heartbeats(spark, sf_dir):
    beats, registered = _beats(spark, sf_dir)
    return fold.unregistered(registered, beats)


@query("SELECT DISTINCT x, y FROM (SELECT CAST(user_id % 14 AS INTEGER) AS x, CAST(event_id % 15 AS INTEGER) AS y FROM events UNION ALL SELECT CAST(user_id % 13 AS INTEGER), CAST(event_id % 11 AS INTEGER) FROM events) WHERE NOT (x BETWEEN 0 AND 11 AND y BETWEEN 0 AND 12)")
def invalid_coordinates(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    at = lambda x, y: e.select((F.col("user_id") % x).cast("int").alias("x"), (F.col("event_id") % y).cast("int").alias("y"))
    return profile.off_grid(at(14, 15), at(13, 11))


@query("SELECT CAST(i AS BIGINT) AS at_ms, 0.6::DOUBLE + (1::DOUBLE - abs(CAST((i + 77000) % 600000 AS DOUBLE) * 2::DOUBLE / 600000::DOUBLE - 1::DOUBLE)) * 0.8::DOUBLE AS wave FROM range(0, 1200000, 5000) t(i)")
def diurnal_wave(spark, sf_dir):
    return spark.range(0, 1_200_000, 5000).select(F.col("id").alias("at_ms"), simulation.diurnal(F.col("id"), 600_000, F.lit(77_000)).alias("wave"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', {b}::DOUBLE, {r}::DOUBLE, {x}::DOUBLE, {y}::DOUBLE, {n}::BIGINT)" for c, b, r, x, y, n in simulation.CLASSES) + ") t(class, base_ops, read_ratio, read_latency_us, write_latency_us, bytes_per_op)")
def workload_classes(spark, sf_dir):
    return simulation.classes(spark)


@query()
def sim_jitter(spark, sf_dir):
    """Draws of the generator's own load stream, by number."""
    return spark.range(1000).select(F.col("id").alias("n"), (F.lit(0.95) + simulation.draw_unit(generator.jitter_seed(20260904), F.col("id")) * (1.05 - 0.95)).alias("jitter"))


@query()
def sim_observations(spark, sf_dir):
    """Sixty ticks of a fleet with a hot cell and a lost node."""
    spec = generator.Spec(hot={(1, 0): (6.0, 10_000, 40_000)})
    faults = spark.createDataFrame([("us-west-db-1", 20_000, False, True), ("us-west-db-1", 45_000, True, True)], "node_id string, at_ms bigint, online boolean, reachable boolean")
    return generator.observations(spark, spec, 60, faults)


@query("SELECT n_name AS node_id, count(event_id) FILTER (event_type <> 'error') AS beats, coalesce(bool_or(event_type = 'click'), false) AS ever_serving FROM nation LEFT JOIN events ON user_id % 25 = n_nationkey GROUP BY n_name")
def probe_heartbeats(spark, sf_dir):
    """Events as liveness probes: errors reach nobody, clicks find a serving node, all others one that answers."""
    kind = F.col("event_type")
    found = F.when(kind == "error", "unreachable").when(kind == "click", "serving").otherwise("answering")
    e = T.table(spark, sf_dir, "events").select((F.col("user_id") % 25).alias("shard_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), found.alias("outcome"))
    nodes = T.regions(spark, sf_dir).select("shard_id", "node_id")
    beats = fold.probe_heartbeats(e.join(nodes, "shard_id")).groupBy("node_id").agg(F.count("*").alias("beats"), F.bool_or("healthy").alias("ever_serving"))
    return nodes.select("node_id").join(beats, "node_id", "left").select("node_id", F.coalesce("beats", F.lit(0)).alias("beats"), F.coalesce("ever_serving", F.lit(False)).alias("ever_serving"))


@query("WITH r AS (SELECT user_id % 25 AS shard_id, event_id, row_number() OVER (PARTITION BY user_id % 25 ORDER BY event_id DESC) AS back, count(*) OVER (PARTITION BY user_id % 25) AS n FROM events) SELECT shard_id, event_id FROM r WHERE back <= CASE WHEN n <= 64 THEN n ELSE 32 + (n - 64 - 1) % 32 + 1 END")
def recent_observations(spark, sf_dir):
    """What a bounded memory of 64 observations that drops its older half when full still holds, by shard."""
    e = T.table(spark, sf_dir, "events").select((F.col("user_id") % 25).alias("shard_id"), F.col("event_id").alias("seq"))
    return profile.recent(e, ["shard_id"], 64).withColumnRenamed("seq", "event_id")


@query("""SELECT event_id, CASE WHEN event_id % 5 > 0 THEN value END AS cpu_utilization, event_id % 7 = 0 AS partial, CASE WHEN event_id % 3 = 0 THEN event_id END AS retry_after_s, event_id % 4 < 2 AS has_credential,
CASE WHEN event_id % 2 = 0 THEN event_id END AS as_integer, CASE WHEN event_id % 2 = 1 THEN value END AS as_double FROM events""")
def wire_fields(spark, sf_dir):
    """Of each event as a reply of the wire: a closed window's figures, partial attribution, the wait asked for, credentials, typed values."""
    i = F.col("event_id")
    rows = T.table(spark, sf_dir, "events").select(
        "event_id", "value", F.when(i % 5 > 0, 60_000).otherwise(0).alias("duration_ms"), F.when(i % 7 == 0, 3).otherwise(0).alias("overflow"),
        F.when(i % 3 == 0, F.concat(F.lit(" "), i, F.lit("\t"))).when(i % 3 == 1, F.concat(F.lit("-"), i)).otherwise("Wed, 21 Oct").alias("retry_after"),
        F.when(i % 4 == 0, F.array(F.lit("X-Api-Key"), F.lit("accept"))).otherwise(F.array(F.lit("accept"))).alias("headers"),
        F.when(i % 4 == 1, "a=1&key=s").when(i % 4 == 2, "key=&a=key").otherwise("keys=1").alias("query"),
        F.when(i % 2 == 0, "integer").otherwise("double").alias("tag"),
    )
    return rows.select(
        "event_id", wire.of_window("duration_ms", "value").alias("cpu_utilization"), wire.partial("overflow").alias("partial"), wire.retry_after("retry_after").alias("retry_after_s"), wire.has_credential("headers", "query").alias("has_credential"),
        wire.typed("tag", "integer", i).alias("as_integer"), wire.typed("tag", "double", F.col("value")).alias("as_double"),
    )
