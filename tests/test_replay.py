import json

from pyspark.sql import functions as F

from gridloom.operators import fleet, replay
from gridloom.sources import placements, session, views
from gridloom.streaming import fold


def sample(x, y, ops, reads, cpu, memory, queue, latency):
    return {"coordinate": {"x": x, "y": y}, "operations_per_second": ops, "read_ratio": reads, "write_ratio": 1 - reads, "read_latency_us": latency, "write_latency_us": latency / 2, "cpu_utilization": cpu, "memory_utilization": memory, "queue_depth": queue}


MESSAGES = [
    {"RegisterNode": {"protocol": "1", "node_id": "node-a", "software_version": "1", "region": "west"}},
    {"RegisterNode": {"protocol": "1", "node_id": "node-b", "software_version": "1", "region": "east"}},
    {"Topology": {"node_id": "node-a", "timestamp_ms": 900, "placements": [{"coordinate": {"x": 2, "y": 3}, "dbms_id": "node-a", "region": "west"}, {"coordinate": {"x": 5, "y": 5}, "dbms_id": "node-b", "region": "east"}]}},
    {"Heartbeat": {"node_id": "node-a", "timestamp_ms": 1500, "healthy": True}},
    {"Telemetry": {"timestamp_ms": 2000, "node_id": "node-a", "shard": {"id": 7, "workload_domain": "d"}, "samples": [sample(2, 3, 1000.0, 0.9, 0.95, 0.95, 10000, 100000.0), sample(5, 5, 10.0, 0.5, 0.1, 0.15, 4, 500.0)]}},
    {"Workload": {"node_id": "node-b", "coordinate": {"x": 13, "y": 0}, "timestamp_ms": 100, "operations_per_second": 8.0, "read_ratio": 0.25, "write_ratio": 0.75}},
]


def rows(spark):
    return session.messages(spark.createDataFrame([(json.dumps(MESSAGES),)], "value string"))


def test_replay(spark):
    m = rows(spark)
    s = replay.status(m).first()
    assert (s["clock_ms"], s["placements"], s["profiles"], s["observations"], s["hot"]) == (2000, 2, 3, 3, 1)
    assert {r["shard_id"] for r in replay.placements(m).collect()} == {38, 65}
    # The telemetry's shard isn't the placements' one, so the hot cell can't be located and nothing can be done.
    found = fleet.decisions(replay.profiles(m), replay.placements(m), fleet.fleet_from_placements(replay.placements(m))).filter("shard_id = 7").orderBy("x").collect()
    assert [(r["action"], r["estimated_cost"], round(r["confidence"], 6)) for r in found] == [("no_action", 1.0, 0.0), ("no_action", 0.0, 0.945425)]
    light = replay.profiles(m).filter("shard_id = 0").first()
    assert (light["reads"], light["writes"], light["cpu_utilization"]) == (2.0, 6.0, 0.0)
    health = {r["node_id"]: (r["health"], r["beats"], r["silence_ms"]) for r in fold.liveness(replay.registrations(m), replay.heartbeats(m), 2000).collect()}
    assert health == {"node-a": ("healthy", 1, 500), "node-b": ("unreachable", 0, None)}
    assert [(r["x"], r["y"]) for r in replay.validate(m).collect()] == [(13, 0)]


def test_views(spark, tmp_path):
    m = rows(spark)
    text = views.render_text(replay.profiles(m), "workload")
    assert text.splitlines()[0].split()[:3] == ["shard_id", "x", "y"] and len(text.splitlines()) == 4
    assert views.render_text(replay.profiles(m).limit(0), "predict") == "no predictions\n"
    views.render_json(replay.profiles(m), "metrics", str(tmp_path / "v"))
    assert spark.read.json(str(tmp_path / "v")).count() == 3


def test_placement_records(spark, tmp_path):
    path = str(tmp_path / "records")
    schema = "seq bigint, shard_id bigint, x int, y int, node_id string, region string, expect bigint, delete boolean"
    ask = lambda *rows: {r["seq"]: r["refusal"] for r in placements.write(spark, path, spark.createDataFrame(list(rows), schema)).collect()}
    assert ask((1, 1, 0, 0, "a", "r", None, False), (2, 1, 0, 0, "b", "r", None, False)) == {1: None, 2: "version"}
    assert ask((3, 1, 0, 0, "b", "r", None, False), (4, 1, 0, 0, "b", "r", 1, False)) == {3: "exists", 4: None}
    assert ask((5, 1, 0, 0, "c", "r", 1, False)) == {5: "version"}
    assert ask((6, 1, 0, 0, "c", "r", 2, True)) == {6: None}
    r = placements.load(spark, path).first()
    assert (r["version"], r["deleted"], r["node_id"]) == (3, True, None)
    assert ask((7, 1, 0, 0, "d", "r", None, False)) == {7: None}
    assert placements.load(spark, path).select(placements.address(F.col("shard_id"), F.col("x"), F.col("y")).alias("a")).first()["a"] == "gridloom_placement:1:0:0"
    # Two writers decide against the same state: only one gets the number, the other decides again.
    number, _ = placements._commits(spark, path)
    assert placements._commit(spark, path, number + 1, "none", "log") is True and placements._commit(spark, path, number + 1, "other", "log") is False


def test_placement_records_compacted(spark, tmp_path):
    path = str(tmp_path / "records")
    schema = "seq bigint, shard_id bigint, x int, y int, node_id string, region string, expect bigint, delete boolean"
    for k in range(3):
        placements.write(spark, path, spark.createDataFrame([(k, 1, 0, 0, f"n{k}", "r", k or None, False)], schema))
    assert placements.compact(spark, path) and len(placements._commits(spark, path)[1]) == 1
    r = placements.load(spark, path).first()
    assert (r["version"], r["node_id"]) == (3, "n2")
    assert [x["refusal"] for x in placements.write(spark, path, spark.createDataFrame([(9, 1, 0, 0, "z", "r", 3, False)], schema)).collect()] == [None]
    assert placements.load(spark, path).first()["version"] == 4


def test_a_text_view_says_what_it_leaves_out(spark):
    text = views.render_text(replay.profiles(rows(spark)), "workload", most=1)
    assert len(text.splitlines()) == 3 and text.splitlines()[-1] == "... and 2 more"
