import json

import pytest
from pyspark.sql import functions as F

from gridloom.functions import scoring as S
from gridloom.functions import simulation
from gridloom.operators import control, diffsync, migration, profile, rates, replication, requests, routing, store
from gridloom.sources.session import encode, messages, read_session
from gridloom.streaming import fold

LOAD = "cpu_utilization double, memory_utilization double, queue_depth bigint, read_latency_us double, write_latency_us double, reads double, writes double"


@pytest.mark.parametrize(
    ("load", "pressure", "level", "probability", "anomaly"),
    [
        ((0.95, 0.95, 10000, 100000.0, 5000.0, 9.0, 1.0), 0.9725, "critical", 0.977625, 0.625),
        ((0.10, 0.15, 4, 500.0, 500.0, 1.0, 1.0), 0.0661, "normal", 0.054575, 0.0),
    ],
)
def test_golden_scores(spark, load, pressure, level, probability, anomaly):
    r = profile.with_prediction(profile.with_profile(spark.createDataFrame([load], LOAD))).first()
    assert r["level"] == level
    for name, value in (("pressure", pressure), ("probability", probability), ("anomaly", anomaly)):
        assert r[name] == pytest.approx(value, abs=1e-9)


def test_ratio_of_nothing_is_zero(spark):
    r = profile.with_profile(spark.createDataFrame([(0.0, 0.0, 0, 0.0, 0.0, 0.0, 0.0)], LOAD)).first()
    assert (r["read_ratio"], r["write_ratio"], r["level"]) == (0.0, 0.0, "normal")


def test_cpu_and_queue(spark):
    r = spark.range(1).select(S.cpu_utilization(F.lit(1.0), F.lit(2.0), F.lit(2), F.lit(1.0)).alias("a"), S.cpu_utilization(F.lit(None).cast("double"), F.lit(2.0), F.lit(2), F.lit(1.0)).alias("b"), S.queue_units(F.lit(512), F.lit(512)).alias("c"), S.queue_units(F.lit(1), F.lit(0)).alias("d")).first()
    assert tuple(r) == (0.5, 0.0, 10_000, 0)


def test_rates_and_restart(spark):
    rows = [("a", 0, 100, 10, 1, 8), ("a", 2000, 300, 30, 1, 8), ("a", 4000, 5, 1, 1, 8), ("a", 4000, 6, 1, 1, 8)]
    df = spark.createDataFrame(rows, "node_id string, taken_at_ms bigint, reads_total bigint, writes_total bigint, in_flight bigint, max_concurrent bigint")
    got = rates.counter_rates(df).collect()
    assert [(r["reads_per_second"], r["writes_per_second"], r["operations_per_second"]) for r in got] == [(100.0, 10.0, 110.0)]


def test_draws():
    assert [simulation.word(42, n) for n in range(5)] == [2949826092126892291, 5139283748462763858, 6349198060258255764, 701532786141963250, 16015981125662989062]


def test_jitter(spark):
    from gridloom.plans.catalog import QUERIES

    got = [r["jitter"] for r in QUERIES["sim_jitter"](spark, "").orderBy("n").limit(3).collect()]
    assert got == [1.0357235928410111, 1.0375933384002458, 0.9876670311150835]


def test_simulation_is_the_same_in_any_partitioning(spark):
    from gridloom.plans.catalog import QUERIES

    a = {tuple(r) for r in QUERIES["sim_observations"](spark, "").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        b = {tuple(r) for r in QUERIES["sim_observations"](spark, "").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(a) == len(b) and {r[:6] for r in a} == {r[:6] for r in b}


SESSION = '[{"RegisterNode": {"protocol": "p", "node_id": "a", "software_version": "1", "region": "r"}}, {"Heartbeat": {"node_id": "a", "timestamp_ms": 5, "healthy": true}}]'


def test_session(spark, tmp_path):
    (tmp_path / "s.json").write_text(SESSION)
    rows = read_session(spark, str(tmp_path / "s.json"))
    got = rows.orderBy("seq").collect()
    assert [r["seq"] for r in got] == [0, 1] and got[1]["Heartbeat"]["timestamp_ms"] == 5 and got[1]["RegisterNode"] is None
    assert encode(rows).count() == 2 and read_session(spark, None).count() == 0


@pytest.mark.parametrize("text", ["{ not valid json ", '[{"Nonsense": {"node_id": "x"}}]', '[{"Heartbeat": {}, "Workload": {}}]'])
def test_bad_sessions_fail(spark, text):
    with pytest.raises(Exception):  # noqa: B017
        messages(spark.createDataFrame([(text,)], "value string")).collect()


def test_empty_session(spark):
    assert messages(spark.createDataFrame([("[]",)], "value string")).count() == 0


def test_migration_goldens():
    m = migration.Migration(4)
    assert m.apply("catch_up", None) == "wrong_phase"
    assert m.apply("write", 0) is None and m.pending() == 1
    assert m.apply("write", 0) == "non_monotonic_write"
    assert m.apply("begin_copy", None) is None and m.apply("copied", 5) == "progress_exceeds_total" and m.apply("catch_up", None) == "copy_incomplete"
    assert m.apply("copied", 4) is None and m.apply("catch_up", None) is None and m.apply("write", 70) is None
    assert m.apply("begin_cutover", None) == "not_caught_up" and m.apply("applied", 69) is None and m.apply("begin_cutover", None) is None
    assert m.apply("write", 71) == "write_fenced" and m.apply("complete_cutover", None) == "cutover_not_drained"
    assert m.apply("applied", 70) is None and m.apply("complete_cutover", None) is None
    assert m.apply("write", 70) == "write_already_applied" and m.apply("abort", None) == "abort_after_cutover" and m.apply("complete", None) is None
    assert m.apply("fail", None) == "already_terminal"


REPLICA = "shard_id bigint, node_id string, region string, role string, state string, pending_writes bigint, apply_lag_ms bigint, last_report_ms bigint"


def test_placement_spreads_regions(spark):
    held = spark.createDataFrame([(1, "db-a", "phoenix", "primary", "in_sync", 0, 0, 0)], REPLICA)
    fleet = spark.createDataFrame([("db-a", "phoenix", True, 0), ("db-b", "phoenix", True, 0), ("db-c", "dallas", True, 5)], "node_id string, region string, serviceable boolean, hosted int")
    assert replication.placement_plan(held, fleet, 3).first()["additions"] == ["db-c", "db-b"]
    two = spark.createDataFrame([("db-b", "dallas", True, 0), ("db-c", "dallas", True, 0)], "node_id string, region string, serviceable boolean, hosted int")
    r = replication.placement_plan(held, two, 3, "require_distinct_regions").first()
    assert (r["additions"], r["shortfall"]) == (["db-b"], 1)
    with pytest.raises(ValueError):
        replication.placement_plan(held, two.union(two), 3)


def test_reports_fold(spark):
    held = spark.createDataFrame([(1, "a", "r", "secondary", "in_sync", 0, 0, None), (1, "b", "r", "secondary", "in_sync", 0, 0, None)], REPLICA)
    told = [(1, "a", 1, 100, 2000, 0, True), (1, "a", 2, 50, 0, 0, True), (1, "b", 1, 0, 0, 0, False), (1, "b", 2, 30_000, 0, 0, False)]
    reports = spark.createDataFrame(told, "shard_id bigint, node_id string, seq bigint, timestamp_ms bigint, pending_writes bigint, apply_lag_ms bigint, reachable boolean")
    got = {r["node_id"]: (r["state"], r["ignored"]) for r in replication.fold_reports(held, reports).collect()}
    assert got == {"a": ("lagging", 1), "b": ("failed", 0)}


def test_admission_counts_what_it_admits(spark):
    rows = [(1, i, 7, i, 0, "n1" if i < 3 else f"m{i}", f"t{i}", None) for i in range(12)]
    df = spark.createDataFrame(rows, "controller_id bigint, seq bigint, shard_id bigint, x int, y int, source_node string, target_node string, refusal string")
    got = [r["refusal"] for r in control.admit(df).orderBy("seq").collect()]
    assert got[:4] == [None, None, "node_overloaded", None] and got.count(None) == 8 and got[-1] == "too_many_in_flight"


def test_transactions_leave_nothing_when_refused(spark):
    ops = [("s", 1, 0, "create", "a", None, '{"v": 1}'), ("s", 2, 0, "insert_node", "b", None, "{}"), ("s", 2, 1, "create", "a", None, "{}"), ("s", 3, 0, "create", "b", None, "{}"), ("s", 4, 0, "set_if", "a", '{"v": 1}', '{"w": 2}'), ("s", 5, 0, "set_if", "a", '{"v": 1}', "{}"), ("s", 6, 0, "delete_node", "zz", None, None)]
    df = spark.createDataFrame(ops, "scope string, tx_id bigint, position int, type string, address string, expect_eq string, set string")
    assert [r["status"] for r in store.transactions(df).orderBy("tx_id").collect()] == [200, 412, 200, 200, 412, 412]


def test_cursor_walk(spark):
    df = spark.range(25).select(F.concat(F.lit("n"), "id").alias("address"), (F.col("id") % 4).alias("v"))
    pages = list(store.walk(df, "v", limit=10))
    assert [len(p) for p in pages] == [10, 10, 5] and len({r["address"] for p in pages for r in p}) == 25
    with pytest.raises(RuntimeError):
        list(store.walk(df, "v", limit=5, most=2))
    with pytest.raises(ValueError):
        store.where({"op": "~", "left": "v", "right": 1}, F.col)


def test_percent_decoding(spark):
    r = spark.range(1).select(requests.segments(F.lit("//node/a%20b+c/%zz/")).alias("s"), requests.query_value(F.lit("x=1&kind=a+b%21"), "kind").alias("k")).first()
    assert r["s"] == ["node", "a b+c", None] and r["k"] == "a b!"


def test_verify_reports_the_count_first(spark):
    a = spark.createDataFrame([("x", "k", "d", "o"), ("y", "k", "d", "o")], "address string, kind string, data string, owner string")
    assert diffsync.verify(a, a.filter("address = 'x'")).first()["reason"] == "count"
    assert diffsync.verify(a, a.withColumn("data", F.lit("z"))).first()["reason"] == "data:x"
    assert diffsync.verify(a, a).first()["reason"] is None


def test_set_if_merges_and_knows_three_expectations(spark):
    nodes = spark.createDataFrame([("n", '{"rev": 1, "kept": "x"}')], "address string, data string")
    asked = [("n", 1, "rev", None, "1", None, '{"rev": 2}'), ("n", 2, "rev", None, "1", None, '{"rev": 9}'), ("n", 3, "rev", 2.0, None, None, '{"lease": 5}'), ("n", 4, "lease", 4.0, None, None, "{}"), ("n", 5, "kept", 9.0, None, None, "{}"), ("n", 6, "new", None, None, True, '{"new": null}'), ("n", 7, "new", None, None, True, '{"new": 1}'), ("m", 1, "a", None, None, True, '{"a": 1}')]
    rows = spark.createDataFrame(asked, "address string, seq bigint, field string, expect_le double, expect_eq string, expect_absent boolean, set string")
    got = store.set_if(nodes, rows).orderBy("address", "seq").collect()
    assert [r["applied"] for r in got] == [True, True, False, True, False, False, True, True]
    assert json.loads(got[-1]["data"]) == {"rev": 2, "kept": "x", "lease": 5, "new": 1}


def test_transactions_leave_all_or_nothing(spark):
    ops = [(1, 0, "create", "A:1", None), (1, 1, "insert_node", "B:1", None), (1, 2, "insert_edge", "A:1", "B:1"), (2, 0, "clear_kind", "B", None), (2, 1, "delete_edge", "A:1", "C:1"), (3, 0, "delete_node", "B:1", None), (4, 0, "insert_edge", "A:1", "B:1"), (5, 0, "clear_kind", "A", None), (6, 0, "create", "A:1", None)]
    df = spark.createDataFrame([("s", t, p, k, a, b, None, "{}") for t, p, k, a, b in ops], "scope string, tx_id bigint, position int, type string, address string, to string, expect_eq string, set string")
    got = [(r["status"], r["changed"]) for r in store.transactions(df).orderBy("tx_id").collect()]
    assert got == [(200, 3), (412, 0), (200, 1), (412, 0), (200, 1), (200, 1)]


def test_replica_operations(spark):
    script = [("add", "a"), ("add", "a"), ("begin_seed", "a"), ("add", "b"), ("promote", "b"), ("mark_in_sync", "b"), ("begin_seed", "b"), ("mark_in_sync", "b"), ("promote", "b"), ("remove", "b"), ("remove", "a"), ("mark_failed", "z")]
    df = spark.createDataFrame([(1, i, op, n) for i, (op, n) in enumerate(script)], "shard_id bigint, seq bigint, op string, node string")
    got = replication.fold_operations(df).orderBy("seq").collect()
    assert [r["refusal"] for r in got] == [None, "duplicate_replica", "primary_cannot_seed", None, "not_in_sync", "illegal_transition", None, None, None, "primary_not_removable", None, "unknown_replica"]
    assert got[-1]["replicas"] == "b=primary:in_sync"


def test_active_actions_count_against_decisions(spark):
    kind = "controller_id bigint, seq bigint, shard_id bigint, x int, y int, source_node string, target_node string, refusal string"
    rows = spark.createDataFrame([(1, 1, 1, 0, 0, "a", "b", None), (1, 2, 1, 1, 0, "a", "c", None), (1, 3, 1, 2, 0, "d", None, "stale")], kind)
    active = spark.createDataFrame([(1, 0, 1, 0, 0, "a", "z", None)], kind)
    assert [r["refusal"] for r in control.admit(rows, active).orderBy("seq").collect()] == ["conflicting_action", None, "stale"]


def test_destination_counts_in_its_own_region(spark):
    entries = spark.createDataFrame([(1, "a", "east"), (2, "q", "east")], "shard_id bigint, owner string, region string")
    replicas = spark.createDataFrame([(1, "a", "east", "primary", "in_sync"), (1, "b", "west", "secondary", "in_sync"), (2, "q", "east", "primary", "failed")], "shard_id bigint, node_id string, region string, role string, state string")
    moves = spark.createDataFrame([(1, "a", "d", True)], "shard_id bigint, source string, destination string, has_cut_over boolean")
    nodes = spark.createDataFrame([("a", "east"), ("b", "west"), ("d", "west"), ("q", "east")], "node_id string, region string")
    got = routing.read_candidates(entries, replicas, moves, "prefer_region", "west", nodes).orderBy("shard_id", "rank").collect()
    assert [(r["shard_id"], r["node_id"], r["error"]) for r in got] == [(1, "d", None), (1, "b", None), (2, None, "no_readable_replica")]


def test_a_feed_that_ends_fails_the_union(spark):
    feed = lambda *rows: spark.createDataFrame(rows, "seq bigint, address string, ended boolean")
    assert fold.fan_in([feed((1, "a", False)), feed((2, "b", False))]).count() == 2
    with pytest.raises(Exception, match="has ended"):
        fold.fan_in([feed((1, "a", False)), feed((2, "b", True))]).collect()
