import json

from pyspark.sql import functions as F

from gridloom.operators.profile import latest
from gridloom.streaming import fold


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [{"seq": i, "shard_id": i % 2, "x": i % 3, "y": 0, "reads": float(i), "timestamp_ms": 1000 - i} for i in range(20)]
    for k in range(4):
        (folder / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows[k * 5 : k * 5 + 5]))
    schema = "seq bigint, shard_id int, x int, y int, reads double, timestamp_ms bigint"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    q = fold.latest_samples(stream, ["shard_id", "x", "y"]).writeStream.outputMode("complete").format("memory").queryName("latest_cells").trigger(availableNow=True).start()
    q.awaitTermination(60)
    batch = latest(spark.read.schema(schema).json(str(folder)), ["shard_id", "x", "y"])
    assert {tuple(r) for r in spark.table("latest_cells").collect()} == {tuple(r) for r in batch.collect()}
    assert fold.clock(spark.read.schema(schema).json(str(folder))).first()[0] == 1000


def test_changes_are_handed_on_once_a_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    frames = [(1, "node_updated", '{"address": "a"}'), (2, "node_updated", '{"address": "a"}'), (3, "transaction_committed", '{"addresses": ["b", "a"]}'), (4, "edge_created", '{"address": "c"}')]
    (folder / "0.json").write_text("\n".join(json.dumps(dict(zip(("seq", "event", "data"), f))) for f in frames))
    stream = spark.readStream.schema("seq bigint, event string, data string").json(str(folder))
    seen = []
    q = fold.follow_changes(stream, lambda df, n: seen.append(sorted(r[0] for r in df.collect())), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert seen == [["a", "b"]]


def test_liveness(spark):
    registered = spark.createDataFrame([("a", 1), ("b", 1), ("c", 9)], "node_id string, seq bigint")
    beats = spark.createDataFrame([(2, "a", 100, True), (3, "b", 90, False), (4, "c", 90, True), (5, "d", 100, True)], "seq bigint, node_id string, timestamp_ms bigint, healthy boolean")
    got = {r["node_id"]: r["health"] for r in fold.liveness(registered, beats, 100, 30).collect()}
    assert got == {"a": "healthy", "b": "degraded", "c": "unreachable"}
    assert {r["node_id"] for r in fold.unregistered(registered, beats).collect()} == {"c", "d"}
    assert fold.clock(beats.select(F.col("timestamp_ms"))).first()[0] == 100
