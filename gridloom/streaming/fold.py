"""Streaming telemetry: the monotone clock, latest samples, liveness and change feeds.

State is kept by Spark: keyed aggregations for what is a maximum or a last arrival, and
`foreachBatch` for the control cycle. A source that fails or ends unexpectedly fails the
query, as everything downstream depends on it.
"""

from __future__ import annotations

from collections.abc import Callable

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diffsync
from ..operators.profile import with_prediction, with_profile


def read_messages(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Messages as JSON lines that arrive as files."""
    return spark.readStream.schema(schema).json(folder)


def clock(messages: DataFrame) -> DataFrame:
    """One row: the latest message time; a late message never turns it back."""
    return messages.agg(F.max("timestamp_ms").alias("clock_ms"))


def latest_samples(samples: DataFrame, keys: list[str]) -> DataFrame:
    """The last row to arrive (by seq) for each key; late ones still replace earlier arrivals."""
    rest = [c for c in samples.columns if c not in keys]
    return samples.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("row")).select(*keys, "row.*")


def live_predictions(samples: DataFrame) -> DataFrame:
    """Scored latest samples of every cell."""
    return with_prediction(with_profile(latest_samples(samples, ["shard_id", "x", "y"])))


def liveness(registered: DataFrame, heartbeats: DataFrame, clock_ms: int | None = None, deadline_ms: int = 30_000) -> DataFrame:
    """node_id, beats, silence_ms, health of registered nodes.

    Never heard since registration, or silent beyond the deadline: unreachable; last beat unhealthy: degraded. A node
    that registers anew must prove itself again. Beats of unregistered nodes create nothing. Without a clock the newest beat's time is it.
    """
    own = registered.groupBy("node_id").agg(F.max("seq").alias("registered_seq"))
    heard = heartbeats.join(own, "node_id").filter("seq > registered_seq").groupBy("node_id").agg(F.count("*").alias("beats"), F.max("timestamp_ms").alias("last_ms"), F.max_by("healthy", "seq").alias("healthy"))
    now = heartbeats.agg(F.max("timestamp_ms").alias("now_ms")) if clock_ms is None else None
    silence = (F.col("now_ms") if now is not None else F.lit(clock_ms)) - F.col("last_ms")
    health = F.when(F.col("last_ms").isNull() | (silence > deadline_ms), "unreachable").when(~F.col("healthy"), "degraded").otherwise("healthy")
    rows = own.join(heard, "node_id", "left")
    rows = rows if now is None else rows.join(now)
    return rows.select("node_id", F.coalesce("beats", F.lit(0)).alias("beats"), silence.alias("silence_ms"), health.alias("health"))


def unregistered(registered: DataFrame, heartbeats: DataFrame) -> DataFrame:
    """Heartbeats that came before any registration of their node."""
    first = registered.groupBy("node_id").agg(F.min("seq").alias("first_seq"))
    return heartbeats.join(first, "node_id", "left").filter("first_seq is null or seq < first_seq").select("seq", "node_id", "timestamp_ms")


def follow_changes(frames: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands each batch's dirty addresses, each once, to `apply`; a failure leaves the batch to be done again."""

    def batch(df: DataFrame, number: int) -> None:
        apply(diffsync.changed_addresses(df).select("address").distinct(), number)

    return frames.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def control_loop(samples: DataFrame, cycle: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query in which one micro-batch is one control cycle over the scored samples that arrived."""

    def batch(df: DataFrame, number: int) -> None:
        cycle(live_predictions(df), number)

    return samples.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def probe_heartbeats(probes: DataFrame) -> DataFrame:
    """Heartbeats of liveness probes (outcome serving, answering or unreachable): a node that wasn't reached files none."""
    return probes.filter(F.col("outcome").isin("serving", "answering")).select("node_id", "timestamp_ms", (F.col("outcome") == "serving").alias("healthy"))


def fan_in(feeds: list[DataFrame]) -> DataFrame:
    """Change frames of several feeds as one. A feed that ends has its last frame's `ended` set: that fails the whole, as a source that breaks does."""
    together = reduce(DataFrame.unionByName, feeds)
    return together.withColumn("ended", F.when(F.col("ended"), F.raise_error(F.lit("a change feed has ended")).cast("boolean")).otherwise(False)).filter(~F.col("ended")).drop("ended")


def feed_counters(frames: DataFrame, addresses: DataFrame) -> DataFrame:
    """observed frames, and applied: distinct dirty addresses that they left."""
    return frames.agg(F.count("*").alias("observed")).join(addresses.agg(F.count_distinct("address").alias("applied")))
