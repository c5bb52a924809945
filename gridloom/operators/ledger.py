"""Registries and ledgers as rows: placements, holders, transitions, actions under way, tails of history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .replication import TRANSITIONS


def registry(operations: DataFrame) -> DataFrame:
    """Where each cell is after operations (seq, op: place, move or remove, shard_id, x, y, node_id), by arrival.

    Moving what isn't placed changes nothing: a move counts only if the operation before it left the cell placed.
    """
    w = Window.partitionBy("shard_id", "x", "y").orderBy("seq")
    # A cell is placed from its first `place` on until a `remove`; moves in between are kept.
    life = F.last(F.when(F.col("op").isin("place", "remove"), F.col("op")), ignorenulls=True).over(w)
    rows = operations.withColumn("life", life).filter("life = 'place' or op = 'remove'")
    last = rows.groupBy("shard_id", "x", "y").agg(F.max_by(F.struct("op", "node_id"), "seq").alias("r"))
    return last.filter("r.op <> 'remove'").select("shard_id", "x", "y", F.col("r.node_id").alias("node_id"))


def illegal_transitions(states: DataFrame) -> DataFrame:
    """Changes of a replica's state (shard_id, node_id, seq, state) that can't follow each other."""
    w = Window.partitionBy("shard_id", "node_id").orderBy("seq")
    allowed = F.broadcast(states.sparkSession.createDataFrame(TRANSITIONS, "before string, state string"))
    changes = states.withColumn("before", F.lag("state").over(w)).filter("before is not null and before <> state")
    return changes.join(allowed, ["before", "state"], "left_anti").select("shard_id", "node_id", "seq", "before", "state")


def load_of(actions: DataFrame) -> DataFrame:
    """node_id and in_flight: the actions under way (source_node, target_node, concluded) that touch each node."""
    open_ = actions.filter("not concluded")
    return open_.select(F.explode(F.array_distinct(F.array_compact(F.array("source_node", "target_node")))).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("in_flight"))


def demand(cells: DataFrame, online: DataFrame) -> DataFrame:
    """node_id and demand of cells (holders, staging, reads, writes): reads are shared by the online holders, writes go to all online copies."""
    up = F.broadcast(online.agg(F.collect_set("node_id").alias("up")))
    rows = cells.join(up).withColumns({"holders": F.array_intersect("holders", "up"), "staging": F.array_intersect("staging", "up")})
    share = F.when(F.size("holders") > 0, F.col("reads") / F.size("holders")).otherwise(F.lit(0.0))
    parts = F.concat(F.transform("holders", lambda h: F.struct(h.alias("node_id"), (share + F.col("writes")).alias("d"))), F.transform("staging", lambda h: F.struct(h.alias("node_id"), F.col("writes").alias("d"))))
    return rows.select(F.explode(parts).alias("p")).groupBy("p.node_id").agg(F.sum("p.d").alias("demand"))


def drain(actions: DataFrame) -> DataFrame:
    """action_id and what becomes of it at the end of the drain (phase, cut_over, measured)."""
    what = F.when(F.col("measured"), "measured").when(F.col("phase") == "awaiting_measurement", "unmeasured").when(F.col("cut_over"), "abandoned").otherwise("rolled_back")
    return actions.select("action_id", what.alias("drained"))


def tail(rows: DataFrame, keys: list[str], most: int = 50) -> DataFrame:
    """The last `most` rows of each key by seq."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seq")))).filter(F.col("_n") <= most).drop("_n")


def poll_messages(polls: DataFrame) -> DataFrame:
    """node_id, round, step, message of each poll (node_id, round, outcome, version): a registration when the version changes, a heartbeat, and telemetry of a sampled one."""
    w = Window.partitionBy("node_id").orderBy("round")
    new = ~F.col("version").eqNullSafe(F.lag("version").over(w))
    steps = F.array_compact(F.array(F.when(F.col("new"), F.struct(F.lit(0).alias("step"), F.lit("register").alias("message"))), F.struct(F.lit(1).alias("step"), F.when(F.col("outcome") == "failed", "unhealthy").otherwise("healthy").alias("message")), F.when(F.col("outcome") == "sampled", F.struct(F.lit(2).alias("step"), F.lit("telemetry").alias("message")))))
    return polls.withColumn("new", new).select("node_id", "round", F.explode(steps).alias("s")).select("node_id", "round", "s.*")
