"""Replica sets: health, failover, placement and surplus."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .folds import folded

# Lag beyond which a copy is behind, silence after which it has failed.
MOST_PENDING, MOST_LAG_MS, GRACE_MS = 1000, 5000, 30_000
#: States that may follow each other.
TRANSITIONS = [("absent", "seeding"), ("seeding", "in_sync"), ("in_sync", "lagging"), ("lagging", "in_sync"), ("seeding", "failed"), ("in_sync", "failed"), ("lagging", "failed"), ("failed", "seeding")]


def replica_health(replicas: DataFrame) -> DataFrame:
    """shard_id, replicas, effective (in sync), readable, failed, write_target."""
    in_sync = F.col("state") == "in_sync"
    return replicas.groupBy("shard_id").agg(F.count("*").alias("replicas"), F.count_if(in_sync).alias("effective"), F.count_if(F.col("state").isin("in_sync", "lagging")).alias("readable"), F.count_if(F.col("state") == "failed").alias("failed"), F.min(F.when(in_sync & (F.col("role") == "primary"), F.col("node_id"))).alias("write_target"))


def surplus(replicas: DataFrame, factor: int) -> DataFrame:
    """shard_id and node_id of in-sync secondaries beyond `factor` in-sync copies, highest ids first."""
    in_sync = replicas.filter("state = 'in_sync'")
    excess = in_sync.groupBy("shard_id").agg((F.count("*") - factor).alias("excess"))
    rank = F.row_number().over(Window.partitionBy("shard_id").orderBy(F.desc("node_id")))
    return in_sync.filter("role <> 'primary'").withColumn("_rank", rank).join(excess, "shard_id").filter("_rank <= excess").select("shard_id", "node_id")


def failover(replicas: DataFrame, now_ms: int, primary_silence_ms: int = 30_000, candidate_silence_ms: int = 30_000, most_pending: int = 0, most_lag_ms: int = 1000) -> DataFrame:
    """shard_id, needs_replacement, promote, blocker, stuck of each shard's set.

    A primary needs replacing if there is none, it isn't in sync, or its last report is too old; one that never
    reported isn't dead. A secondary is eligible if it is in sync, has reported, recently, and is not behind.
    """
    silence = F.lit(now_ms) - F.col("last_report_ms")
    reason = (
        F.when(F.col("state") != "in_sync", "not_in_sync")
        .when(silence.isNull(), "never_reported")
        .when(silence > candidate_silence_ms, "health_too_stale")
        .when(F.col("pending_writes") > most_pending, "would_lose_writes")
        .when(F.col("apply_lag_ms") > most_lag_ms, "too_far_behind")
    )
    rows = replicas.withColumn("silence", silence).withColumn("reason", reason)
    primary, secondary = F.col("role") == "primary", F.col("role") != "primary"
    of = rows.groupBy("shard_id").agg(
        F.max(primary.cast("int")).alias("has_primary"),
        F.max((primary & ((F.col("state") != "in_sync") | F.coalesce(F.col("silence") > primary_silence_ms, F.lit(False)))).cast("int")).alias("lost"),
        F.min(F.when(secondary & F.col("reason").isNull(), F.struct("pending_writes", "apply_lag_ms", "node_id"))).alias("best"),
        F.max((secondary & (F.col("state") == "in_sync")).cast("int")).alias("has_in_sync"),
    )
    needs = (F.col("has_primary") == 0) | (F.col("lost") == 1)
    blocker = F.when(~needs, "primary_still_serving").when(F.col("best").isNull(), F.when(F.col("has_in_sync") == 1, "every_candidate_ineligible").otherwise("no_in_sync_secondary"))
    return of.select("shard_id", needs.alias("needs_replacement"), F.when(needs, F.col("best.node_id")).alias("promote"), blocker.alias("blocker"), (needs & F.col("best").isNull()).alias("stuck"))


def placement_plan(replicas: DataFrame, candidates: DataFrame, factor: int, spread: str = "prefer_distinct_regions") -> DataFrame:
    """shard_id, additions (nodes in order), shortfall.

    Nodes are added one at a time, each choice changing which regions are used: unused regions first (or only, with
    require_distinct_regions; with distinct_nodes regions don't matter), then fewest hosted replicas, then id. A copy
    that failed holds its node but doesn't count. `candidates` is the fleet, a small table.
    """
    if candidates.groupBy("node_id").count().filter("count > 1").head(1):
        raise ValueError("a node is a candidate twice")
    able = candidates.filter("serviceable").agg(F.collect_list(F.struct("node_id", "region", "hosted")).alias("able"))
    schema = "shard_id bigint, additions array<string>, shortfall int"

    def run(df: pd.DataFrame) -> pd.DataFrame:
        used = set(df["node_id"])
        live = df[df["state"] != "failed"]
        regions, added, short = set(live["region"]), [], 0
        options = [dict(a.asDict()) if hasattr(a, "asDict") else dict(a) for a in df["able"].iloc[0]]
        for _ in range(max(factor - len(live), 0)):
            left = [o for o in options if o["node_id"] not in used and (spread != "require_distinct_regions" or o["region"] not in regions)]
            if not left:
                short += 1
                continue
            best = min(left, key=lambda o: (spread != "distinct_nodes" and o["region"] in regions, o["hosted"], o["node_id"]))
            used.add(best["node_id"])
            regions.add(best["region"])
            added.append(best["node_id"])
        return pd.DataFrame([(int(df["shard_id"].iloc[0]), added, short)], columns=["shard_id", "additions", "shortfall"])

    return replicas.select("shard_id", "node_id", "region", "state").join(able).groupBy("shard_id").applyInPandas(run, schema)


def fold_reports(replicas: DataFrame, reports: DataFrame) -> DataFrame:
    """Replicas after their health reports (shard_id, node_id, seq, timestamp_ms, pending_writes, apply_lag_ms, reachable), in order of seq.

    A report older than the newest is ignored; an unreachable copy fails after the grace time; secondaries go between
    in_sync and lagging by their lag. Each replica's reports are independent of all others'.
    """
    columns = ["shard_id", "node_id", "role", "state", "seq", "timestamp_ms", "pending_writes", "apply_lag_ms", "reachable"]
    named = ["shard_id", "node_id", "role", "state", "pending_writes", "apply_lag_ms", "last_report_ms", "ignored"]
    own = replicas.select("shard_id", "node_id", "role", "state", F.lit(-1).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("timestamp_ms"), "pending_writes", "apply_lag_ms", F.lit(True).alias("reachable"))
    told = reports.select("shard_id", "node_id", F.lit("").alias("role"), F.lit("").alias("state"), "seq", "timestamp_ms", "pending_writes", "apply_lag_ms", "reachable")

    def run(batches):
        now = held = last = since = None
        ignored = 0

        def row():
            return (int(now[0]), now[1], *held, last, ignored)

        for b in batches:
            out = []
            for shard, node, role, state, seq, at, pending, lag, reachable in zip(*[b[c].tolist() for c in columns]):
                if (shard, node) != now:
                    if held:
                        out.append(row())
                    now, held, last, since, ignored = (shard, node), None, None, None, 0
                if seq < 0:
                    held = [role, state, int(pending), int(lag)]
                elif held is None:
                    continue  # a report on no replica
                elif last is not None and at < last:
                    ignored += 1
                elif not reachable:
                    last = int(at)
                    since = last if since is None else since
                    if last - since >= GRACE_MS and held[1] != "absent":
                        held[1] = "failed"
                else:
                    last, since = int(at), None
                    held[2:] = int(pending), int(lag)
                    behind = pending > MOST_PENDING or lag > MOST_LAG_MS
                    if held[0] != "primary":
                        held[1] = {("in_sync", True): "lagging", ("lagging", False): "in_sync"}.get((held[1], behind), held[1])
            yield pd.DataFrame(out, columns=named)
        if held:
            yield pd.DataFrame([row()], columns=named)

    schema = "shard_id bigint, node_id string, role string, state string, pending_writes bigint, apply_lag_ms bigint, last_report_ms bigint, ignored bigint"
    return folded(own.unionByName(told), ["shard_id", "node_id"], ["seq"], run, schema)


#: From each state of a replica those that an operation may bring it to.
_SEEDABLE, _SYNCABLE = {"absent", "failed", "lagging"}, {"seeding", "lagging"}


def fold_operations(operations: DataFrame) -> DataFrame:
    """shard_id, seq, refusal and replicas (node=role:state, by node) after each operation on a shard's replica set, in order of seq.

    `operations` has shard_id, seq, op (add, begin_seed, mark_in_sync, mark_failed, promote, remove) and node; the first node added to a set is its
    primary and in sync. Promoting changes the roles of the two. A refused operation changes nothing.
    """

    def why_not(held: dict, op: str, node: str) -> str | None:
        if op == "add":
            return "duplicate_replica" if node in held else None
        if node not in held:
            return "unknown_replica"
        role, state = held[node]
        if op == "begin_seed":
            return "primary_cannot_seed" if role == "primary" else None if state in _SEEDABLE else "illegal_transition"
        if op == "mark_in_sync":
            return None if state in _SYNCABLE else "illegal_transition"
        if op == "mark_failed":
            return "illegal_transition" if state in ("absent", "failed") else None
        if op == "promote":
            return "already_primary" if role == "primary" else None if state == "in_sync" else "not_in_sync"
        if op == "remove":
            return "primary_not_removable" if role == "primary" else None
        raise ValueError(f"unknown operation: {op}")

    def run(batches):
        now, held = None, {}
        for b in batches:
            out = []
            for shard, seq, op, node in zip(*[b[c].tolist() for c in ("shard_id", "seq", "op", "node")]):
                if shard != now:
                    now, held = shard, {}
                refusal = why_not(held, op, node)
                if refusal is None:
                    if op == "add":
                        held[node] = ("secondary", "absent") if held else ("primary", "in_sync")
                    elif op == "remove":
                        del held[node]
                    elif op == "promote":
                        held = {n: ("primary" if n == node else "secondary", s) for n, (_, s) in held.items()}
                    else:
                        held[node] = (held[node][0], {"begin_seed": "seeding", "mark_in_sync": "in_sync", "mark_failed": "failed"}[op])
                out.append((shard, seq, refusal, ",".join(f"{n}={r}:{s}" for n, (r, s) in sorted(held.items()))))
            yield pd.DataFrame(out, columns=["shard_id", "seq", "refusal", "replicas"])

    return folded(operations.select("shard_id", "seq", "op", "node"), ["shard_id"], ["seq"], run, "shard_id bigint, seq bigint, refusal string, replicas string")
