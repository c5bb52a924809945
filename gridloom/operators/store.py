"""The versioned node and edge store: reads, paging, counting, aggregates and writes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .folds import folded
from .keyspace import resolve

PAGE, MOST_PAGES, MOST_ADDRESSES = 500, 10_000, 1000
_COMPARE = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b, "!=": lambda a, b: a != b}


def where(expression: dict, field) -> Column:
    """A predicate from its JSON form: {"op": "<", "left": "x", "right": 1}, with and / or / not over {"args": [...]}.

    `field` gives the column of a field's name. The grammar beyond comparisons is this engine's own.
    """
    op = expression["op"]
    if op in ("and", "or"):
        parts = [where(e, field) for e in expression["args"]]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if op == "and" else out | p
        return out
    if op == "not":
        return ~where(expression["args"][0], field)
    if op not in _COMPARE:
        raise ValueError(f"unknown operator: {op}")
    return _COMPARE[op](field(expression["left"]), F.lit(expression["right"]))


def select(nodes: DataFrame, kind: str | None = None, owner: str | None = None, predicate: Column | None = None) -> DataFrame:
    for name, value in (("kind", kind), ("owner", owner)):
        if value is not None:
            nodes = nodes.filter(F.col(name) == value)
    return nodes if predicate is None else nodes.filter(predicate)


def point_get(nodes: DataFrame, address: str) -> DataFrame:
    return nodes.filter(F.col("address") == address)


def multi_get(nodes: DataFrame, addresses: DataFrame) -> DataFrame:
    """The nodes at `addresses`; absent ones are left out. At most 1000 at once are broadcast, more are joined by hash."""
    wanted = addresses.select("address").distinct()
    return nodes.join(F.broadcast(wanted) if wanted.limit(MOST_ADDRESSES + 1).count() <= MOST_ADDRESSES else wanted, "address", "left_semi")


def offset_page(nodes: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return nodes.orderBy("address").offset(offset).limit(limit)


def keyset_page(nodes: DataFrame, order: str, limit: int = PAGE, after: tuple | None = None, descending: bool = False) -> DataFrame:
    """The next page in the order (field, address) after a row's (value, address)."""
    if after is not None:
        value, address = after
        far = F.col(order) < value if descending else F.col(order) > value
        nodes = nodes.filter(far | ((F.col(order) == value) & (F.col("address") > address)))
    return nodes.orderBy(F.desc(order) if descending else F.asc(order), "address").limit(limit)


def walk(nodes: DataFrame, order: str, limit: int = PAGE, most: int = MOST_PAGES):
    """Page after page as lists of rows until one is short; more than `most` pages are an error."""
    after = None
    for _ in range(most):
        page = keyset_page(nodes, order, limit, after).collect()
        yield page
        if len(page) < limit:
            return
        after = (page[-1][order], page[-1]["address"])
    raise RuntimeError(f"the cursor did not end within {most} pages")


def kind_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("count"))


def aggregate(nodes: DataFrame, func: str, field: str, by: str | None = None, values: list | None = None) -> DataFrame:
    """count, sum, min, max or avg of a field, for all or by groups; `values` limits the groups."""
    made = {"count": F.count(field), "sum": F.sum(field), "min": F.min(field), "max": F.max(field), "avg": F.avg(field)}[func].alias("value")
    if by is None:
        return nodes.agg(made)
    return (nodes if values is None else nodes.filter(F.col(by).isin(values))).groupBy(by).agg(made)


def versions(log: DataFrame) -> DataFrame:
    """A log of writes (seq, address, op: set or delete, ...) with version (from 1) and is_current.

    A deleted address begins anew; of deletes nothing is current.
    """
    w = Window.partitionBy("address").orderBy("seq")
    writes = log.filter(F.col("op").isin("set", "delete"))
    life = F.sum((F.col("op") == "delete").cast("int")).over(w)
    rows = writes.withColumn("life", life).withColumn("last", F.lead("seq").over(w).isNull())
    number = F.sum((F.col("op") == "set").cast("int")).over(Window.partitionBy("address", "life").orderBy("seq"))
    return rows.withColumn("version", F.when(F.col("op") == "set", number)).withColumn("is_current", F.col("last") & (F.col("op") == "set")).drop("last")


_ASKED = ["address", "seq", "field", "expect_le", "expect_eq", "expect_absent", "set", "data"]


def set_if(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """Compare-and-set of one field of a node's data: address, seq, applied and the data after.

    `nodes` has address and data (JSON). `requests` has seq, address, field, one of expect_le (the field is a number and at most this),
    expect_eq (it equals this JSON value) and expect_absent (it is unset or null), and `set`, a JSON object merged into the data if that holds.
    Each address's requests are tried in order of seq against what the one before left.
    """
    state = nodes.select("address", F.lit(-1).cast("bigint").alias("seq"), *[F.lit(None).cast(t).alias(c) for c, t in (("field", "string"), ("expect_le", "double"), ("expect_eq", "string"), ("expect_absent", "boolean"), ("set", "string"))], F.col("data"))
    rows = state.unionByName(requests.select(*_ASKED[:-1], F.lit(None).cast("string").alias("data")))

    def run(batches):
        now, held = None, {}
        for b in batches:
            out = []
            for address, seq, field, le, eq, absent, new, data in zip(*[b[c].tolist() for c in _ASKED]):
                if address != now:
                    now, held = address, {}
                if seq < 0:
                    held = json.loads(data) if data else {}
                    continue
                value = held.get(field)
                if absent is True:
                    ok = value is None
                elif isinstance(eq, str):
                    ok = value == json.loads(eq)
                else:
                    ok = isinstance(value, (int, float)) and not isinstance(value, bool) and value <= le
                if ok:
                    held = {**held, **json.loads(new)}
                out.append((address, seq, ok, json.dumps(held)))
            yield pd.DataFrame(out, columns=["address", "seq", "applied", "data"])

    return folded(rows, ["address"], ["seq"], run, "address string, seq bigint, applied boolean, data string")


_OPERATION = ["scope", "tx_id", "position", "type", "address", "to", "expect_eq", "set"]


def transactions(operations: DataFrame) -> DataFrame:
    """tx_id, status (200 or 412) and changed (what it wrote or deleted) of batches of operations on independent groups of addresses.

    `operations` has scope (addresses that may meet share one), tx_id, position, type, address, to (of edges), expect_eq and set (JSON
    merged into the node's data). Types: create, insert_node, delete_node, set_if, claim, insert_edge, delete_edge (between nodes that exist) and clear_kind
    (address names the kind). Within a scope transactions run in order of tx_id; one of which an operation fails leaves nothing behind.
    """

    def apply(held: dict, o) -> dict | None:
        """What an operation writes (null: deletes), or null if it fails."""
        kind, address, to, expect, new = o
        node = held.get(address)
        fresh = json.loads(new) if isinstance(new, str) and new != "{}" else {}
        if kind == "create":
            return {address: fresh} if node is None else None
        if kind == "insert_node":
            return {address: fresh}
        if kind == "delete_node":
            return {address: None} if node is not None else None
        if kind == "set_if":
            return {address: {**node, **fresh}} if node is not None and node == json.loads(expect) else None
        if kind == "claim":
            return {address: {**node, "claimed_by": fresh}} if node is not None and "claimed_by" not in node else None
        if kind in ("insert_edge", "delete_edge"):
            edge = (address, to)
            there = node is not None and held.get(to) is not None if kind == "insert_edge" else held.get(edge) is not None
            return {edge: {} if kind == "insert_edge" else None} if there else None
        if kind == "clear_kind":
            return {k: None for k, v in held.items() if v is not None and isinstance(k, str) and k.startswith(f"{address}:")}
        raise ValueError(f"unknown operation: {kind}")

    def run(batches):
        scope, tx, nodes, before, ok = None, None, {}, {}, True
        out: list = []

        def end():
            if not ok:
                nodes.update(before)
            out.append((int(tx), 200 if ok else 412, len(before) if ok else 0))

        for b in batches:
            for s, t, _, *o in zip(*[b[c].tolist() for c in _OPERATION]):
                if (s, t) != (scope, tx):
                    if tx is not None:
                        end()
                    if s != scope:
                        nodes = {}
                    scope, tx, before, ok = s, t, {}, True
                if ok:
                    written = apply(nodes, o)
                    ok = written is not None
                    for k, v in (written or {}).items():
                        before.setdefault(k, nodes.get(k))
                        nodes[k] = v
            yield pd.DataFrame(out, columns=["tx_id", "status", "changed"])
            out = []
        if tx is not None:
            end()
            yield pd.DataFrame(out, columns=["tx_id", "status", "changed"])

    rows = operations if "to" in operations.columns else operations.withColumn("to", F.lit(None).cast("string"))
    return folded(rows.select(*_OPERATION), ["scope"], ["tx_id", "position"], run, "tx_id bigint, status int, changed bigint")


def remove(nodes: DataFrame, edges: DataFrame, kind: str, predicate: Column | None = None, writer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that are left when all nodes of a kind are deleted: those that `writer` owns, if one is named, and that a predicate fits, if there is one."""
    gone = select(nodes, kind, writer, predicate).select("address").distinct()
    left = nodes.join(gone, "address", "left_anti")
    ends = [gone.select(F.col("address").alias(c)) for c in ("from", "to")]
    return left, edges.join(ends[0], "from", "left_anti").join(ends[1], "to", "left_anti").select(edges.columns)


def children(nodes: DataFrame, owners: DataFrame) -> DataFrame:
    """owner and address of the nodes that each of `owners` (address) owns."""
    return nodes.join(owners.select(F.col("address").alias("owner")).distinct(), "owner", "left_semi").select("owner", "address")


def published(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """Messages (seq, channel, payload) with the shard that their channel resolves to, or why it doesn't; subscribers get all shards' messages by seq."""
    asked = messages.select("seq", "payload", F.col("channel").alias("address"), F.col("channel").alias("kind"))
    return resolve(asked, rules).select("seq", F.col("address").alias("channel"), "payload", "shard_id", "miss")


def declarations(listings: DataFrame, backends: int) -> DataFrame:
    """Declared indexes or references (backend, name, definition): name, and whether all backends list the same."""
    return listings.groupBy("name").agg((F.count_distinct("backend") == backends).alias("everywhere"), (F.count_distinct("definition") == 1).alias("alike"))


def engine_stats(nodes: DataFrame, edges: DataFrame, log: DataFrame) -> DataFrame:
    """One row of counters: node_count, edge_count, user_count, history_entries, reads_total, writes_total, kinds (kind and count, by kind)."""
    kinds = kind_counts(nodes).agg(F.sort_array(F.collect_list(F.struct("kind", "count"))).alias("kinds"), F.sum("count").alias("node_count"))
    users = nodes.agg(F.count_distinct("owner").alias("user_count"))
    past = versions(log).agg(F.count_if((F.col("op") == "set") & ~F.col("is_current")).alias("history_entries"))
    totals = log.agg(F.count_if(F.col("op") == "read").alias("reads_total"), F.count_if(F.col("op") != "read").alias("writes_total"))
    return kinds.join(edges.agg(F.count("*").alias("edge_count"))).join(users).join(past).join(totals)


def claims(requests: DataFrame) -> DataFrame:
    """address, seq and status: the first to ask gets the node, the others 409."""
    first = F.min("seq").over(Window.partitionBy("address"))
    return requests.select("address", "seq", F.when(F.col("seq") == first, 200).otherwise(409).alias("status"))


def sequence_blocks(requests: DataFrame) -> DataFrame:
    """name, seq, first_id and last_id: each request's block of `size` ids of a named counter."""
    w = Window.partitionBy("name").orderBy("seq")
    last = F.sum("size").over(w)
    return requests.select("name", "seq", (last - F.col("size") + 1).alias("first_id"), last.alias("last_id"))


def out_edges(edges: DataFrame, addresses: DataFrame) -> DataFrame:
    return edges.join(addresses.select(F.col("address").alias("from")).distinct(), "from", "left_semi")


def in_edges(edges: DataFrame, addresses: DataFrame) -> DataFrame:
    return edges.join(addresses.select(F.col("address").alias("to")).distinct(), "to", "left_semi")


def changes_after(log: DataFrame, position: int, limit: int = PAGE) -> DataFrame:
    return log.filter(F.col("seq") > position).orderBy("seq").limit(limit)
