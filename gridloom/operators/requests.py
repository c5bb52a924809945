"""Plans of store requests: where each goes, or why it is refused.

`requests` has request_id, method, path, query and body. A plan is colocated (all its keys
must be served by one node), broadcast, subscribe or refuse; a refusal has a status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import keyspace

# The store's routes. `*` stands for one segment; `scope` says what places the request.
ROUTES = [
    ("GET", "", "agree", "read"),
    ("POST", "node", "body_node", "write"),
    ("GET", "node/*", "address", "read"),
    ("GET", "node/*/history", "address", "read"),
    ("GET", "node/*/owned", "address", "read"),
    ("GET", "node/*/edges/out", "address", "read"),
    ("GET", "node/*/edges/in", "address", "read"),
    ("PUT", "node/*", "address", "write"),
    ("DELETE", "node/*", "address", "write"),
    ("POST", "node/*/claim", "address", "write"),
    ("POST", "sequence/*/next", "address", "write"),
    ("GET", "nodes", "query_kind", "read"),
    ("POST", "nodes/query", "body_kind", "read"),
    ("POST", "nodes/count", "body_kind", "read"),
    ("POST", "nodes/count_by", "body_kind", "read"),
    ("POST", "nodes/aggregate", "body_kind", "read"),
    ("POST", "nodes/aggregate_by", "body_kind", "read"),
    ("POST", "nodes/multiget", "addresses", "read"),
    ("POST", "edge", "ends", "write"),
    ("DELETE", "edge", "ends", "write"),
    ("POST", "transaction", "operations", "write"),
    ("GET", "events", "subscribe", "read"),
    ("POST", "publish", "channel", "write"),
    ("GET", "changes", "spanning", "read"),
    ("GET", "stats", "spanning", "read"),
    ("POST", "admin/users", "spanning", "write"),
    ("GET", "admin/users", "spanning", "write"),
    ("DELETE", "admin/users/*", "spanning", "write"),
    ("GET", "admin/indexes", "agree", "read"),
    ("GET", "admin/references", "agree", "read"),
    ("POST", "admin/indexes", "broadcast", "write"),
    ("POST", "admin/references", "broadcast", "write"),
    ("DELETE", "admin/indexes/*", "broadcast", "write"),
    ("DELETE", "admin/references/*", "broadcast", "write"),
]
STATUS = {"unknown_route": 404, "malformed_path": 400, "malformed_body": 400, "missing_credential": 401, "keyspace": 421, "spans_backends": 421, "not_proxyable": 421}
# Fixed values: (status, retryable) of a routing error.
ROUTING_STATUS = {
    "write_fenced": (503, True),
    "no_writable_replica": (503, True),
    "no_live_owner": (503, True),
    "no_readable_replica": (503, True),
    "unknown_shard": (421, False),
    "invalid_coordinate": (421, False),
    "invalid_address": (400, False),
    "invalid_range": (400, False),
    "unknown_node": (500, False),
}
_OPERATION_KEYS = {"insert_node": "node", "delete_node": "address", "set_if": "address", "clear_kind": "kind", "delete_where": "kind", "insert_edge": "ends", "delete_edge": "ends"}


def segments(path: Column) -> Column:
    """Non-empty segments, percent-decoded."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))))


def query_value(query: Column, name: str) -> Column:
    """A query parameter, decoded with `+` as a space; null if absent."""
    pair = F.try_element_at(F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: F.substring_index(p, "=", 1) == name), F.lit(1))
    return F.try_url_decode(F.when(pair.contains("="), F.regexp_extract(pair, "^[^=]*=(.*)$", 1)).otherwise(F.when(pair.isNotNull(), F.lit(""))))


def classify(requests: DataFrame) -> DataFrame:
    """`requests` with segments, scope, intent and malformed (a segment that can't be decoded)."""
    rows = requests.withColumn("segments", segments(F.col("path")))
    malformed = F.exists("segments", lambda s: s.isNull())
    scope, intent = F.lit(None).cast("string"), F.lit(None).cast("string")
    for method, path, kind, why in ROUTES:
        parts = path.split("/") if path else []
        fits = (F.col("method") == method) & (F.size("segments") == len(parts))
        for i, part in enumerate(parts):
            if part != "*":
                fits = fits & (F.get("segments", F.lit(i)) == part)
        scope, intent = F.when(fits, kind).otherwise(scope), F.when(fits, why).otherwise(intent)
    return rows.withColumns({"malformed": malformed, "scope": F.when(~malformed, scope), "intent": F.when(~malformed, intent)})


def _text(body: Column, name: str) -> Column:
    """A body's field if it is a text."""
    return F.get_json_object(body, f"$.{name}")


def touched_keys(requests: DataFrame) -> DataFrame:
    """request_id, position, kind, address and problem of each key that a classified request names.

    A transaction has one or two per operation: insert_node its kind and address, delete_node and set_if
    their address, clear_kind and delete_where their kind, edges both ends.
    """
    rows = classify(requests) if "scope" not in requests.columns else requests
    body = F.col("body")
    valid = F.try_parse_json(body).isNotNull()
    key = lambda kind, address, problem: F.struct(kind.cast("string").alias("kind"), address.cast("string").alias("address"), problem.cast("string").alias("problem"))
    none = F.lit(None).cast("string")
    one = lambda kind, address, problem=none: F.array(key(kind, address, problem))
    bad = one(none, none, F.lit("malformed_body"))
    field = lambda name: _text(body, name)
    second = F.get("segments", F.lit(1))
    ends = lambda a, b: F.when(a.isNull() | b.isNull(), bad).otherwise(F.array(key(none, a, none), key(none, b, none)))
    addresses = F.from_json(F.get_json_object(body, "$.addresses"), "array<string>")
    operations = F.from_json(F.get_json_object(body, "$.operations"), "array<struct<type:string,kind:string,address:string,from:string,to:string>>")

    def of_operation(o: Column) -> Column:
        either = lambda kind, address: F.when(kind.isNull() & address.isNull(), bad).otherwise(one(kind, address))
        out = bad
        for name, touches in _OPERATION_KEYS.items():
            keys = {"node": lambda: either(o["kind"], o["address"]), "address": lambda: either(none, o["address"]), "kind": lambda: either(o["kind"], none), "ends": lambda: ends(o["from"], o["to"])}[touches]()
            out = F.when(o["type"] == name, keys).otherwise(out)
        return out

    empty = F.array().cast("array<struct<kind:string,address:string,problem:string>>")
    needs_body = F.col("scope").isin("body_node", "body_kind", "addresses", "ends", "operations", "channel")
    keys = (
        F.when(needs_body & ~valid, bad)
        .when(F.col("scope") == "body_node", one(field("kind"), field("address")))
        .when(F.col("scope") == "address", one(none, second))
        .when(F.col("scope") == "query_kind", F.when(query_value(F.col("query"), "kind").isNull(), empty).otherwise(one(query_value(F.col("query"), "kind"), none)))
        .when(F.col("scope") == "body_kind", F.when(field("kind").isNull(), empty).otherwise(one(field("kind"), none)))
        .when(F.col("scope") == "addresses", F.when(addresses.isNull(), bad).otherwise(F.transform(addresses, lambda a: F.when(a.isNull(), key(none, none, F.lit("malformed_body"))).otherwise(key(none, a, none)))))
        .when(F.col("scope") == "ends", ends(field("from"), field("to")))
        .when(F.col("scope") == "operations", F.when(operations.isNull(), bad).otherwise(F.flatten(F.transform(operations, of_operation))))
        .when(F.col("scope") == "channel", F.when(field("channel").isNull(), bad).otherwise(one(field("channel"), none)))
        .otherwise(empty)
    )
    return rows.select("request_id", F.posexplode(keys).alias("position", "k")).select("request_id", "position", "k.*")


def plan(requests: DataFrame, rules: DataFrame, owners: DataFrame) -> DataFrame:
    """request_id, plan, refusal, status, shard_id and node_id of each request.

    `owners` has shard_id and node_id. All keys of a request must lie on one node.
    """
    rows = classify(requests)
    keys = keyspace.resolve(touched_keys(rows), rules).join(owners, "shard_id", "left")
    of = keys.groupBy("request_id").agg(
        F.min("problem").alias("problem"),
        F.max((F.col("problem").isNull() & F.col("miss").isNotNull()).cast("int")).alias("missed"),
        F.count_distinct("node_id").alias("nodes"), F.min("shard_id").alias("key_shard"), F.min("node_id").alias("key_node"), F.count("*").alias("keys"),
    )
    spanning = keyspace.spanning_key(rules).join(owners, F.col("spanning_key") == F.col("shard_id"), "left").select("spanning_key", F.col("node_id").alias("spanning_node"))
    out = rows.join(of, "request_id", "left").join(spanning)
    scope, no_keys = F.col("scope"), F.coalesce("keys", F.lit(0)) == 0
    whole = (scope == "spanning") | (no_keys & scope.isin("query_kind", "body_kind", "addresses", "operations"))
    refusal = (
        F.when(F.col("malformed"), "malformed_path")
        .when(scope.isNull(), "unknown_route")
        .when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("missed") == 1, "keyspace")
        .when(whole & F.col("spanning_key").isNull(), "not_proxyable")
        .when(F.col("nodes") > 1, "spans_backends")
    )
    status = F.lit(None).cast("int")
    for name, code in STATUS.items():
        status = F.when(F.col("refusal") == name, code).otherwise(status)
    kind = F.when(F.col("refusal").isNotNull(), "refuse").when(scope.isin("agree", "broadcast"), "broadcast").when(scope == "subscribe", "subscribe").otherwise("colocated")
    placed = F.col("plan") == "colocated"
    return (
        out.withColumn("refusal", refusal).withColumn("plan", kind).withColumn("status", status)
        .select("request_id", "plan", "refusal", "status", F.when(placed, F.when(whole, F.col("spanning_key")).otherwise(F.col("key_shard"))).alias("shard_id"), F.when(placed, F.when(whole, F.col("spanning_node")).otherwise(F.col("key_node"))).alias("node_id"))
    )


def merge_answers(answers: DataFrame) -> DataFrame:
    """request_id, status and body of broadcast answers (request_id, position, status, body; a null status: unreachable).

    Any unreachable backend: 502. Else the first answer that is no success. Else, if `agree` is set and the bodies
    differ as sets of JSON rows: 409. Else the first answer.
    """
    canonical = F.coalesce(F.array_join(F.array_sort(F.transform(F.from_json("body", "array<variant>"), lambda v: F.to_json(v))), "\n"), F.col("body"))
    rows = answers.withColumn("canonical", canonical).withColumn("failed", F.col("status").isNotNull() & ~F.col("status").between(200, 299))
    of = rows.groupBy("request_id").agg(
        F.max(F.col("status").isNull().cast("int")).alias("unreachable"), F.min_by(F.struct("status", "body"), "position").alias("first"),
        F.min(F.when(F.col("failed"), F.struct("position", "status", "body"))).alias("bad"), F.count_distinct("canonical").alias("bodies"), F.max("agree").alias("agree"),
    )
    status = F.when(F.col("unreachable") == 1, 502).when(F.col("bad").isNotNull(), F.col("bad.status")).when(F.col("agree") & (F.col("bodies") > 1), 409).otherwise(F.col("first.status"))
    body = F.when(F.col("unreachable") == 1, None).when(F.col("bad").isNotNull(), F.col("bad.body")).when(F.col("agree") & (F.col("bodies") > 1), None).otherwise(F.col("first.body"))
    return of.select("request_id", status.alias("status"), body.alias("body"))


def first_disagreement(answers: DataFrame) -> DataFrame:
    """request_id and position of the first answer whose status or rows differ from the first answer's."""
    canonical = F.coalesce(F.array_join(F.array_sort(F.transform(F.from_json("body", "array<variant>"), lambda v: F.to_json(v))), "\n"), F.col("body"))
    rows = answers.select("request_id", "position", F.struct("status", canonical.alias("c")).alias("answer"))
    first = rows.groupBy("request_id").agg(F.min_by("answer", "position").alias("first"))
    return rows.join(first, "request_id").filter(~F.col("answer").eqNullSafe(F.col("first"))).groupBy("request_id").agg(F.min("position").alias("position"))
