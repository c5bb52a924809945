"""Queries on the node and edge store, its log, and copies of it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import diffsync, keyspace, store
from ..sources import tables as T
from . import parts as P
from .registry import query

_ROW = ["address", "kind", "owner", "status", "amount"]
_S = "WITH " + P.NODES + " "


def _nodes(spark, sf_dir):
    return T.store_nodes(spark, sf_dir).select(*_ROW)


@query(_S + "SELECT * FROM store WHERE address = 'Order:7'")
def node_point_get(spark, sf_dir):
    return store.point_get(_nodes(spark, sf_dir), "Order:7")


@query(_S + "SELECT * FROM store WHERE address IN (SELECT 'Order:' || i * 3 FROM range(300) t(i))")
def node_multiget(spark, sf_dir):
    return store.multi_get(_nodes(spark, sf_dir), spark.range(300).select(F.concat(F.lit("Order:"), F.col("id") * 3).alias("address")))


@query(_S + "SELECT * FROM store WHERE kind = 'Order' AND (amount > 50000 OR (amount = 50000 AND address > 'Order:5')) ORDER BY amount, address LIMIT 500")
def keyset_page(spark, sf_dir):
    return store.keyset_page(store.select(_nodes(spark, sf_dir), kind="Order"), "amount", 500, (50_000.0, "Order:5"))


@query(_S + "SELECT * FROM store WHERE kind = 'Customer' ORDER BY address LIMIT 50 OFFSET 25")
def offset_page(spark, sf_dir):
    return store.offset_page(store.select(_nodes(spark, sf_dir), kind="Customer"), 50, 25)


@query(_S + "SELECT kind, count(*) AS count FROM store GROUP BY kind")
def kind_counts(spark, sf_dir):
    return store.kind_counts(_nodes(spark, sf_dir))


@query(_S + "SELECT count(*) AS count FROM store WHERE kind = 'Order' AND status = 'F' AND NOT (amount < 1000 OR amount > 200000)")
def count_where(spark, sf_dir):
    predicate = {"op": "and", "args": [{"op": "=", "left": "status", "right": "F"}, {"op": "not", "args": [{"op": "or", "args": [{"op": "<", "left": "amount", "right": 1000}, {"op": ">", "left": "amount", "right": 200000}]}]}]}
    return store.select(_nodes(spark, sf_dir), kind="Order", predicate=store.where(predicate, F.col)).agg(F.count("*").alias("count"))


@query(_S + "SELECT count(*) AS count FROM store WHERE kind = 'Part' AND CAST(floor(amount) AS BIGINT) % 2 = 0")
def count_json_where(spark, sf_dir):
    """The same kind of filter on the JSON payload itself."""
    nodes = store.select(T.store_nodes(spark, sf_dir), kind="Part")
    price = F.get_json_object("data", "$.price").cast("double")
    return nodes.filter(F.floor(price) % 2 == 0).agg(F.count("*").alias("count"))


@query(_S + "SELECT status, count(*) AS count FROM store WHERE kind = 'Order' GROUP BY status")
def count_by(spark, sf_dir):
    return store.aggregate(store.select(_nodes(spark, sf_dir), kind="Order"), "count", "address", by="status").withColumnRenamed("value", "count")


@query(_S + "SELECT max(amount) AS value FROM store WHERE kind = 'Order'")
def aggregate(spark, sf_dir):
    return store.aggregate(store.select(_nodes(spark, sf_dir), kind="Order"), "max", "amount")


@query(_S + "SELECT owner, min(amount) AS value FROM store WHERE kind = 'Customer' AND owner IN ('NATION_3', 'NATION_7', 'NATION_19') GROUP BY owner")
def aggregate_by(spark, sf_dir):
    return store.aggregate(store.select(_nodes(spark, sf_dir), kind="Customer"), "min", "amount", by="owner", values=["NATION_3", "NATION_7", "NATION_19"])


@query(_S + "SELECT owner, address FROM store WHERE owner IN (SELECT 'Customer:' || c_custkey FROM customer)")
def owned_nodes(spark, sf_dir):
    """The children of every customer."""
    nodes = _nodes(spark, sf_dir)
    return store.children(nodes, store.select(nodes, kind="Customer"))


@query("WITH " + P.EDGES + " SELECT \"from\", \"to\", kind FROM edges WHERE \"from\" IN (SELECT 'Order:' || i * 10 FROM range(200) t(i))")
def edges_out(spark, sf_dir):
    return store.out_edges(T.store_edges(spark, sf_dir), spark.range(200).select(F.concat(F.lit("Order:"), F.col("id") * 10).alias("address"))).select("from", "to", "kind")


@query("WITH " + P.EDGES + " SELECT \"from\", \"to\", kind FROM edges WHERE \"to\" IN (SELECT 'Part:' || i * 10 FROM range(100) t(i))")
def edges_in(spark, sf_dir):
    return store.in_edges(T.store_edges(spark, sf_dir), spark.range(100).select(F.concat(F.lit("Part:"), F.col("id") * 10).alias("address"))).select("from", "to", "kind")


_VERSIONS = "WITH " + P.LOG + """, writes AS (SELECT *, sum(CASE WHEN op = 'delete' THEN 1 ELSE 0 END) OVER w AS life, lead(seq) OVER w IS NULL AS last FROM log WHERE op IN ('set', 'delete') WINDOW w AS (PARTITION BY address ORDER BY seq)),
versions AS (SELECT *, CASE WHEN op = 'set' THEN sum(CASE WHEN op = 'set' THEN 1 ELSE 0 END) OVER (PARTITION BY address, life ORDER BY seq) END AS version, last AND op = 'set' AS is_current FROM writes) """


@query(_VERSIONS + "SELECT address, seq, CAST(version AS BIGINT) AS version, value FROM versions WHERE op = 'set' AND NOT is_current")
def node_history(spark, sf_dir):
    return store.versions(T.change_log(spark, sf_dir)).filter("op = 'set' and not is_current").select("address", "seq", F.col("version").cast("bigint").alias("version"), "value")


@query(_VERSIONS + "SELECT address, seq, value FROM versions WHERE is_current")
def current_nodes(spark, sf_dir):
    return store.versions(T.change_log(spark, sf_dir)).filter("is_current").select("address", "seq", "value")


@query("WITH " + P.LOG + " SELECT seq, address, op, value FROM log WHERE seq > 4000 ORDER BY seq LIMIT 500")
def changes_after(spark, sf_dir):
    return store.changes_after(T.change_log(spark, sf_dir), 4000).select("seq", "address", "op", "value")


_LEFT = "WITH " + P.NODES + ", " + P.EDGES + """, gone AS (SELECT address FROM store WHERE kind = 'Order'{}), counted AS (SELECT kind, count(*) AS left FROM store WHERE address NOT IN (SELECT address FROM gone) GROUP BY kind
UNION ALL SELECT 'edges', count(*) FROM edges WHERE "from" NOT IN (SELECT address FROM gone) AND "to" NOT IN (SELECT address FROM gone)) SELECT kind, left AS remaining FROM counted"""


def _remaining(spark, sf_dir, predicate=None):
    nodes, edges = store.remove(_nodes(spark, sf_dir), T.store_edges(spark, sf_dir), "Order", predicate)
    return store.kind_counts(nodes).union(edges.agg(F.lit("edges").alias("kind"), F.count("*").alias("count"))).withColumnRenamed("count", "remaining")


@query(_LEFT.replace(" AS left ", " AS n ").replace("left AS remaining", "n AS remaining").format(" AND amount < 20000"))
def delete_where(spark, sf_dir):
    """What a filtered clearing of a kind leaves of nodes and edges."""
    return _remaining(spark, sf_dir, store.where({"op": "<", "left": "amount", "right": 20000}, F.col))


@query(_LEFT.replace(" AS left ", " AS n ").replace("left AS remaining", "n AS remaining").format(""))
def clear_kind(spark, sf_dir):
    """What clearing a kind leaves."""
    return _remaining(spark, sf_dir)


def _asking(rows, **expect):
    kinds = {"expect_le": "double", "expect_eq": "string", "expect_absent": "boolean"}
    return rows.select("address", "seq", F.lit("value").alias("field"), *[F.lit(expect.get(c)).cast(t).alias(c) if not hasattr(expect.get(c), "alias") else expect[c].alias(c) for c, t in kinds.items()], F.to_json(F.struct("value")).alias("set"))


def _value(data):
    return F.get_json_object(data, "$.value").cast("double").alias("value")


@query("WITH " + P.LOG + ", asked AS (SELECT address, seq, value FROM log WHERE op = 'set') SELECT address, seq, seq = min(seq) OVER (PARTITION BY address) AS applied, first(value) OVER (PARTITION BY address ORDER BY seq) AS value FROM asked")
def set_if_cas(spark, sf_dir):
    """Each write asks to be the first of its address; the value after is the winner's."""
    log = T.change_log(spark, sf_dir).filter("op = 'set'")
    none = log.select("address", F.lit(None).cast("string").alias("data")).limit(0)
    return store.set_if(none, _asking(log, expect_absent=True)).select("address", "seq", "applied", _value("data"))


@query("WITH " + P.LOG + ", asked AS (SELECT address, seq, value FROM log WHERE op = 'set') SELECT address, seq, value >= coalesce(max(value) OVER (PARTITION BY address ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS applied, greatest(max(value) OVER (PARTITION BY address ORDER BY seq), 0) AS value FROM asked")
def set_if_at_most(spark, sf_dir):
    """Each write asks that the value be at most its own, from 0 on: what stays is the greatest so far."""
    log = T.change_log(spark, sf_dir).filter("op = 'set'")
    start = log.select("address").distinct().withColumn("data", F.lit('{"value": 0, "kept": true}'))
    return store.set_if(start, _asking(log, expect_le=F.col("value"))).select("address", "seq", "applied", _value("data"))


@query("WITH " + P.LOG + """, asked AS (SELECT address, seq, row_number() OVER (PARTITION BY address ORDER BY seq) AS n FROM log WHERE op = 'set')
SELECT address, seq, true AS applied, CAST(n AS DOUBLE) AS value, n AS revision FROM asked UNION ALL SELECT address, seq + 1000000000, false, CAST(n AS DOUBLE), n FROM asked""")
def set_if_revision(spark, sf_dir):
    """Each write comes twice with the revision that it has seen: the second time all have moved on, and it must fail."""
    log = T.change_log(spark, sf_dir).filter("op = 'set'")
    n = F.row_number().over(Window.partitionBy("address").orderBy("seq"))
    asked = log.select("address", "seq", n.alias("n")).select("address", "seq", F.lit("revision").alias("field"), F.lit(None).cast("double").alias("expect_le"), (F.col("n") - 1).cast("string").alias("expect_eq"), F.lit(None).cast("boolean").alias("expect_absent"), F.to_json(F.struct(F.col("n").alias("revision"), F.col("n").cast("double").alias("value"))).alias("set"))
    again = asked.withColumn("seq", F.col("seq") + F.lit(1_000_000_000))
    start = log.select("address").distinct().withColumn("data", F.lit('{"revision": 0}'))
    out = store.set_if(start, asked.union(again))
    # A second try leaves what all writes have left; the first one is told by its own revision.
    tried = asked.union(again).select("address", "seq", F.col("expect_eq").cast("bigint").alias("seen"))
    return out.join(tried, ["address", "seq"]).select("address", "seq", "applied", (F.col("seen") + 1).cast("double").alias("value"), (F.col("seen") + 1).alias("revision"))


@query("WITH " + P.LOG + " SELECT address, seq, CAST(CASE WHEN seq = min(seq) OVER (PARTITION BY address) THEN 200 ELSE 409 END AS INTEGER) AS status FROM log WHERE op = 'set'")
def node_claims(spark, sf_dir):
    return store.claims(T.change_log(spark, sf_dir).filter("op = 'set'"))


@query("WITH " + P.LOG + " SELECT address AS name, seq, CAST(sum(seq % 5 + 1) OVER w - (seq % 5 + 1) + 1 AS BIGINT) AS first_id, CAST(sum(seq % 5 + 1) OVER w AS BIGINT) AS last_id FROM log WHERE op = 'set' WINDOW w AS (PARTITION BY address ORDER BY seq)")
def sequence_blocks(spark, sf_dir):
    return store.sequence_blocks(T.change_log(spark, sf_dir).filter("op = 'set'").select(F.col("address").alias("name"), "seq", (F.col("seq") % 5 + 1).alias("size")))


_ORDERED = """WITH o AS (SELECT l_orderkey AS k, count(DISTINCT l_partkey) AS parts, bool_or(l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1),
t AS (SELECT k * 4 AS tx_id, CASE WHEN returned THEN 412 ELSE 200 END AS status, CASE WHEN returned THEN 0 ELSE 1 + 2 * parts END AS changed FROM o
UNION ALL SELECT k * 4 + 1, CASE WHEN returned THEN 200 ELSE 412 END, CASE WHEN returned THEN 1 ELSE 0 END FROM o
UNION ALL SELECT k * 4 + 2, 200, CASE WHEN returned THEN 0 ELSE parts END FROM o) """


@query(_ORDERED + "SELECT CAST(tx_id AS BIGINT) AS tx_id, CAST(status AS INTEGER) AS status, CAST(changed AS BIGINT) AS changed FROM t")
def transaction_fold(spark, sf_dir):
    """Each order's transactions: one creates the order, its parts and the edges to them, and fails if a line was returned (its claim finds no node);
    the next creates the order again, which works only if nothing is left of the first; the last clears the parts."""
    line = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.concat(F.lit("Part:"), "l_partkey").alias("part"), (F.col("l_returnflag") == "R").alias("returned"))
    order = F.concat(F.lit("Order:"), "k")
    op = lambda tx, position, kind, address, to=None: F.struct((F.col("k") * 4 + tx).alias("tx_id"), F.lit(position).alias("position"), F.lit(kind).alias("type"), address.alias("address"), (F.lit(None).cast("string") if to is None else to).alias("to"))
    rows = lambda of, made: of.select(F.col("k").cast("string").alias("scope"), F.explode(made).alias("o")).select("scope", "o.*", F.lit(None).cast("string").alias("expect_eq"), F.lit("{}").alias("set"))
    # A part of an order is one row, from which its operations are made after it is counted.
    parts = line.groupBy("k", "part").agg(F.count_if("returned").cast("int").alias("returned"))
    claims = F.array_repeat(op(0, 3, "claim", F.lit("Nobody:0")), F.col("returned"))
    return store.transactions(
        rows(parts, F.concat(F.array(op(0, 1, "insert_node", F.col("part")), op(0, 2, "insert_edge", order, F.col("part"))), claims))
        .union(rows(line.select("k").distinct(), F.array(op(0, 0, "create", order), op(1, 0, "create", order), op(2, 0, "clear_kind", F.lit("Part")))))
    )


@query("WITH " + P.NODES + ", " + P.EDGES + ", " + P.LOG + """, v AS (SELECT op, lead(seq) OVER (PARTITION BY address ORDER BY seq) IS NULL AS last FROM log WHERE op IN ('set', 'delete'))
SELECT (SELECT count(*) FROM store) AS node_count, (SELECT count(*) FROM edges) AS edge_count, (SELECT count(DISTINCT owner) FROM store) AS user_count, (SELECT count(*) FROM v WHERE op = 'set' AND NOT last) AS history_entries,
(SELECT count(*) FROM log WHERE op = 'read') AS reads_total, (SELECT count(*) FROM log WHERE op <> 'read') AS writes_total, (SELECT string_agg(kind || '=' || n, ',' ORDER BY kind) FROM (SELECT kind, count(*) AS n FROM store GROUP BY kind)) AS kinds""")
def engine_stats(spark, sf_dir):
    stats = store.engine_stats(_nodes(spark, sf_dir), T.store_edges(spark, sf_dir), T.change_log(spark, sf_dir))
    return stats.withColumn("kinds", F.array_join(F.transform("kinds", lambda k: F.concat_ws("=", k["kind"], k["count"])), ","))


@query("SELECT event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'Order' WHEN 1 THEN 'Customer' WHEN 2 THEN 'Part' WHEN 3 THEN 'Supplier' ELSE 'Nothing' END AS channel, CAST(CASE event_id % 5 WHEN 4 THEN NULL ELSE event_id % 5 + 1 END AS BIGINT) AS shard_id, CASE WHEN event_id % 5 = 4 THEN 'unmapped' END AS miss FROM events")
def published_messages(spark, sf_dir):
    """Each event published on a channel that belongs to one shard, or to none."""
    rules = spark.createDataFrame([("kind", k, i + 1) for i, k in enumerate(["Order", "Customer", "Part", "Supplier"])], keyspace.RULES)
    channels = F.array(*[F.lit(c) for c in ("Order", "Customer", "Part", "Supplier", "Nothing")])
    e = T.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.element_at(channels, (F.col("event_id") % 5 + 1).cast("int")).alias("channel"), F.col("props").alias("payload"))
    return store.published(e, rules).drop("payload")


@query("SELECT p_brand AS name, count(DISTINCT p_size % 3) = 3 AS everywhere, count(DISTINCT p_type) = 1 AS alike FROM part GROUP BY p_brand")
def declared_indexes(spark, sf_dir):
    """Brands as declarations that three backends list, with the part's type as what each says of them."""
    return store.declarations(T.table(spark, sf_dir, "part").select((F.col("p_size") % 3).alias("backend"), F.col("p_brand").alias("name"), F.col("p_type").alias("definition")), 3)


def _pair(spark, sf_dir):
    """The orders and a copy that misses some, differs in some, and has some of its own."""
    k = F.col("o_orderkey")
    o = T.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("Order:"), "o_orderkey").alias("address"), F.lit("Order").alias("kind"), F.concat(F.lit("Customer:"), "o_custkey").alias("owner"), F.col("o_orderstatus").alias("data"),
        F.struct((k % 12).alias("x"), (k % 13).alias("y")).alias("coordinate"), k.cast("bigint").alias("value"), F.when(k % 7 == 0, F.lit("worker")).alias("claimed_by"), F.lit("public").alias("visibility"),
    )
    copy = o.filter(k % 97 != 5).withColumns({
        "data": F.when(k % 89 == 7, "?").otherwise(F.col("data")), "owner": F.when(k % 83 == 11, "nobody").otherwise(F.col("owner")), "value": F.when(k % 79 == 3, k + 1).otherwise(F.col("value")),
        "coordinate": F.when(k % 73 == 2, F.struct((k % 12).alias("x"), (k % 13 + 1).alias("y"))).otherwise(F.col("coordinate")), "claimed_by": F.when(k % 71 == 0, None).otherwise(F.col("claimed_by")), "visibility": F.when(k % 67 == 1, "private").otherwise(F.col("visibility")),
    })
    ghosts = o.filter(k % 101 == 3).withColumn("address", F.concat(F.lit("Order:-"), "o_orderkey"))
    return o, copy.unionByName(ghosts)


_PAIR = """WITH source AS (SELECT o_orderkey AS k, 'Order:' || o_orderkey AS address, 'Order' AS kind, 'Customer:' || o_custkey AS owner, o_orderstatus AS data, o_orderkey AS value, o_orderkey % 13 AS y, CASE WHEN o_orderkey % 7 = 0 THEN 'worker' END AS claimed_by, 'public' AS visibility FROM orders),
copy AS (SELECT k, address, kind, CASE WHEN k % 83 = 11 THEN 'nobody' ELSE owner END AS owner, CASE WHEN k % 89 = 7 THEN '?' ELSE data END AS data, CASE WHEN k % 79 = 3 THEN value + 1 ELSE value END AS value, CASE WHEN k % 73 = 2 THEN y + 1 ELSE y END AS y,
  CASE WHEN k % 71 = 0 THEN NULL ELSE claimed_by END AS claimed_by, CASE WHEN k % 67 = 1 THEN 'private' ELSE visibility END AS visibility FROM source WHERE k % 97 <> 5
  UNION ALL SELECT k, 'Order:-' || k, kind, owner, data, value, y, claimed_by, visibility FROM source WHERE k % 101 = 3),
diff AS (SELECT address, CASE WHEN c.kind IS NULL THEN 'missing' WHEN s.kind IS NULL THEN 'extra' WHEN s.kind <> c.kind THEN 'kind' WHEN s.data <> c.data THEN 'data' WHEN s.y <> c.y THEN 'coordinate' WHEN s.value <> c.value THEN 'value' WHEN s.owner <> c.owner THEN 'owner'
  WHEN s.claimed_by IS DISTINCT FROM c.claimed_by THEN 'claimed_by' WHEN s.visibility <> c.visibility THEN 'visibility' END AS difference FROM source s FULL JOIN copy c USING (address)) """


@query("WITH e AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), a AS (SELECT o_orderkey % 25 AS cell, n FROM orders LEFT JOIN e ON l_orderkey = o_orderkey UNION ALL SELECT 25 + p_partkey % 25, NULL FROM part) SELECT CAST(cell AS BIGINT) AS cell, CAST(coalesce(sum(n), 0) AS BIGINT) AS edges, CASE WHEN sum(n) > 0 THEN 'holds_edges' END AS refusal FROM a GROUP BY cell")
def copy_refusals(spark, sf_dir):
    """Cells of orders, which have edges to parts, and cells of parts, which have none."""
    orders = T.table(spark, sf_dir, "orders").select(F.concat(F.lit("Order:"), "o_orderkey").alias("address"), (F.col("o_orderkey") % 25).cast("bigint").alias("cell"))
    parts = T.table(spark, sf_dir, "part").select(F.concat(F.lit("Part:"), "p_partkey").alias("address"), (F.col("p_partkey") % 25 + 25).cast("bigint").alias("cell"))
    return diffsync.copy_refusal(orders.union(parts), T.store_edges(spark, sf_dir))


@query(_PAIR + "SELECT address, difference FROM diff WHERE difference IS NOT NULL")
def copy_diff(spark, sf_dir):
    return diffsync.copy_diff(*_pair(spark, sf_dir))


@query(_PAIR + "SELECT (SELECT count(*) FROM source) AS source_rows, (SELECT count(*) FROM copy) AS copy_rows, CASE WHEN (SELECT count(*) FROM source) <> (SELECT count(*) FROM copy) THEN 'count' ELSE (SELECT arg_min(difference, address) || ':' || min(address) FROM diff WHERE difference IS NOT NULL) END AS reason")
def copy_verify(spark, sf_dir):
    return diffsync.verify(*_pair(spark, sf_dir))


@query(_PAIR + ", dirty AS (SELECT address FROM diff WHERE difference IS NOT NULL UNION ALL SELECT 'Order:x' || i FROM range(5) t(i)) SELECT address, CASE WHEN address IN (SELECT address FROM source) THEN 'upsert' WHEN address IN (SELECT address FROM copy) THEN 'delete' ELSE 'none' END AS op FROM dirty")
def reconcile_ops(spark, sf_dir):
    source, copy = _pair(spark, sf_dir)
    dirty = diffsync.copy_diff(source, copy).select("address").union(spark.range(5).select(F.concat(F.lit("Order:x"), "id").alias("address")))
    return diffsync.reconcile(dirty, source, copy)


@query("SELECT event_id AS seq, unnest(CASE WHEN event_id % 3 = 0 THEN ['User:' || user_id, 'User:' || (user_id + 1)] ELSE ['User:' || user_id] END) AS address FROM events WHERE event_id % 4 <> 1")
def changed_addresses(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    me, next_ = F.concat(F.lit("User:"), "user_id"), F.concat(F.lit("User:"), F.col("user_id") + 1)
    frames = e.select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 4 == 1, "edge_created").when(F.col("event_id") % 3 == 0, "transaction_committed").otherwise("node_updated").alias("event"),
        F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.array(me, next_).alias("addresses")))).otherwise(F.to_json(F.struct(me.alias("address")))).alias("data"),
    )
    return diffsync.changed_addresses(frames)


@query("SELECT count(*) AS rows, sum(strlen(o_orderstatus)) AS bytes FROM orders")
def stored_bytes(spark, sf_dir):
    return diffsync.stored_bytes(_pair(spark, sf_dir)[0])
