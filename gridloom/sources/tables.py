"""The engine's inputs derived from star-schema tables: telemetry, fleet, store, counters, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READS, WRITES = ["view", "click", "error"], ["signup", "purchase"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shard_id, node_id, region: a node for each shard."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("bigint").alias("shard_id"), F.col("n_name").alias("node_id"), F.col("r_name").alias("region"))


def cell_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample per cell and day; `seq` is its arrival."""
    kind, cents = F.col("event_type"), F.floor(F.col("value") * 100 + 0.5).cast("bigint")
    days = (
        table(spark, sf_dir, "events")
        .withColumn("shard_id", F.col("user_id") % 25)
        .withColumn("cell_index", (F.floor(F.col("user_id") / 25) % 156).cast("int"))
        .groupBy("shard_id", "cell_index", F.date_trunc("day", "ts").alias("day"))
        .agg(
            F.max("event_id").alias("seq"),
            F.unix_millis(F.max(F.col("ts").cast("timestamp"))).alias("timestamp_ms"),
            F.count_if(kind.isin(READS)).cast("double").alias("reads"),
            F.count_if(kind.isin(WRITES)).cast("double").alias("writes"),
            F.least(F.lit(1.0), F.sum(cents) / F.lit(30000.0)).alias("cpu_utilization"),
            F.least(F.lit(1.0), F.max("value") / 250.0).alias("memory_utilization"),
            F.coalesce(F.max(F.when(kind.isin(READS), F.col("value"))) * 400.0, F.lit(0.0)).alias("read_latency_us"),
            F.coalesce(F.max(F.when(kind.isin(WRITES), F.col("value"))) * 400.0, F.lit(0.0)).alias("write_latency_us"),
            (F.count_if(kind == "error") * 5000).cast("bigint").alias("queue_depth"),
        )
    )
    return days.join(F.broadcast(regions(spark, sf_dir)), "shard_id").withColumn("x", F.col("cell_index") % 12).withColumn("y", F.floor(F.col("cell_index") / 12).cast("int"))


def fleet_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, region, condition and capacity of each node."""
    k = F.col("shard_id")
    condition = F.when(k % 11 == 10, "unreachable").when(k % 7 == 6, "degraded").otherwise("healthy")
    return regions(spark, sf_dir).select("shard_id", "node_id", "region", condition.alias("condition"), F.lit(64).cast("bigint").alias("capacity"))


def store_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """address, kind, owner, data (JSON) and the numeric fields of the store's nodes."""
    t = lambda name: table(spark, sf_dir, name)
    nation = F.broadcast(t("nation").select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("nation")))
    orders = t("orders").select(F.concat(F.lit("Order:"), "o_orderkey").alias("address"), F.lit("Order").alias("kind"), F.concat(F.lit("Customer:"), "o_custkey").alias("owner"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("double").alias("amount"), F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("double").alias("total"), F.col("o_orderpriority").alias("priority"))).alias("data"))
    customers = t("customer").join(nation, F.col("c_nationkey") == F.col("nk")).select(F.concat(F.lit("Customer:"), "c_custkey").alias("address"), F.lit("Customer").alias("kind"), F.col("nation").alias("owner"), F.col("c_mktsegment").alias("status"), F.col("c_acctbal").cast("double").alias("amount"), F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").cast("double").alias("balance"))).alias("data"))
    parts = t("part").select(F.concat(F.lit("Part:"), "p_partkey").alias("address"), F.lit("Part").alias("kind"), F.col("p_brand").alias("owner"), F.col("p_type").alias("status"), F.col("p_retailprice").cast("double").alias("amount"), F.to_json(F.struct(F.col("p_type").alias("type"), F.col("p_size").alias("size"), F.col("p_retailprice").cast("double").alias("price"))).alias("data"))
    suppliers = t("supplier").join(nation, F.col("s_nationkey") == F.col("nk")).select(F.concat(F.lit("Supplier:"), "s_suppkey").alias("address"), F.lit("Supplier").alias("kind"), F.col("nation").alias("owner"), F.lit(None).cast("string").alias("status"), F.col("s_acctbal").cast("double").alias("amount"), F.to_json(F.struct(F.col("s_acctbal").cast("double").alias("balance"))).alias("data"))
    return orders.unionByName(customers).unionByName(parts).unionByName(suppliers)


def store_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("Order:"), "l_orderkey").alias("from"), F.concat(F.lit("Part:"), "l_partkey").alias("to"), F.lit("contains").alias("kind"))


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, address, op (set, read, delete) and value of every event, in order of arrival."""
    kind = F.col("event_type")
    op = F.when(kind.isin("signup", "purchase"), "set").when(kind.isin("view", "click"), "read").otherwise("delete")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("User:"), "user_id").alias("address"), F.col("user_id"), op.alias("op"), F.col("value"))


def counter_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node's cumulative counters at the end of each day; every tenth of its days they start anew."""
    from pyspark.sql.window import Window

    days = (
        table(spark, sf_dir, "events").join(F.broadcast(regions(spark, sf_dir)), F.col("user_id") % 25 == F.col("shard_id"))
        .groupBy("node_id", F.date_trunc("day", "ts").alias("day"))
        .agg(F.count_if(F.col("event_type").isin(READS)).alias("r"), F.count_if(F.col("event_type").isin(WRITES)).alias("w"), F.count_if(F.col("event_type") == "error").alias("errors"))
    )
    by_day = Window.partitionBy("node_id").orderBy("day")
    era = Window.partitionBy("node_id", "era").orderBy("day")
    numbered = days.withColumn("day_no", F.row_number().over(by_day) - 1).withColumn("era", F.floor(F.col("day_no") / 10))
    return numbered.select("node_id", F.col("day_no").cast("bigint").alias("day_no"), F.unix_millis("day").alias("taken_at_ms"), F.sum("r").over(era).alias("reads_total"), F.sum("w").over(era).alias("writes_total"), F.col("errors").alias("in_flight"), F.lit(8).cast("bigint").alias("max_concurrent"))
