"""Which routing key an address or a kind belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = "rule string, pattern string, shard_id bigint"  # rule: kind, prefix or fallback


def conflicts(rules: DataFrame) -> DataFrame:
    """rule, pattern and problem (empty or duplicate) of rules that a keyspace can't have."""
    empty = rules.filter("rule <> 'fallback' and trim(pattern) = ''").select("rule", "pattern", F.lit("empty").alias("problem"))
    double = rules.filter("rule <> 'fallback'").groupBy("rule", "pattern").count().filter("count > 1").select("rule", "pattern", F.lit("duplicate").alias("problem"))
    return empty.union(double)


def prefix_lengths(rules: DataFrame) -> list[int]:
    """The distinct lengths of the prefixes, longest first; as many as the declaration has, not the data."""
    return sorted((r[0] for r in rules.filter("rule = 'prefix'").select(F.length("pattern")).distinct().collect()), reverse=True)


def resolve(rows: DataFrame, rules: DataFrame, kind: str = "kind", address: str = "address") -> DataFrame:
    """`rows` with by_kind, by_prefix (longest match), shard_id and miss.

    Both found and different: inconsistent. The kind's key wins if it is the only one or equal;
    neither: the fallback, else unmapped. A prefix is found by equality of an address's beginnings
    of each length that the rules have, so every lookup is a hash join.
    """
    kinds = rules.filter("rule = 'kind'").select(F.col("pattern").alias("_k"), F.col("shard_id").alias("by_kind"))
    out = rows.join(F.broadcast(kinds), F.col(kind) == F.col("_k"), "left").drop("_k")
    found: list[Column] = []
    for n in prefix_lengths(rules):
        own = rules.filter((F.col("rule") == "prefix") & (F.length("pattern") == n)).select(F.col("pattern").alias("_p"), F.col("shard_id").alias(f"_s{n}"))
        out = out.join(F.broadcast(own), F.substring(address, 1, n) == F.col("_p"), "left").drop("_p")
        found.append(F.col(f"_s{n}"))
    out = out.withColumn("by_prefix", F.coalesce(*found) if found else F.lit(None).cast("bigint")).drop(*[f"_s{n}" for n in prefix_lengths(rules)])
    fallback = rules.filter("rule = 'fallback'").agg(F.min("shard_id").alias("_fallback"))
    out = out.join(F.broadcast(fallback))
    differ = F.col("by_kind").isNotNull() & F.col("by_prefix").isNotNull() & (F.col("by_kind") != F.col("by_prefix"))
    key = F.coalesce("by_kind", "by_prefix", "_fallback")
    return out.withColumn("miss", F.when(differ, "inconsistent").when(key.isNull(), "unmapped")).withColumn("shard_id", F.when(F.col("miss").isNull(), key)).drop("_fallback")


def spanning_key(rules: DataFrame) -> DataFrame:
    """One row: the key that every rule and the fallback have, else null."""
    fallback, low, high = F.min(F.when(F.col("rule") == "fallback", F.col("shard_id"))), F.min("shard_id"), F.max("shard_id")
    return rules.agg(F.when(fallback.isNotNull() & (low == high), fallback).alias("spanning_key"))


def in_scope(rows: DataFrame, rules: DataFrame, shard_id: int) -> DataFrame:
    """`rows` with in_scope: whether the shard's kinds or prefixes name the row, or, if it holds the fallback, no other rule does."""
    own = rules.filter(F.col("shard_id") == shard_id)
    other = rules.filter((F.col("shard_id") != shard_id) & (F.col("rule") != "fallback"))
    lists = lambda r, name: r.agg(F.collect_set(F.when(F.col("rule") == "kind", F.col("pattern"))).alias(f"{name}_kinds"), F.collect_set(F.when(F.col("rule") == "prefix", F.col("pattern"))).alias(f"{name}_prefixes"), F.max((F.col("rule") == "fallback").cast("int")).alias(f"{name}_catch"))
    out = rows.join(F.broadcast(lists(own, "own"))).join(F.broadcast(lists(other, "other")))
    hit = lambda name: F.array_contains(f"{name}_kinds", F.col("kind")) | F.exists(f"{name}_prefixes", lambda p: F.col("address").startswith(p))
    return out.withColumn("in_scope", hit("own") | ((F.coalesce("own_catch", F.lit(0)) == 1) & ~hit("other"))).select(*rows.columns, "in_scope")
