"""Copies of a cell: field-by-field comparison and catching up from a change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: In the order in which a difference is reported.
FIELDS = ["kind", "data", "coordinate", "value", "owner", "claimed_by", "visibility"]
#: Change frames that name addresses; any other frame names none.
SINGLE = ["node_created", "node_updated", "node_deleted", "node_claimed"]


def copy_diff(source: DataFrame, copy: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """address and difference (missing, extra, or the first field that differs) of rows that aren't equal; by default of all FIELDS that both have."""
    fields = fields or [f for f in FIELDS if f in source.columns and f in copy.columns]
    both = source.select("address", F.struct(*fields).alias("s")).join(copy.select("address", F.struct(*fields).alias("c")), "address", "full_outer")
    what = F.when(F.col("c").isNull(), "missing").when(F.col("s").isNull(), "extra")
    for f in fields:
        what = what.when(~F.col(f"s.{f}").eqNullSafe(F.col(f"c.{f}")), f)
    return both.select("address", what.alias("difference")).filter("difference is not null")


def verify(source: DataFrame, copy: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One row: rows on both sides and what is reported first: a different count, else the first differing address and field."""
    counts = source.agg(F.count("*").alias("source_rows")).join(copy.agg(F.count("*").alias("copy_rows")))
    first = copy_diff(source, copy, fields).agg(F.min(F.struct("address", "difference")).alias("d"))
    reason = F.when(F.col("source_rows") != F.col("copy_rows"), "count").when(F.col("d").isNotNull(), F.concat_ws(":", "d.difference", "d.address"))
    return counts.join(first).select("source_rows", "copy_rows", reason.alias("reason"))


def reconcile(dirty: DataFrame, source: DataFrame, copy: DataFrame) -> DataFrame:
    """address and op for each dirty address once: upsert if the source has it, delete if only the copy has, else none."""
    own = dirty.select("address").distinct()
    rows = own.join(source.select("address", F.lit(True).alias("here")), "address", "left").join(copy.select("address", F.lit(True).alias("there")), "address", "left")
    return rows.select("address", F.when(F.col("here"), "upsert").when(F.col("there"), "delete").otherwise("none").alias("op"))


def changed_addresses(frames: DataFrame) -> DataFrame:
    """seq and address of each address that a frame (seq, event, data: JSON) names."""
    one, many = F.get_json_object("data", "$.address"), F.from_json(F.get_json_object("data", "$.addresses"), "array<string>")
    named = F.when(F.col("event").isin(SINGLE), F.array(one)).when(F.col("event") == "transaction_committed", many)
    return frames.select("seq", F.explode(F.array_compact(named)).alias("address"))


def stored_bytes(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("rows"), F.sum(F.octet_length("data")).alias("bytes"))


def copy_refusal(nodes: DataFrame, edges: DataFrame, cell: str = "cell") -> DataFrame:
    """cell, edges and refusal of every cell of nodes (address, cell): one that holds the beginning of an edge can't be copied, since an edge out of it has no other end there."""
    held = nodes.select("address", cell).join(edges.groupBy(F.col("from").alias("address")).agg(F.count("*").alias("n")), "address", "left")
    total = held.groupBy(cell).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"))
    return total.withColumn("refusal", F.when(F.col("edges") > 0, "holds_edges"))
