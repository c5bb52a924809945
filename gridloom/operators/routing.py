"""Who serves a cell: owners, replicas, migrations and segments of ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import grid


def owners(topology: DataFrame, overrides: DataFrame) -> DataFrame:
    """shard_id, cell_index and node of all cells of every shard.

    `topology` has shard_id, node_id and position (the first listing owns the shard); `overrides`
    have shard_id, x, y and node_id, and win over the shard's owner.
    """
    of_shard = topology.groupBy("shard_id").agg(F.min_by("node_id", "position").alias("shard_owner"))
    cells = of_shard.withColumn("cell_index", F.explode(F.sequence(F.lit(0), F.lit(grid.CELLS - 1))))
    own = overrides.select("shard_id", grid.cell_index(F.col("x"), F.col("y")).alias("cell_index"), F.col("node_id").alias("moved_to"))
    return cells.join(own, ["shard_id", "cell_index"], "left").select("shard_id", "cell_index", F.coalesce("moved_to", "shard_owner").alias("node_id"))


def segments(served: DataFrame, keys: list[str] = ["shard_id"]) -> DataFrame:  # noqa: B006
    """Runs of consecutive cells with the same node and role: keys, segment (from 1), node_id, served_by, first_cell, last_cell, cells."""
    by = Window.partitionBy(*keys).orderBy("cell_index")
    role = F.struct("node_id", "served_by")
    new = (~role.eqNullSafe(F.lag(role).over(by))).cast("int")
    rows = served.withColumn("_new", F.coalesce(new, F.lit(1))).withColumn("segment", F.sum("_new").over(by))
    return rows.groupBy(*keys, "segment").agg(F.min("node_id").alias("node_id"), F.min("served_by").alias("served_by"), F.min("cell_index").alias("first_cell"), F.max("cell_index").alias("last_cell"), F.count("*").alias("cells"))


def checked(served: DataFrame, error: str = "error") -> DataFrame:
    """All or nothing: fails on the first row that has an error."""
    return served.withColumn(error, F.when(F.col(error).isNotNull(), F.raise_error(F.concat(F.lit("routing: "), F.col(error)))))


def published(topology: DataFrame, overrides: DataFrame, migrations: DataFrame) -> DataFrame:
    """shard_id, x, y (null: the whole shard) and node_id: owners and overrides after migrations (shard_id, x, y, destination, phase, has_cut_over).

    A migration that has ended after its cutover folds into the owner of what it moved: a shard's entry, or a cell's override.
    Of several of one scope the one with the highest seq counts.
    """
    scope = ["shard_id", "x", "y"]
    ended = migrations.filter(F.col("has_cut_over") & F.col("phase").isin("cleanup", "completed", "aborted", "failed"))
    last = ended.groupBy(*scope).agg(F.max_by("destination", "seq").alias("moved_to"))
    entry = topology.groupBy("shard_id").agg(F.min_by("node_id", "position").alias("node_id")).select("shard_id", F.lit(None).cast("int").alias("x"), F.lit(None).cast("int").alias("y"), "node_id")
    held = entry.unionByName(overrides.select(*scope, "node_id"))
    same = [F.col(f"h.{c}").eqNullSafe(F.col(f"m.{c}")) for c in scope]
    both = held.alias("h").join(last.alias("m"), same[0] & same[1] & same[2], "full_outer")
    return both.select(*[F.coalesce(f"h.{c}", f"m.{c}").alias(c) for c in scope], F.coalesce("m.moved_to", "h.node_id").alias("node_id"))


def scoped(cells: DataFrame, of_cell: DataFrame, of_shard: DataFrame, columns: list[str]) -> DataFrame:
    """`cells` (shard_id, x, y) with `columns` of the cell's own replica sets or migrations, which win as a whole over the shard's; `cell_scope` tells which."""
    own = of_cell.select("shard_id", "x", "y", F.lit(True).alias("cell_scope"), *columns)
    rest = cells.join(of_cell.select("shard_id", "x", "y").distinct(), ["shard_id", "x", "y"], "left_anti")
    by_shard = rest.join(of_shard.select("shard_id", F.lit(False).alias("cell_scope"), *columns), "shard_id", "left").select("shard_id", "x", "y", F.coalesce("cell_scope", F.lit(False)).alias("cell_scope"), *columns)
    return cells.join(own, ["shard_id", "x", "y"]).select("shard_id", "x", "y", "cell_scope", *columns).unionByName(by_shard)


def routable(availability: Column, require_proven_health: bool = False) -> Column:
    return F.when(availability == "serviceable", True).when(availability == "unreachable", False).otherwise(not require_proven_health)


def write_targets(entries: DataFrame, replicas: DataFrame, migrations: DataFrame) -> DataFrame:
    """shard_id, node_id, served_by, error: where each shard's writes go.

    `entries` has shard_id, owner; `replicas` shard_id, node_id, role, state; `migrations` shard_id, source,
    destination, write_owner (null while fenced). A migration counts only if the copy that takes writes moves.
    """
    primary = replicas.groupBy("shard_id").agg(F.min(F.when(F.col("role") == "primary", F.col("node_id"))).alias("primary"), F.min(F.when((F.col("role") == "primary") & (F.col("state") == "in_sync"), F.col("node_id"))).alias("writable"))
    sets = replicas.select("shard_id").distinct().withColumn("with_set", F.lit(True))
    rows = entries.join(primary, "shard_id", "left").join(migrations, "shard_id", "left").join(sets, "shard_id", "left")
    takes_writes = F.col("primary").isNull() | (F.col("primary") == F.col("source")) | (F.col("primary") == F.col("destination"))
    moving = F.col("source").isNotNull() & takes_writes
    with_set = F.coalesce("with_set", F.lit(False))
    error = F.when(moving & F.col("write_owner").isNull(), "write_fenced").when(~moving & with_set & F.col("writable").isNull(), "no_writable_replica")
    node = F.when(moving, F.col("write_owner")).when(with_set, F.col("writable")).otherwise(F.col("owner"))
    served = F.when(moving, F.when(F.col("write_owner") == F.col("destination"), "migration_destination").otherwise("migration_source")).when(with_set, "primary").otherwise("shard_owner")
    return rows.select("shard_id", F.when(error.isNull(), node).alias("node_id"), F.when(error.isNull(), served).alias("served_by"), error.alias("error"))


def _order(first: Column, second: Column, node: Column) -> Column:
    return F.struct(first.alias("first"), second.alias("second"), node.alias("node")).alias("key")


def read_candidates(entries: DataFrame, replicas: DataFrame, migrations: DataFrame, preference: str = "any_fresh", region: str | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """shard_id, rank, node_id, served_by and error of the nodes a read may go to, best first; a shard of `entries` with none has one row with no_readable_replica.

    preference: primary, any_fresh, any_copy, or prefer_region (fresh ones, those of `region` first). Before a
    migration's cutover its destination serves no read; after it the source serves none and the destination is first
    if it was no candidate yet. Where a node lies is what `nodes` (node_id, region) say of it, needed for prefer_region only.
    """
    fresh = F.col("state") == "in_sync"
    readable = {"primary": fresh & (F.col("role") == "primary"), "any_copy": F.col("state").isin("in_sync", "lagging")}.get(preference, fresh)
    of_set = replicas.filter(readable).select("shard_id", "node_id", "region", F.when(F.col("role") == "primary", "primary").otherwise("secondary").alias("served_by"), _order((F.col("role") != "primary").cast("int"), (~fresh).cast("int"), F.col("node_id")))
    with_set = replicas.select("shard_id").distinct()
    alone = entries.join(with_set, "shard_id", "left_anti").select("shard_id", F.col("owner").alias("node_id"), F.col("region"), F.lit("shard_owner").alias("served_by"), _order(F.lit(0), F.lit(0), F.col("owner")))
    base = of_set.unionByName(alone).join(migrations.select("shard_id", "source", "destination", "has_cut_over"), "shard_id", "left")
    cut = F.coalesce("has_cut_over", F.lit(False))
    moving = F.col("source").isNotNull()
    left_out = moving & F.when(cut, F.col("node_id") == F.col("source")).otherwise(F.col("node_id") == F.col("destination"))
    stays = base.filter(~left_out).withColumn("served_by", F.when(moving & cut & (F.col("node_id") == F.col("destination")), "migration_destination").when(moving & ~cut & (F.col("node_id") == F.col("source")), "migration_source").otherwise(F.col("served_by")))
    have = stays.groupBy("shard_id").agg(F.collect_set("node_id").alias("nodes"))
    extra = migrations.join(have, "shard_id", "left").withColumn("nodes", F.coalesce("nodes", F.array().cast("array<string>")))
    front = extra.filter(F.col("has_cut_over") & ~F.array_contains("nodes", F.col("destination"))).select("shard_id", F.col("destination").alias("node_id"), F.lit("migration_destination").alias("served_by"))
    last = extra.filter(~F.col("has_cut_over") & (F.size("nodes") == 0)).select("shard_id", F.col("source").alias("node_id"), F.lit("migration_source").alias("served_by"))
    added = front.union(last).select("shard_id", "node_id", "served_by", _order(F.lit(-1), F.lit(0), F.col("node_id")))
    rows = stays.select("shard_id", "node_id", "served_by", "key").unionByName(added)
    near = F.lit(0)
    if preference == "prefer_region":
        rows = rows.join(nodes.select("node_id", F.col("region").alias("lies_in")), "node_id", "left")
        near = (~F.coalesce(F.col("lies_in") == region, F.lit(False))).cast("int")
    rank = F.row_number().over(Window.partitionBy("shard_id").orderBy(near, "key")).cast("bigint")
    ranked = rows.select("shard_id", rank.alias("rank"), "node_id", "served_by")
    out = entries.select("shard_id").distinct().join(ranked, "shard_id", "left")
    return out.withColumn("error", F.when(F.col("node_id").isNull(), "no_readable_replica"))


def routes(candidates: DataFrame, nodes: DataFrame, require_proven_health: bool = False) -> DataFrame:
    """Candidates with routable, and per shard the error if none is: its own, unknown_node for a single one that the fleet lacks, else no_live_owner."""
    known = nodes.select("node_id", "availability", F.lit(True).alias("known"))
    rows = candidates.join(known, "node_id", "left").withColumn("routable", F.coalesce("known", F.lit(False)) & routable(F.col("availability"), require_proven_health))
    by = Window.partitionBy("shard_id")
    none = F.max(F.col("routable").cast("int")).over(by) == 0
    lone = (F.count("*").over(by) == 1) & F.col("known").isNull()
    return rows.withColumn("error", F.coalesce("error", F.when(none & lone, "unknown_node").when(none, "no_live_owner"))).select("shard_id", "rank", "node_id", "served_by", "routable", "error")
