"""The 12 x 13 grid of cells and routing keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT = 12, 13
CELLS = WIDTH * HEIGHT


def cell_index(x: Column, y: Column) -> Column:
    return y * WIDTH + x


def on_grid(x: Column, y: Column) -> Column:
    return x.between(0, WIDTH - 1) & y.between(0, HEIGHT - 1)


def grid(spark: SparkSession) -> DataFrame:
    """atom_id, cell_index, x, y of every cell, row by row."""
    i = F.col("id").cast("int")
    return spark.range(CELLS).select(F.concat(F.lit("atom-"), "id").alias("atom_id"), i.alias("cell_index"), (i % WIDTH).alias("x"), F.floor(i / WIDTH).cast("int").alias("y"))


def parse_key(text: Column) -> Column:
    """A struct (shard_id, x, y, error) of a routing key `<shard>/<x>,<y>`; white space around the parts doesn't count, a plus sign before a number is allowed.

    The error is null, or the first of: missing_slash, missing_comma, bad_shard, bad_x, bad_y, off_grid. Shard numbers go up to 2^63 - 1.
    """
    # Each part is bound once: written out, the error's conditions would be evaluated anew for every field.
    bound = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    after = lambda c, mark: F.substr(c, F.instr(c, mark) + 1)
    number = lambda part: F.when(part.rlike(r"^\+?[0-9]+\z"), F.regexp_replace(part, r"^\+", "").try_cast("bigint"))
    byte = lambda n: F.when(n <= 255, n.cast("int"))
    cell = after(text, "/")
    parts = F.array(*[strip(c) for c in (F.substring_index(text, "/", 1), F.substring_index(cell, ",", 1), after(cell, ","))])

    def fields(n: Column) -> Column:
        shard_id, x, y = n[0], byte(n[1]), byte(n[2])
        error = (
            F.when(text.isNull() | ~text.contains("/"), "missing_slash")
            .when(~cell.contains(","), "missing_comma")
            .when(shard_id.isNull(), "bad_shard")
            .when(x.isNull(), "bad_x")
            .when(y.isNull(), "bad_y")
            .when(~on_grid(x, y), "off_grid")
        )

        def kept(e: Column) -> Column:
            keep = lambda c: F.when(e.isNull(), c)
            return F.struct(keep(shard_id).alias("shard_id"), keep(x).alias("x"), keep(y).alias("y"), e.alias("error"))

        return bound(error, kept)

    return bound(F.transform(parts, number), fields)
