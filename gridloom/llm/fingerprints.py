"""Document fingerprints: threshold-scaled sketches of word shingles, in built-in functions only.

A sketch retains every shingle hash below a fixed fraction of the hash range (the first
hexadecimal digit below THRESHOLD: an eighth), whatever the text's length, and in any case the
LEAST smallest ones, so that a short text's sketch is its whole set. All that is below a
sketch's `reach` is in it: two sketches are compared below the smaller of their reaches, where
both are complete. So a contained text's containment is always 1, sets of fewer than LEAST shingles
are compared exactly, and `merged` gives the sketch of the union itself.

Hashes are the first 16 digits of MD5 as text, whose order is that of the numbers: any SQL
engine can repeat them.

Defined cases: a null text is empty; a text without words has the fingerprint '' and is alike
(1.0) only to another such text; fewer than five words are one shingle; repeated shingles count
once; a containment for which no retained hash speaks is 1.0 (nothing speaks against it);
rows with equal or null doc_id are each kept (null first, equal ids in the order of
their texts); the document after the last is the first, a single document is its own next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .columns import partitions

WIDTH = 5
LEAST = 16
THRESHOLD = "2"
_ALL = "~"  # greater than every hash
_SPACES = r"[ \t\n\x0B\f\r]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPACES), lambda w: w != "")


def _hash(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 16)


def shingles(words: Column) -> Column:
    """The hash of each run of five words; of all words if there are fewer."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), n - WIDTH), lambda i: _hash(F.concat_ws(" ", *[F.get(words, i + k) for k in range(WIDTH)])))
    return F.when(n >= WIDTH, runs).when(n > 0, F.array(_hash(F.array_join(words, " ")))).otherwise(F.array().cast("array<string>"))


def _retained(values: Column, low: Column) -> Column:
    return F.when(F.size(low) >= LEAST, F.array_sort(low)).otherwise(F.slice(F.array_sort(F.array_distinct(values)), 1, LEAST))


def retained(values: Column) -> Column:
    """The sorted sketch of shingle hashes."""
    return _retained(values, F.array_distinct(F.filter(values, lambda h: h < THRESHOLD)))


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """`df` with the sketch of a text column (array<string>) under `name`."""
    steps = df.withColumn(f"{name}_w", words_of(F.coalesce(F.col(text), F.lit(""))))
    steps = steps.withColumn(f"{name}_w", shingles(F.col(f"{name}_w")))
    steps = steps.withColumn(f"{name}_l", F.array_distinct(F.filter(f"{name}_w", lambda h: h < THRESHOLD)))
    return steps.withColumn(name, _retained(F.col(f"{name}_w"), F.col(f"{name}_l"))).drop(f"{name}_w", f"{name}_l")


def fingerprint(sketch: Column) -> Column:
    """The sketch as text: 16 hexadecimal digits a hash, in ascending order."""
    return F.array_join(sketch, "")


def reach(sketch: Column) -> Column:
    """Up to where a sketch holds every hash of its text."""
    last = F.element_at(sketch, -1)
    return F.when(F.size(sketch) < LEAST, F.lit(_ALL)).otherwise(F.greatest(F.lit(THRESHOLD), last))


def _part(a: Column, b: Column, whole) -> Column:
    """Of the hashes that `whole` gives of both sketches within their common reach, the share that both have; 1 if there are none."""
    # A variable of a lambda is worked out once, not for each hash.
    count = lambda hashes, limit: F.size(F.filter(hashes, lambda h: h <= limit))
    found = F.transform(F.array(F.least(reach(a), reach(b))), lambda limit: F.struct(count(F.array_intersect(a, b), limit).alias("both"), count(whole(a, b), limit).alias("of")))
    found = F.transform(found, lambda x: F.when(x["of"] == 0, F.lit(1.0)).otherwise(x["both"] / x["of"]))
    return F.element_at(found, 1)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches."""
    return _part(a, b, F.array_union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has."""
    return _part(a, b, lambda x, _: x)


def merged(a: Column, b: Column) -> Column:
    """The sketch of both documents together."""
    return retained(F.array_union(a, b))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Each row with `next_<column>` of the row that follows by doc_id, cyclically.

    The ids are cut into a few ranges for each shuffle partition, at values that occur among
    them, so the first row of each range is known. It is dealt to the range before it
    as well, and there the row that follows any other is a window's next one. No task sees
    more than a range, and the texts are shuffled once.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    n = 4 * partitions(spark)
    found = docs.select(key.alias("k")).agg(F.min("k").alias("low"), F.percentile_approx("k", F.array(*[F.lit(i / n) for i in range(n)]), F.lit(10000)).alias("cut")).first()
    if found["low"] is None:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    low = found["low"]
    cuts = sorted({c for c in found["cut"] if c > low})
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    rows = docs.withColumn("_k", key)
    rows = rows.withColumn("_range", F.size(F.filter(bounds, lambda b: b <= F.col("_k"))))
    own = F.struct(F.col("_range"), F.lit(0).alias("ahead"))
    ahead = F.when(F.col("_k") == low, F.struct(F.lit(len(cuts)).alias("_range"), F.lit(1).alias("ahead")))
    if cuts:
        ahead = ahead.when(F.array_contains(bounds, F.col("_k")), F.struct((F.col("_range") - 1).alias("_range"), F.lit(1).alias("ahead")))
    dealt = rows.withColumn("_at", F.explode(F.array_compact(F.array(own, ahead))))
    dealt = dealt.select("*", F.col("_at._range").alias("_in"), F.col("_at.ahead").alias("_ahead")).drop("_range", "_at")
    order = Window.partitionBy("_in").orderBy("_ahead", "_k", "text")
    return dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).filter("_ahead = 0").drop("_k", "_in", "_ahead")


def with_edited(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_chars, sketch, edited (the last half replaced by the start of the next text) and next_sketch."""
    rows = with_sketch(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")), "text", "sketch")
    rows = with_next(rows, ["text", "sketch"])
    n = F.char_length("text").cast("bigint")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half))
    return rows.select("doc_id", n.alias("n_chars"), "sketch", edited.alias("edited"), "next_sketch")
