"""One query for each operator, over whole tables with production parameters."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import columns as C

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def oracle(name: str, sql: str) -> None:
    """DuckDB SQL for the rows of a query."""
    ORACLES[name] = sql


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify, train

    docs = documents(spark, sf_dir).withColumn("held_out", C.fold_of() == 0)
    model = train(docs.filter(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model)


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), with_ids=False).drop("ids")


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


@query
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import fingerprints as P

    rows = P.with_sketch(P.with_edited(documents(spark, sf_dir)).withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_sketch")
    own, edited = F.col("sketch"), F.col("edited_sketch")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        P.fingerprint(own).alias("fingerprint"),
        P.fingerprint(edited).alias("edited_fingerprint"),
        P.likeness(own, edited).alias("near_edited"),
        P.likeness(own, F.col("next_sketch")).alias("near_next"),
        P.containment(own, edited).alias("contained_in_edited"),
    )


_SKETCH = """
CASE WHEN len(list_distinct(list_filter({s}, lambda h: h < '2'))) >= 16 THEN list_sort(list_distinct(list_filter({s}, lambda h: h < '2')))
     ELSE list_sort(list_distinct({s}))[1:16] END"""
_SHINGLES = """
CASE WHEN len({w}) >= 5 THEN list_transform(range(1, len({w}) - 3), lambda i: substr(md5({w}[i] || ' ' || {w}[i+1] || ' ' || {w}[i+2] || ' ' || {w}[i+3] || ' ' || {w}[i+4]), 1, 16))
     WHEN len({w}) > 0 THEN [substr(md5(array_to_string({w}, ' ')), 1, 16)] ELSE []::VARCHAR[] END"""
_WORDS = "list_filter(string_split_regex(lower({t}), '[ \\t\\n\\v\\f\\r]+'), lambda w: w <> '')"
_REACH = "CASE WHEN len({a}) < 16 THEN '~' ELSE greatest('2', {a}[-1]) END"


def _sql_part(a: str, b: str, whole: str) -> str:
    limit = f"least({_REACH.format(a=a)}, {_REACH.format(a=b)})"
    total = f"len(list_filter({whole}, lambda h: h <= {limit}))"
    return f"CASE WHEN {total} = 0 THEN 1.0::DOUBLE ELSE len(list_filter(list_intersect({a}, {b}), lambda h: h <= {limit}))::DOUBLE / {total} END"


oracle("op1_fingerprints", f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next_text FROM t),
e AS (SELECT *, substring(text, 1, length(text) - length(text) // 2) || substring(next_text, 1, length(text) // 2) AS edited FROM n),
w AS (SELECT *, {_WORDS.format(t="text")} AS w0, {_WORDS.format(t="edited")} AS w1, {_WORDS.format(t="next_text")} AS w2 FROM e),
s AS (SELECT *, {_SHINGLES.format(w="w0")} AS s0, {_SHINGLES.format(w="w1")} AS s1, {_SHINGLES.format(w="w2")} AS s2 FROM w),
k AS (SELECT *, {_SKETCH.format(s="s0")} AS a, {_SKETCH.format(s="s1")} AS b, {_SKETCH.format(s="s2")} AS c FROM s)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, coalesce(array_to_string(a, ''), '') AS fingerprint, coalesce(array_to_string(b, ''), '') AS edited_fingerprint,
  {_sql_part("a", "b", "list_distinct(list_concat(a, b))")} AS near_edited, {_sql_part("a", "c", "list_distinct(list_concat(a, c))")} AS near_next, {_sql_part("a", "b", "a")} AS contained_in_edited
FROM k""")


PII_KEY = "spark.gridloom.pii.key"


def pii_key(spark: SparkSession) -> str:
    """The secret that the session's configuration names; without one a new random key, so that surrogates of two runs don't refer to each other."""
    return spark.conf.get(PII_KEY, None) or secrets.token_hex(32)


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import replace

    return replace(documents(spark, sf_dir), pii_key(spark)).select("doc_id", "n_entities", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


_LOWERED = "translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

oracle("op7_ngram_join", f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWERED.format(t="text")}, '[^ \\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4])
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
t AS MATERIALIZED (SELECT doc_id, hash(unnest(s)) AS t FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT a AS doc_id, any_value(n.n) AS n_shingles, min(b) AS component_id FROM reach JOIN n ON n.doc_id = a GROUP BY a""")


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_items = F.size("items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("spans").cast("long").alias("n_spans"))


_WORDS_OF = f"regexp_extract_all({_LOWERED.format(t='text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

oracle("op8_decontamination", f"""
WITH d AS (SELECT doc_id, {_WORDS_OF} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, {_WORDS_OF} AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS p FROM b WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM p),
place AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n),
found AS MATERIALIZED (SELECT q.doc_id, q.n, i, p.item_id FROM place q JOIN d ON d.doc_id = q.doc_id JOIN p ON p.n = q.n AND p.p = array_to_string(d.w[i:i + q.n - 1], ' ')),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, n, i FROM found)),
hits AS (SELECT h.doc_id, count(*) AS n_hit, count(*) FILTER (WHERE g.k IS NULL) AS n_spans FROM hit h LEFT JOIN hit g ON g.doc_id = h.doc_id AND g.k = h.k - 1 GROUP BY ALL),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM found GROUP BY ALL)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_spans, 0)::BIGINT AS n_spans
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""")


@query
def op10_brown_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .brown import score, train_model

    docs = documents(spark, sf_dir).select("doc_id", "text", (C.fold_of() == 1).alias("held_out"))
    return score(docs, train_model(docs.filter(~F.col("held_out"))))


def toxicity_model(docs: DataFrame, sf_dir: str):
    """Fitted on the labelled rows outside the held-out fold."""
    from .toxicity import train

    labels = docs.sparkSession.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return train(docs.filter(C.fold_of() != 0).select("doc_id", "text"), labels)


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    docs = documents(spark, sf_dir)
    return score(docs.select("doc_id", (C.fold_of() == 0).alias("held_out"), "text"), toxicity_model(docs, sf_dir)).drop("text")


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(documents(spark, sf_dir))
