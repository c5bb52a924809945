"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
again as the next one's docs. All but the last return the columns of documents.

Null texts pass every filter (they are neither toxic nor copies) and are packed as empty;
an empty table stays empty; a row that repeats a doc_id stays with the document it repeats;
a null doc_id is compared with no other; further columns, whatever their names, pass through
up to the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import queries as Q
from gridloom.llm.decontaminate import decontaminate
from gridloom.llm.ngram_join import near_duplicates
from gridloom.llm.packing import pack
from gridloom.llm.pii import replace
from gridloom.llm.storage import kept
from gridloom.llm.toxicity import score

ORACLE_SQL = None


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast("bigint"), "n_chars"))


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with its own columns of these names out of an operator's way, and the way back."""
    back = {f"_own_{n}": n for n in names if n in docs.columns}
    return docs.withColumnsRenamed({n: k for k, n in back.items()}), back


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go."""
    own, back = _aside(docs, "score", "predicted")
    return score(own, Q.toxicity_model(own, sf_dir)).filter("predicted = 0").select(own.columns).withColumnsRenamed(back)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    copies = near_duplicates(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts."""
    return _measured(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets give way to surrogates."""
    own, back = _aside(docs, "n_entities")
    return _measured(replace(own, Q.pii_key(spark)).select(own.columns)).withColumnsRenamed(back)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their token ids."""
    return pack(docs, Q.vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("decontamination", cut_benchmark),
    ("pii", replace_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written and read again."""
    docs = Q.documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = kept(docs)
    return docs
