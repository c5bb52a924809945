"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting is one distributed pass over the training rows; the counts' size is fixed by
`buckets` x languages, so they are summed by chunk and the log-probability matrix is
broadcast. Scoring gathers the matrix's entries of a batch's n-grams and sums them by text.

Defined cases: a text that is null or has no letter is `und` with score 0; training rows
with a null text or language are left out; without any training row every text is `und`;
equal texts get equal predictions; other columns of the input are passed through untouched,
but a column named lang_pred or score gives way to the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import columns as C

WIDTHS = (1, 2, 3)
_SALT = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@dataclass
class LanguageModel:
    languages: list[str]
    log_prior: np.ndarray
    log_probability: np.ndarray  # languages x buckets
    buckets: int


def _grams(texts: list[str], buckets: int):
    """For each n-gram width the buckets of all n-grams in a row, and each text's range of them."""
    texts = [t.lower() for t in texts]
    lengths = np.array([len(t) for t in texts], dtype=np.int64) + 2
    points = np.frombuffer((" " + "  ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    h = np.zeros(len(points), dtype=np.uint32)
    for width in WIDTHS:
        h = (h[: len(points) - width + 1] ^ points[width - 1 :]) * _SALT[width - 1]
        h ^= h >> np.uint32(15)
        yield (h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - int(buckets).bit_length() + 1), begins, np.maximum(ends - width + 1, begins)


def train(docs: DataFrame, buckets: int = 1 << 15, smoothing: float = 0.5) -> LanguageModel:
    """Fit on the rows whose text and lang aren't null. `buckets` is a power of two."""
    spark = docs.sparkSession
    C.session_limits(spark)
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    languages = sorted(r[0] for r in rows.select("lang").distinct().collect())
    n = len(languages)

    def count(batches):
        total, texts_of = np.zeros(n * buckets, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for b in C.slices(batches):
            lang = pc.index_in(b.column("lang"), pa.array(languages, pa.string())).to_numpy(zero_copy_only=False)
            texts_of += np.bincount(lang, minlength=n)
            for h, begins, ends in _grams(b.column("text").to_pylist(), buckets):
                where = np.repeat(lang, ends - begins)
                at = np.arange(len(where)) + np.repeat(begins - np.concatenate([[0], np.cumsum(ends - begins)[:-1]]), ends - begins)
                total += np.bincount(where * buckets + h[at], minlength=n * buckets)
        if texts_of.any():
            yield C.count_rows(np.concatenate([total, texts_of]), C.task_salt())

    counts = C.summed(rows.mapInArrow(count, "chunk int, salt int, counts binary"), spark, n * buckets + n) if n else np.zeros(0, np.int64)
    grams = counts[: n * buckets].reshape(n, buckets) + smoothing if n else np.zeros((0, buckets))
    prior = counts[n * buckets :] + 1.0
    return LanguageModel(languages, np.log(prior / prior.sum()), np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32), buckets)


def score_texts(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Predicted languages and their posterior probabilities."""
    known = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], dtype=bool)
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts))
    total = np.tile(model.log_prior, (len(texts), 1))
    for h, begins, ends in _grams([t or "" for t in texts], model.buckets):
        for k in range(len(model.languages)):
            sums = np.concatenate([[0.0], np.cumsum(model.log_probability[k][h], dtype=np.float64)])
            total[:, k] += sums[ends] - sums[begins]
    best = total.argmax(axis=1)
    score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return [model.languages[k] if ok else "und" for k, ok in zip(best, known)], np.where(known, np.minimum(score, 1.0), 0.0)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of `docs` (doc_id, text and others but lang) with lang_pred and score."""
    spark = docs.sparkSession
    C.session_limits(spark)
    shared = spark.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    given = docs.select(*keep, "text")
    schema = given.drop("text").schema.add("lang_pred", "string").add("score", "double")

    def score(batches):
        for b in C.slices(batches):
            names, values = score_texts(b.column("text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(names, pa.string()), pa.array(values, pa.float64())], names=[*keep, "lang_pred", "score"])

    return given.mapInArrow(score, schema)
