"""Text columns as flat numpy arrays, and the two ways in which tasks share what they have counted.

Every helper works on whole Arrow batches: a batch's texts are one byte array with
offsets, its words are start and end positions, and a word's hash comes from prefix
sums, so no Python object is made for a word.
"""

from __future__ import annotations

import os
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 19
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of `[^\x20\x09-\x0D]`.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def session_limits(spark: SparkSession) -> None:
    """Workers that find this package where the driver has it, besides what the user lets them find; and, where the user has left
    the default, Arrow batches small enough that a Python worker holds a few MB at a time."""
    own, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if own not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([own, *paths])
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_of(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, mod 5; a null id counts as an empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 5


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row and the n + 1 offsets; a null is empty."""
    column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, dtype=np.uint8), at - at[0]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches, column: str = "text", limit: int = CHUNK_BYTES):
    """The batches cut so that a piece has about `limit` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of words before it (n + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    own = inside[data]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    before = np.empty_like(own)
    before[0] = False
    before[1:] = own[:-1]
    before[edge] = False
    after = np.empty_like(own)
    after[-1] = False
    after[:-1] = own[1:]
    after[edge[edge > 0] - 1] = False
    starts = np.flatnonzero(own & ~before)
    return starts, np.flatnonzero(own & ~after) + 1, np.searchsorted(starts, offsets)


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = max(n + 1, CHUNK_BYTES + 1)
        for i, m in enumerate((_MULTIPLIER, _INVERSE)):
            steps = np.full(size, m, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def prefix_sums(data: np.ndarray) -> np.ndarray:
    power = _grown(len(data))[0]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes; equal bytes have equal hashes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * _grown(len(sums))[1][starts])


def hash_of(word: bytes) -> int:
    data = np.frombuffer(word, dtype=np.uint8)
    return int(span_hashes(prefix_sums(data), np.array([0]), np.array([len(data)]))[0])


_SHINGLE = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_hashes(words: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles in a row, and where each text's begin (n + 1).

    A text with fewer words than `width` has one shingle of all its words; one without
    words has none.
    """
    counts = np.diff(at)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(begins[-1], dtype=np.uint64)
    if len(words) >= width:
        every = words[: len(words) - width + 1] * _SHINGLE[0]
        for i in range(1, width):
            every = mix(every) + words[i : len(words) - width + 1 + i] * _SHINGLE[i % len(_SHINGLE)]
        long = np.repeat(counts >= width, sizes)
        place = np.arange(begins[-1]) - np.repeat(begins[:-1] - at[:-1], sizes)
        out[long] = mix(every)[place[long]]
    for d in np.flatnonzero((counts > 0) & (counts < width)):
        h = np.uint64(counts[d])
        with np.errstate(over="ignore"):
            for w in words[at[d] : at[d + 1]]:
                h = mix(np.array([h * _SHINGLE[0] + w], dtype=np.uint64))[0]
        out[begins[d]] = h
    return out, begins


# Arrays in rows: a task hands on (bucket, binary columns), one row a bucket, so that the
# shuffle moves packed numbers.


def bucket_rows(buckets: np.ndarray, arrays: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    order = np.argsort(buckets, kind="stable")
    buckets = buckets[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(buckets)) + 1, [len(buckets)]]) if len(buckets) else np.zeros(1, int)
    columns = []
    for a in arrays:
        raw, width = np.ascontiguousarray(a[order]).tobytes(), a.dtype.itemsize
        columns.append(pa.array([raw[i * width : j * width] for i, j in zip(cut[:-1], cut[1:])], pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(buckets[cut[:-1]].astype(np.int32), pa.int32()), *columns], names=["bucket", *names])


def dealt(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """Rows that `bucket_rows` made, each bucket's next to each other in one partition; sorted by the engine, which spills."""
    return rows.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")


def each_bucket(batches, names: list[str], kinds: list):
    """(bucket, its arrays end to end) of each bucket of rows that `dealt` gave; no more than one bucket is held."""
    now, parts = None, [[] for _ in names]
    for b in batches:
        columns = [b.column(n).to_pylist() for n in names]
        for i, k in enumerate(b.column("bucket").to_pylist()):
            if k != now:
                if now is not None:
                    yield now, [np.frombuffer(b"".join(p), dtype=t) for p, t in zip(parts, kinds)]
                now, parts = k, [[] for _ in names]
            for p, c in zip(parts, columns):
                p.append(c[i] or b"")
    if now is not None:
        yield now, [np.frombuffer(b"".join(p), dtype=t) for p, t in zip(parts, kinds)]


def summed(rows: DataFrame, spark: SparkSession, size: int, dtype=np.int64) -> np.ndarray:
    """The sum of count vectors that tasks gave as rows (chunk int, salt int, counts binary).

    The vector's length is fixed by the model, not by the data; it is summed in two rounds,
    so that a chunk's rows from many tasks are first added up by salt.
    """
    schema = "chunk int, salt int, counts binary"

    def add(batches):
        total: dict = {}
        for b in batches:
            for k, s, c in zip(b.column("chunk").to_pylist(), b.column("salt").to_pylist(), b.column("counts").to_pylist()):
                v = np.frombuffer(c, dtype=dtype)
                total[k] = total[k] + v if k in total else v.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([0] * len(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["chunk", "salt", "counts"])

    once = rows.repartition(partitions(spark), "chunk", "salt").mapInArrow(add, schema)
    out = np.zeros(size, dtype=dtype)
    for r in once.repartition(partitions(spark), "chunk").mapInArrow(add, schema).collect():
        v = np.frombuffer(r["counts"], dtype=dtype)
        out[r["chunk"] * CHUNK_COUNTS : r["chunk"] * CHUNK_COUNTS + len(v)] += v
    return out


CHUNK_COUNTS = 1 << 14


def count_rows(counts: np.ndarray, salt: int) -> pa.RecordBatch:
    """A task's counts as rows for `summed`."""
    cut = range(0, len(counts), CHUNK_COUNTS)
    return pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array([salt] * len(cut), pa.int32()), pa.array([counts[i : i + CHUNK_COUNTS].tobytes() for i in cut], pa.binary())], names=["chunk", "salt", "counts"])


def task_salt() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return (context.partitionId() if context else 0) % 64
