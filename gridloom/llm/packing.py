"""Mixture-controlled packing: deficit round-robin over source queues.

Every window of `window` tokens is filled from one queue per source. A source's deficit
grows by its target share of the window and falls by what it serves; the source with the
largest deficit serves next, as long as its deficit lasts (but `least` tokens at once, so
that pieces stay long), and what a window leaves over is carried to the next one. When a
queue is empty the others fill the window.

The corpus is dealt over parts of about `part_tokens` tokens, all packed at once. The
deficits that a part begins with are those with which the part before it must end: since
a part packs all of its own tokens, its closing deficit is its target minus its supply,
for each source, which the table of counts by part and source already gives. So deficits
cross parts by a running sum, not by waiting for them. Only a part's last window can be
short; it is padded to the next power of two.

Defined cases: a null text is empty and has only its end token; a null source is a queue
of its own; equal rows are separate documents; special strings in a text are what the
tokenizer makes of them; an empty table gives no pieces.
"""

from __future__ import annotations

import base64
import heapq
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import columns as C
from .storage import kept

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("padded_to", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)
#: Texts by which a rank file is held against the tokenizers file when it is loaded.
PROBES = ["The quick brown foxes' 12345 jumps!", "  spaced\tand\r\n\nlined  ", "naïve Straße ﬁn de siècle 漢字かな 😀👍🏽", "x = y[0] += 1; // don't", "é\u0301\u200d\u0000\ufffd"]
#: Numbers among which rows of one task are spread, so that rows with one id don't stay together.
SPREAD = 1 << 16
#: Parts whose running sums are made in one window.
SPAN = 1 << 12
_loaded: dict = {}


class ByteBpe:
    """Ids of a byte-level BPE vocabulary.

    The file for `tokenizers` is authoritative. Where the same vocabulary also lies beside
    it as ranks, texts without special strings are encoded from these, which gives the same
    ids several times faster; a text that holds a special string goes through `tokenizers`.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.ranks = None
        beside = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(beside):
            import public_tokenizers
            import tiktoken

            with open(beside, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            if any(self.ranks.encode_ordinary(t) != self.full.encode(t, add_special_tokens=False).ids for t in PROBES):
                self.ranks = None

    def encode(self, text: str) -> list[int]:
        if self.ranks is None or any(s in text for s in self.special):
            return self.full.encode(text, add_special_tokens=False).ids
        return self.ranks.encode_ordinary(text)


def _encoder(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, source, spread (a number that differs among a task's rows), n_tokens and ids (little-endian 16 bits if the vocabulary allows, else 32; `wide` tells)."""
    C.session_limits(docs.sparkSession)

    def run(batches):
        e = _encoder(path)
        wide = max(e.full.get_vocab_size(), end_id + 1) > 1 << 16
        kind = np.dtype("<u4" if wide else "<u2")
        seen = 0
        for b in C.slices(batches):
            ids, sizes = [], []
            for t in b.column("text").to_pylist():
                own = e.encode(t) if t else []
                own.append(end_id)
                sizes.append(len(own))
                ids.append(np.array(own, dtype=kind).tobytes())
            n = b.num_rows
            spread = np.arange(seen, seen + n, dtype=np.int32) % SPREAD
            seen += n
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(spread), pa.array(sizes, pa.int64()), pa.array([wide] * n, pa.bool_()), pa.array(ids, pa.binary())], names=["doc_id", "source", "spread", "n_tokens", "wide", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, source string, spread int, n_tokens bigint, wide boolean, ids binary")


def _fill(sources, docs_of, share, carry, window, least):
    """Yield (doc, start, length, window number, offset) of one part, in order."""
    queues = {s: iter(docs_of[s]) for s in sources}
    head, left = {}, {}
    for s in sources:
        left[s] = sum(n for _, n in docs_of[s])
        head[s] = [*next(queues[s]), 0]
    deficit = {s: carry.get(s, 0.0) for s in sources}
    w = 0
    while left:
        room = min(window, sum(left.values()))
        for s in left:
            deficit[s] += share.get(s, 0.0) * room
        turns = [(-deficit[s], str(s), s) for s in left]
        heapq.heapify(turns)
        offset = 0
        while room:
            _, name, s = heapq.heappop(turns)
            doc, n, start = head[s]
            size = min(room, n - start, max(least, int(deficit[s])))
            if 0 < n - start - size < least:  # no sliver stays behind
                size = min(room, n - start)
            yield doc, start, size, w, offset
            offset, room, left[s] = offset + size, room - size, left[s] - size
            deficit[s] -= size
            if start + size < n:
                head[s][2] = start + size
            elif left[s]:
                head[s] = [*next(queues[s]), 0]
            if left[s]:
                heapq.heappush(turns, (-deficit[s], name, s))
            else:
                del left[s]
        w += 1


def _before(rows: DataFrame, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """`rows` with running sums of columns over the parts before, by key; first within spans of parts, then over the spans' sums,
    so that no window has more rows than a span or than there are spans."""
    spanned = rows.withColumn("_span", F.floor(F.col("part") / F.lit(SPAN)))
    back = Window.unboundedPreceding, -1
    of_span = spanned.groupBy(*keys, "_span").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    over_spans = Window.partitionBy(*keys).orderBy("_span").rowsBetween(*back)
    of_span = of_span.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_span").alias("_at"), *[F.coalesce(F.sum(f"_{n}").over(over_spans), F.lit(0)).alias(f"_{n}") for n in sums])
    within = Window.partitionBy(*keys, "_span").orderBy("part").rowsBetween(*back)
    same = F.col("_span") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    out = spanned.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(n) for n, c in sums.items()]).join(of_span, same)
    return out.select(*rows.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, least: int = 128, part_tokens: int = 1 << 20, targets: dict[str, float] | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece (PIECES). `targets` are token shares by source; by default those of the corpus."""
    spark = docs.sparkSession
    tokens = kept(tokenize(docs, path, end_id))
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, -(-total // part_tokens))
    part = F.pmod(F.xxhash64("doc_id", "n_tokens", "spread"), F.lit(parts)).cast("int")
    tokens = tokens.withColumn("part", part)

    # By part and source: the supply; the target share; what the parts before carry over.
    supply = tokens.groupBy("part", "source").agg(F.sum("n_tokens").alias("own"))
    shares = supply.groupBy("source").agg((F.sum("own") / F.lit(float(max(total, 1)))).alias("share"))
    if targets is not None:
        wanted = F.create_map(*[x for s, v in targets.items() for x in (F.lit(s), F.lit(float(v)))]) if targets else F.create_map().cast("map<string,double>")
        shares = shares.select("source", F.coalesce(wanted[F.col("source")], F.lit(0.0)).alias("share"))
    # Running sums have a row per part, or per part and source that it holds, never per document.
    of_part = supply.groupBy("part").agg(F.sum("own").alias("part_total")).withColumn("windows", F.ceil(F.col("part_total") / F.lit(window)))
    of_part = _before(of_part, [], {"total_before": "part_total", "first": "windows"}).select("part", "total_before", "first")
    shares = shares.withColumnRenamed("source", "of")
    plan = (
        _before(supply, ["source"], {"own_before": "own"})
        .join(of_part, "part")
        .join(shares, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("carry", F.col("share") * F.col("total_before") - F.col("own_before"))
        .select("part", "source", "share", "carry", "first")
    )
    rows = tokens.select("part", "source", "doc_id", "n_tokens", "wide", "ids", F.lit(None).cast("double").alias("share"), F.lit(None).cast("double").alias("carry"), F.lit(None).cast("bigint").alias("first")).unionByName(
        plan.select("part", "source", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("n_tokens"), F.lit(None).cast("boolean").alias("wide"), F.lit(None).cast("binary").alias("ids"), "share", "carry", "first")
    )

    def run(table: pa.Table) -> pa.Table:
        is_plan = pc.is_valid(table.column("share"))
        plans, own = table.filter(is_plan), table.filter(pc.invert(is_plan)).sort_by([("doc_id", "ascending"), ("n_tokens", "ascending"), ("ids", "ascending")])
        names = plans.column("source").to_pylist()
        share = dict(zip(names, plans.column("share").to_pylist()))
        carry = dict(zip(names, plans.column("carry").to_pylist()))
        first = max(plans.column("first").to_pylist(), default=0)
        ids, kinds = own.column("ids"), own.column("wide").to_pylist()
        doc_ids, sizes, source = own.column("doc_id").to_pylist(), own.column("n_tokens").to_pylist(), own.column("source").to_pylist()
        docs_of: dict = {}
        for i, s in enumerate(source):
            docs_of.setdefault(s, []).append((i, sizes[i]))
        out: dict = {f.name: [] for f in PIECES}
        last, wide = (-1, None), None
        fills: dict = {}
        for doc, start, length, w, offset in _fill(sorted(docs_of, key=str), docs_of, share, carry, window, least):
            if last[0] != doc:
                last = (doc, np.frombuffer(ids[doc].as_buffer(), dtype="<u4" if kinds[doc] else "<u2").astype("<u4"))
            raw = last[1][start : start + length].tobytes()
            for name, value in (("doc_id", doc_ids[doc]), ("source", source[doc]), ("start", start), ("length", length), ("ids_crc32", zlib.crc32(raw)), ("doc_tokens", sizes[doc]), ("sequence_id", first + w), ("offset", offset), ("ids", raw if with_ids else None)):
                out[name].append(value)
            fills[first + w] = offset + length
        out["padded_to"] = [window if fills[s] > window // 2 else 1 << (fills[s] - 1).bit_length() for s in out["sequence_id"]]
        return pa.table({f.name: pa.array(out[f.name], {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in PIECES})

    return rows.groupBy("part").applyInArrow(run, PIECES)
