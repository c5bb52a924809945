"""Benchmark decontamination by an FM-index of every shard of the training texts.

The test items' windows (ten consecutive words, or all words of a shorter item) are the
search phrases. A shard is what a task reads of the documents, up to SHARD_BYTES of text or SHARD_WORDS indexed words. It is turned
into symbols: words that no phrase has can't
be part of an occurrence, so only runs of phrase words as long as the shortest phrase are
indexed, each closed by its own end mark. Over their suffix array stands the
Burrows-Wheeler transform as a wavelet matrix; the phrases of which the shard has every word are searched backwards at once by
its ranks, the rows found are walked back to sampled suffix positions, and the words that
any occurrence covers are merged into spans.

The benchmark's words are hashed in tasks. Up to BLOCK_WORDS of them (8 bytes each) are made into phrases and broadcast at once; a larger
benchmark is searched block by block, each in a pass of its own whose broadcast is given up after it, and the hits,
written by each pass, are merged by document.

Defined cases: a null text has no words; an item without words, or with a null id, is
ignored; repeated items and rows count as they stand; a text of any length is searched
whole; an empty benchmark hits nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import columns as C
from .storage import kept

WINDOW = 10
SAMPLE = 8
#: Words of the benchmark in one block; a larger one is searched block by block.
BLOCK_WORDS = 1 << 22
#: Where a shard ends.
SHARD_BYTES, SHARD_WORDS = 1 << 24, 1 << 21
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing.
WORD = np.zeros(256, dtype=bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True


@dataclass
class Phrases:
    vocabulary: np.ndarray  # sorted word hashes; symbol = place + 1
    by_length: dict[int, np.ndarray]  # phrases x length, symbols
    owners: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: offsets of the phrase's items, item numbers
    items: list[str]
    shortest: int


def _words(batch, column="text"):
    data, offsets = C.text_bytes(batch.column(column))
    data = C.LOWER[data]
    starts, ends, at = C.word_spans(data, offsets, WORD)
    return C.span_hashes(C.prefix_sums(data), starts, ends), starts, ends, at, offsets


def phrases_of(items: list[tuple[str, np.ndarray]], window: int = WINDOW) -> Phrases:
    """The phrases of (item id, word hashes) pairs."""
    vocabulary = np.unique(np.concatenate([w for _, w in items])) if items else np.zeros(0, np.uint64)
    rows: dict[int, list] = {}
    owner: dict[int, list] = {}
    for i, (_, words) in enumerate(items):
        symbols = np.searchsorted(vocabulary, words).astype(np.int32) + 1
        n = min(window, len(symbols))
        own = np.lib.stride_tricks.sliding_window_view(symbols, n)
        rows.setdefault(n, []).append(own)
        owner.setdefault(n, []).append(np.full(len(own), i))
    by_length, owners = {}, {}
    for n in rows:
        distinct, place = np.unique(np.concatenate(rows[n]), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([place.reshape(-1), np.concatenate(owner[n])], axis=1), axis=0)
        by_length[n] = distinct
        owners[n] = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), pairs[:, 1]
    return Phrases(vocabulary, by_length, owners, [str(k) for k, _ in items], min(rows, default=0))


class WaveletMatrix:
    """Ranks of symbols in a sequence, by one bit vector per binary digit."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels = []
        for bit in range(max(1, int(largest).bit_length()) - 1, -1, -1):
            ones = ((symbols >> bit) & 1).astype(bool)
            rank = np.zeros(len(symbols) + 1, dtype=np.int32)
            np.cumsum(ones, out=rank[1:])
            self.levels.append((bit, rank, len(symbols) - int(rank[-1])))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        start = np.zeros_like(at)
        for bit, rank, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            at = np.where(one, zeros + rank[at], at - rank[at])
            start = np.where(one, zeros + rank[start], start - rank[start])
        return at - start


class FmIndex:
    """Index of runs of symbols (> 0); `runs` are their lengths, in the order of `symbols`."""

    def __init__(self, symbols: np.ndarray, runs: np.ndarray, sample: int = SAMPLE):
        n, marks = len(symbols) + len(runs), len(runs)
        ends = np.cumsum(runs + 1) - 1
        text = np.zeros(n, dtype=np.int64)
        is_word = np.ones(n, dtype=bool)
        is_word[ends] = False
        text[is_word] = symbols
        first = np.concatenate([[0], ends[:-1] + 1])
        key = text + marks
        key[ends] = np.arange(marks)
        order, rank, step = np.argsort(key, kind="stable"), None, 1
        while True:
            sorted_key = key[order]
            new = np.ones(n, dtype=np.int64)
            new[0] = 0
            new[1:] = sorted_key[1:] != sorted_key[:-1]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(new)
            if rank[order[-1]] == n - 1:
                break
            after = np.zeros(n, dtype=np.int64)
            after[:-step] = rank[step:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            step *= 2
        self.bwt = text[order - 1]
        largest = int(text.max())
        # Rows whose suffix begins with a smaller symbol; end marks come first.
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=largest + 1))])
        self.ranks = WaveletMatrix(self.bwt, largest)
        kept = order % sample == 0
        is_first = np.zeros(n, dtype=bool)
        is_first[first] = True
        self.sampled = kept | is_first[order]
        self.position = np.where(self.sampled, order, -1)
        self.largest, self.n = largest, n
        # The place in `symbols` of a place in the text with end marks.
        self.plain = np.cumsum(is_word) - 1

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last row + 1 of each phrase (all of one length)."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.n, dtype=np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[:, k].astype(np.int64)
            alive = (low < high) & (symbol <= self.largest)
            high[~alive] = low[~alive]
            if not alive.any():
                break
            s = symbol[alive]
            low[alive] = self.before[s] + self.ranks.rank(s, low[alive])
            high[alive] = self.before[s] + self.ranks.rank(s, high[alive])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in `symbols` at which the rows' suffixes begin."""
        rows, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        open_ = np.flatnonzero(~self.sampled[rows])
        while len(open_):
            symbol = self.bwt[rows[open_]]
            rows[open_] = self.before[symbol] + self.ranks.rank(symbol, rows[open_])
            steps[open_] += 1
            open_ = open_[~self.sampled[rows[open_]]]
        return self.plain[self.position[rows] + steps]


def runs_of(hashes: np.ndarray, at: np.ndarray, p: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places and symbols of the words to index, and the lengths of their runs; no run crosses texts."""
    none = np.zeros(0, dtype=np.int64)
    if not len(hashes) or not p.items:
        return none, none, none
    place = np.minimum(np.searchsorted(p.vocabulary, hashes), len(p.vocabulary) - 1)
    symbols = np.where(p.vocabulary[place] == hashes, place + 1, 0)
    known = symbols > 0
    begin = known.copy()
    begin[1:] &= ~known[:-1]
    first = at[:-1][at[:-1] < len(hashes)]
    begin[first] |= known[first]
    run = np.cumsum(begin) - 1
    length = np.bincount(run[known], minlength=run[-1] + 1)
    known[known] = length[run[known]] >= p.shortest
    words = np.flatnonzero(known)
    return words, symbols[words], length[length >= p.shortest]


def occurrences(symbols: np.ndarray, runs: np.ndarray, p: Phrases):
    """(places, lengths, items' offsets, items' numbers) of all occurrences in the indexed symbols, by phrase length."""
    index = FmIndex(symbols, runs)
    present = np.zeros(len(p.vocabulary) + 1, dtype=bool)
    present[symbols] = True
    for n, phrases in p.by_length.items():
        alive = np.flatnonzero(present[phrases[:, 0]])
        for k in range(1, n):
            alive = alive[present[phrases[alive, k]]]
        if not len(alive):
            continue
        low, high = index.search(phrases[alive])
        found = np.flatnonzero(high > low)
        if not len(found):
            continue
        count = (high - low)[found]
        rows = np.repeat(low[found] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        which = alive[np.repeat(found, count)]
        offsets, numbers = p.owners[n]
        yield index.locate(rows), n, offsets[which], offsets[which + 1], numbers


class Shard:
    """Batches of documents with what is indexed of them."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.batches, self.parts, self.bytes, self.words = phrases, [], [], 0, 0

    def add(self, batch) -> None:
        hashes, starts, ends, at, offsets = _words(batch)
        words, symbols, runs = runs_of(hashes, at, self.phrases)
        text = np.searchsorted(at, words, side="right") - 1
        self.batches.append((batch, np.diff(at)))
        self.parts.append((symbols, runs, text, words - at[text], starts[words] - offsets[text], ends[words] - offsets[text]))
        self.bytes += batch.nbytes
        self.words += len(symbols)

    @property
    def full(self) -> bool:
        return self.bytes >= SHARD_BYTES or self.words >= SHARD_WORDS

    def searched(self):
        """(batch, its numbers of words, {text of the batch: (words hit, their first bytes and last bytes, sorted item ids)})."""
        symbols, runs = (np.concatenate([p[k] for p in self.parts]) if self.parts else np.zeros(0, np.int64) for k in range(2))
        cover, owners = np.zeros(len(symbols) + 1, dtype=np.int64), []
        if len(symbols):
            for start, n, a, b, numbers in occurrences(symbols, runs, self.phrases):
                np.add.at(cover, start, 1)
                np.add.at(cover, start + n, -1)
                size = b - a
                own = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                owners.append((np.repeat(start, size), numbers[own]))
        hit = np.cumsum(cover[:-1]) > 0
        place, item = (np.concatenate([o[k] for o in owners]) if owners else np.zeros(0, np.int64) for k in range(2))
        begin = 0
        for (batch, n_words), (own, _, text, word, first, last) in zip(self.batches, self.parts):
            mine = hit[begin : begin + len(own)]
            found: dict = {}
            inside = (place >= begin) & (place < begin + len(own))
            items: dict = {}
            for t, i in set(zip(text[place[inside] - begin].tolist(), item[inside].tolist())):
                items.setdefault(t, set()).add(self.phrases.items[i])
            for t in items:
                a, b = np.searchsorted(text, [t, t + 1])
                at = np.flatnonzero(mine[a:b]) + a
                found[t] = word[at], first[at], last[at], sorted(items[t])
            begin += len(own)
            yield batch, n_words, found


def _spans(word: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of runs of words that are hit."""
    cut = np.flatnonzero(np.diff(word) > 1)
    return list(zip(first[np.concatenate([[0], cut + 1])].tolist(), last[np.concatenate([cut, [len(word) - 1]])].tolist())) if len(word) else []


def _shards(batches, phrases: Phrases):
    shard = Shard(phrases)
    for b in C.slices(batches):
        shard.add(b)
        if shard.full:
            yield from shard.searched()
            shard = Shard(phrases)
    if shard.batches:
        yield from shard.searched()


def _hashed(benchmark: DataFrame) -> DataFrame:
    """(item_id, words binary, n) of the items that have words, kept; hashed in tasks."""

    def run(batches):
        for b in C.slices(batches):
            words, _, _, at, _ = _words(b)
            own = [words[a:z].tobytes() for a, z in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(own, pa.binary()), pa.array(np.diff(at), pa.int64())], names=["item_id", "words", "n"])

    rows = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return kept(rows.mapInArrow(run, "item_id string, words binary, n bigint").filter("n > 0"))


def _blocks(benchmark: DataFrame, window: int):
    """The phrases of the benchmark, in blocks of a bounded number of words, one at a time."""
    block, size = [], 0
    for r in _hashed(benchmark).toLocalIterator():
        block.append((r["item_id"], np.frombuffer(r["words"], dtype=np.uint64)))
        size += r["n"]
        if size >= BLOCK_WORDS:
            yield phrases_of(block, window)
            block, size = [], 0
    if block:
        yield phrases_of(block, window)


_SPAN = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
_FOUND = "items array<string>, spans array<struct<from: bigint, to: bigint>>"


def _search(docs: DataFrame, phrases, give, schema) -> DataFrame:
    """`give` of each batch, its words and what was found in it."""

    def run(batches):
        for batch, n_words, found in _shards(batches, phrases.value):
            yield from give(batch, n_words, found)

    return docs.mapInArrow(run, schema)


def _in_passes(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[object, DataFrame | None]:
    """(broadcast of the only block, None), or (None, what the passes over several blocks found by row `_row`: n_hit, items and spans)."""
    spark = docs.sparkSession
    blocks = _blocks(benchmark, window)
    first = next(blocks, None) or phrases_of([], window)
    second = next(blocks, None)
    if second is None:
        return spark.sparkContext.broadcast(first), None

    def give(batch, n_words, found):
        rows = [(batch.column("_row")[t].as_py(), items, list(zip(word.tolist(), a.tolist(), b.tolist()))) for t, (word, a, b, items) in found.items()]
        if rows:
            hits = [[{"word": w, "from": a, "to": b} for w, a, b in h] for _, _, h in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array(hits, pa.list_(pa.struct([("word", pa.int64()), ("from", pa.int64()), ("to", pa.int64())])))], names=["_row", "items", "hits"])

    parts = []
    for block in chain([first, second], blocks):
        shared = spark.sparkContext.broadcast(block)
        parts.append(kept(_search(docs.select("_row", "text"), shared, give, "_row bigint, items array<string>, hits array<struct<word: bigint, from: bigint, to: bigint>>")))
        shared.destroy()
    together = reduce(DataFrame.union, parts).groupBy("_row").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"))
    # Runs of consecutive words: a run begins where the word before isn't hit.
    hit = F.col("hits")
    starts = F.filter(hit, lambda h, i: (i == 0) | (F.get(hit, i - 1)["word"] < h["word"] - 1))
    ends = F.filter(hit, lambda h, i: (i == F.size(hit) - 1) | (F.get(hit, i + 1)["word"] > h["word"] + 1))
    spans = F.zip_with(starts, ends, lambda a, b: F.struct(a["from"].alias("from"), b["to"].alias("to")))
    return None, together.select("_row", "items", F.size("hits").cast("long").alias("n_hit"), spans.alias("spans"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids sorted as text) and spans (bytes from, to) of each document."""
    C.session_limits(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    numbered, shared, hits = _prepared(given, benchmark, window)

    def give(batch, n_words, found):
        none = ((), (), (), [])
        rows = [found.get(t, none) for t in range(batch.num_rows)]
        spans = [[{"from": a, "to": b} for a, b in _spans(*r[:3])] if r[3] else [] for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array([len(r[0]) for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.string())), pa.array(spans, _SPAN)], names=["doc_id", "n_words", "n_hit", "items", "spans"])

    if hits is None:
        return _search(given, shared, give, f"doc_id bigint, n_words bigint, n_hit bigint, {_FOUND}")

    def count(batches):
        for b in C.slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("doc_id"), pa.array(np.diff(_words(b)[3]), pa.int64())], names=["_row", "doc_id", "n_words"])

    rows = numbered.mapInArrow(count, "_row bigint, doc_id bigint, n_words bigint").join(hits, "_row", "left")
    none = F.array().cast("array<string>")
    return rows.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("spans", F.from_json(F.lit("[]"), "array<struct<from: bigint, to: bigint>>")).alias("spans"))


def _prepared(docs: DataFrame, benchmark: DataFrame, window: int):
    """(documents with `_row` where the benchmark takes several passes, broadcast of a single block, hits of several passes)."""
    blocks_in = benchmark.filter("item_id is not null and text is not null").agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    if blocks_in < BLOCK_WORDS:  # a word takes a byte at least
        return (docs, *_in_passes(docs, benchmark, window))
    numbered = kept(docs.withColumn("_row", F.monotonically_increasing_id()))
    return (numbered, *_in_passes(numbered, benchmark, window))


def _cut(text: str, spans) -> str:
    raw, last, parts = text.encode(), 0, []
    for a, b in spans:
        parts.append(raw[last:a])
        last = b
    return b"".join([*parts, raw[last:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` with the spans cut out of its texts; all other columns pass through."""
    C.session_limits(docs.sparkSession)
    numbered, shared, hits = _prepared(docs, benchmark, window)
    names = docs.columns

    def rewritten(batch, spans_of):
        if spans_of:
            texts = batch.column("text").to_pylist()
            for t, spans in spans_of.items():
                texts[t] = _cut(texts[t], spans)
            at = batch.schema.get_field_index("text")
            batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)
        return batch

    if hits is None:
        return _search(docs, shared, lambda batch, _, found: [rewritten(batch, {t: _spans(*f[:3]) for t, f in found.items()})], docs.schema)

    def cut(batches):
        for b in batches:
            spans = {t: [(s["from"], s["to"]) for s in x] for t, x in enumerate(b.column("_spans").to_pylist()) if x}
            yield rewritten(b, spans).select(names)

    return numbered.join(hits.select("_row", F.col("spans").alias("_spans")), "_row", "left").mapInArrow(cut, docs.schema)
