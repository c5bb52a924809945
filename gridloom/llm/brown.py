"""Language-model scoring with Brown classes: class transitions times word emissions.

Every word of the model's vocabulary (the `frequent` commonest words of the training texts) has a symbol of its own; any
other one that of its ending (a hash of its last bytes). Exchange clustering moves symbols between classes as long
as the mutual information of adjacent classes grows. A token's probability is
P(class | class before) * P(symbol | class), and for a word without an own symbol times
P(word | ending).

The first pass over the texts counts all training words: tasks hand on their
distinct words with counts, dealt by hash, and what they add up to is the vocabulary table; it
grows with the corpus and stays in the executors. The second counts adjacent symbols, into a table with a row for each
range of symbols: what follows them and what they follow. Each step of the exchange reads that table
where it lies: a task moves its own symbols to their best classes, given everyone's classes and the class pairs' counts
(both broadcast, `frequent` + `endings` and `classes` squared numbers). As all of a step's symbols move at once, a
step takes a part of them only, and one that didn't help is taken back. The last pass scores: frequent words by the broadcast
model, rare ones where their occurrences meet the vocabulary table by hash, each occurrence with its text's number,
so that only sums by text leave that place. The counts are the model's, whatever texts are scored.

Defined cases: a null text is empty and has only its end token; words that training never
saw have count 0; without training texts all counts are 0 and the classes uniform; equal
rows score alike; a text of any length is scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import columns as C
from .storage import dropped, kept

END = np.uint64(1)
FLUSH = 1 << 18
#: Buckets of a shuffle for each partition; one bucket at a time is held.
FINE = 16
#: Parts of the symbols that take turns in the exchange.
TURNS = 4


@dataclass
class ClassModel:
    words: np.ndarray  # sorted hashes of the words with an own symbol, the end among them
    counts: np.ndarray
    symbol_class: np.ndarray  # of the words, then of the endings
    log_emission: np.ndarray  # by symbol
    log_transition: np.ndarray  # class before x class
    log_ending_total: np.ndarray  # log10(N_u + 0.5 (V_u + 1)) by ending
    tokens: int  # N
    distinct: int  # V
    endings: int


@dataclass
class TrainedModel:
    core: ClassModel  # what tasks are sent
    vocabulary: DataFrame  # word, shape and n of all training words; stays a table


def _tokens(batch):
    """Word hashes, shapes' raw hashes, and each text's words (n + 1 offsets)."""
    data, offsets = C.text_bytes(batch.column("text"))
    data = C.LOWER[data]
    starts, ends, at = C.word_spans(data, offsets, C.NOT_SPACE)
    sums = C.prefix_sums(data)
    return C.span_hashes(sums, starts, ends), C.span_hashes(sums, np.maximum(starts, ends - 3), ends), at


def _with_ends(words: np.ndarray, at: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """The tokens with an end after each text's, and the offsets of these."""
    n = len(at) - 1
    out = np.empty(len(words) + n, dtype=words.dtype)
    new = at + np.arange(n + 1)
    is_end = np.zeros(len(out), dtype=bool)
    is_end[new[1:] - 1] = True
    out[is_end], out[~is_end] = end, words
    return out, new


def _shape(raw: np.ndarray, shapes: int) -> np.ndarray:
    return (raw % np.uint64(shapes)).astype(np.int64)


def _count_words(train: DataFrame, shapes: int) -> DataFrame:
    """(word, shape, n) of all training tokens, kept; the end is the word 1."""
    spark = train.sparkSession
    step = np.uint64((1 << 64) // (FINE * C.partitions(spark)) + 1)

    def merged(parts):
        words, shape, n = (np.concatenate([p[k] for p in parts]) for k in range(3))
        words, first, place = np.unique(words, return_index=True, return_inverse=True)
        return words, shape[first].astype(np.int32), np.bincount(place, weights=n).astype(np.int64)

    def deal(batches):
        parts, size = [], 0
        for b in C.slices(batches):
            words, raw, at = _tokens(b)
            words, first, n = np.unique(words, return_index=True, return_counts=True)
            parts.append((np.append(words, END), np.append(_shape(raw[first], shapes), 0), np.append(n, b.num_rows)))
            size += len(words)
            if size >= FLUSH * 2:
                parts = [merged(parts)]
                size = len(parts[0][0])
                if size >= FLUSH:
                    yield C.bucket_rows((parts[0][0] // step).astype(np.int64), list(parts[0]), ["word", "shape", "n"])
                    parts, size = [], 0
        if parts:
            own = merged(parts)
            yield C.bucket_rows((own[0] // step).astype(np.int64), list(own), ["word", "shape", "n"])

    def meet(batches):
        for _, own in C.each_bucket(batches, ["word", "shape", "n"], [np.uint64, np.int32, np.int64]):
            words, shape, n = merged([own])
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(shape), pa.array(n)], names=["word", "shape", "n"])

    dealt = train.select("text").mapInArrow(deal, "bucket int, word binary, shape binary, n binary")
    return kept(C.dealt(dealt, spark).mapInArrow(meet, "word bigint, shape int, n bigint"))


_SIDES, _KINDS = ["left", "right", "n"], [np.int32, np.int32, np.int64]
_IN = [f"in_{s}" for s in _SIDES]


def _count_pairs(train: DataFrame, words, shapes: int, tokens: int) -> DataFrame:
    """A row for each range of symbols, kept: the pairs of adjacent training symbols that begin with one of them (left, right, n) and those that
    end with one (in_left, in_right, in_n). The end also stands before a text."""
    spark = train.sparkSession
    size = len(words.value) + shapes
    buckets = min(size, max(2 * FINE * C.partitions(spark), tokens >> 22))
    step = -(-size // buckets)

    def merged(parts):
        pairs, place = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        return pairs, np.bincount(place, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    def rows(pairs, n, by_right=False):
        left, right = (pairs // size).astype(np.int32), (pairs % size).astype(np.int32)
        return C.bucket_rows((right if by_right else left) // step, [left, right, n], _SIDES)

    def deal(batches):
        parts, held = [], 0
        for b in C.slices(batches):
            symbols, at = _symbols(b, words.value, shapes)[:2]
            before = np.empty_like(symbols)
            before[1:] = symbols[:-1]
            before[at[:-1]] = np.searchsorted(words.value, END)
            parts.append(np.unique(before * size + symbols, return_counts=True))
            held += len(parts[-1][0])
            if held >= FLUSH * 2:
                parts = [merged(parts)]
                held = len(parts[0][0])
                if held >= FLUSH:
                    yield rows(*parts[0])
                    parts, held = [], 0
        if parts:
            yield rows(*merged(parts))

    def row(k, left, right, n, in_left, in_right, in_n):
        columns = [left.astype(np.int32), right.astype(np.int32), n, in_left.astype(np.int32), in_right.astype(np.int32), in_n]
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in columns]], names=["bucket", *_SIDES, *_IN])

    none = np.zeros(0, dtype=np.int64)

    def meet(batches):
        for k, (left, right, n) in C.each_bucket(batches, _SIDES, _KINDS):
            pairs, n = merged([(left.astype(np.int64) * size + right, n)])
            yield row(k, *np.divmod(pairs, size), n, none, none, none)

    def turned(batches):
        """Each row, and all rows' pairs again, dealt by what they end with; as few rows of these as `deal` makes."""

        def back(parts):
            dealt = rows(*(np.concatenate([p[k] for p in parts]) for k in range(2)), by_right=True)
            empty = [pa.array([b""] * dealt.num_rows, pa.binary())] * 3
            return pa.RecordBatch.from_arrays([dealt.column("bucket"), *empty, *[dealt.column(s) for s in _SIDES]], names=["bucket", *_SIDES, *_IN])

        parts, held = [], 0
        for b in batches:
            for i in range(b.num_rows):
                left, right, n = (np.frombuffer(b.column(s)[i].as_buffer(), t) for s, t in zip(_SIDES, _KINDS))
                parts.append((left.astype(np.int64) * size + right, n))
                held += len(n)
                yield b.slice(i, 1)
                if held >= FLUSH:
                    yield back(parts)
                    parts, held = [], 0
        if parts:
            yield back(parts)

    def gathered(batches):
        for k, own in C.each_bucket(batches, [*_SIDES, *_IN], [*_KINDS, *_KINDS]):
            yield row(k, *own)

    schema = "bucket int, left binary, right binary, n binary"
    both = f"{schema}, in_left binary, in_right binary, in_n binary"
    follow = kept(C.dealt(train.select("text").mapInArrow(deal, schema), spark).mapInArrow(meet, both))
    out = kept(C.dealt(follow.mapInArrow(turned, both), spark).mapInArrow(gathered, both))
    dropped(follow)
    return out


def _found(table: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each word in a sorted table, and whether it is there."""
    place = np.minimum(np.searchsorted(table, words), len(table) - 1)
    return place, table[place] == words


def _symbols(batch, core: np.ndarray, shapes: int):
    """Symbol, offsets, word hash and ending of each token with the ends."""
    words, raw, at = _tokens(batch)
    shape = _shape(raw, shapes)
    tokens, new = _with_ends(words, at, END)
    shape = _with_ends(shape, at, 0)[0]
    place, own = _found(core, tokens)
    return np.where(own, place, len(core) + shape).astype(np.int64), new, tokens, shape


def _xlogx(x):
    return x * np.log(np.maximum(x, 1.0))


def information(joint: np.ndarray) -> float:
    """What the exchange raises: the sum over class pairs of N log N less those over the classes before and after."""
    return float(_xlogx(joint).sum() - _xlogx(joint.sum(axis=1)).sum() - _xlogx(joint.sum(axis=0)).sum())


def best_class(k: int, own: float, after: np.ndarray, before: np.ndarray, joint: np.ndarray) -> int:
    """The class that a symbol of class `k` is best in; `own` counts it behind itself, `after` and `before` other symbols' classes beside it."""
    h, joint = _xlogx, joint.copy()
    joint[k] -= after
    joint[:, k] -= before
    joint[k, k] -= own
    rows, cols = joint.sum(axis=1), joint.sum(axis=0)
    gain = (h(joint + after) - h(joint)).sum(axis=1) + (h(joint + before[:, None]) - h(joint)).sum(axis=0)
    d = np.diagonal(joint)
    gain += h(d + after + before + own) - h(d + after) - h(d + before) + h(d)
    gain -= h(rows + after.sum() + own) - h(rows) + h(cols + before.sum() + own) - h(cols)
    best = int(gain.argmax())
    return best if gain[best] > gain[k] + 1e-9 else k


def moves(out: tuple, in_: tuple, of: np.ndarray, joint: np.ndarray, chosen) -> tuple[list[int], list[int]]:
    """The chosen symbols that change their class, and these; `out` and `in_` are (left, right, n) of all pairs that begin or end with one of them."""
    classes = len(joint)
    out_at, in_at = np.argsort(out[0], kind="stable"), np.argsort(in_[1], kind="stable")
    (left, to, n), (by, right, m) = (x[out_at] for x in out), (x[in_at] for x in in_)
    symbols, new = [], []
    for w in np.union1d(left, right):
        if not chosen(w):
            continue
        a, b = np.searchsorted(left, [w, w + 1])
        c, d = np.searchsorted(right, [w, w + 1])
        self_ = to[a:b] == w
        own = float(n[a:b][self_].sum())
        after = np.bincount(of[to[a:b][~self_]], weights=n[a:b][~self_], minlength=classes)
        apart = by[c:d] != w
        before = np.bincount(of[by[c:d][apart]], weights=m[c:d][apart], minlength=classes)
        k = best_class(int(of[w]), own, after, before, joint)
        if k != of[w]:
            symbols.append(int(w))
            new.append(k)
    return symbols, new


def _joint(pairs: DataFrame, of, classes: int) -> np.ndarray:
    def count(batches):
        total = np.zeros(classes * classes, dtype=np.int64)
        for b in batches:
            for i in range(b.num_rows):
                left, right, n = (np.frombuffer(b.column(s)[i].as_buffer(), t) for s, t in zip(_SIDES, _KINDS))
                total += np.bincount(of.value[left].astype(np.int64) * classes + of.value[right], weights=n, minlength=classes * classes).astype(np.int64)
        if total.any():
            yield C.count_rows(total, C.task_salt())

    return C.summed(pairs.select(*_SIDES).mapInArrow(count, "chunk int, salt int, counts binary"), pairs.sparkSession, classes * classes).reshape(classes, classes).astype(float)


def exchange_clusters(pairs: DataFrame, counts: np.ndarray, classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each symbol by the exchange algorithm, and the counts of class pairs; classes begin as ranks by frequency, modulo their number."""
    spark = pairs.sparkSession
    of = np.empty(len(counts), dtype=np.int16)
    of[np.argsort(-counts, kind="stable")] = np.arange(len(counts)) % classes
    shared = spark.sparkContext.broadcast(of)
    joint = _joint(pairs, shared, classes)
    for turn in range(rounds * TURNS):
        given = spark.sparkContext.broadcast((of, joint))
        part = turn % TURNS

        def move(batches):
            now, counted = given.value
            chosen = lambda w: int(C.mix(np.array([w], dtype=np.uint64))[0] % np.uint64(TURNS)) == part  # noqa: E731, B023
            for b in batches:
                for i in range(b.num_rows):
                    arrays = [np.frombuffer(b.column(s)[i].as_buffer(), t) for s, t in zip((*_SIDES, *_IN), (*_KINDS, *_KINDS))]
                    symbols, new = moves(arrays[:3], arrays[3:], now, counted, chosen)
                    if symbols:
                        yield pa.RecordBatch.from_arrays([pa.array(symbols, pa.int32()), pa.array(new, pa.int32())], names=["symbol", "class"])

        moved = pairs.mapInArrow(move, "symbol int, class int").toArrow()
        given.unpersist()
        if not moved.num_rows:
            continue
        tried = of.copy()
        tried[moved.column("symbol").to_numpy()] = moved.column("class").to_numpy()
        shared.unpersist()
        shared = spark.sparkContext.broadcast(tried)
        new = _joint(pairs, shared, classes)
        if information(new) > information(joint):
            of, joint = tried, new
    return of, joint


def train_model(train: DataFrame, frequent: int = 1 << 17, classes: int = 48, endings: int = 1024, rounds: int = 1) -> TrainedModel:
    """Fit on all texts of `train`.

    The `frequent` commonest words and the `endings` are the symbols that are exchanged
    between `classes`. These sizes bound what the driver and a broadcast hold.
    """
    spark = train.sparkSession
    C.session_limits(spark)
    vocabulary = _count_words(train, endings)
    sums = vocabulary.agg(F.sum("n"), F.count("*")).first()
    top = vocabulary.orderBy(F.desc("n"), "word").limit(frequent).select("word", "n").toArrow()
    words, counts = top.column("word").to_numpy().astype(np.int64).view(np.uint64), top.column("n").to_numpy().astype(np.int64)
    if END not in words:
        words, counts = np.append(words, END), np.append(counts, 0)
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    shared = spark.sparkContext.broadcast(words)

    def of_ending(batches):
        own, table = np.zeros(2 * endings, dtype=np.int64), shared.value
        for b in batches:
            rest = ~_found(table, b.column("word").to_numpy().view(np.uint64))[1]
            shape = b.column("shape").to_numpy()[rest]
            own[:endings] += np.bincount(shape, weights=b.column("n").to_numpy()[rest], minlength=endings).astype(np.int64)
            own[endings:] += np.bincount(shape, minlength=endings)
        if own.any():
            yield C.count_rows(own, C.task_salt())

    rest = C.summed(vocabulary.mapInArrow(of_ending, "chunk int, salt int, counts binary"), spark, 2 * endings)
    total = int(sums[0] or 0)
    by_count = np.concatenate([counts, rest[:endings]])
    of, joint = exchange_clusters(_count_pairs(train, shared, endings, total), by_count, classes, rounds)
    # Smoothing: half a count for every pair of classes and every symbol of a class.
    joint, emission = joint + 0.5, by_count + 0.5
    log_ending = np.log10(rest[:endings] + 0.5 * (rest[endings:] + 1))
    core = ClassModel(words, counts, of, np.log10(emission / np.bincount(of, weights=emission, minlength=classes)[of]), np.log10(joint / joint.sum(axis=1, keepdims=True)), log_ending, total, int(sums[1]), endings)
    return TrainedModel(core, vocabulary)


_PARTS = ["doc", "doc_id", "held_out", "n_tokens", "known", "base", "own", "bucket", "word", "at", "n"]


def score(docs: DataFrame, model: TrainedModel) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of each text.

    `docs` are any texts, with doc_id, text and held_out (passed through).
    """
    spark = docs.sparkSession
    C.session_limits(spark)
    shared = spark.sparkContext.broadcast(model.core)
    step = np.uint64((1 << 64) // (FINE * C.partitions(spark)) + 1)
    by_text = FINE * C.partitions(spark)

    def packed(held):
        word, doc, n = (np.concatenate([x[k] for x in held]) for k in range(3))
        rows = C.bucket_rows((word // step).astype(np.int64), [word, doc, n], ["word", "at", "n"])
        empty = [pa.nulls(rows.num_rows, t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays([*empty, *rows.columns], names=_PARTS)

    def deal(batches):
        m = shared.value
        log_count = np.log10(m.counts + 0.5)
        end_class = m.symbol_class[np.searchsorted(m.words, END)]
        held, size = [], 0
        for b in C.slices(batches):
            symbols, at, tokens, ending = _symbols(b, m.words, m.endings)
            of = m.symbol_class[symbols]
            before = np.empty_like(of)
            before[1:] = of[:-1]
            before[at[:-1]] = end_class
            frequent = symbols < len(m.words)
            place = np.minimum(symbols, len(m.words) - 1)
            own = m.log_transition[before, of] + m.log_emission[symbols] - np.where(frequent, 0.0, m.log_ending_total[ending])
            base = np.where(frequent, log_count[place], 0.0)
            known = frequent & (m.counts[place] > 0)
            sums = [np.concatenate([[0.0], np.cumsum(x)]) for x in (own, base, known)]
            own, base, known = (x[at[1:]] - x[at[:-1]] for x in sums)
            k = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("doc_id"), b.column("held_out"), pa.array(np.diff(at)), pa.array(np.rint(known).astype(np.int64)), pa.array(base), pa.array(own), pa.nulls(k, pa.int32()), *[pa.nulls(k, pa.binary())] * 3], names=_PARTS)
            where = np.flatnonzero(~frequent)
            if len(where):
                # A text's occurrences of a word go as one.
                doc = b.column("doc").to_numpy()
                text = np.searchsorted(at, where, side="right") - 1
                order = np.lexsort((tokens[where], text))
                w, t = tokens[where][order], text[order]
                new = np.ones(len(w), dtype=bool)
                new[1:] = (w[1:] != w[:-1]) | (t[1:] != t[:-1])
                first = np.flatnonzero(new)
                held.append((w[first], doc[t[first]], np.diff(np.append(first, len(w))).astype(np.int64)))
                size += len(first)
            if size >= FLUSH:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    def rare_words(batches):
        """The vocabulary's words that the model has no symbol for, dealt like the occurrences; -1 stands for the text."""
        for b in batches:
            word = b.column("word").to_numpy().view(np.uint64)
            rest = ~_found(shared.value.words, word)[1]
            if rest.any():
                n = b.column("n").to_numpy()[rest]
                yield C.bucket_rows((word[rest] // step).astype(np.int64), [word[rest], np.full(len(n), -1, dtype=np.int64), n], ["word", "at", "n"])

    def meet(batches):
        for _, (word, doc, n) in C.each_bucket(batches, ["word", "at", "n"], [np.uint64, np.int64, np.int64]):
            is_entry = doc < 0
            table, counts = word[is_entry], n[is_entry]
            order = np.argsort(table)
            table, counts = table[order], counts[order]
            word, doc, n = word[~is_entry], doc[~is_entry], n[~is_entry]
            if not len(word):
                continue
            count = np.zeros(len(word), dtype=np.int64)
            if len(table):
                place, hit = _found(table, word)
                count[hit] = counts[place[hit]]
            yield of_texts(doc, n * (count > 0), np.log10(count + 0.5) * n)

    def of_texts(doc, known, base):
        """Sums by text, packed and dealt by text."""
        doc, place = np.unique(doc, return_inverse=True)
        sums = [doc, np.bincount(place, weights=known).astype(np.int64), np.bincount(place, weights=base)]
        return C.bucket_rows((C.mix(doc.view(np.uint64)) % np.uint64(by_text)).astype(np.int64), sums, ["doc", "rare_known", "rare"])

    def together(batches):
        for _, (doc, known, base) in C.each_bucket(batches, ["doc", "rare_known", "rare"], [np.int64, np.int64, np.float64]):
            doc, place = np.unique(doc, return_inverse=True)
            known, base = np.bincount(place, weights=known).astype(np.int64), np.bincount(place, weights=base)
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(known), pa.array(base)], names=["doc", "rare_known", "rare"])

    schema = "doc bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, own double, bucket int, word binary, at binary, n binary"
    given = docs.select(F.monotonically_increasing_id().alias("doc"), F.col("doc_id").cast("bigint").alias("doc_id"), "held_out", F.col("text").cast("string").alias("text"))
    table = kept(given.mapInArrow(deal, schema))
    packed_schema = "bucket int, word binary, at binary, n binary"
    occurrences = table.filter("bucket is not null").select("bucket", "word", "at", "n").unionByName(model.vocabulary.mapInArrow(rare_words, packed_schema))
    rare = C.dealt(occurrences, spark).mapInArrow(meet, "bucket int, doc binary, rare_known binary, rare binary")
    rare = C.dealt(rare, spark).mapInArrow(together, "doc bigint, rare_known bigint, rare double")
    m = model.core
    whole = float(np.log10(m.tokens + 0.5 * (m.distinct + 1)))
    extra = F.coalesce("rare", F.lit(0.0))
    out = (
        table.filter("bucket is null")
        .join(rare, "doc", "left")
        .select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(m.tokens).cast("long").alias("train_tokens"), (F.col("base") + extra - F.col("n_tokens") * F.lit(whole)).alias("base_score"), (F.col("own") + extra).alias("score"))
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
