"""Near-duplicate join on word shingles: prefix filter, then a trie of ordered sets.

A document's set holds its distinct five-word shingles (64-bit hashes). All sets are put in
one global order by how often a shingle's hash bin occurs in the corpus. Two sets with
Jaccard similarity t share a shingle among the first |x| - ceil(t |x|) + 1 of each in
rare-first order, so these few are shuffled; a shingle of one set alone ends there. Equal
sets are one node from the start.

Nodes that share rare shingles are compared in rounds of stars: every node with a few hubs of
its shingles that are in other components, for as long as that joins components. That makes
few rows for a large group of near copies. Then, of shingles that still span several
components, every pair of nodes of different components that share one early enough in both
sets, and enough of them, for a link. Where a shingle has many nodes these pairs are made in
turns, first with few of its nodes, then with more, and components are joined after each: a
node that a large component has not reached yet is joined to it by some of the first pairs and
then makes none with the rest. A pair within one component can't change the result, so it
isn't made; a pair that is still across components always is, so no link is lost.

Before two sets are compared, their signs are: of 1024 parts of the range of hashes, whether
a set has an odd number of shingles in each. Where signs differ a shingle is in one set only,
so sets whose signs differ more often than a link allows don't link. Only pairs that pass
become rows of their own; most of the near copies that miss the threshold never do.

Pairs are verified by trie: the candidates of one node, in common-first order, stand sorted
so that equal beginnings are adjacent (a trie whose paths are shared beginnings). One walk
counts each shared path's overlap once and leaves a branch when what remains of a set can't
reach the needed overlap.

Defined cases: null or wordless text has an empty set, no link and its own id as component;
fewer than five words are one shingle; equal rows are linked like any copies; a null doc_id
takes no part in links and has a null component; rows with one doc_id and different texts are
documents of their own, each in the component of its text; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import columns as C
from .graph import components
from .storage import dropped, kept

#: Bits of a shingle's hash bin: so many that a bin holds about PER_BIN shingles of the corpus, within these bounds (the counts are 4 bytes a bin).
LEAST_BITS, MOST_BITS, PER_BIN = 19, 24, 256
#: Bits of the filter by which a scan finds the texts of nodes, at most; more nodes are joined with all texts.
FILTER_BITS = 1 << 30
FLUSH = 1 << 19
BLOCK = 64
#: Hubs that a node is compared with in a round of stars, and rounds at most; they also end when one finds a fifth of what the first did.
STARS, ROUNDS = 2, 12
#: Beyond so many nodes a shingle's pairs are made by levels; one in so many nodes of a level is of the next, too.
FEW, SHARE = 32, 8
#: 64-bit numbers of a set's sign.
SIGN = 16


def _bin(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _ranks(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each shingle's bin occurs in the corpus."""
    return counts[_bin(s, len(counts).bit_length() - 1)]


def _bits(docs: DataFrame) -> int:
    """Bits of a bin, from the size of the corpus; a shingle begins about every six bytes."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, (size // (6 * PER_BIN)).bit_length()))


def shingle_sets(batch):
    """The sorted set of each text of a batch."""
    data, offsets = C.text_bytes(batch.column("text"))
    data = C.LOWER[data]
    starts, ends, at = C.word_spans(data, offsets, C.NOT_SPACE)
    hashes, begins = C.shingle_hashes(C.span_hashes(C.prefix_sums(data), starts, ends), at)
    return [np.unique(hashes[b:e]) for b, e in zip(begins[:-1], begins[1:])]


def _node_hash(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(C.mix(np.array([C.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0])


def sign(s: np.ndarray) -> np.ndarray:
    """The parity of a set's shingles in each part of the range of hashes, as SIGN numbers."""
    odd = np.bincount((C.mix(s) & np.uint64(64 * SIGN - 1)).astype(np.int64), minlength=64 * SIGN) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _apart(a: str, b: str):
    """Parts in which two signs differ: at most as many as the shingles that one of the sets has and the other has not."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1, SIGN)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))


def _survey(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n_shingles, sid, sign) of every document, kept; and the corpus counts by hash bin."""
    bits = _bits(docs)
    schema = "doc_id bigint, n_shingles bigint, sid bigint, sign array<bigint>, chunk int, salt int, counts binary"
    names = ["doc_id", "n_shingles", "sid", "sign", "chunk", "salt", "counts"]

    def run(batches):
        counts = np.zeros(1 << bits, dtype=np.int64)
        for b in C.slices(batches):
            sets = shingle_sets(b)
            if sets:
                counts += np.bincount(_bin(np.concatenate(sets), bits), minlength=1 << bits)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_node_hash(s) if len(s) else None for s in sets], pa.int64()), pa.array([sign(s) if len(s) else None for s in sets], pa.list_(pa.int64())), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names
            )
        if counts.any():
            rows = C.count_rows(counts.astype(np.uint32), C.task_salt())
            n = rows.num_rows
            yield pa.RecordBatch.from_arrays([*[pa.nulls(n, pa.int64())] * 3, pa.nulls(n, pa.list_(pa.int64())), *rows.columns], names=names)

    table = kept(docs.mapInArrow(run, schema))
    counts = C.summed(table.filter("chunk is not null").select("chunk", "salt", "counts"), docs.sparkSession, 1 << bits, np.uint32)
    return table.filter("chunk is null").select("doc_id", "n_shingles", "sid", "sign"), counts


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _rest(size: str, percent: int):
    """Shingles of a set beyond its prefix."""
    return F.ceil(percent * F.col(size) / 100) - 1


def _shared(docs: DataFrame, counts, percent: int) -> DataFrame:
    """(token, sid, at) of the prefix shingles that more than one set has; `at` is a shingle's place in its set, rarest first."""
    spark = docs.sparkSession
    buckets = 8 * C.partitions(spark)
    step = np.uint64((1 << 64) // buckets + 1)

    def distinct(tokens, sids, at):
        order = np.lexsort((sids, tokens))
        tokens, sids, at = tokens[order], sids[order], at[order]
        new = np.ones(len(tokens), dtype=bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (sids[1:] != sids[:-1])
        return tokens[new], sids[new], at[new]

    def rows(tokens, sids, at):
        tokens, sids, at = distinct(np.concatenate(tokens), np.concatenate(sids), np.concatenate(at))
        return C.bucket_rows((tokens // step).astype(np.int64), [tokens, sids, at], ["tokens", "sids", "at"])

    def deal(batches):
        rank, tokens, sids, at, size = counts.value, [], [], [], 0
        for b in C.slices(batches):
            for s in shingle_sets(b):
                if len(s):
                    own = s[np.lexsort((s, _ranks(s, rank)))[: prefix_length(len(s), percent)]]
                    tokens.append(own)
                    sids.append(np.full(len(own), _node_hash(s), dtype=np.int64))
                    at.append(np.arange(len(own), dtype=np.int32))
                    size += len(own)
            if size >= FLUSH:
                yield rows(tokens, sids, at)
                tokens, sids, at, size = [], [], [], 0
        if size:
            yield rows(tokens, sids, at)

    def meet(batches):
        for _, (tokens, sids, at) in C.each_bucket(batches, ["tokens", "sids", "at"], [np.uint64, np.int64, np.int32]):
            tokens, sids, at = distinct(tokens, sids, at)
            same = tokens[1:] == tokens[:-1]
            live = np.zeros(len(tokens), dtype=bool)
            live[1:] |= same
            live[:-1] |= same
            columns = tokens[live].view(np.int64), sids[live], at[live]
            for i in range(0, len(columns[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in columns], names=["token", "sid", "at"])

    dealt = docs.select("text").mapInArrow(deal, "bucket int, tokens binary, sids binary, at binary")
    return C.dealt(dealt, spark).mapInArrow(meet, "token bigint, sid bigint, at int")


def _sets_of(docs: DataFrame, nodes: DataFrame, counts) -> DataFrame:
    """(node, size, tokens) of the sets of `nodes` (node, rep: a document that has the set); tokens in common-first order.

    The documents' ids go to the scan as a Bloom filter of a bounded size; the join after it is exact.
    """
    spark = docs.sparkSession
    n = nodes.count()
    docs = docs.filter("doc_id is not null")
    if 8 * n > FILTER_BITS:
        return _taken(docs.join(nodes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), nodes, counts, None)
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * n).bit_length()))
    place = lambda ids: C.mix(ids.astype(np.int64).view(np.uint64)) & np.uint64(bits - 1)

    def mark(batches):
        field = np.zeros(bits // 8, dtype=np.uint8)
        for b in batches:
            at = place(b.column("rep").to_numpy(zero_copy_only=False))
            np.bitwise_or.at(field, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        for i in range(0, len(field), 1 << 13):
            if field[i : i + (1 << 13)].any():
                yield pa.RecordBatch.from_arrays([pa.array([i >> 13], pa.int32()), pa.array([field[i : i + (1 << 13)].tobytes()], pa.binary())], names=["chunk", "field"])

    def merge(batches):
        found: dict = {}
        for b in batches:
            for k, v in zip(b.column("chunk").to_pylist(), b.column("field").to_pylist()):
                v = np.frombuffer(v, dtype=np.uint8)
                found[k] = found[k] | v if k in found else v
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())], names=["chunk", "field"])

    field = np.zeros(bits // 8, dtype=np.uint8)
    for r in nodes.select("rep").mapInArrow(mark, "chunk int, field binary").repartition(C.partitions(spark), "chunk").mapInArrow(merge, "chunk int, field binary").collect():
        field[r["chunk"] << 13 : (r["chunk"] << 13) + len(r["field"])] = np.frombuffer(r["field"], dtype=np.uint8)
    shared = spark.sparkContext.broadcast(field)

    def among(ids):
        at, bloom = place(ids), shared.value
        return ((bloom[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)

    return _taken(docs, nodes, counts, among)


def _taken(docs: DataFrame, nodes: DataFrame, counts, among) -> DataFrame:
    def run(batches):
        rank = counts.value
        for b in C.slices(batches):
            if among:
                b = b.filter(pa.array(among(b.column("doc_id").to_numpy(zero_copy_only=False))))
            sets = [(i, s) for i, s in enumerate(shingle_sets(b)) if len(s)] if b.num_rows else []
            if not sets:
                continue
            rep = b.column("doc_id").take(pa.array([i for i, _ in sets]))
            blobs = [s[np.lexsort((s, -_ranks(s, rank).astype(np.int64)))].tobytes() for _, s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([_node_hash(s) for _, s in sets], pa.int64()), rep, pa.array([len(s) for _, s in sets], pa.int64()), pa.array(blobs, pa.binary())], names=["node", "rep", "size", "tokens"])

    return docs.mapInArrow(run, "node bigint, rep bigint, size bigint, tokens binary").join(nodes, ["node", "rep"], "left_semi").drop("rep")


def trie_overlaps(probe: np.ndarray, sets: list[bytes], percent: int) -> list[bool]:
    """For each ordered set (packed 64-bit tokens) whether it links with `probe`.

    Sorted by their bytes the sets are a trie in depth-first order: a set shares the path of
    the one before it as far as their common beginning goes.
    """
    members = np.sort(probe)
    order = sorted(range(len(sets)), key=sets.__getitem__)
    out = [False] * len(sets)
    path = np.zeros(0, dtype=np.uint64)  # the tokens walked
    overlap = np.zeros(1, dtype=np.int64)  # at each depth of the walked path
    for i in order:
        tokens = np.frombuffer(sets[i], dtype=np.uint64)
        n = len(tokens)
        need = -(-percent * (len(members) + n) // (100 + percent))
        limit = min(n, len(path))
        apart = np.flatnonzero(tokens[:limit] != path[:limit])
        depth = int(apart[0]) if len(apart) else limit
        overlap = overlap[: depth + 1]
        if min(n, len(members)) < need:
            path = tokens[:depth]
            continue
        while depth < n and overlap[depth] + n - depth >= need:
            block = tokens[depth : depth + BLOCK]
            at = np.searchsorted(members, block)
            hit = members[np.minimum(at, len(members) - 1)] == block
            overlap = np.concatenate([overlap, overlap[depth] + np.cumsum(hit)])
            depth += len(block)
        path = tokens[:depth]
        out[i] = depth == n and bool(overlap[n] >= need)
    return out


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` (a, b) that link; b is the side with fewer distinct nodes."""

    def run(batches):
        for b in batches:
            left, right = b.column("a").to_numpy(), b.column("b").to_numpy()
            own, other = b.column("own").to_pylist(), b.column("other").to_pylist()
            keep = np.zeros(b.num_rows, dtype=bool)
            order = np.argsort(right, kind="stable")
            cut = np.flatnonzero(np.diff(right[order])) + 1
            for group in np.split(order, cut):
                keep[group] = trie_overlaps(np.frombuffer(other[group[0]], dtype=np.uint64), [own[i] for i in group], percent)
            yield pa.RecordBatch.from_arrays([pa.array(left[keep]), pa.array(right[keep])], names=["a", "b"])

    own = sets.select(F.col("node").alias("a"), F.col("tokens").alias("own"))
    other = sets.select(F.col("node").alias("b"), F.col("tokens").alias("other"))
    return pairs.join(own, "a").join(other, "b").select("a", "b", "own", "other").mapInArrow(run, "a bigint, b bigint")


def _levels(most: int) -> int:
    """Levels above 0, for a shingle of `most` nodes to have about FEW at the highest."""
    top = 0
    while FEW * SHARE**top < most:
        top += 1
    return top


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component, size) once `links` (a, b) of their nodes join them."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    between = links.join(of("a"), "a").join(of("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    joined = components(between).select(F.col("node").alias("component"), F.col("component").alias("further"))
    return kept(labels.join(joined, "component", "left").select("node", F.coalesce("further", "component").alias("component"), "size"))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    C.session_limits(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    survey, counts = _survey(docs)
    counts = spark.sparkContext.broadcast(counts)
    # A node is a set; any document that has it stands for it where its text is needed.
    classes = kept(survey.filter("sid is not null and doc_id is not null").groupBy(F.col("sid").alias("node")).agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("size"), F.max("sign").alias("own_sign")))
    shared = kept(_shared(docs, counts, percent).withColumnRenamed("sid", "node"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of `pairs` (a, b) that link; only the sets of these nodes are read and moved, and none is kept."""
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        nodes = kept(classes.select("node", "rep").join(wanted, "node", "left_semi"))
        sets = kept(_sets_of(docs, nodes, counts))
        found = kept(_linked(pairs, sets, percent))
        dropped(nodes)
        dropped(sets)
        return found

    needed = F.ceil(percent * (F.col("size") + F.col("size_b")) / (100 + percent))
    # Of a link's shared shingles, all but those of the longer rest beyond the prefixes are shared by the prefixes.
    least = needed - F.greatest(_rest("size", percent), _rest("size_b", percent))
    allowed = 100 * F.least("size", "size_b") >= percent * F.greatest("size", "size_b")
    near = _apart("sign", "sign_b") <= F.col("size") + F.col("size_b") - 2 * needed
    # Both sides of a join give all columns new names and filter alike, so that they share one exchange.
    signs = classes.filter("node is not null and own_sign is not null")
    signs_a, signs_b = signs.select(F.col("node").alias("a"), F.col("own_sign").alias("sign")), signs.select(F.col("node").alias("b"), F.col("own_sign").alias("sign_b"))

    # Rounds of stars: each node with those hubs of its shingles, of other components, with which it shares most of
    # them. A hub is the first of a shingle's nodes in an order of the round. Shingles of one component alone go.
    # Aggregates read `at`, too, so that their rows are dealt by node once for them and for the join with what they give.
    labels = kept(classes.select("node", F.col("node").alias("component"), "size"))
    open_, last, most = shared, shared, None
    for turn in range(ROUNDS):
        placed = open_.join(labels, "node")
        turned = lambda c: F.col(c).bitwiseXOR(F.xxhash64(F.lit(turn)))
        order = turned("node")
        hubs = placed.groupBy("token").agg(F.min(order).alias("hub"), F.min_by("size", order).alias("size_b"), F.min_by("component", order).alias("component_b"), F.min("component").alias("low"), F.max("component").alias("high"), F.max("at").alias("last"))
        hubs = hubs.filter("low <> high and last >= 0").select("token", turned("hub").alias("b"), "size_b", "component_b")
        placed = kept(placed.join(hubs, "token"))
        dropped(last)
        open_, last = placed.select("token", "node", "at"), placed
        stars = (
            placed.filter("component <> component_b").filter(allowed)
            .groupBy(F.col("node").alias("a"), "b", "size", "size_b").agg(F.count("*").alias("n"))
            .filter(4 * F.col("n") >= least)
            .join(signs_a, "a").join(signs_b, "b").filter(near)
            .groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", F.xxhash64("b").alias("order"), "b")), asc=False), 1, STARS).alias("best"))
            .select("a", F.explode("best.b").alias("b"))
        )
        stars = kept(stars)
        found = verified(stars)
        n = found.count()
        if n:
            before, labels = labels, _merged(labels, found)
            dropped(before)
        dropped(stars)
        dropped(found)
        most = most or n
        if 5 * n <= most:
            break

    # Shingles that still span several components: every pair across them that may link. The first
    # shingle that such a pair shares has at least `needed` - 1 after it in either set, and at least
    # `least` of the shared ones are in both prefixes. A pair whose shingles before this one are equal is made there,
    # and one whose signs are too far apart nowhere.
    columns = ["token", "prior", "node", "size", "at", "own_sign", "component", "n"]

    def opened(rows: DataFrame) -> DataFrame:
        """Those of `rows` (token, node, at) whose shingles span several components, with what pairs are made of; all nodes of a shingle stay or go, so `n` of them."""
        placed = rows.join(labels, "node")
        spans = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("at").alias("last"), F.count("*").alias("n")).filter("low <> high and last >= 0").select("token", "n")
        placed = placed.join(spans, "token").withColumn("prior", F.lag("token").over(Window.partitionBy("node").orderBy("at"))).join(signs.select("node", "own_sign"), "node")
        return kept(placed.select(*[F.col(c).alias(f"own_{i}") for i, c in enumerate(columns)]))

    open_ = opened(open_)
    dropped(last)
    prefixes = kept(open_.groupBy(F.col("own_2").alias("node")).agg(F.collect_list("own_0").alias("tokens")))  # a node's are as many as its prefix at most
    early = (F.col("at") <= F.col("size") - needed) & (F.col("at_b") <= F.col("size_b") - needed)
    names_a, names_b = ["token_a", "prior_a", "a", "size", "at", "sign", "component_a"], ["token", "prior", "b", "size_b", "at_b", "sign_b", "component_b"]
    # Where a shingle has many nodes, each that its component hasn't reached yet would make a pair with every node of a
    # large component. There a pair is made at the higher of its nodes' levels, highest first: few nodes are that high, and
    # what they join makes no further pairs with one another. Level 0 has the pairs of all others, so none is left out.
    # Only rows of these shingles are labelled anew; those of few nodes make few pairs with the components as they were.
    top = _levels(open_.agg(F.max("own_7")).first()[0] or 0)
    level = sum(((F.xxhash64("own_2").bitwiseAND(F.lit(SHARE**k - 1)) == 0).cast("int") for k in range(1, top + 1)), F.lit(0))
    few, first = open_.filter(F.col("own_7") <= FEW), open_.filter(F.col("own_7") > FEW) if top else open_
    many = first
    for turn in range(top, -1, -1):
        # All but `prior` are never null.
        rows = many if turn or not top else few.union(many.filter(level == 0))
        rows = rows.filter(" and ".join(f"own_{i} is not null" for i, c in enumerate(columns) if c != "prior"))
        if turn:
            side_a, side_b = rows.withColumn("level", level).filter(F.col("level") <= turn), rows.filter(level == turn)
            other = (F.col("component_a") != F.col("component_b")) & ((F.col("level") < turn) | (F.col("component_a") > F.col("component_b")))
        else:
            side_a = side_b = rows
            other = F.col("component_a") > F.col("component_b")
        left, right = (side.select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(names)], *[c for c in ("level",) if c in side.columns]) for side, names in ((side_a, names_a), (side_b, names_b)))
        across = left.join(right, (F.col("token_a") == F.col("token")) & other & allowed & early & F.coalesce(F.col("prior_a") != F.col("prior"), F.lit(True)) & near)
        across = across.select("a", "b", "size", "size_b").distinct()
        across = across.join(prefixes.select(F.col("node").alias("a"), F.col("tokens").alias("of_a")), "a").join(prefixes.select(F.col("node").alias("b"), F.col("tokens").alias("of_b")), "b")
        across = kept(across.filter(F.size(F.array_intersect("of_a", "of_b")) >= least).select("a", "b"))
        if across.isEmpty():
            continue
        found = verified(across)
        if not found.isEmpty():
            before, labels = labels, _merged(labels, found)
            dropped(before)
            if turn:
                before, many = many, opened(many.select(F.col("own_0").alias("token"), F.col("own_2").alias("node"), F.col("own_4").alias("at")))
                if before is not first:  # which the rows of few nodes are read from, too
                    dropped(before)
        dropped(across)
        dropped(found)
    placed = kept(classes.join(labels, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component")))
    least = placed.groupBy("component").agg(F.min("rep").alias("of_class"))
    of_class = placed.join(least, "component").select(F.col("node").alias("sid"), "of_class")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("of_class", "doc_id"))
    return survey.join(kept(of_class), "sid", "left").select("doc_id", "n_shingles", component.alias("component_id"))
