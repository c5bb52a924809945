"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features are densities of lexicon words (a fixed list of insults, and terms learned from the
labelled rows), their closeness to second-person words, capitals, punctuation and
obfuscation (insults that show only once punctuation inside them is dropped or digits are
read as letters). A batch's words are hashes, so a lexicon look-up is one binary search for all.

Training uses the labelled rows, at most `max_rows` of them by hash of the id. A third of
them each teaches the learned terms, the trees and the calibration, so that no part judges
rows that an earlier part has fitted.

Defined cases: a null or empty text has zero features and gets the score these have; without
positive or without negative labels the score is the share of positive ones, or 0 without
labels; rows with a null label or id are left out of training; equal texts score alike;
columns named score or predicted give way to the result, all others pass through.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import columns as C
from .storage import kept

# Insults and second-person words in the corpus's languages.
INSULTS = """idiot idiots stupid moron morons scum trash loser losers clown clowns disgusting pathetic worthless
dumb dumbass fool fools jerk jerks garbage filth filthy vermin imbecile cretin retard retarded bastard bitch asshole
shit fuck fucking fucker crap whore slut pig pigs hate kill ugly coward liar freak creep degenerate parasite subhuman
dummkopf idioten arschloch schlampe abschaum dreckig widerlich trottel versager scheiße
connard connasse salope imbécile crétin ordure débile pourriture merde pathétique
idiota estúpido estúpida imbécil basura escoria asqueroso patético cabrón puta mierda gilipollas""".split()
SECOND_PERSON = "you your yours yourself you're youre u du dich dir dein deine ihr euch tu toi ton ta tes vous votre vos te tú ti usted ustedes vosotros".split()
PREFIXES = (4, 5, 6, 8)
NEAR = 4
FEATURES = ["insults", "learned", "learned_best", "obfuscated", "near_person", "person", "capitals", "shouted", "marks", "exclamations", "symbols", "digits", "words", "any_insult", "any_learned"]
_LEET = C.LOWER.copy()
for _a, _b in zip(b"013457@$", b"oieastas"):
    _LEET[_a] = _b
_IS_PUNCTUATION = np.zeros(256, dtype=bool)
_IS_PUNCTUATION[33:48] = _IS_PUNCTUATION[58:65] = _IS_PUNCTUATION[91:97] = _IS_PUNCTUATION[123:127] = True


def _hashes(words) -> np.ndarray:
    return np.sort(np.array([C.hash_of(w.encode()) for w in dict.fromkeys(words)], dtype=np.uint64))


_INSULTS, _PERSON = _hashes(INSULTS), _hashes(SECOND_PERSON)


@dataclass
class Trees:
    """Boosted regression trees of one depth over binned features."""

    edges: list[np.ndarray]
    base: float
    rate: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = _binned(x, self.edges)
        out = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[node]
                if (f < 0).all():
                    break
                right = binned[np.arange(len(x)), np.maximum(f, 0)] > cut[node]
                node = np.where(f < 0, node, 2 * node + 1 + right)
            out += self.rate * value[node]
        return out


@dataclass
class ToxicityModel:
    terms: np.ndarray  # sorted hashes of learned words and beginnings of words
    weights: np.ndarray
    trees: Trees | None
    steps: tuple[np.ndarray, np.ndarray]  # isotonic: margins and probabilities
    prior: float


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, least: float = 2.0, bins: int = 64) -> Trees:
    """Newton boosting of the logistic loss on histograms."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(edges, float(np.log(p / (1 - p))), rate)
    binned, margin = _binned(x, edges), np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        size = 2 ** (depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, dtype=np.int64), np.zeros(size)
        rows = {0: np.arange(len(y))}
        for node in range(size):
            own = rows.pop(node, None)
            if own is None:
                continue
            gs, hs = g[own].sum(), h[own].sum()
            value[node] = -gs / (hs + 1.0)
            if node >= size // 2 or len(own) < 2:
                continue
            best = (1e-6, -1, 0)
            for k in range(x.shape[1]):
                if not len(edges[k]):
                    continue
                gl = np.cumsum(np.bincount(binned[own, k], weights=g[own], minlength=len(edges[k]) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[own, k], weights=h[own], minlength=len(edges[k]) + 1))[:-1]
                nl = np.cumsum(np.bincount(binned[own, k], minlength=len(edges[k]) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(nl < least) | (len(own) - nl < least)] = 0
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], k, at)
            if best[1] >= 0:
                feature[node], cut[node] = best[1], best[2]
                right = binned[own, best[1]] > best[2]
                rows[2 * node + 1], rows[2 * node + 2] = own[~right], own[right]
        model.trees.append((feature, cut, value))
        node = np.zeros(len(y), dtype=np.int64)
        for _ in range(depth):
            f = feature[node]
            right = binned[np.arange(len(y)), np.maximum(f, 0)] > cut[node]
            node = np.where(f < 0, node, 2 * node + 1 + right)
        margin += rate * value[node]
    return model


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: margins in order and the mean labels of their pools."""
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []
    for m, v in zip(margin[order], y[order]):
        if pools and pools[-1][3] == m:
            pools[-1][0] += v
            pools[-1][1] += 1
        else:
            pools.append([float(v), 1.0, m, m])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            b = pools.pop()
            pools[-1] = [pools[-1][0] + b[0], pools[-1][1] + b[1], pools[-1][2], b[3]]
    xs = np.array([x for p in pools for x in (p[2], p[3])])
    return xs, np.array([p[0] / p[1] for p in pools for _ in (0, 1)])


def _is_in(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(h), dtype=bool)
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


def _plain_words(data, offsets, table):
    """Prefix sums and word spans of the texts with punctuation dropped and bytes mapped by `table`."""
    keep = ~_IS_PUNCTUATION[data]
    kept = table[data[keep]]
    new = np.concatenate([[0], np.cumsum(keep)])[offsets]
    starts, ends, at = C.word_spans(kept, new, C.NOT_SPACE)
    return C.prefix_sums(kept), starts, ends, at


def _bare(data, starts, ends):
    """The words' spans without the punctuation before and behind them."""
    at = np.arange(len(data))
    word = ~_IS_PUNCTUATION[data]
    first = np.minimum.accumulate(np.where(word, at, len(data))[::-1])[::-1]
    last = np.maximum.accumulate(np.where(word, at, -1))
    starts, ends = first[starts], last[ends - 1] + 1
    return np.minimum(starts, ends), ends


def terms_of(batch):
    """Hashes of the words and word beginnings of each text, and the number of each."""
    data, offsets = C.text_bytes(batch.column("text"))
    sums, starts, ends, at = _plain_words(data, offsets, C.LOWER)
    text = np.repeat(np.arange(batch.num_rows), np.diff(at))
    found = [(text, C.span_hashes(sums, starts, ends))]
    for k in PREFIXES:
        long = ends - starts > k
        found.append((text[long], C.span_hashes(sums, starts[long], starts[long] + k) ^ np.uint64(k)))
    return np.concatenate([t for t, _ in found]), np.concatenate([h for _, h in found])


def features(batch, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The dense features (FEATURES) of each text."""
    data, offsets = C.text_bytes(batch.column("text"))
    n = batch.num_rows
    size = np.maximum(np.diff(offsets), 1)

    def share(mask):
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / size

    upper = (data >= 65) & (data <= 90)
    lower = (data >= 97) & (data <= 122)
    letters = np.maximum(share(upper | lower), 1e-9)
    sums, starts, ends, at = _plain_words(data, offsets, C.LOWER)
    words = np.diff(at)
    per = np.maximum(words, 1)
    text = np.repeat(np.arange(n), words)
    count = lambda m: np.bincount(text, weights=m, minlength=n)
    h = C.span_hashes(sums, starts, ends)
    insult, person = _is_in(_INSULTS, h), _is_in(_PERSON, h)
    best = np.zeros(len(h))
    for k in (0, *PREFIXES):
        if not len(terms):
            break
        own = h if not k else C.span_hashes(sums, starts, np.minimum(starts + k, ends)) ^ np.uint64(k)
        place = np.minimum(np.searchsorted(terms, own), len(terms) - 1)
        best = np.maximum(best, np.where((terms[place] == own) & ((ends - starts > k) | (k == 0)), weights[place], 0.0))
    sums2, starts2, ends2, at2 = _plain_words(data, offsets, _LEET)
    leet = _is_in(_INSULTS, C.span_hashes(sums2, starts2, ends2))
    raw_starts, raw_ends, raw_at = C.word_spans(data, offsets, C.NOT_SPACE)
    raw = _is_in(_INSULTS, C.span_hashes(C.prefix_sums(C.LOWER[data]), *_bare(data, raw_starts, raw_ends))) if len(data) else np.zeros(0, bool)
    leet_n = np.bincount(np.repeat(np.arange(n), np.diff(at2)), weights=leet, minlength=n)
    raw_n = np.bincount(np.repeat(np.arange(n), np.diff(raw_at)), weights=raw, minlength=n)
    bad = insult | (best > 0)
    # Bad words with a second-person word of the same text at most NEAR words away.
    spread = np.zeros(len(h) + 1)
    for i in np.flatnonzero(person):
        spread[max(i - NEAR, at[text[i]])] += 1
        spread[min(i + NEAR + 1, at[text[i] + 1])] -= 1
    near = np.cumsum(spread[:-1]) > 0
    shouted = np.bincount(np.repeat(np.arange(n), np.diff(raw_at)), weights=_shouted(data, raw_starts, raw_ends), minlength=n) / np.maximum(np.diff(raw_at), 1)
    top = np.zeros(n)
    np.maximum.at(top, text, best)
    columns = [count(insult) / per, count(best > 0) / per, top, np.maximum(leet_n - raw_n, 0) / per, count(bad & near) / per, count(person) / per, share(upper) / letters, shouted, share(_IS_PUNCTUATION[data]), share(data == 33), share((data >= 35) & (data <= 42)), share((data >= 48) & (data <= 57)), np.log1p(words), np.log1p(count(insult)), np.log1p(count(best > 0))]
    return np.stack(columns, axis=1)


def _shouted(data, starts, ends):
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    lower = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    return (upper[ends] - upper[starts] >= 3) & (lower[ends] == lower[starts])


def _learn_terms(rows: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Terms whose texts are toxic far more often than others, with smoothed log odds; as many as the bounded rows have."""
    spark = rows.sparkSession
    buckets = 8 * C.partitions(spark)
    step = np.uint64((1 << 64) // buckets + 1)

    def deal(batches):
        found: list = []
        for b in C.slices(batches):
            text, h = terms_of(b)
            if not len(h):
                continue
            order = np.lexsort((h, text))
            text, h = text[order], h[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            found.append((h[new], b.column("toxic").to_numpy().astype(np.int64)[text[new]]))
        if found:
            h, y = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            h, place = np.unique(h, return_inverse=True)
            positive, all_ = np.bincount(place, weights=y).astype(np.int64), np.bincount(place)
            yield C.bucket_rows((h // step).astype(np.int64), [h, positive, all_.astype(np.int64)], ["term", "positive", "n"])

    def meet(batches):
        for _, (h, positive, n) in C.each_bucket(batches, ["term", "positive", "n"], [np.uint64, np.int64, np.int64]):
            h, place = np.unique(h, return_inverse=True)
            positive, n = np.bincount(place, weights=positive), np.bincount(place, weights=n)
            keep = positive >= least
            yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(positive[keep]), pa.array(n[keep])], names=["term", "positive", "n"])

    totals = rows.agg(F.sum("toxic"), F.count("*")).first()
    bad, good = float(totals[0] or 0), float(totals[1] - (totals[0] or 0))
    if not bad or not good:
        return np.zeros(0, np.uint64), np.zeros(0)
    counted = C.dealt(rows.select("text", "toxic").mapInArrow(deal, "bucket int, term binary, positive binary, n binary"), spark).mapInArrow(meet, "term bigint, positive double, n double")
    odds = F.log(((F.col("positive") + 0.25) / F.lit(bad)) / ((F.col("n") - F.col("positive") + 0.25) / F.lit(good)))
    top = counted.withColumn("odds", odds).filter("odds > 2.5").select("term", "odds").toArrow()
    terms, weights = top.column("term").to_numpy().astype(np.int64).view(np.uint64), top.column("odds").to_numpy()
    order = np.argsort(terms)
    return terms[order], weights[order]


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, least: int = 3) -> ToxicityModel:
    """Fit on the texts of `docs` (doc_id, text) that `labels` (doc_id, toxic 0/1) has; of these `max_rows` at most, by hash of the id.

    A document that is labelled twice counts as toxic if either label says so. The rows are chosen by id alone, and
    since they are bounded the texts are found by a broadcast join.
    """
    spark = docs.sparkSession
    C.session_limits(spark)
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = kept(marks.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3))
    terms, weights = _learn_terms(rows.filter(part == 0), least)
    shared = spark.sparkContext.broadcast((terms, weights))

    def describe(batches):
        for b in C.slices(batches):
            x = features(b, *shared.value)
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))], names=["part", "toxic", "x"])

    found = rows.select(part.cast("int").alias("part"), "toxic", "text").filter("part > 0").mapInArrow(describe, "part int, toxic int, x array<double>").toArrow()
    which, y = found.column("part").to_numpy(), found.column("toxic").to_numpy().astype(float)
    x = np.array(found.column("x").to_pylist(), dtype=float).reshape(len(y), len(FEATURES))
    prior = float(y.mean()) if len(y) else 0.0
    fit, rest = which == 1, which == 2
    if not len(y) or len(np.unique(y[fit])) < 2 or len(np.unique(y[rest])) < 2:
        return ToxicityModel(terms, weights, None, (np.zeros(0), np.zeros(0)), prior)
    order = np.lexsort(x.T)  # the same model whatever the order in which the rows came
    x, y, fit, rest = x[order], y[order], fit[order], rest[order]
    trees = fit_trees(x[fit], y[fit])
    return ToxicityModel(terms, weights, trees, isotonic(trees.margin(x[rest]), y[rest]), prior)


def probabilities(x: np.ndarray, model: ToxicityModel) -> np.ndarray:
    if model.trees is None:
        return np.full(len(x), model.prior)
    margin = model.trees.margin(x)
    # A trace of the margin keeps the order of texts within a pool of the calibration.
    return np.clip(0.999 * np.interp(margin, *model.steps) + 0.001 / (1 + np.exp(-margin)), 0.0, 1.0)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """`docs` with `score` (0 to 1) and `predicted` (1 from 0.5 on); every other column passes through."""
    spark = docs.sparkSession
    C.session_limits(spark)
    shared = spark.sparkContext.broadcast(model)
    given = docs.drop("score", "predicted")
    schema = docs.drop("score", "predicted").schema.add("score", "double").add("predicted", "integer")

    def run(batches):
        m = shared.value
        for b in C.slices(batches):
            p = probabilities(features(b, m.terms, m.weights), m)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    return given.mapInArrow(run, schema)
