"""Token counts of a byte-fallback BPE by prefix dynamic programming.

For a unit of text (its leading spaces with the following non-spaces) the last token of
every prefix is found from those of the shorter prefixes: token t ends prefix i if the
last token before it and t stay two tokens when merged alone. count[i] is then
count[i - len(t)] + 1, so one sweep gives the exact count at every prefix. Merges never
cross from a non-space to a space in such a vocabulary (checked when it is loaded), so a
text's prefix counts are running sums over its units.

Defined cases: a null text is empty and has 0 tokens; special strings in a text are plain
text; a unit of any length is swept whole; repeated rows count alike.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import columns as C

SPACE = "▁"
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
CACHE = 600_000
#: Longer units are swept whole and not kept.
KEPT_LENGTH = 64
_loaded: dict = {}


class _Counts(dict):
    """Counts by unit, filled on demand and emptied when full."""

    def __init__(self, count):
        self.of = count

    def __missing__(self, unit: str) -> int:
        n = self.of(unit)
        if len(unit) <= KEPT_LENGTH:
            if len(self) >= CACHE:
                self.clear()
            self[unit] = n
        return n


class PrefixCounter:
    """Counts of one vocabulary. `path` names a sentencepiece BPE model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
                continue
            self.score[piece] = model.get_score(i)
        self.crosses = any(SPACE in p.lstrip(SPACE) for p in self.score)
        self.longest = max(map(len, self.score), default=1)
        self.normalize = model.normalize
        self.apart: dict = {}
        self.whole = {p for p in self.score if self._merged(p) == [p]}
        self.states: dict = {}
        self.units = _Counts(self._unit_count)

    def _merged(self, text: str) -> list[str]:
        """The greedy merges of `text`: the best-scored adjacent pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stay(self, left: str, right: str) -> bool:
        key = (left, right)
        found = self.apart.get(key)
        if found is None:
            if len(self.apart) > CACHE:
                self.apart.clear()
            found = self.apart[key] = self._merged(left + right) == [left, right]
        return found

    def prefixes(self, unit: str) -> list[int]:
        """Exact token counts of unit[:1], unit[:2], ... by the sweep."""
        last, counts, whole = [""], [0], self.whole
        for i in range(1, len(unit) + 1):
            token, length = None, 1
            for n in range(min(i, self.longest), 0, -1):
                t = unit[i - n : i]
                if t in whole and (n == i or not last[i - n] or self._stay(last[i - n], t)):
                    token, length = t, n
                    break
            if token is None:  # a character outside the vocabulary: its UTF-8 bytes
                last.append("")
                counts.append(counts[i - 1] + len(unit[i - 1].encode("utf-8", "surrogatepass")))
            else:
                last.append(token)
                counts.append(counts[i - length] + 1)
        return counts[1:]

    def _state(self, prefix: str) -> tuple[int, str]:
        """Token count and last token ('' for bytes) of one prefix; only the shorter ones it rests on are looked at."""
        found = self.states.get(prefix)
        if found is None:
            whole = self.whole
            found = None
            for n in range(min(len(prefix), self.longest), 0, -1):
                t = prefix[-n:]
                if t in whole:
                    if n == len(prefix):
                        found = 1, t
                        break
                    count, last = self._state(prefix[:-n])
                    if not last or self._stay(last, t):
                        found = count + 1, t
                        break
            if found is None:
                count = self._state(prefix[:-1])[0] if len(prefix) > 1 else 0
                found = count + len(prefix[-1].encode("utf-8", "surrogatepass")), ""
            if len(self.states) >= CACHE // 2:
                self.states.clear()
            self.states[prefix] = found
        return found

    def _unit_count(self, unit: str) -> int:
        return self._state(unit)[0] if len(unit) <= KEPT_LENGTH else self.prefixes(unit)[-1]

    def units_of(self, text: str) -> list[str]:
        """The normalized text cut where no merge crosses."""
        text = self.normalize(text) if text else ""
        if self.crosses:
            return [text] if text else []
        if text[:1] == SPACE and SPACE * 2 not in text and text[-1:] != SPACE:
            return [SPACE + u for u in text[1:].split(SPACE)]
        return _UNIT.findall(text)

    def count(self, text: str) -> int:
        return sum(map(self.units.__getitem__, self.units_of(text)))

    def at_every_prefix(self, text: str) -> tuple[str, np.ndarray]:
        """The normalized text and the token count of each of its prefixes, from length 0 on."""
        counts, total = [0], 0
        for u in (units := self.units_of(text)):
            own = self.prefixes(u)
            counts.extend(total + n for n in own)
            total += own[-1]
        return "".join(units), np.array(counts, dtype=np.int64)

    def at_every_unit(self, text: str) -> tuple[list[str], np.ndarray]:
        """The units and the token count of the text up to the end of each, from 0 on."""
        units = self.units_of(text)
        counts = np.zeros(len(units) + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(self.units.__getitem__, units), dtype=np.int64, count=len(units)), out=counts[1:])
        return units, counts

    def fit(self, text: str, budget: int) -> int:
        """Length of the longest normalized prefix whose count, and that of every shorter one, keeps within `budget`."""
        _, counts = self.at_every_prefix(text)
        return bisect.bisect_right(np.maximum.accumulate(counts), budget) - 1


def counter(path: str) -> PrefixCounter:
    """One counter for each vocabulary and Python worker."""
    if path not in _loaded:
        _loaded[path] = PrefixCounter(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str, budget: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fit_chars (the length of the normalized prefix within the budget) of each text.

    All are read off the counts at the ends of a text's units and, where the budget ends, at every prefix of one.
    """
    C.session_limits(docs.sparkSession)
    schema = docs.select("doc_id").schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean").add("fit_chars", "long")

    def run(batches):
        c = counter(path)
        for b in C.slices(batches):
            counts, fits = [], []
            for t in b.column("text").to_pylist():
                units, at = c.at_every_unit(t or "")
                counts.append(int(at[-1]))
                fits.append(None if at[-1] <= budget else _cut(c, units, at, budget))
            size = pc.fill_null(pc.binary_length(b.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, pa.array(counts, pa.int64()), pa.array([n > budget for n in counts], pa.bool_()), pa.array(fits, pa.int64())], names=schema.names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _cut(c: PrefixCounter, units: list[str], at: np.ndarray, budget: int) -> int:
    """As `fit`, with the counts at every prefix of the units up to where one goes beyond the budget."""
    length = 0
    for u, total in zip(units, at.tolist()):
        if total + len(u.encode("utf-8", "surrogatepass")) > budget:  # no prefix has more tokens than bytes
            own = np.maximum.accumulate(c.prefixes(u))
            k = bisect.bisect_right(own, budget - total)
            if k < len(u):
                return length + k
        length += len(u)
    return length


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and counts: the token count of every prefix of each normalized text, from that of length 0 on. `within` answers from it."""
    C.session_limits(docs.sparkSession)
    schema = docs.select("doc_id").schema.add("counts", T.ArrayType(T.IntegerType()))

    def run(batches):
        c = counter(path)
        for b in C.slices(batches):
            counts = [c.at_every_prefix(t or "")[1].astype(np.int32) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.list_(pa.int32()))], names=schema.names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def within(counts: Column, budget: int | Column) -> Column:
    """Length of the longest prefix whose count, and that of every shorter one, keeps within a budget, from stored prefix counts."""
    over = F.array_position(F.transform(counts, lambda n: n > budget), F.lit(True))
    return (F.when(over > 0, over - 2).otherwise(F.size(counts) - 1)).cast("long")
