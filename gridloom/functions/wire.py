"""Small rules on fields of the store's wire."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def of_window(duration_ms: str | Column, value: str | Column) -> Column:
    """A figure of an observation window; null as long as none has closed (a duration of 0), which isn't the same as idle."""
    return F.when(_column(duration_ms) > 0, _column(value))


def partial(*overflow: str | Column) -> Column:
    """Whether attribution to cells is partial: some counter of what was left out is above 0. Counters are cumulative, so it stays so."""
    out = F.lit(False)
    for c in overflow:
        out = out | (F.coalesce(_column(c), F.lit(0)) > 0)
    return out


def retry_after(header: str | Column) -> Column:
    """Seconds to wait: all digits once trimmed and a number that fits; dates and all else are none."""
    text = F.regexp_replace(_column(header), r"(?U)^\s+|\s+$", "")
    return F.when(text.rlike(r"^[0-9]+\z"), text.try_cast("bigint"))


def has_credential(headers: str | Column, query: str | Column) -> Column:
    """An x-api-key header (names in any case), or a query parameter `key` that isn't empty."""
    named = F.exists(_column(headers), lambda h: F.lower(h) == "x-api-key")
    asked = F.exists(F.split(F.coalesce(_column(query), F.lit("")), "&"), lambda p: p.startswith("key=") & (F.char_length(p) > 4))
    return F.coalesce(named, F.lit(False)) | asked


def typed(tag: str | Column, wanted: str, value: str | Column) -> Column:
    """A tagged value as the type that it has; null for any other, nothing is converted."""
    return F.when(_column(tag) == wanted, _column(value))
