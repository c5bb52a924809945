"""The query catalogue: name -> (spark, sf_dir) -> DataFrame, and its DuckDB oracle."""

from __future__ import annotations

from . import ledger, placement, routing, store, telemetry
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "ledger", "placement", "routing", "store", "telemetry"]
