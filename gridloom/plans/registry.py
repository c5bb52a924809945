"""Where queries register themselves and their oracles."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable
from pathlib import Path

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function under its name; `oracle` is the same query in DuckDB SQL."""

    def add(f):
        @functools.wraps(f)
        def run(spark, sf_dir):
            # Python workers find the package where the driver has it, besides what the user lets them find.
            own, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
            paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p and p != own]
            environment["PYTHONPATH"] = os.pathsep.join([own, *paths])
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add
