"""Deterministic draws and the workload model of the fleet generator."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GOLDEN = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
# Operations a second, read share, latencies and bytes by class of workload.
CLASSES = [
    ("ReadHeavy", 800.0, 0.92, 400.0, 1200.0, 512),
    ("WriteHeavy", 400.0, 0.15, 900.0, 2500.0, 1024),
    ("Mixed", 500.0, 0.55, 600.0, 1500.0, 768),
    ("EventHeavy", 1200.0, 0.35, 300.0, 800.0, 256),
    ("Media", 150.0, 0.85, 2500.0, 9000.0, 65536),
    ("Realtime", 2000.0, 0.60, 150.0, 400.0, 128),
    ("Unknown", 100.0, 0.50, 1000.0, 1000.0, 512),
]
CLASS_SCHEMA = "class string, base_ops double, read_ratio double, read_latency_us double, write_latency_us double, bytes_per_op bigint"


def classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLASSES, CLASS_SCHEMA)


def _words(seed: int, n: np.ndarray) -> np.ndarray:
    """The n-th word (from 0) of the stream of a seed; each is computed from its number alone."""
    start = np.uint64((seed & MASK) ^ GOLDEN)
    with np.errstate(over="ignore"):
        z = start + (n.astype(np.uint64) + np.uint64(1)) * np.uint64(GOLDEN)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def word(seed: int, n: int) -> int:
    return int(_words(seed, np.array([n]))[0])


def draw_unit(seed: int, n: Column) -> Column:
    """The n-th draw of a seed's stream as a double in [0, 1)."""

    @F.pandas_udf("double")
    def unit(k: pd.Series) -> pd.Series:
        return pd.Series((_words(seed, k.to_numpy()) >> np.uint64(11)).astype(np.float64) * (1.0 / 9007199254740992.0))

    return unit(n)


def draw_below(seed: int, n: Column, bound: int) -> Column:
    """The n-th draw of a seed's stream as a bigint below `bound`; 0 if that is 0."""

    @F.pandas_udf("bigint")
    def below(k: pd.Series) -> pd.Series:
        return pd.Series((_words(seed, k.to_numpy()) % np.uint64(bound)).astype(np.int64) if bound else np.zeros(len(k), dtype=np.int64))

    return below(n)


def diurnal(now_ms: Column, period_ms: int, offset_ms: Column) -> Column:
    """A triangle wave from 0.6 to 1.4 and back over the period."""
    period = max(period_ms, 1)
    return F.lit(0.6) + (F.lit(1.0) - F.abs(F.pmod(now_ms + offset_ms, F.lit(period)).cast("double") * 2.0 / float(period) - 1.0)) * 0.8


JITTER_LOW, JITTER_HIGH = 0.95, 1.05
