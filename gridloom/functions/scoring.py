"""Load scores of a cell: ratios, pressure, hotspot probability, anomaly.

All inputs are columns without NaN; a null counts as 0 where the score sums terms.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and thresholds of the scores.
QUEUE_FULL = 10_000.0
LATENCY_FULL_US = 100_000.0
LATENCY_ANOMALY_US = 50_000.0
LEVELS = (("critical", 0.90), ("high", 0.75), ("elevated", 0.50))
HOT_THRESHOLD = 0.75
ANOMALY_THRESHOLD = 0.80
CONFIDENCE_THRESHOLD = 0.80


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def ratio(part: Column, total: Column) -> Column:
    return F.when(total > 0, part / total).otherwise(F.lit(0.0))


def latency_share(read_us: Column, write_us: Column) -> Column:
    return clamp(F.greatest(read_us, write_us) / LATENCY_FULL_US)


def pressure(cpu: Column, memory: Column, queue: Column, read_us: Column, write_us: Column) -> Column:
    return clamp(cpu) * 0.35 + clamp(memory) * 0.20 + clamp(queue / QUEUE_FULL) * 0.25 + latency_share(read_us, write_us) * 0.20


def level(score: Column) -> Column:
    out = F.lit("normal")
    for name, least in reversed(LEVELS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def hotspot(score: Column, cpu: Column, memory: Column, queue: Column, read_us: Column, write_us: Column) -> Column:
    return clamp(score * 0.45 + latency_share(read_us, write_us) * 0.15 + clamp(queue / QUEUE_FULL) * 0.20 + (cpu * 0.60 + memory * 0.40) * 0.20)


def anomaly(cpu: Column, memory: Column, queue: Column, read_us: Column, write_us: Column) -> Column:
    over = lambda value, onset, scale: F.greatest((value - onset) / scale, F.lit(0.0))
    worst = F.greatest(read_us, write_us)
    return clamp(over(cpu, 0.8, 0.2) * 0.30 + over(memory, 0.8, 0.2) * 0.20 + over(queue, QUEUE_FULL, QUEUE_FULL) * 0.25 + over(worst, LATENCY_ANOMALY_US, LATENCY_ANOMALY_US) * 0.25)


def cpu_utilization(before: Column, after: Column, cores: Column, seconds: Column) -> Column:
    used = after - before
    known = used.isNotNull() & (used >= 0) & (cores > 0) & (seconds > 0)
    return F.when(known, clamp(used / (seconds * cores))).otherwise(F.lit(0.0))


def queue_units(in_flight: Column, most: Column) -> Column:
    return F.when(most > 0, F.round(clamp(in_flight / most) * QUEUE_FULL)).otherwise(F.lit(0.0)).cast("bigint")
