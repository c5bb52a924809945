"""Reports: the rows of a view in its order, as a text table or as JSON lines."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

#: View -> (columns, order, what is said when there are no rows).
VIEWS = {
    "topology": (["cell_index", "shard_id", "node_id", "region"], ["cell_index", "shard_id"], "no placements"),
    "workload": (["shard_id", "x", "y", "operations", "read_ratio", "write_ratio", "pressure", "level"], ["y", "x", "shard_id"], "no workload profiles"),
    "predict": (["shard_id", "x", "y", "probability", "likely_hot", "anomaly", "anomalous"], ["y", "x", "shard_id"], "no predictions"),
    "metrics": (["shard_id", "x", "y", "reads", "writes", "cpu_utilization", "memory_utilization", "queue_depth"], ["y", "x", "shard_id"], "no observations"),
    "placement": (["shard_id", "x", "y", "action", "target_node", "expected_gain", "estimated_cost", "confidence"], ["y", "x", "shard_id"], "no decisions"),
    "nodes": (["node_id", "health", "beats", "silence_ms"], ["node_id"], "no registered nodes"),
    "status": (["clock_ms", "placements", "profiles", "observations", "hot"], ["clock_ms"], "no messages"),
    "validate": (["cell_index", "x", "y"], ["cell_index"], "all coordinates are on the grid"),
}


def view(rows: DataFrame, name: str) -> DataFrame:
    columns, order, _ = VIEWS[name]
    return rows.select(*columns).orderBy(*order)


def render_json(rows: DataFrame, name: str, path: str) -> None:
    """Write a view as JSON lines."""
    view(rows, name).write.mode("overwrite").json(path)


def render_text(rows: DataFrame, name: str, most: int = 1000) -> str:
    """A table of a view's first `most` rows: a report for reading, whose number of rows is its limit; a last line says how many it leaves out."""
    columns, _, nothing = VIEWS[name]
    more = max(rows.count() - most, 0)
    found = [[("-" if v is None else f"{v:.4f}" if isinstance(v, float) else json.dumps(v) if isinstance(v, bool) else str(v)) for v in r] for r in view(rows, name).limit(most).collect()]
    if not found:
        return nothing + "\n"
    widths = [max(len(c), *(len(r[i]) for r in found)) for i, c in enumerate(columns)]
    line = lambda r: "  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip()
    return "\n".join([line(columns), *map(line, found), *([f"... and {more} more"] if more else [])]) + "\n"
