"""Schemas of the engine's inputs, in one place."""

from pyspark.sql import types as T

_NAMES = {"int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}


def struct(**fields) -> T.StructType:
    """A struct of nullable fields, each a type's name, a type, or a list of one type (an array)."""
    kind = lambda t: T.ArrayType(kind(t[0])) if isinstance(t, list) else _NAMES.get(t, t) if isinstance(t, str) else t
    return T.StructType([T.StructField(n, kind(t)) for n, t in fields.items()])


COORDINATE = struct(x="int", y="int")
TAG = {"x": "int", "y": "int", "z": "int", "q": "int"}
CELL_RATES = struct(**TAG, reads_per_second="double", writes_per_second="double", bytes_read_per_second="double", bytes_written_per_second="double")
SAMPLE = struct(
    coordinate=COORDINATE,
    operations_per_second="double",
    read_ratio="double",
    write_ratio="double",
    read_latency_us="double",
    write_latency_us="double",
    cpu_utilization="double",
    memory_utilization="double",
    queue_depth="bigint",
    cell_breakdown=[CELL_RATES],
    cell_breakdown_partial="boolean",
)
#: One element of a session: exactly one of the five is present.
MESSAGE = struct(
    RegisterNode=struct(protocol="string", node_id="string", software_version="string", region="string"),
    Heartbeat=struct(node_id="string", timestamp_ms="bigint", healthy="boolean"),
    Topology=struct(node_id="string", timestamp_ms="bigint", placements=[struct(coordinate=COORDINATE, dbms_id="string", region="string")]),
    Telemetry=struct(timestamp_ms="bigint", node_id="string", shard=struct(id="bigint", workload_domain="string"), samples=[SAMPLE]),
    Workload=struct(node_id="string", coordinate=COORDINATE, timestamp_ms="bigint", operations_per_second="double", read_ratio="double", write_ratio="double"),
)
VARIANTS = MESSAGE.names
SNAPSHOT = struct(
    node_id="string",
    taken_at_ms="bigint",
    reads_total="bigint",
    writes_total="bigint",
    cpu_seconds_total="double",
    cpu_cores="bigint",
    memory_utilization="double",
    read_p99_us="bigint",
    write_p99_us="bigint",
    in_flight="bigint",
    max_concurrent="bigint",
    cells=[struct(**TAG, reads="bigint", writes="bigint", bytes_read="bigint", bytes_written="bigint")],
)
EDGE = T.StructType([T.StructField(n, T.StringType()) for n in ("from", "to", "kind")])
