"""Record shapes of the ingest jobs and result tables."""

from __future__ import annotations

from pyspark.sql import types as T

_INT, _LONG, _DOUBLE = T.IntegerType(), T.LongType(), T.DoubleType()
_TEXT, _BYTES, _TIME = T.StringType(), T.BinaryType(), T.TimestampType()
_TEXT_MAP = T.MapType(_TEXT, _TEXT)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


DETECTIONS = struct(id=_INT, type=_TEXT, confidence=_DOUBLE)

POSITIONS = struct(
    id=_INT,
    tag_id=_TEXT,
    x_position=_DOUBLE,
    y_position=_DOUBLE,
    timestamp=_TIME,
    anchor_info=_TEXT,
)

_READINGS = dict(
    objId=_INT,
    rsctypeId=_TEXT,
    TEMPERATURE=_DOUBLE,
    TEMPERATURE1=_DOUBLE,
    HUMIDITY=_DOUBLE,
    HUMIDITY1=_DOUBLE,
)
# The sensor record as sent, and as stored.
SENSOR_WIRE = struct(**{"@timestamp": _TEXT}, **_READINGS)
SENSOR = struct(**{"@timestamp": _TIME}, **_READINGS)

# The columns Spark's Kafka source produces.
MESSAGE = struct(
    key=_BYTES,
    value=_BYTES,
    topic=_TEXT,
    partition=_INT,
    offset=_LONG,
    timestamp=_TIME,
    timestampType=_INT,
)

COMMAND = struct(command=_TEXT, duration=_DOUBLE)

METRIC_SAMPLE = struct(metric=_TEXT, value=_DOUBLE, timestamp=_TIME)

EXPERIMENT_RESULT = struct(
    experiment_label=_TEXT,
    resolution=_TEXT,
    reference_time_kst=_TEXT,
    duration_minutes=_INT,
    query_start_utc=_TEXT,
    query_end_utc=_TEXT,
    actual_data_start=_TEXT,
    actual_data_end=_TEXT,
    total_records=_LONG,
    avg_rx_mibps=_DOUBLE,
    avg_tx_mibps=_DOUBLE,
    max_rx_mibps=_DOUBLE,
    max_tx_mibps=_DOUBLE,
    std_tx_mibps=_DOUBLE,
)

NODE_ITEM = struct(
    metadata=struct(name=_TEXT, labels=_TEXT_MAP, creationTimestamp=_TEXT),
    status=struct(
        conditions=T.ArrayType(struct(type=_TEXT)), nodeInfo=struct(kubeletVersion=_TEXT)
    ),
)

BOX_ITEM = struct(
    metadata=struct(name=_TEXT, annotations=_TEXT_MAP, creationTimestamp=_TEXT),
    spec=struct(metadata=struct(rack=_TEXT, cluster=_TEXT), group=struct(role=_TEXT)),
    status=struct(
        access=struct(primary=struct(address=_TEXT)),
        power=_TEXT,
        state=_TEXT,
        network=struct(speed=_TEXT),
        version=_TEXT,
    ),
)


def item_list(item: T.StructType) -> T.StructType:
    """The document that lists ``item`` records under ``items``."""
    return struct(items=T.ArrayType(item))
