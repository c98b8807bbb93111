"""Message decoding, validation and the JSON message sink form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlake import schemas
from sensorlake.functions import plan, text, times

_CORRUPT = "_corrupt_record"


def decode_json(
    df: DataFrame, schema: T.StructType, *, value: str = "value", keep: Sequence[str] = ()
) -> DataFrame:
    """Parse message bytes as JSON and expand the record to columns.

    Unknown keys are ignored, a field of the wrong type is null, and a document
    that is not JSON gives a row of nulls. ``keep`` carries envelope columns.
    """
    record = F.from_json(F.col(value).cast("string"), schema)
    return df.select(*keep, plan.fields_once(record))


def threshold_filter(df: DataFrame, column: str, minimum: float) -> DataFrame:
    """Rows at or above ``minimum``; rows without a value are dropped."""
    return df.filter(F.col(column) >= F.lit(minimum))


def sensor_columns(df: DataFrame) -> DataFrame:
    """Wire records to stored records: the time becomes a timestamp, order is fixed."""
    stamp = times.wire_time(F.col("`@timestamp`")).alias("@timestamp")
    others = [f"`{name}`" for name in schemas.SENSOR.fieldNames() if name != "@timestamp"]
    return df.select(stamp, *others)


def decode_sensor(df: DataFrame, *, value: str = "value") -> DataFrame:
    return sensor_columns(decode_json(df, schemas.SENSOR_WIRE, value=value))


def decode_positions(df: DataFrame, *, value: str = "value") -> DataFrame:
    """Position records as they come; they carry no confidence to filter on."""
    return decode_json(df, schemas.POSITIONS, value=value)


def classify_messages(
    df: DataFrame, schema: T.StructType, *, value: str = "value", keep: Sequence[str] = ()
) -> DataFrame:
    """Decoded fields, the text, and a reason where the message is not clean.

    Reasons: ``null_value``; ``empty`` text; ``malformed`` when the document
    yields no field at all; ``bad_field`` when only some fields were unusable.
    """
    flagged = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    rows = df.select(*keep, F.col(value).cast("string").alias("message"))
    record = F.from_json("message", flagged, {"columnNameOfCorruptRecord": _CORRUPT})
    rows = rows.select(*keep, "message", plan.fields_once(record))
    fields = [f"`{name}`" for name in schema.fieldNames()]
    no_field = F.coalesce(*[F.col(name).cast("string") for name in fields]).isNull()
    corrupt = F.col(_CORRUPT).isNotNull()
    reason = (
        F.when(F.col("message").isNull(), "null_value")
        .when(text.strip(F.col("message")) == "", "empty")
        .when(corrupt & no_field, "malformed")
        .when(corrupt, "bad_field")
    )
    return rows.select(*keep, *fields, "message", reason.alias("reject_reason"))


def is_usable(strict: bool = False) -> Column:
    """Whether a classified message belongs in the table.

    A message with some bad fields is stored with nulls there unless ``strict``.
    """
    reason = F.col("reject_reason")
    clean = reason.isNull()
    return clean if strict else clean | (reason == "bad_field")


def to_json_messages(
    df: DataFrame, *, columns: Sequence[str] | None = None, key: str | None = None
) -> DataFrame:
    """One message per row: the JSON record as bytes, nulls written out."""
    names = [f"`{name}`" for name in (columns or df.columns)]
    body = F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).cast("binary")
    keys = [F.col(key).cast("string").cast("binary").alias("key")] if key else []
    return df.select(*keys, body.alias("value"))


def validate_commands(df: DataFrame, *, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Check control commands: a command that is not empty and a numeric duration.

    Every message is kept with its ``status`` and ``message``; fields of a
    rejected one are as sent where they can be read.
    """
    body = F.col(value).cast("string")
    # The parser stops after one value. Text behind it breaks one of these two.
    listed = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    nested = F.try_parse_json(F.concat(F.lit('{"m":'), body, F.lit("}")))
    record = F.when(listed.isNotNull(), F.try_variant_get(nested, "$.m", "variant"))
    rows = df.select(*keep, plan.once(record).alias("record"))
    rows = rows.select(
        *keep,
        F.schema_of_variant("record").alias("kind"),
        F.try_variant_get("record", "$.command", "string").alias("command"),
        F.schema_of_variant(F.try_variant_get("record", "$.command", "variant")).alias("c_kind"),
        F.schema_of_variant(F.try_variant_get("record", "$.duration", "variant")).alias("d_kind"),
        F.try_variant_get("record", "$.duration", "double").alias("duration"),
    )
    empty = F.col("command").isin("", "false", "0", "0.0", "[]", "{}")
    named = F.when(F.col("c_kind") == "STRING", F.col("command") != "").otherwise(
        F.col("command").isNotNull() & ~empty
    )
    numeric = F.col("d_kind").rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))$")
    accepted = F.coalesce(named, F.lit(False)) & F.coalesce(numeric, F.lit(False))
    readable = F.coalesce(F.col("kind").startswith("OBJECT"), F.lit(False))
    return rows.select(
        *keep,
        "command",
        F.when(numeric, F.col("duration")).alias("duration"),
        F.when(readable & accepted, "success").otherwise("error").alias("status"),
        F.when(~readable, "Not a JSON object")
        .when(accepted, "Command sent successfully")
        .otherwise("Invalid input")
        .alias("message"),
    )


def accepted_commands(checked: DataFrame, *, key: str | None = None) -> DataFrame:
    """The messages to send for checked commands: command and duration of each good one."""
    good = checked.filter(F.col("status") == "success")
    return to_json_messages(good, columns=schemas.COMMAND.fieldNames(), key=key)
