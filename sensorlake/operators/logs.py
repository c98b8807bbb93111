"""Container log lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.functions import plan, text


def parse_logs(
    df: DataFrame, *, line: str = "value", keep: Sequence[str] = (), drop_unmatched: bool = False
) -> DataFrame:
    """Split log lines into ``time``, ``stream``, ``tag`` and ``message``.

    A line of another form is kept with its text in ``body`` and nulls. ``time``
    is the text as written; ``ts`` holds it to the microsecond. The pattern is
    tested once and the parts are cut at blanks.
    """
    rows = df.select(*keep, F.col(line).cast("string").alias("body"))
    hit = F.col("body").rlike(text.LOG_LINE)
    rows = rows.select(*keep, "body", plan.once(F.when(hit, F.split("body", " ", 4))).alias("_parts"))
    if drop_unmatched:
        rows = rows.filter(F.col("_parts").isNotNull())
    part = [F.col("_parts")[i] for i in range(4)]
    return rows.select(
        *keep,
        part[0].alias("time"),
        part[1].alias("stream"),
        part[2].alias("tag"),
        part[3].alias("message"),
        F.try_to_timestamp(part[0], F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSSX")).alias("ts"),
        "body",
    )
