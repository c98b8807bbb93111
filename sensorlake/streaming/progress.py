"""What running queries report, kept as rows of a table."""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from sensorlake.sinks import tables as sinks
from sensorlake.sources import tables as sources

SCHEMA = """query STRING, run STRING, name STRING, kind STRING, batch BIGINT, at STRING, input_rows BIGINT,
    input_rows_per_second DOUBLE, processed_rows_per_second DOUBLE, batch_ms BIGINT, lag BIGINT, watermark STRING, error STRING"""
#: Rows that are held before a batch of them is written.
HELD = 500


class ProgressLog(StreamingQueryListener):
    """A listener that keeps start, progress and end of the session's queries.

    Rows are written by ``HELD`` at a time, and by ``flush``; ``lag`` is what the
    sources had beyond the batch, where they tell it as ``numOutstanding...``.
    Used as a context it listens inside, and writes what is left at the end.
    """

    def __init__(self, spark: SparkSession, path: str, held: int = HELD):
        self.spark, self.path, self.held = spark, path, held
        self._rows: list[dict] = []
        self._lock = threading.Lock()
        self._ended = threading.Condition(self._lock)
        self._runs: set[str] = set()
        self._writer, self._written = f"progress-{uuid.uuid4().hex}", 0

    def onQueryStarted(self, event) -> None:
        self._add(query=str(event.id), run=str(event.runId), name=event.name, kind="started", at=event.timestamp)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        behind = [int(v) for s in p.sources for k, v in (s.metrics or {}).items() if "behind" in k.lower() and str(v).isdigit()]
        self._add(
            query=str(p.id), run=str(p.runId), name=p.name, kind="progress", batch=p.batchId, at=p.timestamp,
            input_rows=p.numInputRows, input_rows_per_second=p.inputRowsPerSecond,
            processed_rows_per_second=p.processedRowsPerSecond, batch_ms=p.durationMs.get("triggerExecution"),
            lag=sum(behind) if behind else None, watermark=(p.eventTime or {}).get("watermark"),
        )

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        error = event.exception
        self._add(query=str(event.id), run=str(event.runId), kind="failed" if error else "ended", error=error)
        with self._ended:
            self._runs.add(str(event.runId))
            self._ended.notify_all()

    def _add(self, **row) -> None:
        with self._lock:
            self._rows.append(row)
            full = len(self._rows) >= self.held
        if full:  # a job from here would hold up the bus
            threading.Thread(target=self.flush, daemon=True).start()

    def wait(self, run: str, seconds: float = 60) -> bool:
        """Wait until the end of a run was reported; reports come after a query has ended."""
        with self._ended:
            return self._ended.wait_for(lambda: run in self._runs, seconds)

    def flush(self) -> None:
        """Append the rows held to the table."""
        with self._lock:
            rows, self._rows = self._rows, []
            number, self._written = self._written, self._written + bool(rows)
        if rows:
            lines = self.spark.createDataFrame([(json.dumps(row),) for row in rows], "line string").coalesce(1)
            table = lines.selectExpr(f"inline(array(from_json(line, '{' '.join(SCHEMA.split())}')))")
            sinks.write_batch(table, self.path, self._writer, number)

    def __enter__(self) -> ProgressLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *error) -> None:
        self.spark.streams.removeListener(self)
        self.flush()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows kept so far."""
    return sources.lake_scan(spark, path)
