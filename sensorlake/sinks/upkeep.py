"""Compaction, retention and removal of what no reader needs.

Both rewrite batches into one that stands for them, and change the table by one
new version of its ledger. Until then readers see the old batches, from then on
the new one; a batch that is run again stays covered. ``vacuum`` removes files
later, when readers of older versions are done.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import replace
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.operators import series
from sensorlake.sinks import evolve, ledger
from sensorlake.sinks.tables import APPENDS, POINT_PARTITIONS, write_files
from sensorlake.sources import tables as sources

DATE = "date"
_NULL = "__HIVE_DEFAULT_PARTITION__"


def _whole(spark: SparkSession, path: str, state: ledger.State) -> dict[str, int]:
    """For each query the last batch that was written whole, and may be rewritten."""
    found = {q: batches[-1] for q, batches in ledger.marked(spark, path).items() if batches and not q.endswith(".second")}
    return found | {q: 2**62 for q in state.outputs}


def _rewrite(
    spark: SparkSession, path: str, state: ledger.State, start: date | None, stop: date | None,
    *, full: bool, since: datetime | None = None, time_column: str = "",
) -> tuple[str | None, list[ledger.Cover]]:
    """Write the rows of covered dates as one batch; its id, and what it stands for. None if there are none to do."""
    upto = {q: b for q, b in _whole(spark, path, state).items() if full or not q.startswith(ledger.OUTPUT)}
    parts = evolve.partition_columns(spark, path)
    if not set(ledger.BATCH_COLUMNS) <= set(parts) or not upto:
        return None, []
    if (start or stop) and DATE not in parts:
        raise ValueError(f"{path} is not partitioned by {DATE}")
    edges = [d.isoformat() if d else None for d in (start, stop)]
    covers = [ledger.Cover(q, b, *edges) for q, b in sorted(upto.items())]
    raw = sources.read_files(spark, path, state)
    rows = ledger.visible(raw, state, DATE).filter(ledger.covers(ledger.State(covered=tuple(covers)), DATE))
    names = [name for name in parts if name not in ledger.BATCH_COLUMNS]
    found = rows.groupBy("query_id").agg(F.max("batch_id").alias("last")).collect()  # one row a query
    if not found or (not full and all(r["query_id"].startswith(ledger.OUTPUT) for r in found)):
        return None, []
    if since is not None:
        rows = rows.filter(F.col(f"`{time_column}`") >= F.lit(since))
    output, number = f"{ledger.OUTPUT}{uuid.uuid4().hex}", 0
    order: list[str] = []
    if tuple(names) == POINT_PARTITIONS:
        rows, number = series.latest(sources.stamped(rows)), max(r["last"] for r in found)
        order = [c for c in rows.columns if c not in (*names, "_field", "_value", series.TIME)] + [series.TIME]
    else:
        rows = rows.drop(*ledger.BATCH_COLUMNS)
    write_files(rows, path, output, number, partition_by=names, order=order)
    return output, covers


def compact(spark: SparkSession, path: str, *, closed: date | None = None, full: bool = False) -> int:
    """Rewrite the batches of closed dates as one; returns how many queries and outputs it stands for.

    closed: the last date that is rewritten, for tables partitioned by date; all
    without it. Batches that were not marked as written whole are left alone, so
    a stream may go on meanwhile. Of points the last write is kept. Later
    batches of closed dates are taken by the next call; ``full`` merges what
    earlier calls have written, too.
    """
    state = ledger.read(spark, path)
    output, covers = _rewrite(spark, path, state, None, closed, full=full)
    if output is None:
        return 0
    gone = {c.query_id for c in covers if c.stop is None}
    outputs = tuple(o for o in state.outputs if o not in gone)
    ledger.commit(spark, path, state, replace(state.with_cover(covers), outputs=(*outputs, output)))
    return len(covers)


def drop_before(spark: SparkSession, path: str, limit: datetime, *, time_column: str = "@timestamp") -> bool:
    """Remove rows before ``limit`` from a table partitioned by date; whether there was anything to do.

    Whole dates go by their names, without a row being read. Of the date that
    holds the limit the rest is written anew; no file of a later date changes.
    """
    state = ledger.read(spark, path)
    if state.limit is not None and datetime.fromisoformat(state.limit) >= limit:
        return False
    border, output, covers = limit.date(), None, []
    if limit != datetime.combine(border, datetime.min.time()):
        output, covers = _rewrite(spark, path, state, border, border, full=True, since=limit, time_column=time_column)
    new = replace(state.with_cover(covers), before=border.isoformat(), limit=limit.isoformat())
    ledger.commit(spark, path, state, replace(new, outputs=(*state.outputs, output) if output else state.outputs))
    return True


def vacuum(spark: SparkSession, path: str, *, keep: timedelta = timedelta(hours=1)) -> int:
    """Delete folders that the ledger has replaced or dropped; returns how many.

    Only once the last version is older than ``keep``, by when its readers and
    those of earlier ones should be done; likewise for outputs that nobody named.
    """
    state, folder = ledger.read(spark, path), ledger.Folder(spark, path)
    old = time.time() * 1000 - keep.total_seconds() * 1000
    notes = {e.getPath().getName(): e.getModificationTime() for e in folder.entries("_ledger")}
    if not state.version or notes[f"{state.version:012d}.json"] > old:
        return 0
    removed = 0

    def dead(names: dict[str, str], at: int) -> bool:
        day, query, batch = names.get(DATE), names.get("query_id"), names.get("batch_id")
        if state.before and day and day != _NULL and day < state.before:
            return True
        if query is None or batch is None:
            return False
        if query.startswith(ledger.OUTPUT) and query not in state.outputs:
            return at <= old
        mine = ledger.Cover(query, int(batch), day if day != _NULL else None, day if day != _NULL else None)
        return any(c.holds(mine) for c in state.covered)

    def walk(place: str, names: dict[str, str]) -> None:
        nonlocal removed
        for entry in folder.entries(place):
            name = entry.getPath().getName()
            if entry.isDirectory() and "=" in name and name[0] != ".":
                here, below = f"{place}/{name}".lstrip("/"), names | dict([name.split("=", 1)])
                if dead(below, entry.getModificationTime()):
                    folder.delete(here)
                    removed += 1
                else:
                    walk(here, below)
                    if not folder.entries(here):
                        folder.delete(here)

    walk("", {})
    # an append never runs again, so nothing is left for its cover to hide
    for c in state.covered:
        if c.query_id.startswith(APPENDS) and c.start is None and c.stop is None:
            ledger.unmark(spark, path, c.query_id)
    kept = tuple(c for c in state.covered if not c.query_id.startswith((APPENDS, ledger.OUTPUT)))
    if kept != state.covered:
        state = ledger.commit(spark, path, state, replace(state, covered=kept))
    ledger.forget(spark, path, state)
    return removed


def table_files(spark: SparkSession, path: str) -> DataFrame:
    """Files that readers of the table open, with their rows: path, rows."""
    state = ledger.read(spark, path)
    rows = ledger.visible(sources.read_files(spark, path, state), state, DATE)
    return rows.groupBy(F.input_file_name().alias("path")).agg(F.count("*").alias("rows"))

