"""Changes of a table's columns, decided before anything is written."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlake.sinks import ledger

CHANGES = "column string, stored string, offered string, action string, reason string"
#: Types whose files can be read as wider ones, narrow to wide.
_WIDER = {
    "tinyint": ("smallint", "int", "bigint", "double"),
    "smallint": ("int", "bigint", "double"),
    "int": ("bigint", "double"),
    "float": ("double",),
    "date": ("timestamp_ntz",),
}


class SchemaRefused(ValueError):
    """A write whose columns cannot be stored; ``changes`` says why, column by column."""

    def __init__(self, changes: list[tuple]):
        self.changes = changes
        super().__init__("; ".join(f"{c[0]}: {c[4]}" for c in changes if c[3] == "refuse"))


def compare(stored: T.StructType | None, offered: T.StructType) -> list[tuple]:
    """One row for each offered column: column, stored and offered type, action, reason.

    Actions: ``same``; ``add`` a new column; ``widen`` the stored type, which
    older files can be read as; ``cast`` the offered values, which loses none;
    ``refuse``. Names that differ in case only are refused, as Spark takes them for one.
    """
    known = {f.name: f.dataType.simpleString() for f in stored.fields} if stored else {}
    lower = {name.lower(): name for name in known}
    out = []
    for f in offered.fields:
        new, old = f.dataType.simpleString(), known.get(f.name)
        if old is None and f.name.lower() in lower:
            out.append((f.name, known[lower[f.name.lower()]], new, "refuse", f"the table has {lower[f.name.lower()]}"))
        elif old is None:
            out.append((f.name, None, new, "add", "new column"))
        elif old == new:
            out.append((f.name, old, new, "same", "equal types"))
        elif new in _WIDER.get(old, ()):
            out.append((f.name, old, new, "widen", f"{old} is read as {new}"))
        elif old in _WIDER.get(new, ()):
            out.append((f.name, old, new, "cast", f"{new} is stored as {old}"))
        else:
            out.append((f.name, old, new, "refuse", f"{new} does not go into {old}"))
    return out


def merged(stored: T.StructType | None, offered: T.StructType, changes: list[tuple]) -> T.StructType:
    """The columns of the table after the changes."""
    action = {c[0]: c[3] for c in changes}
    new = {f.name: f for f in offered.fields}
    old = stored.fields if stored else []
    fields = [T.StructField(f.name, new[f.name].dataType if action.get(f.name) == "widen" else f.dataType) for f in old]
    return T.StructType(fields + [T.StructField(n, f.dataType) for n, f in new.items() if action[n] == "add"])


def stored_columns(spark: SparkSession, path: str) -> T.StructType | None:
    """The noted columns of a table, else those of its files without partition columns; None without either."""
    known = ledger.read(spark, path).columns
    if known is not None or not ledger.Folder(spark, path).exists():
        return known
    folder = ledger.Folder(spark, path)
    if not any(name[0] not in "._" for name in folder.names()):
        return None
    found = spark.read.option("mergeSchema", "true").parquet(path)
    parts = set(partition_columns(spark, path))
    return T.StructType([f for f in found.schema.fields if f.name not in parts])


def partition_columns(spark: SparkSession, path: str) -> list[str]:
    """Names of the partition columns, from the first folders of the table that lead to files."""
    folder = ledger.Folder(spark, path)

    def below(place: str) -> list[str] | None:
        entries = [(e.getPath().getName(), e.isDirectory()) for e in folder.entries(place)]
        for name, is_folder in entries:
            if is_folder and "=" in name and name[0] != ".":
                found = below(f"{place}/{name}".lstrip("/"))
                if found is not None:
                    return [name.split("=", 1)[0], *found]
        return [] if any(not is_folder and name[0] not in "._" for name, is_folder in entries) else None

    return below("") or []


def changes(spark: SparkSession, path: str, offered: T.StructType) -> DataFrame:
    """What a write of such columns would change, as rows; nothing is written."""
    return spark.createDataFrame(compare(stored_columns(spark, path), offered), CHANGES)


def settle(spark: SparkSession, path: str, offered: T.StructType) -> T.StructType:
    """Note the columns that a write adds or widens, and return those of the table; refuse what cannot be stored."""
    for attempt in range(5):
        state = ledger.read(spark, path)
        stored = state.columns or stored_columns(spark, path)
        found = compare(stored, offered)
        if any(c[3] == "refuse" for c in found):
            raise SchemaRefused(found)
        table = merged(stored, offered, found)
        if state.columns == table:
            return table
        try:
            ledger.commit(spark, path, state, replace(state, schema=json.dumps(table.jsonValue())))
            return table
        except ledger.Conflict:
            if attempt == 4:
                raise
    raise AssertionError


def fitted(df: DataFrame, table: T.StructType) -> DataFrame:
    """The rows with their columns in the types of the table."""
    types = {f.name: f.dataType for f in table.fields}
    return df.select(*[
        F.col(f"`{f.name}`").cast(types[f.name]).alias(f.name) if f.name in types and types[f.name] != f.dataType else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])
