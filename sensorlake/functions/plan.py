"""Helpers that shape the plan, not the result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column) -> Column:
    """Work ``value`` out one time per row, however often later steps refer to it.

    Catalyst pushes a filter below a projection by copying the projected
    expression into the filter, so an expensive parse would run again for every
    mention. It does not push a filter below a generator, and this generator
    yields exactly one row.
    """
    return F.explode(F.array(value))


def fields_once(record: Column) -> Column:
    """The fields of a struct as columns, worked out one time; nulls for a null struct."""
    return F.inline(F.array(record))
