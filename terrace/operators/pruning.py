"""Pruning: predicates on the level columns that follow from predicates on the raw key.

Spark prunes directories by their own columns only.  Labels and buckets are
functions of the key, and labels are monotone, so a range or an equality of the
key implies one of theirs; both are applied.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.axis import TimeAxis
from terrace.operators.routing import DEFAULT, level_columns
from terrace.plans.scheme import Hash, Level, List, Range, SlidingList


def implied(scheme: Level, ranges: Mapping[str, tuple[int | None, int | None]] | None = None, equal: Mapping[str, Any] | None = None) -> Column:
    """What must hold of p0, p1, ... where each key of ``ranges`` lies in [low, high) and those of ``equal`` have one value.

    Positions are microseconds on time axes.  DEFAULT is always read, since a row may
    have been left there.
    """
    ranges, equal = dict(ranges or {}), dict(equal or {})
    out = F.lit(True)
    for name, level in zip(level_columns(scheme), scheme.walk()):
        inside = None
        if isinstance(level, (Range, SlidingList)):
            axis = level.progression
            low, high = ranges.get(level.column, (None, None))
            if level.column in equal and equal[level.column] is not None and not isinstance(axis, TimeAxis):
                low, high = equal[level.column], equal[level.column] + 1
            parts = []
            # Labels sort like their windows on time axes; integers are compared through the parsed label.
            key = (lambda o, axis=axis: axis.label(F.lit(o).cast("long"))) if isinstance(axis, TimeAxis) else (lambda o: F.lit(o).cast("long"))
            column = F.col(name) if isinstance(axis, TimeAxis) else axis.parse(F.col(name))
            if low is not None:
                parts.append(column >= key(axis.ordinal_at(low)))
            if high is not None:
                parts.append(column <= key(axis.ordinal_at(high - 1)))
            if parts:
                inside = parts[0] if len(parts) == 1 else parts[0] & parts[1]
        elif level.column in equal:
            value = equal[level.column]
            if isinstance(level, List):
                named = [g.name for g in level.groups if (g.includes_null if value is None else str(value) in g.values)]
                inside = F.col(name) == (named[0] if named else level.default_name)
            elif isinstance(level, Hash) and all(c in equal for c in level.columns) and len(level.columns) == 1 and isinstance(value, int):
                inside = F.col(name) == f"h{value % level.modulus}"
        if inside is not None:
            out = out & (inside | (F.col(name) == DEFAULT))
    return out


def prune(df: DataFrame, scheme: Level, ranges: Mapping[str, tuple[int | None, int | None]] | None = None, equal: Mapping[str, Any] | None = None) -> DataFrame:
    """Rows in the ranges and equal to the values, reading only the directories that can hold them."""
    out = df.where(implied(scheme, ranges, equal))
    by_column = {level.column: level for level in scheme.walk()}
    for column, (low, high) in (ranges or {}).items():
        level = by_column.get(column)
        axis = level.progression if level is not None else None
        if isinstance(axis, TimeAxis) and axis.codec is None:
            edge = lambda p: F.timestamp_micros(F.lit(p).cast("long")).cast(df.schema[column].dataType)  # noqa: E731, B023
            key = F.col(column)
        else:
            edge = lambda p: F.lit(p).cast("long")
            key = axis.position(F.col(column)) if axis is not None else F.col(column)
        if low is not None:
            out = out.where(key >= edge(low))
        if high is not None:
            out = out.where(key < edge(high))
    for column, value in (equal or {}).items():
        out = out.where(F.col(column).isNull() if value is None else F.col(column) == value)
    return out
