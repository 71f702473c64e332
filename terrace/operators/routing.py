"""Routing: which partition each row belongs to, computed from the key alone.

No row is joined to a partition by comparing bounds.  Every level adds a
column with the partition's label (or NULL for DEFAULT); labels are zero-padded
text, so directories named by them sort like their windows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.functions.names import SEPARATOR
from terrace.plans.scheme import Hash, Level, List, Range, SlidingList

DEFAULT = "default"


def bucket(level: Hash, df: DataFrame | None = None) -> Column:
    """The bucket: a single integer key modulo, any other by xxhash64.  Null keys go to bucket 0 of an integer key."""
    integral = df is not None and len(level.columns) == 1 and isinstance(df.schema[level.column].dataType, T.IntegralType)
    hashed = F.coalesce(F.col(level.column).cast("long"), F.lit(0).cast("long")) if integral else F.xxhash64(*level.columns)
    return F.pmod(hashed, F.lit(level.modulus).cast("long")).cast("int")


def ordinal(level: Range | SlidingList) -> Column:
    axis = level.progression
    return axis.ordinal(axis.position(F.col(level.column)))


def group_of(level: List) -> Column:
    """The group's name; the default's, or NULL if there is none, for other values."""
    key = F.col(level.column).cast("string")
    out = F.lit(level.default_name if level.include_default else None).cast("string")
    for group in reversed(level.groups):
        inside = F.coalesce(key.isin(*group.values), F.lit(False)) if group.values else F.lit(False)
        out = F.when((inside | key.isNull()) if group.includes_null else inside, F.lit(group.name)).otherwise(out)
    return out


def label(level: Level, df: DataFrame | None = None) -> Column:
    """The label of the row's partition at this level; NULL where the row belongs to DEFAULT."""
    if isinstance(level, Hash):
        return F.concat(F.lit("h"), bucket(level, df).cast("string"))
    if isinstance(level, List):
        return group_of(level)
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in level.columns])
    return F.when(whole, level.progression.label(ordinal(level)))


def level_columns(scheme: Level) -> list[str]:
    return [f"p{k}" for k in range(len(scheme.walk()))]


def route(df: DataFrame, scheme: Level, *, table: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """``df`` with a label per level (p0, p1, ...; ``default`` beyond the scheme) and, with ``table``, the partition's name.

    ``known`` is a column ``partition`` with the names that exist; rows of others go to the
    table's DEFAULT.  It is joined by name, and broadcast only if Spark finds it small.
    """
    names = level_columns(scheme)
    out = df
    for name, level in zip(names, scheme.walk()):
        out = out.withColumn(name, F.coalesce(label(level, df), F.lit(DEFAULT)))
    # Below a DEFAULT there are no further levels.
    for k in range(1, len(names)):
        out = out.withColumn(names[k], F.when(F.col(names[k - 1]) == DEFAULT, F.lit(DEFAULT)).otherwise(F.col(names[k])))
    if table is None:
        return out
    path = F.array_join(F.filter(F.array(*names), lambda x: x != DEFAULT), SEPARATOR)
    out = out.withColumn("partition", F.when(F.col(names[0]) == DEFAULT, F.lit(f"{table}{SEPARATOR}{DEFAULT}")).otherwise(F.concat(F.lit(table + SEPARATOR), path)))
    if known is None:
        return out
    there = known.select(F.col("partition"), F.lit(True).alias("__there")).distinct()
    return out.join(there, "partition", "left").withColumn("partition", F.when(F.col("__there"), F.col("partition")).otherwise(F.lit(f"{table}{SEPARATOR}{DEFAULT}"))).drop("__there")


def write(df: DataFrame, scheme: Level, path: str, *, mode: str = "append", **options: str) -> None:
    """Write rows into directories by level.  Rows of a partition are brought together first, so that files are few.

    Rebalancing splits a partition that holds much of the data over several tasks.
    """
    names = level_columns(scheme)
    routed = route(df, scheme)
    routed.hint("rebalance", *[F.col(n) for n in names]).write.mode(mode).options(**options).partitionBy(*names).parquet(path)
