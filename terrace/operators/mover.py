"""Moving rows between DEFAULT and the partitions they belong to, as set operations."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from terrace.functions.names import SEPARATOR
from terrace.operators.routing import DEFAULT, level_columns, route
from terrace.plans.scheme import Level, Range


def whole_key(scheme: Level) -> Column:
    """Rows with a null in any key column of the root stay in DEFAULT."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in scheme.columns])


def earliest(df: DataFrame, scheme: Range) -> DataFrame:
    """One row: the smallest position of a row whose whole key is known; null if there is none."""
    return df.where(whole_key(scheme)).agg(F.min(scheme.axis.position(F.col(scheme.column))).alias("position"))


def in_window(df: DataFrame, scheme: Range, start: int, end: int) -> DataFrame:
    """The rows of one window: its key range and a known rest of the key."""
    at = scheme.axis.position(F.col(scheme.column))
    return df.where(whole_key(scheme) & (at >= start) & (at < end))


def first_rows(df: DataFrame, n: int) -> Column:
    """Whether a row is among the first ``n`` of ``df`` by __file and __row: a batch that is the same whenever it is worked out."""
    for file, count in df.groupBy("__file").count().orderBy("__file").collect():  # a row a file
        if n < count:
            last = df.where(F.col("__file") == file).orderBy("__row").limit(n).agg(F.max("__row")).first()[0]
            return (F.col("__file") < file) | ((F.col("__file") == file) & (F.col("__row") <= F.lit(-1 if last is None else last)))
        n -= count
    return F.lit(True)


def drained(df: DataFrame, scheme: Level, table: str) -> DataFrame:
    """The rows of DEFAULT that belong elsewhere, each with its partition; all windows in one pass."""
    return route(df, scheme, table=table).where(F.col("partition") != f"{table}{SEPARATOR}{DEFAULT}")


def staying(df: DataFrame, scheme: Level) -> DataFrame:
    """The rows of DEFAULT that stay there."""
    return route(df, scheme).where(F.col("p0") == DEFAULT).drop(*level_columns(scheme))


def tally(moved: DataFrame, batch: int) -> DataFrame:
    """partition, moved, batches: rows by partition and how many batches they make."""
    rows = moved.groupBy("partition").agg(F.count("*").alias("moved"))
    return rows.withColumn("batches", F.call_function("div", F.col("moved") + (batch - 1), F.lit(batch).cast("long")))


def referenced(part: DataFrame, referencing: DataFrame, keys: Mapping[str, str], by: str) -> DataFrame:
    """(by, referenced = true) of the partitions that some row refers to; null keys refer to nothing."""
    others = referencing.select(*[F.col(theirs).alias(mine) for mine, theirs in keys.items()]).na.drop()
    return part.join(others, list(keys), "left_semi").select(by).distinct().withColumn("referenced", F.lit(True))


def unpartitioned(spark: SparkSession, path: str, schema: StructType, scheme: Level, *, keep_labels: bool = False) -> DataFrame:
    """All rows under ``path`` as one table.  Labels are read as text whatever they look like."""
    names = level_columns(scheme)
    whole = StructType([*schema.fields, *[StructField(n, StringType()) for n in names]])
    df = spark.read.schema(whole).parquet(path)
    return df if keep_labels else df.drop(*names)
