"""A stream into a partitioned table: each micro-batch is routed by the same columns as a table is.

Rows later than their partition go to DEFAULT like any other row without one, and a
later backfill moves them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from terrace.operators.routing import route, write
from terrace.plans.scheme import Level
from terrace.service import LifecycleService


def to_folders(stream: DataFrame, scheme: Level, path: str, checkpoint: str) -> DataStreamWriter:
    """Append to folders by level."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: write(batch, scheme, path))


def to_table(stream: DataFrame, service: LifecycleService, checkpoint: str) -> DataStreamWriter:
    """Append to a stored table, a catalogue version a batch."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: None if batch.isEmpty() else service.append(batch) and None)


def counts(stream: DataFrame, scheme: Level, table: str, key: str, lateness: str) -> DataFrame:
    """Rows by partition, kept up to ``lateness`` behind the newest key."""
    return route(stream.withWatermark(key, lateness), scheme, table=table).groupBy("partition").count()
