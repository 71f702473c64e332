"""Connected components of an edge table, all on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import cut

#: Edges a task: the rounds over a small table run in few tasks, whatever the session's shuffle partitions.
PER_TASK = 250_000


def _few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in tasks enough for ``rows``; no shuffle, it reads several shuffle partitions a task."""
    return df.coalesce(max(4, -(-rows // PER_TASK)))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``: root is the smallest node it reaches.

    Alternating large-star and small-star steps: each hangs a node's neighbours
    on its smallest one, so the edges become stars in a number of rounds that
    is logarithmic in practice; they go on until a round changes nothing.  A step
    is a min aggregation and an equi-join, so a node with very many neighbours is
    combined on the map side.  Each round is checkpointed.  Null ends and loops
    are dropped; an empty table gives an empty result.
    """
    now = cut(
        edges.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    rows = now.count()
    now, before = _few(now, rows), None
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _few(large.where("a != b"), 2 * rows)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(_few(_few(small.unionByName(least.select("a", F.col("m").alias("b"))), 2 * rows).distinct(), rows))
        rows, mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (rows, mark) == before:
            break
        before = rows, mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
