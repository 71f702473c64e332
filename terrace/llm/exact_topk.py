"""Exact top-k inner products by the no-random-access algorithm (NRA).

Every dimension of a block of vectors is two lists, sorted by value and by its
negative, and a query reads the one that its own sign favours, weighted by the
size of its component.  All lists are read sequentially, ``slice`` places at a
time.  A vector's lower bound adds up what has been read of it, and for each list
in which it has not come up the list's last value; its upper bound takes the value
read last instead.  Reading stops when no vector but the k with the best lower
bounds, unseen ones included, has an upper bound that reaches the k-th; the final
scores of those are resolved then.  Bounds and scores are whole numbers, so they are exact.

Vectors are dealt into blocks; each block of queries is sent to each block of
vectors once, and each pair yields k rows a query, of which the best k are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import cut, prepare

_EXACT = 2**53  # doubles hold all whole numbers up to here


@dataclass(frozen=True)
class TopK:
    k: int = 5
    block: int = 4096
    query_block: int = 256
    slice: int = 256


class Lists:
    """The sorted lists of one block, best first: list j of the first half by component j, of the second by its negative."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.rows = np.hstack((np.argsort(-self.vectors.astype(object) if _largest(vectors) >= _EXACT else -self.vectors, axis=0), np.argsort(self.vectors, axis=0)))

    def values(self, kind: type) -> np.ndarray:
        """What the lists hold, in their order."""
        vectors = self.vectors.astype(kind)
        return np.take_along_axis(np.hstack((vectors, -vectors)), self.rows, axis=0)

    def top(self, queries: np.ndarray, own: np.ndarray, how: TopK) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """For each query (its index, ids and scores of the block's best, depth read); smaller id first among equals, id ``own`` left out."""
        n, dim = self.vectors.shape
        # Beyond what doubles hold exactly, Python's whole numbers take their place.
        kind = np.float64 if 4 * dim * _largest(self.vectors) * _largest(queries) < _EXACT else object
        values, q = self.values(kind), queries.astype(kind)
        weights = np.hstack((np.maximum(q, 0), np.maximum(-q, 0)))
        least = values[-1]
        other = self.ids[None, :] != own[:, None]
        k = np.minimum(how.k, other.sum(axis=1))
        waiting = np.flatnonzero(k > 0)
        lower = np.repeat((weights[waiting] @ least)[:, None], n, axis=1)
        unread = np.ones(values.shape, kind)
        for start in range(0, n, how.slice):
            stop = min(start + how.slice, n)
            gained = np.zeros(values.shape, kind)
            np.put_along_axis(gained, self.rows[start:stop], values[start:stop] - least, axis=0)
            np.put_along_axis(unread, self.rows[start:stop], 0, axis=0)
            lower = lower + weights[waiting] @ gained.T
            upper = lower + (weights[waiting] * (values[stop - 1] - least)) @ unread.T
            done = np.zeros(len(waiting), bool)
            for x, i in enumerate(waiting):
                allowed = np.flatnonzero(other[i])
                kth = np.partition(lower[x, allowed], len(allowed) - k[i])[len(allowed) - k[i]]
                rivals = allowed[upper[x, allowed] >= kth]
                if len(rivals) == k[i] or stop == n:
                    scores = self.vectors[rivals].astype(kind) @ q[i]
                    best = sorted(range(len(rivals)), key=lambda r: (-scores[r], self.ids[rivals[r]]))[: k[i]]
                    yield i, self.ids[rivals[best]], scores[best].astype(np.int64), stop
                    done[x] = True
            waiting, lower = waiting[~done], lower[~done]
            if not len(waiting):
                return


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as a double; null if the vector, or any component, is null or not finite."""
    fine = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def top_k(vectors: DataFrame, how: TopK = TopK(), *, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256, every: int = 50) -> DataFrame:
    """query_id, rank (from 1), vec_id, score and depth for each row whose id is divisible by ``every``, against all rows but those of its own id.

    Rows with a null id take no part, nor do vectors that are null or hold a null
    or non-finite component.  Every distinct pair of id and vector is a candidate,
    and what the vectors of one query id find is ranked together.  Vectors of
    different lengths are compared only with their like.  ``depth`` is the share of
    its lists that the block of the vector had read when the query was decided.  A
    score beyond 64 bits ends the job with an error.
    """
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), whole_numbers(F.col(vector), scale).alias("v")).where("id is not null and v is not null and size(v) > 0")
    rows = cut(rows.distinct().withColumn("dim", F.size("v")))
    queries = rows.where(F.col("id") % every == 0)
    n, n_queries = rows.count(), queries.count()
    blocks, query_blocks = max(1, -(-n // how.block)), max(1, -(-n_queries // how.query_block))

    def packed(df: DataFrame, count: int) -> DataFrame:
        """Blocks of rows as one row each: ids and components as bytes."""

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            v = np.array(frame.v.tolist(), "<i8").reshape(len(frame), -1)
            return pd.DataFrame([(int(frame.dim[0]), int(frame.block[0]), frame.id.to_numpy("<i8").tobytes(), v.tobytes())], columns=["dim", "block", "ids", "vs"])

        dealt = df.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(count)).cast("long"))
        return dealt.groupBy("dim", "block").applyInPandas(run, "dim int, block long, ids binary, vs binary")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, lists = None, None
        for frame in frames:
            for dim, block, number, ids, vs in zip(frame.dim, frame.block, frame.query_block, frame.ids, frame.vs):
                ids, vs = np.frombuffer(ids, "<i8"), np.frombuffer(vs, "<i8").reshape(-1, dim)
                if number < 0:
                    at, lists = (dim, block), Lists(ids, vs)
                elif at == (dim, block):  # otherwise no vector of this block has the queries' length
                    found = [(np.full(len(x), ids[i]), x, scores, np.full(len(x), depth / len(lists.ids))) for i, x, scores, depth in lists.top(vs, ids, how)]
                    if found:
                        yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score", "depth"), map(np.concatenate, zip(*found)))))

    # The stated query set against all rows: each block of queries is sent once to every block of vectors, and
    # streams past the lists of that block, which come first.
    held = packed(rows, blocks).withColumn("query_block", F.lit(-1).cast("long"))
    asked = packed(queries, query_blocks).withColumnRenamed("block", "query_block")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    dealt = held.unionByName(asked).repartition(min(blocks, 2000), "dim", "block").sortWithinPartitions("dim", "block", "query_block")
    found = dealt.mapInPandas(search, "query_id long, vec_id long, score long, depth double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= how.k).select("query_id", "rank", "vec_id", "score", "depth")
