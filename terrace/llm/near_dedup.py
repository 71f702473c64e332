"""Near-duplicate classes by MinHash with tensored banding.

Plain banding with ``L`` tables of ``K`` values needs ``L * K`` minhashes.  Here
two collections of ``side`` small hashes, each of ``width`` minhashes, are
computed, and the key of table (i, j) is the pair of the i-th of the first
and the j-th of the second: ``side ** 2`` tables from ``2 * side * width``
minhashes.  Two sets of similarity s meet in some table with a chance of
``(1 - (1 - s ** width) ** side) ** 2``.

What follows:

1.  Equal sets are one class, so exact copies, however many, cost nothing more.
2.  Small hashes that no second class has are dropped before keys are formed.
3.  In every table each class meets the most central one of its bucket (the one
    with the fullest buckets), and its best such partner is verified on full sets.
    Verified links give a first labelling by components.
4.  Buckets that then hold several components are gone over again.  In one of at
    most ``small`` members every two of different components are compared.
5.  Larger buckets with the same most central member make a family.  First its
    members are peeled: a link needs ``similarity`` per cent of a member's shingles
    to be in another member, so one with more shingles that only it has is out,
    exactly and without meeting anyone.  Those
    left outside the family's largest component then meet each other and that
    component, chunk against chunk, unless their sizes rule a link out.
6.  The new links join the components of the first labelling.

So every two texts that share a table are in one component, were compared, or
cannot be near; no number of partners or candidates is capped.

Sets are compared by hashes of their shingles: classes by 128 bits, links by 32,
where a wrong count within a pair has a chance of about |x-y| * |y-x| / 2**32.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm import hashing
from terrace.llm.common import cut, prepare, stored
from terrace.llm.graph import components


@dataclass(frozen=True)
class NearDedup:
    """``shingle`` words a shingle; links from ``similarity`` per cent up."""

    shingle: int = 5
    similarity: int = 80
    width: int = 2  # three is enough from 85 per cent up
    side: int = 10
    small: int = 25
    chunk: int = 512
    slice: int = 1_000_000
    seed: int = 7

    @property
    def multipliers(self) -> np.ndarray:
        return np.random.default_rng(self.seed).integers(2**62, 2**63, (2 * self.side * self.width, 2), np.uint64) | np.uint64(1)


def signatures(frames: Iterator[pd.DataFrame], how: NearDedup) -> Iterator[pd.DataFrame]:
    """(doc_id, text_md5, text) to (doc_id, text_md5, n, digest, small): small has the hashes of both collections."""
    ab = how.multipliers
    for whole in frames:
        for frame, texts in hashing.pieces(whole):
            sets = hashing.shingle_sets([t.translate(hashing.LOWER) for t in texts], how.shingle)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            full = np.flatnonzero(sizes)
            small = np.zeros((len(sets), 2 * how.side), np.uint64)
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                begins = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                for k in range(2 * how.side):
                    total = np.full(len(full), k + 1, np.uint64)
                    for a, b in ab[k * how.width : (k + 1) * how.width]:
                        drawn = (flat ^ (flat >> np.uint64(29))) * a + b
                        total = hashing.mix(total * np.uint64(31) + np.minimum.reduceat(drawn ^ (drawn >> np.uint64(32)), begins))
                    small[full, k] = total
            yield pd.DataFrame(
                {
                    "doc_id": frame.doc_id.to_numpy(),
                    "text_md5": frame.text_md5.to_numpy(),
                    "n": sizes,
                    "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                    "small": list(small.view(np.int64)),
                }
            ).astype({"doc_id": "Int64"})


def shingled(frames: Iterator[pd.DataFrame], how: NearDedup) -> Iterator[pd.DataFrame]:
    """(sid, text) to (sid, grams): the set by 32-bit hashes."""
    for whole in frames:
        for frame, texts in hashing.pieces(whole):
            sets = hashing.shingle_sets([t.translate(hashing.LOWER) for t in texts], how.shingle)
            yield pd.DataFrame({"sid": frame.sid.to_numpy(), "grams": [(s >> np.uint64(32)).astype(np.uint32).view(np.int32) for s in sets]})


def _verified(pairs: DataFrame, sets: DataFrame, how: NearDedup, *carried: str) -> DataFrame:
    """Those of ``pairs(x, n_x, y, n_y)`` that are links, confirmed on full sets: (x, y) and the columns named."""
    one, other = (sets.select(F.col("sid").alias(k), F.col("grams").alias(f"grams_{k}")) for k in "xy")
    sized = pairs.where(100 * F.least("n_x", "n_y") >= how.similarity * F.greatest("n_x", "n_y"))
    both = sized.join(one, "x").join(other, "y").withColumn("common", F.size(F.array_intersect("grams_x", "grams_y")))
    return both.where(100 * F.col("common") >= how.similarity * (F.col("n_x") + F.col("n_y") - F.col("common"))).select("x", "y", *carried)


def overlaps(members: list[np.ndarray], reps: list[np.ndarray]) -> np.ndarray:
    """How many grams each member has in common with each of ``reps``; all are distinct within an array."""
    every = np.concatenate(reps)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], np.repeat(np.arange(len(reps)), [len(r) for r in reps])[order]
    out = np.zeros((len(members), len(reps)), np.int64)
    for k, grams in enumerate(members):
        low, high = np.searchsorted(every, grams, "left"), np.searchsorted(every, grams, "right")
        counts = high - low
        at = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        out[k] = np.bincount(owner[at], minlength=len(reps))
    return out


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the edges (a, b), in order, join what the ones before have not joined."""
    above: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    out = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        if (x := find(x)) != (y := find(y)):
            above[x], out[k] = y, True
    return out


def _linked(members: pd.DataFrame, others: pd.DataFrame, how: NearDedup) -> pd.DataFrame:
    """Pairs (a, b) of components that a link between two chunks of a family joins, on full sets; no more than join them all."""
    if not len(members) or not len(others):
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    found = overlaps([np.asarray(g) for g in members.grams], [np.asarray(g) for g in others.grams])
    near = 100 * found >= how.similarity * (members.n.to_numpy()[:, None] + others.n.to_numpy()[None, :] - found)
    one, other = members.comp.to_numpy(), others.comp.to_numpy()
    x, y = np.nonzero(near & (one[:, None] != other[None, :]))
    needed = forest(one[x], other[y])
    return pd.DataFrame({"a": one[x[needed]], "b": other[y[needed]]})


def _mixed(keys: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``keys`` in buckets that hold several components, with comp and the bucket's family."""
    placed = keys.join(found, "sid", "left").withColumn("comp", F.coalesce("root", "sid")).drop("root")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("weight", "sid")).alias("top")).where("lo != hi").select("key", F.col("top.sid").alias("family"))
    return stored(placed.join(mixed, "key"))


def _alone(group: pd.DataFrame) -> pd.DataFrame:
    """(family, sid, own): how many of a member's shingles in this slice no other member has."""
    grams = [np.asarray(g) for g in group.grams]
    owner = np.repeat(np.arange(len(group)), [len(g) for g in grams])
    _, first, counts = np.unique(np.concatenate(grams), return_index=True, return_counts=True)
    own = np.bincount(owner[first[counts == 1]], minlength=len(group))
    return pd.DataFrame({"family": group.family.to_numpy(), "sid": group.sid.to_numpy(), "own": own.astype(np.int64)})[own > 0]


def _peeled(members: DataFrame, sets: DataFrame, how: NearDedup) -> DataFrame:
    """``members(family, sid, n, comp)``, with their sets, less those with so many shingles of their own that no link is possible."""
    with_sets = stored(members.join(sets.select("sid", "grams"), "sid"))
    # Shingles of a family are counted in slices of about ``slice`` of them; one is enough for most families.
    sizes = members.groupBy("family").agg(F.ceil(F.sum("n") / how.slice).cast("int").alias("slices"))
    dealt = with_sets.join(sizes, "family").select("family", "sid", "grams", "slices", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    inside = F.filter("grams", lambda g: F.pmod(g, F.col("slices")) == F.col("slice"))
    # One column for both, so that a family's slices are not dealt out by the family alone.
    dealt = dealt.select("family", "sid", F.xxhash64("family", "slice").alias("cell"), F.when(F.col("slices") == 1, F.col("grams")).otherwise(inside).alias("grams"))
    own = dealt.groupBy("cell").applyInPandas(_alone, "family long, sid long, own long").groupBy("family", "sid").agg(F.sum("own").alias("own"))
    left = with_sets.join(own, ["family", "sid"], "left").where(100 * (F.col("n") - F.coalesce("own", F.lit(0))) >= how.similarity * F.col("n"))
    return stored(left.drop("own"))


def _across_small(open_rows: DataFrame, sets: DataFrame, how: NearDedup) -> DataFrame:
    """Pairs (a, b) of components with a link in a small bucket."""
    few = open_rows.where(F.col("c") <= how.small)
    one, other = (few.select("key", F.col("sid").alias(k), F.col("n").alias(f"n_{k}"), F.col("comp").alias(f"comp_{k}")) for k in "xy")
    pairs = one.join(other, "key").where("x < y and comp_x != comp_y").drop("key").distinct()
    return cut(_verified(pairs, sets, how, "comp_x", "comp_y").select(F.col("comp_x").alias("a"), F.col("comp_y").alias("b")))


def _across_large(open_rows: DataFrame, sets: DataFrame, how: NearDedup) -> DataFrame:
    """Pairs (a, b) that join all components between which any pair in a common large bucket has a link."""
    members = _peeled(open_rows.where(F.col("c") > how.small).select("family", "sid", "n", "comp").distinct(), sets, how)
    largest = members.groupBy("family", "comp").count().groupBy("family").agg(F.max(F.struct("count", "comp")).alias("most")).select("family", F.col("most.comp").alias("bulk"))
    # Sets of similarity t have sizes at most a factor 1 / t apart, so they lie in the same band or in neighbouring ones.
    band = F.floor(F.log("n") / F.log(F.lit(100 / how.similarity)) + F.lit(1e-9)).cast("int")
    members = members.join(largest, "family").select("family", "sid", "n", "comp", "grams", (F.col("comp") == F.col("bulk")).alias("bulk"), band.alias("band"))
    cells = ["family", "bulk", "band"]
    # A chunk has about ``chunk`` sets, fewer of long ones.
    counts = cut(members.groupBy(cells).agg(F.ceil(F.greatest(F.count("*") / how.chunk, F.sum("n") / (1000 * how.chunk))).cast("int").alias("chunks")))
    numbered = counts.select(*cells, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    x, y = (numbered.select("family", *(F.col(k).alias(f"{k}_{side}") for k in ("bulk", "band", "chunk"))) for side in "xy")
    order = F.struct("bulk_x", "band_x", "chunk_x") <= F.struct("bulk_y", "band_y", "chunk_y")
    pairs = x.join(y, "family").where(order & (F.abs(F.col("band_x") - F.col("band_y")) <= 1) & ~(F.col("bulk_x") & F.col("bulk_y")))
    pairs = cut(pairs.withColumn("pair", F.xxhash64("family", "bulk_x", "band_x", "chunk_x", "bulk_y", "band_y", "chunk_y")))
    dealt = members.join(counts, cells).withColumn("chunk", F.pmod(F.xxhash64("sid"), F.col("chunks").cast("long")).cast("int")).drop("chunks")
    one, other = (
        dealt.join(pairs.select("pair", "family", *(F.col(f"{k}_{side}").alias(k) for k in ("bulk", "band", "chunk"))), [*cells, "chunk"]).select("pair", "sid", "n", "comp", "grams").toDF("pair", "sid", "n", "comp", "grams")
        for side in "xy"
    )
    return cut(one.groupBy("pair").cogroup(other.groupBy("pair")).applyInPandas(lambda m, r: _linked(m, r, how), "a long, b long"))


def near_duplicates(docs: DataFrame, how: NearDedup = NearDedup(), *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_md5, n_shingles, component_id, component, kept.

    component_id is the smallest doc_id reachable over links, itself included;
    component names the group also where no member has a doc_id.  A null or
    wordless text has an empty set and no link: its component is its own row's,
    and it is kept.  A null doc_id gets the group's smallest doc_id, or null,
    and kept = false unless the group has no doc_id at all.  Equal rows get equal
    results.  Other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_md5"), F.col(text).cast("string").alias("text")
    )
    signed = cut(rows.mapInPandas(lambda it: signatures(it, how), "doc_id long, text_md5 string, n long, digest binary, small array<long>"))
    classes = signed.where("n > 0").groupBy("digest").agg(
        F.first("n").alias("n"), F.first("small").alias("small"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_md5")).alias("row"), F.min("doc_id").alias("least")
    )
    # Numbered once and written, so a class keeps its number.
    classes = stored(classes.select(F.monotonically_increasing_id().alias("sid"), "digest", "n", "small", "least", F.col("row.doc_id").alias("of"), F.col("row.text_md5").alias("md5")))

    # Keys: small hashes that several classes have, then the pairs of both collections.
    hashes = classes.select("sid", "n", F.posexplode("small").alias("k", "h"))
    shared = hashes.groupBy("k", "h").count().where("count > 1").select("k", "h")
    alive = hashes.join(shared, ["k", "h"])
    first, second = alive.where(F.col("k") < how.side), alive.where(F.col("k") >= how.side)
    keys = first.select("sid", "n", F.col("k").alias("i"), F.col("h").alias("u")).join(
        second.select("sid", F.col("k").alias("j"), F.col("h").alias("v")), "sid"
    ).select(F.xxhash64("i", "j", "u", "v").alias("key"), "sid", "n")
    fullness = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    keys = stored(keys.join(fullness, "key"))
    central = keys.groupBy("sid").agg(F.sum("c").alias("weight"))
    keys = stored(keys.join(central, "sid"))

    wanted = classes.join(central.select("sid"), "sid", "left_semi").select("sid", "n", "of", "md5")
    texts = rows.join(
        wanted, F.col("of").eqNullSafe(F.col("doc_id")) & (F.col("md5") == F.col("text_md5"))
    ).select("sid", "text").dropDuplicates(["sid"])
    sets = stored(texts.mapInPandas(lambda it: shingled(it, how), "sid long, grams array<int>").join(wanted.select("sid", "n"), "sid"))

    top = keys.groupBy("key").agg(F.max(F.struct("weight", "sid", "n")).alias("top"))
    stars = keys.join(top, "key").select(F.col("sid").alias("x"), F.col("n").alias("n_x"), F.col("top.sid").alias("y"), F.col("top.n").alias("n_y"), F.col("top.weight").alias("w")).where("x != y")
    best = stars.groupBy("x", "n_x", "y", "n_y").agg(F.count("*").alias("met"), F.max("w").alias("w"))
    best = best.groupBy("x", "n_x").agg(F.max(F.struct("met", "w", "y", "n_y")).alias("b")).select("x", "n_x", F.col("b.y").alias("y"), F.col("b.n_y").alias("n_y"))
    links = _verified(best, sets, how).select(F.col("x").alias("a"), F.col("y").alias("b"))

    first = components(links).withColumnRenamed("node", "sid")
    open_rows = _mixed(keys, first)
    joined = components(_across_small(open_rows, sets, how).unionByName(_across_large(open_rows, sets, how))).select(F.col("node").alias("comp"), F.col("root").alias("joined"))
    found = classes.select("sid").join(first, "sid", "left").withColumn("comp", F.coalesce("root", "sid")).drop("root")
    found = cut(found.join(joined, "comp", "left").select("sid", F.coalesce("joined", "comp").alias("root")))
    named = found.join(classes.select("sid", "least"), "sid").groupBy("root").agg(F.min("least").alias("component_id"))
    heads = classes.select(F.col("sid").alias("root"), F.col("digest").alias("component"))
    placed = found.join(named, "root").join(heads, "root").select("sid", "component_id", "component")
    linked = classes.select("sid", "digest").join(placed, "sid").select("digest", "component_id", "component")
    filled = signed.where("n > 0").drop("small").join(linked, "digest").select("doc_id", "text_md5", F.col("n").alias("n_shingles"), "component_id", "component")
    blank = signed.where("n = 0").select("doc_id", "text_md5", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.unhex(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))).alias("component"))
    return filled.unionByName(blank).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
