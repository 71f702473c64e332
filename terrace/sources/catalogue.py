"""The partition catalogue as tables: nodes, orphans, unattached tables and facts, and what is asked of them.

``nodes`` has a row per relation of the tree: name, parent_name, the bounds of
:data:`terrace.functions.bounds.BOUNDS` with their positions pos_start and pos_end
(null: open or unreadable), relkind, how it is partitioned itself, and flags.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.errors import ConfigError
from terrace.functions import bounds as B
from terrace.sources.shared import shared_folder

NODES = (
    "name string, parent_name string, kind string, from_value string, to_value string, values array<string>, includes_null boolean, modulus int, remainder int, "
    "pos_start bigint, pos_end bigint, relkind string, partition_type string, partition_columns array<string>, has_expression_key boolean, detach_pending boolean"
)
ORPHANS = "name string, parent_name string, relkind string, detached_at bigint"
UNATTACHED = "name string, relkind string, holds_rows boolean"
FACTS = "name string, size_bytes bigint, row_estimate bigint, referenced boolean, predicates map<string,boolean>"


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _levels(nodes: DataFrame, first: DataFrame, below: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """``first`` and what ``below`` makes of each level, until a level is empty; each is cut, so the plan does not grow."""
    shared_folder(first.sparkSession, "levels")  # sees that there is a folder for checkpoints
    found = [first.checkpoint()]
    while not found[-1].isEmpty():
        if len(found) > 64 and len(found) > nodes.count():
            raise ConfigError("the parents form a cycle")
        found.append(below(found[-1], len(found)).checkpoint())
    return first_of(found)


def closure(edges: DataFrame, *, name: str = "name", parent: str = "parent_name") -> DataFrame:
    """(ancestor, name, distance) of every node and each node above it, itself included: one equi-join per level, however many there are."""
    own = edges.select(F.col(name).alias("name"), F.col(parent).alias("parent"))
    up = own.select(F.col("name").alias("ancestor"), F.col("parent").alias("above")).where("above is not null")
    start = own.select(F.col("name").alias("ancestor"), "name", F.lit(0).alias("distance"))
    return _levels(own, start, lambda level, k: level.join(up, "ancestor").where("above != name").select(F.col("above").alias("ancestor"), "name", F.lit(k).alias("distance")))


def tree(edges: DataFrame, root: str | None = None, *, name: str = "name", parent: str = "parent_name") -> DataFrame:
    """(name, parent_name, level, path) of what the roots reach, to any depth; rows whose parent is missing are not in it."""
    own = edges.select(F.col(name).alias("name"), F.col(parent).alias("parent_name"))
    top = own.where(F.col("name") == root) if root is not None else own.where("parent_name is null")

    def below(level: DataFrame, k: int) -> DataFrame:
        above = level.select(F.col("name").alias("parent_name"), F.col("path").alias("above"))
        return own.join(above, "parent_name").select("name", "parent_name", F.lit(k).alias("level"), F.concat_ws("/", "above", "name").alias("path"))

    return _levels(own, top.select("name", "parent_name", F.lit(0).alias("level"), F.col("name").alias("path")), below)


def leaves(edges: DataFrame, *, name: str = "name", parent: str = "parent_name") -> DataFrame:
    parents = edges.select(F.col(parent).alias(name)).where(F.col(name).isNotNull()).distinct()
    return edges.join(parents, name, "left_anti")


def facts(edges: DataFrame, stats: DataFrame, *, sums: tuple[str, ...] = ("size_bytes", "row_estimate")) -> DataFrame:
    """Sums over the leaves under each node (a leaf counts as its own); 0 where nothing is known."""
    under = closure(edges).join(leaves(edges).select("name"), "name").join(stats, "name", "left")
    return under.groupBy(F.col("ancestor").alias("name")).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in sums])


def orphans(tables: DataFrame, edges: DataFrame, parents: list[str]) -> DataFrame:
    """Detached partitions: their marker names one of ``parents`` and they hang on nothing."""
    return tables.where(F.col("marker").isin(*parents)).join(edges.select("name"), "name", "left_anti")


def unattached(tables: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """Tables named like a partition of ``root`` without a parent and without a marker."""
    return tables.where(F.startswith("name", F.lit(root + "__")) & F.col("marker").isNull()).join(edges.select("name"), "name", "left_anti")


def children(nodes: DataFrame, parent: str) -> DataFrame:
    return nodes.where(F.col("parent_name") == parent)


def default_partition(nodes: DataFrame, root: str) -> DataFrame:
    return children(nodes, root).where("kind = 'default'").limit(1)


def listing(nodes: DataFrame, detached: DataFrame, root: str) -> DataFrame:
    """Direct partitions and this root's orphans: name, attached, kind, pos_start, pos_end, detached_at."""
    mine = children(nodes, root).select("name", F.lit(True).alias("attached"), "kind", "pos_start", "pos_end", F.lit(None).cast("long").alias("detached_at"))
    gone = detached.where(F.col("parent_name") == root).select("name", F.lit(False).alias("attached"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("pos_start"), F.lit(None).cast("long").alias("pos_end"), "detached_at")
    return mine.unionByName(gone)


def lookup(names: DataFrame, nodes: DataFrame, detached: DataFrame, strays: DataFrame) -> DataFrame:
    """What each of ``names(name)`` is: name, found (attached, detached, unattached or null), parent_name, relkind, kind and bounds.

    A name that is in several of the catalogue's tables is what the first of them
    says.  ``bounds`` is the boundary clause of an attached partition.
    """
    clause = B.render(F.struct("kind", "from_value", "to_value", "values", "includes_null", "modulus", "remainder"))
    none = F.lit(None).cast("string")
    attached = nodes.select("name", F.lit("attached").alias("found"), F.lit(1).alias("order"), "parent_name", "relkind", "kind", clause.alias("bounds"))
    gone = detached.select("name", F.lit("detached").alias("found"), F.lit(2).alias("order"), "parent_name", "relkind", none.alias("kind"), none.alias("bounds"))
    stray = strays.select("name", F.lit("unattached").alias("found"), F.lit(3).alias("order"), none.alias("parent_name"), "relkind", none.alias("kind"), none.alias("bounds"))
    told = ["found", "parent_name", "relkind", "kind", "bounds"]
    known = attached.unionByName(gone).unionByName(stray).groupBy("name").agg(F.min_by(F.struct(*told), "order").alias("is"))
    return names.select("name").distinct().join(known, "name", "left").select("name", *(F.col("is")[c].alias(c) for c in told))


# --- coverage ---------------------------------------------------------------------------------------------------------


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open intervals; a null end is open."""
    return F.coalesce(a_start < b_end, F.lit(True)) & F.coalesce(b_start < a_end, F.lit(True))


def gaps(members: DataFrame, *by: str) -> DataFrame:
    """Where consecutive members (pos_start, pos_end) leave something out: gap_start, gap_end."""
    order = Window.partitionBy(*by).orderBy("pos_start", "pos_end")
    furthest = F.max("pos_end").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return members.select(*by, furthest.alias("gap_start"), F.lead("pos_start").over(order).alias("gap_end")).where("gap_end > gap_start")


def missing_remainders(buckets: DataFrame, modulus: int) -> DataFrame:
    """The remainders 0 .. modulus-1 that no (modulus, remainder) of ``buckets`` has at that modulus."""
    want = buckets.sparkSession.range(modulus).select(F.col("id").cast("int").alias("remainder"))
    return want.join(buckets.where(F.col("modulus") == modulus).select("remainder"), "remainder", "left_anti")


def _gcd(a: Column, b: Column) -> Column:
    """Euclid's steps; forty are enough for any two numbers below 10**8."""
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], F.nullif(s["b"], F.lit(0).cast("long"))).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.struct(a.alias("a"), b.alias("b")), step, lambda s: s["a"])


def hash_coverage(buckets: DataFrame, by: str, cap: int = 65_536) -> DataFrame:
    """Per set: members, whether all have one modulus (then which), and whether the residue classes cover everything.

    A set of one modulus is complete if it has all remainders.  Of mixed ones the
    classes are counted over the least common multiple of the moduli; beyond ``cap``
    the answer is null.
    """
    sets = buckets.groupBy(by).agg(F.count("*").alias("members"), F.min("modulus").alias("low"), F.max("modulus").alias("high"), F.count_distinct("remainder").alias("remainders"))
    uniform = sets.where("low = high").select(by, "members", F.col("low").cast("int").alias("modulus"), (F.col("remainders") == F.col("low")).alias("complete"))
    mixed = buckets.join(sets.where("low != high").select(by, "members"), by)
    lcm = F.aggregate("moduli", F.lit(1).cast("long"), lambda a, m: F.when(a > cap, a).otherwise(F.call_function("div", a * m, _gcd(a, m))))
    moduli = mixed.groupBy(by).agg(F.max("members").alias("members"), F.collect_set(F.col("modulus").cast("long")).alias("moduli")).select(by, "members", lcm.alias("lcm"))
    residues = mixed.drop("members").join(moduli.where(F.col("lcm") <= cap), by).select(by, "lcm", F.explode(F.sequence(F.col("remainder").cast("long"), F.col("lcm") - 1, F.col("modulus").cast("long"))).alias("r"))
    covered = residues.groupBy(by).agg((F.count_distinct("r") == F.max("lcm")).alias("complete"))
    return uniform.unionByName(moduli.join(covered, by, "left").select(by, "members", F.lit(None).cast("int").alias("modulus"), "complete"))


def first_of(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
