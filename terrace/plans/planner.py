"""The maintenance plan: what separates a catalogue from its scheme, as tables of operations and findings.

The plan is made level by level of the scheme (at most five), never partition by
partition: at each level all parents of the tree are compared with what the scheme
wants of them by joins.  Nothing is written and nothing is collected here.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.errors import ConfigError
from terrace.functions.axis import Axis, TimeAxis
from terrace.functions.names import SEPARATOR, is_addressable, label_of, name_fits
from terrace.plans.policy import CreateAhead, CreateNextIf, DropAfter, Lifecycle, keep_counts
from terrace.plans.scheme import Hash, Level, List, Range, SlidingList, Table
from terrace.sources.catalogue import hash_coverage, overlaps

# Modes, reasons and severities.
MAINTAIN, RECONCILE, EXPLICIT = "maintain", "reconcile", "explicit"
REASONS = (
    "create_ahead", "create_until", "create_next", "explicit", "subtree", "hash_gap", "hash_gap_historical_modulus", "list_group_missing",
    "list_default_missing", "reattach", "retention_expired", "detach_finalize", "follows_detach", "grace_elapsed",
)
FINDING_REASONS = (
    "legacy_leaf", "strategy_mismatch", "column_mismatch", "modulus_preserved", "modulus_repaired", "non_uniform_complete", "non_uniform_incomplete",
    "coverage_unknown", "list_values_conflict", "name_unusable", "default_holds_rows", "unconvergeable", "range_overlap", "unmanaged_partition",
    "unreadable_bound", "unbounded_partition", "foreign_partition", "detach_pending", "grace_pending", "drop_deferred", "unattached_rows", "rows_in_default",
)
INFO = (
    "legacy_leaf", "modulus_preserved", "modulus_repaired", "non_uniform_complete", "unmanaged_partition", "unbounded_partition", "foreign_partition", "detach_pending",
    "grace_pending", "drop_deferred",
)
PHASES = ("create", "attach", "detach", "drop")

OPERATION = (
    "kind", "depth", "target", "parent_name", "reason", "counts_as", "bound", "pos_start", "pos_end", "values", "includes_null", "modulus", "remainder",
    "mode", "follows_detach", "detached_at", "size_bytes", "row_estimate",
)
_TYPES = {
    "depth": "int", "pos_start": "bigint", "pos_end": "bigint", "values": "array<string>", "includes_null": "boolean", "modulus": "int", "remainder": "int",
    "follows_detach": "boolean", "detached_at": "bigint", "size_bytes": "bigint", "row_estimate": "bigint",
}


@dataclass(frozen=True)
class Context:
    """``now`` in microseconds; the cursor of each integer axis by column; in explicit mode the ordinals asked for, by column."""

    now: int
    cursors: Mapping[str, int] = field(default_factory=dict)
    mode: str = MAINTAIN
    explicit: Mapping[str, tuple[int, ...]] = field(default_factory=dict)
    default_earliest: int | None = None


@dataclass(frozen=True)
class Plan:
    operations: DataFrame
    findings: DataFrame
    table: str
    fingerprint: str
    now: int

    def ordered(self) -> DataFrame:
        """Operations in an order that is safe to follow."""
        phase = F.array_position(F.array(*map(F.lit, PHASES)), F.col("kind"))
        return self.operations.orderBy(phase, "depth", "parent_name", "pos_start", "remainder", "target")

    def without(self, *kinds: str) -> DataFrame:
        """Operations of other kinds; without detaches there are no drops that follow one either."""
        out = self.operations.where(~F.col("kind").isin(*kinds))
        return out.where(~F.coalesce("follows_detach", F.lit(False))) if "detach" in kinds else out

    def only(self, *kinds: str) -> DataFrame:
        return self.without(*[k for k in PHASES if k not in kinds])

    def actionable(self) -> DataFrame:
        return self.findings.where("severity = 'warning'")


#: A catalogue's part of up to so many rows (about 10 MB) is passed on as a local table; a larger one stays on the executors.
LOCAL_ROWS = 50_000


def held(df: DataFrame) -> DataFrame:
    """An intermediate table worked out once, with its lineage cut and its size known.

    Few rows come to the driver and go on as a local table, which makes the many small
    joins of a plan cheap; more than :data:`LOCAL_ROWS` are kept on the executors.
    """
    rows = df.limit(LOCAL_ROWS + 1).toArrow()
    if rows.num_rows <= LOCAL_ROWS:
        return df.sparkSession.createDataFrame(rows, df.schema)
    df = df.persist()
    df.count()
    return df


def severity(reason: Column) -> Column:
    return F.when(reason.isin(*INFO), "info").otherwise("warning")


def on_grid(axis: Axis, start: Column, end: Column) -> Column:
    """A window of the grid, or inside one."""
    o = axis.ordinal(start)
    return F.coalesce((axis.start(o) <= start) & (end <= axis.end(o)), F.lit(False))


def _shaped(df: DataFrame, **values: Column | str | int | bool | None) -> DataFrame:
    """The columns of an operation: those of ``df`` by name, ``values`` over them, null for the rest."""
    made = {k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()}
    return df.select(*[(made.get(c) if c in made else F.col(c) if c in df.columns else F.lit(None)).cast(_TYPES.get(c, "string")).alias(c) for c in OPERATION])


class _Planner:
    def __init__(self, table: Table, nodes: DataFrame, orphans: DataFrame, unattached: DataFrame | None, facts: DataFrame | None, ctx: Context) -> None:
        self.table, self.ctx, self.policy = table, ctx, table.lifecycle or Lifecycle()
        self.orphans, self.unattached = held(orphans), unattached
        known = facts.select("name", "size_bytes", "row_estimate", "referenced", "predicates") if facts is not None else None
        blank = {"size_bytes": "bigint", "row_estimate": "bigint", "referenced": "boolean", "predicates": "map<string,boolean>"}
        self.measured = lambda df: df.join(known, "name", "left") if known is not None else df.withColumns({k: F.lit(None).cast(t) for k, t in blank.items()})
        self.nodes = held(nodes)
        self.operations: list[DataFrame] = []
        self.findings: list[DataFrame] = []

    def owns(self) -> Column:
        return (F.col("relkind") == "table") | (F.col("relkind") == "partitioned") | ((F.col("relkind") == "foreign") & F.lit(self.table.foreign_leaves))

    def note(self, df: DataFrame, name: str, reason: Column | str, detail: Column | None = None) -> None:
        why = reason if isinstance(reason, Column) else F.lit(reason)
        self.findings.append(df.select(F.col(name).alias("partition_name"), why.alias("reason"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail")))

    def run(self) -> Plan:
        levels = self.table.scheme.walk()
        parents = self.nodes.where(F.col("name") == self.table.name).select("name")
        for depth, level in enumerate(levels):
            parents = self.fit(level, parents)
            if isinstance(level, Hash):
                parents = self.hash_level(level, parents, depth)
            elif isinstance(level, List):
                parents = self.list_level(level, parents, depth)
            else:
                parents = self.progression(level, parents, depth)
        self.strays()
        blank = self.nodes.where(F.lit(False)).select(F.col("name").alias("partition_name"), F.col("name").alias("reason"), F.col("name").alias("detail"))
        self.findings.append(blank)
        self.operations.append(_shaped(blank, kind="create"))
        operations = reduce(DataFrame.unionByName, self.operations)
        findings = reduce(DataFrame.unionByName, self.findings).withColumn("severity", severity(F.col("reason")))
        return Plan(operations, findings, self.table.name, self.table.fingerprint, self.ctx.now)

    # --- what a node can hold -----------------------------------------------------------------------------------------

    def fit(self, level: Level, parents: DataFrame) -> DataFrame:
        """The parents that can hold the level; findings for the others."""
        parents = held(parents)
        rows = self.nodes.join(parents, "name", "left_semi")
        hidden = self.nodes.where(~is_addressable(F.col("name"))).select(F.col("parent_name").alias("name"), F.lit(True).alias("hidden")).distinct()
        rows = rows.join(hidden, "name", "left")
        columns = F.array(*map(F.lit, level.columns))
        why = (
            F.when(F.col("hidden"), "coverage_unknown")
            .when(F.col("relkind") == "foreign", "foreign_partition")
            .when(F.col("partition_type").isNull(), "legacy_leaf")
            .when(F.col("partition_type") != level.method, "strategy_mismatch")
            .when(F.coalesce("has_expression_key", F.lit(False)) | ~F.col("partition_columns").eqNullSafe(columns), "column_mismatch")
        )
        rows = held(rows.withColumn("why", why))
        self.note(rows.where("why is not null"), "name", F.col("why"))
        return rows.where("why is null").select("name")

    # --- progression levels -------------------------------------------------------------------------------------------

    def cursor(self, level: Range | SlidingList, parents: DataFrame, managed: DataFrame) -> DataFrame:
        """parents(name, cursor_ord)."""
        axis = level.progression
        if isinstance(level, SlidingList):
            newest = managed.groupBy(F.col("parent_name").alias("name")).agg(F.max("pos_start").alias("newest"))
            return parents.join(newest, "name", "left").select("name", F.coalesce("newest", F.lit(level.first)).cast("long").alias("cursor_ord"))
        at = self.ctx.now if isinstance(axis, TimeAxis) else self.ctx.cursors.get(level.column, axis.origin)
        return parents.withColumn("cursor_ord", F.lit(axis.ordinal_at(at)).cast("long"))

    def judged(self, df: DataFrame, axis: Axis) -> DataFrame:
        """What rules look at besides facts: axis, now, cursor_start, keep_from."""
        kept = keep_counts(self.policy.retention) or 1
        return df.withColumns(
            {"axis": F.lit(axis.kind), "now": F.lit(self.ctx.now).cast("long"), "cursor_start": axis.start(F.col("cursor_ord")), "keep_from": axis.start(F.col("cursor_ord") - (kept - 1))}
        )

    def members(self, level: Range | SlidingList, parents: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
        """(members with status and window, windows that are half detached)."""
        rows = self.nodes.join(parents.select(F.col("name").alias("parent_name")), "parent_name", "left_semi").where(F.col("kind") == level.method)
        pending = rows.where(F.coalesce("detach_pending", F.lit(False)))
        self.note(pending, "name", "detach_pending")
        if self.ctx.mode == MAINTAIN:
            self.operations.append(_shaped(pending, kind="detach", depth=depth, target=F.col("name"), reason="detach_finalize", mode=self.policy.detach, bound=level.method))
        rows = rows.where(~F.coalesce("detach_pending", F.lit(False)))
        foreign = (F.col("relkind") == "foreign") & ~self.owns()
        if isinstance(level, SlidingList):
            value = F.when((F.size("values") == 1) & ~F.coalesce("includes_null", F.lit(False)), F.try_element_at("values", F.lit(1)).try_cast("long"))
            as_window = lambda df: df.withColumns({"pos_start": value, "pos_end": value + 1})
            rows, pending = as_window(rows), as_window(pending)
            status = F.when(foreign, "foreign_partition").when(F.col("pos_start").isNull(), "unmanaged_partition").otherwise("managed")
            claimed = F.transform("values", lambda v: v.try_cast("long"))
            rows = rows.withColumns({"status": status, "claimed": claimed})
        else:
            open_low, open_high = F.upper("from_value").isin("MINVALUE", "-INFINITY"), F.upper("to_value").isin("MAXVALUE", "INFINITY")
            unread = (~open_low & F.col("pos_start").isNull()) | (~open_high & F.col("pos_end").isNull())
            status = (
                F.when(foreign, "foreign_partition")
                .when(unread, "unreadable_bound")
                .when(open_low | open_high, "unbounded_partition")
                .when(on_grid(level.progression, F.col("pos_start"), F.col("pos_end")), "managed")
                .otherwise("unmanaged_partition")
            )
            rows = rows.withColumn("status", F.coalesce(status, F.lit("unreadable_bound")))
        self.note(rows.where("status != 'managed'"), "name", F.col("status"))
        return held(rows), pending.select("parent_name", "pos_start", "pos_end")

    def desired(self, level: Range | SlidingList, cursors: DataFrame, managed: DataFrame) -> DataFrame:
        """(parent_name, ord, pos_start, pos_end) of all windows that should be."""
        axis, ctx = level.progression, self.ctx
        if ctx.mode == RECONCILE:
            wanted = cursors.where(F.lit(False)).select("name", "cursor_ord", F.col("cursor_ord").alias("ord"))
        elif ctx.mode == EXPLICIT:
            asked = F.array(*[F.lit(o).cast("long") for o in ctx.explicit.get(level.column, ())]).cast("array<bigint>")
            wanted = cursors.select("name", "cursor_ord", F.explode(asked).alias("ord"))
        else:
            creation = self.policy.creation
            if isinstance(level, SlidingList) and isinstance(creation, CreateAhead):
                raise ConfigError("a sliding list cannot create ahead: its cursor is its newest partition")
            wanted = cursors.select("name", "cursor_ord", F.explode(F.sequence("cursor_ord", creation.last(axis, F.col("cursor_ord")))).alias("ord"))
            if isinstance(creation, CreateNextIf):
                newest = managed.groupBy("parent_name").agg(F.max_by("name", "pos_start").alias("name"), F.max("pos_start").alias("pos_start"), F.max_by("pos_end", "pos_start").alias("pos_end"))
                judged = self.judged(self.measured(newest).join(cursors.select(F.col("name").alias("parent_name"), "cursor_ord"), "parent_name"), axis)
                following = judged.where(creation.when.holds()).select(F.col("parent_name").alias("name"), "cursor_ord", (axis.ordinal(F.col("pos_start")) + 1).alias("ord"))
                wanted = wanted.unionByName(following)
        wanted = wanted.distinct()
        return wanted.select(F.col("name").alias("parent_name"), "cursor_ord", "ord", axis.start(F.col("ord")).alias("pos_start"), axis.end(F.col("ord")).alias("pos_end"))

    def progression(self, level: Range | SlidingList, parents: DataFrame, depth: int) -> DataFrame:
        axis, ctx, policy = level.progression, self.ctx, self.policy
        window = ["parent_name", "pos_start", "pos_end"]
        rows, pending = self.members(level, parents, depth)
        managed = rows.where("status = 'managed'")
        cursors = self.cursor(level, parents, managed)
        wanted = held(self.desired(level, cursors, managed))
        orphans = self.orphans.join(parents.select(F.col("name").alias("parent_name")), "parent_name", "left_semi")
        parsed = axis.parse(label_of(F.col("parent_name"), F.col("name")))
        orphans = orphans.withColumn("ord", parsed).withColumns({"pos_start": axis.start(F.col("ord")), "pos_end": axis.end(F.col("ord"))})
        owned = orphans.where(self.owns() & F.col("ord").isNotNull())
        owned = owned.withColumn("turn", F.row_number().over(Window.partitionBy("parent_name", "ord").orderBy("name")))
        restore = isinstance(policy.drop, DropAfter)

        # Wanted windows that nothing holds: blocked by others, restored from an orphan, or created.
        lacking = wanted.join(pending, window, "left_anti").join(rows.select(window), window, "left_anti")
        other = rows.where("status != 'unreadable_bound'")
        if isinstance(level, SlidingList):
            taken = rows.select("parent_name", "name", F.explode("claimed").alias("pos_start"))
            blocked = lacking.join(taken, ["parent_name", "pos_start"]).groupBy("parent_name", "ord").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))
        else:
            spans = other.select(F.col("parent_name").alias("p"), "name", F.col("pos_start").alias("s"), F.col("pos_end").alias("e"))
            hit = lacking.join(spans, (F.col("parent_name") == F.col("p")) & overlaps(F.col("pos_start"), F.col("pos_end"), F.col("s"), F.col("e")))
            blocked = hit.groupBy("parent_name", "ord").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))
        blocked = held(blocked)
        self.note(blocked, "parent_name", "range_overlap", F.concat(axis.label(F.col("ord")), F.lit(": "), F.col("names")))
        free = lacking.join(blocked.select("parent_name", "ord"), ["parent_name", "ord"], "left_anti")
        first = owned.where("turn = 1")
        free = held(free)
        back = held(first.join(free.select("parent_name", "ord"), ["parent_name", "ord"], "left_semi"))
        if restore:
            self.operations.append(_shaped(back, kind="attach", depth=depth, target=F.col("name"), reason="reattach", bound=level.method))
        else:
            self.note(back, "parent_name", "name_unusable", F.col("name"))
        new = free.join(back.select("parent_name", "ord"), ["parent_name", "ord"], "left_anti")
        reason = "explicit" if ctx.mode == EXPLICIT else policy.creation.reason
        new = new.withColumn("target", F.concat("parent_name", F.lit(SEPARATOR), axis.label(F.col("ord"))))
        extra = {"values": F.array(F.col("pos_start").cast("string")), "includes_null": F.lit(False)} if isinstance(level, SlidingList) else {}
        self.create(new.withColumns(extra), level, depth, F.lit(reason), F.lit("created"))

        staying = managed.join(wanted.select(window), window, "left_semi").select("name")
        rest = managed.join(wanted.select(window), window, "left_anti")
        if ctx.mode == EXPLICIT:
            return staying
        if ctx.mode == RECONCILE:
            return managed.select("name")

        at = cursors.select(F.col("name").alias("parent_name"), "cursor_ord")
        judged = self.judged(self.measured(rest).join(at, "parent_name"), axis).withColumn("detached_at", F.lit(self.ctx.now).cast("long"))
        expired = (F.col("pos_end") <= F.col("cursor_start")) & policy.retention.holds()
        judged = held(judged.withColumn("expired", expired))
        gone = judged.where("expired")
        has_default = self.nodes.where("kind = 'default'").select("parent_name", F.lit("blocking").alias("forced")).distinct()
        detached = gone.join(has_default, "parent_name", "left")
        mode = F.coalesce("forced", F.lit("auto")) if policy.detach == "auto" else F.lit(policy.detach)
        self.operations.append(_shaped(detached.drop("detached_at"), kind="detach", depth=depth, target=F.col("name"), reason="retention_expired", mode=mode, bound=level.method))
        if restore:
            now_too = gone.where(policy.drop.elapsed() & policy.drop.agreed())
            self.operations.append(_shaped(now_too.drop("detached_at"), kind="drop", depth=depth, target=F.col("name"), reason="follows_detach", follows_detach=True, bound=level.method))
        kept = judged.where("not expired").select("name")

        # Orphans that no wanted window has taken: back if retention would keep them, else to be dropped in time.
        left = orphans.join(back.select("name"), "name", "left_anti")
        if restore and not self.orphans.isEmpty():
            left = self.judged(self.measured(left).join(at, "parent_name"), axis)
            occupied = rows.where("pos_start is not null and pos_end is not null").select(window).unionByName(back.select(window))
            mine = left.where(self.owns() & F.col("ord").isNotNull()).join(occupied, window, "left_anti")
            mine = mine.where((F.col("pos_end") > F.col("cursor_start")) | ~policy.retention.holds())
            mine = mine.withColumn("turn", F.row_number().over(Window.partitionBy("parent_name", "ord").orderBy("name"))).where("turn = 1")
            mine = held(mine)
            self.operations.append(_shaped(mine, kind="attach", depth=depth, target=F.col("name"), reason="reattach", bound=level.method))
            left = left.join(mine.select("name"), "name", "left_anti")
            state = F.when(~self.owns(), "foreign_partition").when(~policy.drop.elapsed(), "grace_pending").when(~policy.drop.agreed(), "drop_deferred")
            left = left.withColumn("state", state)
            self.note(left.where("state is not null"), "name", F.col("state"))
            self.operations.append(_shaped(left.where("state is null"), kind="drop", depth=depth, target=F.col("name"), reason="grace_elapsed", follows_detach=False, bound=level.method))
        return staying.unionByName(kept)

    # --- set levels ---------------------------------------------------------------------------------------------------

    def hash_level(self, level: Hash, parents: DataFrame, depth: int) -> DataFrame:
        rows = held(self.nodes.where("kind = 'hash'").join(parents.select(F.col("name").alias("parent_name")), "parent_name", "left_semi"))
        sets = parents.join(held(hash_coverage(rows.select("parent_name", "modulus", "remainder"), "parent_name")).withColumnRenamed("parent_name", "name"), "name", "left")
        why = (
            F.when(F.col("members").isNull(), None)
            .when(F.col("modulus").isNull() & F.col("complete").isNull(), "coverage_unknown")
            .when(F.col("modulus").isNull(), F.when(F.col("complete"), "non_uniform_complete").otherwise("non_uniform_incomplete"))
            .when(F.col("modulus") == level.modulus, None)
            .otherwise(F.when(F.col("complete"), "modulus_preserved").otherwise("modulus_repaired"))
        )
        sets = held(sets.withColumn("why", why))
        self.note(sets.where("why is not null"), "name", F.col("why"))
        filled = sets.where("why is null or why = 'modulus_repaired'").select(F.col("name").alias("parent_name"), F.coalesce("modulus", F.lit(level.modulus)).alias("modulus"))
        missing = filled.select("*", F.explode(F.sequence(F.lit(0), F.col("modulus") - 1)).alias("remainder")).join(rows.select("parent_name", "modulus", "remainder"), ["parent_name", "modulus", "remainder"], "left_anti")
        missing = missing.withColumn("target", F.concat("parent_name", F.lit(SEPARATOR + "h"), F.col("remainder").cast("string")))
        reason = F.when(F.col("modulus") == level.modulus, "hash_gap").otherwise("hash_gap_historical_modulus")
        self.create(missing, level, depth, reason, F.lit("created" if depth == 0 else "repaired"))
        return rows.select("name")

    def list_level(self, level: List, parents: DataFrame, depth: int) -> DataFrame:
        rows = self.nodes.where("kind in ('list', 'default')").join(parents.select(F.col("name").alias("parent_name")), "parent_name", "left_semi")
        groups = F.array(*[F.struct(F.lit(g.name).alias("group"), F.array(*map(F.lit, g.values)).cast("array<string>").alias("values"), F.lit(g.includes_null).alias("includes_null")) for g in level.groups])
        asked = parents.select(F.col("name").alias("parent_name"), F.inline(groups)) if level.groups else None
        if asked is not None:
            asked = asked.withColumn("set", F.array_join(F.array_sort("values"), "\x00"))
            there = rows.where("kind = 'list'").select("parent_name", F.array_join(F.array_sort(F.array_distinct("values")), "\x00").alias("set")).distinct()
            lacking = asked.join(there, ["parent_name", "set"], "left_anti")
            claims = rows.where("kind = 'list'").select("parent_name", F.explode("values").alias("value"))
            clash = lacking.select("parent_name", "group", F.explode("values").alias("value")).join(claims, ["parent_name", "value"]).groupBy("parent_name", "group").agg(F.array_join(F.array_sort(F.collect_set("value")), ", ").alias("clash"))
            self.note(clash, "parent_name", "list_values_conflict", F.concat_ws(": ", "group", "clash"))
            new = lacking.join(clash.select("parent_name", "group"), ["parent_name", "group"], "left_anti").withColumn("target", F.concat("parent_name", F.lit(SEPARATOR), F.col("group")))
            self.create(new, level, depth, F.lit("list_group_missing"), F.lit("created" if depth == 0 else "repaired"))
        if level.include_default:
            bare = parents.select(F.col("name").alias("parent_name")).join(rows.where("kind = 'default'").select("parent_name"), "parent_name", "left_anti")
            bare = bare.withColumn("target", F.concat("parent_name", F.lit(SEPARATOR + level.default_name)))
            self.create(bare, level, depth, F.lit("list_default_missing"), F.lit("created" if depth == 0 else "repaired"), bound="default")
        return rows.select("name")

    # --- new partitions -----------------------------------------------------------------------------------------------

    def labels_below(self, level: Level) -> list[tuple[str, str]]:
        """(label, bound) of every partition that the scheme wants in a new parent."""
        if isinstance(level, Hash):
            return [(f"h{r}", "hash") for r in range(level.modulus)]
        if isinstance(level, List):
            return [(g.name, "list") for g in level.groups] + [(level.default_name, "default")] * level.include_default
        return []

    def below(self, parents: DataFrame, level: Level, depth: int) -> DataFrame:
        """parents(top, target) to their members at ``level``: top, target, parent_name, bounds."""
        if isinstance(level, (Range, SlidingList)):
            axis = level.progression
            if isinstance(level, SlidingList):
                cursor = level.first
            else:
                cursor = axis.ordinal_at(self.ctx.now if isinstance(axis, TimeAxis) else self.ctx.cursors.get(level.column, axis.origin))
            named = self.ctx.explicit.get(level.column)
            last = self.policy.creation.last(axis, F.lit(cursor).cast("long"))
            ords = F.array(*[F.lit(o).cast("long") for o in sorted(set(named))]) if named else F.sequence(F.lit(cursor).cast("long"), last)
            out = parents.select("top", F.col("target").alias("parent_name"), F.explode(ords).alias("ord"))
            out = out.select("top", "parent_name", F.concat("parent_name", F.lit(SEPARATOR), axis.label(F.col("ord"))).alias("target"), axis.start(F.col("ord")).alias("pos_start"), axis.end(F.col("ord")).alias("pos_end"), F.lit(level.method).alias("bound"))
            return out.withColumns({"values": F.array(F.col("pos_start").cast("string")), "includes_null": F.lit(False)}) if isinstance(level, SlidingList) else out
        found = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(bound).alias("bound")) for label, bound in self.labels_below(level)])
        out = parents.select("top", F.col("target").alias("parent_name"), F.inline(found)).withColumn("target", F.concat("parent_name", F.lit(SEPARATOR), F.col("label")))
        if isinstance(level, Hash):
            return out.withColumns({"modulus": F.lit(level.modulus), "remainder": F.expr("cast(substring(label, 2) as int)")}).drop("label")
        groups = F.create_map(*[x for g in level.groups for x in (F.lit(g.name), F.array(*map(F.lit, g.values)).cast("array<string>"))]) if level.groups else None
        nulls = [g.name for g in level.groups if g.includes_null]
        values = F.try_element_at(groups, F.col("label")) if groups is not None else F.lit(None).cast("array<string>")
        return out.withColumns({"values": values, "includes_null": F.col("label").isin(*nulls) if nulls else F.lit(False)}).drop("label")

    def create(self, new: DataFrame, level: Level, depth: int, reason: Column, counts_as: Column, bound: str | None = None) -> None:
        """Operations for ``new(parent_name, target, ...)`` with their whole subtrees; none where any name of it cannot be used."""
        taken = self.nodes.select(F.col("name").alias("target"), F.lit(True).alias("taken"))
        new = new.join(taken, "target", "left")
        bad = F.coalesce("taken", F.lit(False)) | ~name_fits(F.col("target"))
        self.note(new.where(bad), "parent_name", "name_unusable", F.col("target"))
        new = held(new.where(~bad).drop("taken"))
        if new.isEmpty():
            return
        tops = new.select(F.col("target").alias("top"), "target")
        generations, refused = [], None
        for k, lower in enumerate(level.walk()[1:], 1):
            tops = self.below(tops, lower, depth + k) if not (isinstance(lower, List) and not self.labels_below(lower)) else None
            if tops is None:  # a level without any member cannot take rows
                refused = new.select(F.col("target").alias("top"))
                break
            long = tops.where(~name_fits(F.col("target")))
            self.note(long, "parent_name", "name_unusable", F.col("target"))
            these = long.select("top").distinct()
            refused = these if refused is None else refused.unionByName(these)
            generations.append((k, tops))
        if refused is not None:
            refused = held(refused.distinct())
            self.note(refused, "top", "unconvergeable")
            new = new.join(refused.withColumnRenamed("top", "target"), "target", "left_anti")
        self.operations.append(_shaped(new, kind="create", depth=depth, reason=reason, counts_as=counts_as, bound=bound or level.method))
        for k, members in generations:
            sound = members.join(refused, "top", "left_anti")
            self.operations.append(_shaped(sound, kind="create", depth=depth + k, reason="subtree", counts_as="subtree"))

    # --- what lies outside the tree -----------------------------------------------------------------------------------

    def strays(self) -> None:
        """Rows that no query through the root sees, and rows in DEFAULT that no run would come back for."""
        root = self.table.scheme
        if not isinstance(root, Range):
            return
        axis = root.axis
        planned = reduce(DataFrame.unionByName, self.operations).where("kind = 'create'").select(F.col("target").alias("name"))
        if self.unattached is not None:
            seen = self.unattached.where("holds_rows").where(axis.parse(label_of(F.lit(self.table.name), F.col("name"))).isNotNull())
            self.note(seen.join(planned, "name", "left_anti"), "name", "unattached_rows")
        if self.ctx.default_earliest is not None:
            at = axis.ordinal_at(self.ctx.default_earliest)
            cursor = self.ctx.now if isinstance(axis, TimeAxis) else self.ctx.cursors.get(root.column)
            if cursor is None or at < axis.ordinal_at(cursor):
                default = self.nodes.where((F.col("parent_name") == self.table.name) & (F.col("kind") == "default"))
                default = default.withColumn("window", F.concat(F.lit(self.table.name + SEPARATOR), axis.label(F.lit(at).cast("long"))))
                self.note(default.join(planned.withColumnRenamed("name", "window"), "window", "left_anti"), "name", "rows_in_default", F.col("window"))


def plan(table: Table, nodes: DataFrame, orphans: DataFrame, ctx: Context, *, unattached: DataFrame | None = None, facts: DataFrame | None = None) -> Plan:
    """The operations that bring ``nodes`` to the scheme of ``table`` and findings for all that is left as it is.

    A catalogue that already fits gives no operation.
    """
    return _Planner(table, nodes, orphans, unattached, facts, ctx).run()


def fact_targets(table: Table, nodes: DataFrame) -> DataFrame:
    """The partitions that rules judge: those of progression levels, not every leaf under them."""
    levels = table.scheme.walk()
    parents, out = nodes.where(F.col("name") == table.name).select("name"), None
    for level in levels:
        rows = nodes.join(parents.select(F.col("name").alias("parent_name")), "parent_name", "left_semi").select("name")
        if level.progression is not None:
            out = rows if out is None else out.unionByName(rows)
        parents = rows
    return out if out is not None else parents.limit(0)
