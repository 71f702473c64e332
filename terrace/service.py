"""The lifecycle of a stored table: inspect, plan, apply, maintain, move rows in and out."""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrace.errors import ConfigError, HookFailed, PlanStale
from terrace.functions.axis import TimeAxis, instant_of, micros
from terrace.functions.names import SEPARATOR, label_of
from terrace.hooks import Hooks
from terrace.operators import mover
from terrace.operators.pruning import implied
from terrace.operators.routing import DEFAULT, level_columns, route
from terrace.plans import planner
from terrace.plans.planner import EXPLICIT, MAINTAIN, RECONCILE, Context, Plan
from terrace.plans.policy import SqlPredicate, is_closed, rules_of
from terrace.plans.scheme import List, Range, Table
from terrace.sources.catalogue import listing
from terrace.sources.store import ATTACHED, DETACHED, Lock, Store, merged


@dataclass
class Result:
    """What a run did; ``issues`` has what it could not do and why."""

    created: int = 0
    repaired: int = 0
    attached: int = 0
    detached: int = 0
    dropped: int = 0
    issues: list[dict] = field(default_factory=list)
    findings: list[dict] = field(default_factory=list)
    seconds: float = 0.0


@dataclass
class Moved:
    rows: int = 0
    batches: int = 0
    partitions: list[str] = field(default_factory=list)
    complete: bool = True
    by_window: dict[str, int] = field(default_factory=dict)
    issues: list[dict] = field(default_factory=list)


class LifecycleService:
    """Operations on one table below ``root``."""

    def __init__(
        self, spark: SparkSession, root: str, table: Table, schema: StructType, hooks: Hooks | None = None, *,
        referencing: Iterable[tuple[DataFrame, Mapping[str, str]]] = (), options: Mapping[str, str] | None = None,
    ) -> None:
        """``referencing``: rows that refer to this table's, each with {our column: theirs}; ``options``: of the Parquet writer."""
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.table, self.hooks, self.referencing = spark, table, hooks or Hooks(), tuple(referencing)
        self.store = Store(spark, root, table.name, schema, tuple((options or {}).items()))
        for level in table.scheme.walk():
            if missing := set(level.columns) - set(schema.fieldNames()):
                raise ConfigError(f"{table.name} has no column {sorted(missing)}")

    # --- setting up and writing ---------------------------------------------------------------------------------------

    def initialise(self, default: bool = True) -> None:
        """An empty table: its root and, if wanted, a DEFAULT partition.  Nothing happens to one that exists."""
        if self.store.version:
            return
        level = self.table.scheme
        root = {"name": self.table.name, "relkind": "partitioned", "partition_type": level.method, "partition_columns": list(level.columns), "state": ATTACHED}
        rows = [root] + [{"name": self.default_name, "parent_name": self.table.name, "kind": "default", "relkind": "table", "state": ATTACHED, "folders": []}] * default
        self.store.publish(self._entries(rows), 0)

    @property
    def default_name(self) -> str:
        root = self.table.scheme
        return f"{self.table.name}{SEPARATOR}{root.default_name if isinstance(root, List) else DEFAULT}"

    def _entries(self, rows: list[dict]) -> DataFrame:
        names = self.store.entries(0).schema
        return self.spark.createDataFrame([tuple(r.get(f.name) for f in names.fields) for r in rows], names)

    def append(self, df: DataFrame) -> int:
        """Write rows to the leaves that exist, all others to DEFAULT, and publish them together.  The new version.

        Where another writer publishes first, the staged files are published on top of
        its version, or staged anew if the leaves are no longer the same.
        """
        staged, home, routed_to = None, f"{self.table.name}{SEPARATOR}{DEFAULT}", None
        while True:
            before = self.store.version
            known = self.store.entries(before).where("folders is not null and state = 'attached'").select(F.col("name").alias("partition"))
            leaves = known.agg(F.count("*"), F.sum(F.xxhash64("partition").cast("decimal(38,0)"))).first()
            if staged is None or leaves != routed_to:
                self.store.drop_folders(list((staged or {}).values()))
                routed = route(df, self.table.scheme, table=self.table.name, known=known)
                staged = self.store.stage(routed.withColumn("partition", F.when(F.col("partition") == home, self.default_name).otherwise(F.col("partition"))), "partition")
                routed_to = leaves
            try:
                return self._published(staged, before)
            except PlanStale:
                if self.store.version == before:
                    raise

    def _published(self, staged: Mapping[str, str], before: int) -> int:
        entries = self.store.entries(before)
        new = self.spark.createDataFrame([(n, f) for n, f in staged.items()] or [("", "")], "name string, folder string")
        joined = entries.join(F.broadcast(new), "name", "left")  # a row a leaf that was written to
        return self.store.publish(joined.withColumn("folders", F.when(F.col("folder").isNotNull(), F.array_append(F.coalesce("folders", F.array().cast("array<string>")), F.col("folder"))).otherwise(F.col("folders"))).drop("folder"), before)

    def read(self) -> DataFrame:
        return self.store.read()

    def get_partitions_for_pruning(self, ranges: Mapping[str, tuple[int | None, int | None]] | None = None, equal: Mapping[str, object] | None = None) -> DataFrame:
        """The leaves that can hold rows of these key ranges and values."""
        names = level_columns(self.table.scheme)
        leaves = self.store.entries().where("folders is not null and state = 'attached'").select("name", "kind")
        labels = F.split(label_of(F.lit(self.table.name), F.col("name")), SEPARATOR)
        for k, n in enumerate(names):
            leaves = leaves.withColumn(n, F.coalesce(F.get(labels, F.lit(k)), F.lit(DEFAULT)))
        leaves = leaves.withColumn(names[0], F.when(F.col("kind") == "default", F.lit(DEFAULT)).otherwise(F.col(names[0])))
        return leaves.where(implied(self.table.scheme, ranges, equal)).select("name")

    # --- planning -----------------------------------------------------------------------------------------------------

    def inspect(self) -> DataFrame:
        return self.store.entries()

    def validate(self) -> None:
        """The stored root is partitioned as the scheme says; ConfigError if not."""
        root = self.store.nodes().where(F.col("name") == self.table.name).first()
        level = self.table.scheme
        if root is None:
            raise ConfigError(f"{self.table.name} does not exist")
        if (root.partition_type, tuple(root.partition_columns)) != (level.method, level.columns):
            raise ConfigError(f"{self.table.name} is partitioned by {root.partition_type} ({', '.join(root.partition_columns)})")

    def list_partitions(self) -> DataFrame:
        """Direct partitions and this table's orphans."""
        return listing(self.store.nodes(), self.store.orphans(), self.table.name)

    def is_partition_closed(self, name: str, now: dt.datetime, settle: dt.timedelta = dt.timedelta(0)) -> bool:
        """Whether no more rows are due; false for DEFAULT, open-ended, detached and unknown partitions."""
        row = self.store.nodes().where(F.col("name") == name).select(F.lit(micros(now)).alias("now"), "pos_end").select(is_closed(settle)).first()
        return bool(row and row[0])

    def measure(self, wanted: frozenset[str] | None = None) -> DataFrame | None:
        """Facts of the partitions that rules judge, and only those that rules need.

        Sizes, row counts and references are worked out for all partitions in one
        pass.  A query of a rule is arbitrary, so it runs once for each partition.
        """
        wanted = (self.table.lifecycle.facts if self.table.lifecycle else frozenset()) if wanted is None else wanted
        if not wanted:
            return None
        top = F.concat(F.lit(self.table.name + SEPARATOR), F.col("p0"))
        routed = route(self.store.read(self.table.name), self.table.scheme).withColumn("name", top)
        size = F.octet_length(F.to_json(F.struct(*[f.name for f in self.store.schema.fields])))
        facts = routed.groupBy("name").agg(F.sum(size).alias("size_bytes"), F.count("*").alias("row_estimate"))
        used = [mover.referenced(routed, rows, keys, "name") for rows, keys in self.referencing]
        if used:
            facts = facts.join(merged(used).distinct(), "name", "left").withColumn("referenced", F.coalesce("referenced", F.lit(False)))
        else:
            facts = facts.withColumn("referenced", F.lit(None).cast("boolean"))
        answers = self._answers([r for r in rules_of(self.table.lifecycle) if isinstance(r, SqlPredicate)])
        return facts.join(answers, "name", "left").select("name", "size_bytes", "row_estimate", "referenced", "predicates")

    def _answers(self, predicates: list[SqlPredicate], together: int = 50) -> DataFrame:
        """What each predicate says of each partition; one statement asks about ``together`` partitions."""
        kinds = "name string, predicates map<string,boolean>"
        names = [r.name for r in self.store.entries().where((F.col("parent_name") == self.table.name) & (F.col("kind") != "default")).select("name").collect()] if predicates else []
        found = [self.spark.createDataFrame([], kinds)]
        for at in range(0, len(names), together):
            views: list[str] = []
            try:
                asked = []
                for name in names[at : at + together]:
                    views.append(f"terrace_{uuid.uuid4().hex}")
                    self.store.read(name).createOrReplaceTempView(views[-1])
                    answers = ", ".join(f"'{p.id}', CAST(({p.sql.replace('{partition}', views[-1])}) AS BOOLEAN)" for p in predicates)
                    asked.append(f"SELECT '{name}' AS name, map({answers}) AS predicates")
                rows = self.spark.sql(" UNION ALL ".join(asked)).collect()  # a row a partition
            finally:
                for view in views:
                    self.spark.catalog.dropTempView(view)
            found.append(self.spark.createDataFrame([(r.name, {k: bool(v) for k, v in r.predicates.items()}) for r in rows], kinds))
        return merged(found)

    def cursors(self) -> dict[str, int]:
        """The largest key of each integer axis."""
        columns = [level.column for level in self.table.scheme.walk() if isinstance(level, Range) and not isinstance(level.axis, TimeAxis)]
        if not columns:
            return {}
        top = self.store.read().agg(*[F.max(c).alias(c) for c in columns]).first()
        return {c: int(top[c]) for c in columns if top[c] is not None}

    def plan(self, now: dt.datetime, mode: str = MAINTAIN, explicit: Mapping[str, Iterable[int]] | None = None) -> Plan:
        root, earliest = self.table.scheme, None
        if isinstance(root, Range) and mode != EXPLICIT:
            earliest = mover.earliest(self.store.read(self.default_name), root).first()[0]
        context = Context(micros(now), self.cursors(), mode, {k: tuple(v) for k, v in (explicit or {}).items()}, earliest)
        return planner.plan(self.table, self.store.nodes(), self.store.orphans(), context, facts=self.measure())

    # --- applying -----------------------------------------------------------------------------------------------------

    def apply(self, plan: Plan, *, destructive: bool = True, continue_on_error: bool = True) -> Result:
        """Follow a plan in order and publish one version; an operation that fails is left out and reported.

        A hook that fails after its operation is reported too, but the operation stays.
        """
        return self._applied(plan, destructive, continue_on_error)[0]

    def _applied(self, plan: Plan, destructive: bool = True, continue_on_error: bool = True, eligible: Column | None = None, lock: Lock | None = None) -> tuple[Result, Moved]:
        """With ``eligible``, just those rows of DEFAULT move, to new and old partitions; without, all rows that new ones take."""
        if plan.fingerprint != self.table.fingerprint or plan.table != self.table.name:
            raise PlanStale("the plan was made for another configuration")
        began, result, before = time.time(), Result(), self.store.version
        result.findings = [r.asDict() for r in plan.findings.collect()]
        operations = (plan.ordered() if destructive else Plan(plan.without("detach", "drop"), plan.findings, plan.table, plan.fingerprint, plan.now).ordered()).collect()
        if not operations and eligible is None:
            result.seconds = time.time() - began
            return result, Moved()
        entries = {r.name: r.asDict(True) for r in self.store.entries(before).collect()}  # a row a relation
        skipped: set[str] = set()
        garbage: list[str] = []
        made: list[str] = []
        for op in (o.asDict(True) for o in operations):
            event = {"table": self.table.name, "operation": op["kind"], "partition": op["target"], "reason": op["reason"], "pos_start": op["pos_start"], "pos_end": op["pos_end"]}
            try:
                if op["parent_name"] in skipped or (op["follows_detach"] and op["target"] in skipped):
                    raise HookFailed("what it depends on was not done")
                if op["kind"] in ("detach", "drop", "attach") and op["target"] not in entries:
                    raise PlanStale(f"{op['target']} is gone")
                if op["counts_as"] != "subtree":
                    self.hooks.fire(f"before_{op['kind']}", event)
                getattr(self, f"_{op['kind']}")(op, entries, plan.now, garbage)
            except Exception as e:  # whatever went wrong concerns this operation and those that depend on it
                skipped.add(op["target"])
                if op["counts_as"] == "subtree" and op["parent_name"] in skipped:
                    continue  # reported with the partition that it is a part of
                result.issues.append({"step": op["kind"], "partition": op["target"], "error": str(e)})
                if not continue_on_error:
                    break
                continue
            if op["kind"] in ("create", "attach"):
                made.append(op["target"])
            counter = {"create": op["counts_as"], "attach": "attached", "detach": "detached", "drop": "dropped"}[op["kind"]]
            if counter in ("created", "repaired", "attached", "detached", "dropped"):
                setattr(result, counter, getattr(result, counter) + 1)
            if op["counts_as"] != "subtree":
                try:
                    self.hooks.fire(f"after_{op['kind']}", event)
                except HookFailed as e:
                    result.issues.append({"step": f"after_{op['kind']}", "partition": op["target"], "error": str(e)})
            if lock and time.time() - began > lock.patience / 4:
                lock.renew()
        moved = self._filled(entries, made if eligible is None else None, garbage, eligible)
        if lock:
            lock.renew()
        self.store.publish(self._entries(list(entries.values())), before)
        self.store.drop_folders(garbage)
        result.seconds = time.time() - began
        return result, moved

    def _create(self, op: dict, entries: dict[str, dict], now: int, garbage: list[str]) -> None:
        if op["target"] in entries:
            raise PlanStale(f"{op['target']} exists")
        levels = self.table.scheme.walk()
        below = levels[op["depth"] + 1] if op["depth"] + 1 < len(levels) and op["bound"] != "" else None
        level = levels[op["depth"]]
        literal = (lambda p: None if p is None else str(instant_of(p)) if isinstance(level.progression, TimeAxis) else str(p)) if isinstance(level, Range) else (lambda p: None)
        entries[op["target"]] = {
            "name": op["target"], "parent_name": op["parent_name"], "kind": op["bound"], "from_value": literal(op["pos_start"]), "to_value": literal(op["pos_end"]), "values": op["values"],
            "includes_null": op["includes_null"], "modulus": op["modulus"], "remainder": op["remainder"], "pos_start": op["pos_start"] if op["bound"] == "range" else None, "pos_end": op["pos_end"] if op["bound"] == "range" else None,
            "relkind": "partitioned" if below else "table", "partition_type": below.method if below else None, "partition_columns": list(below.columns) if below else None, "state": ATTACHED, "folders": None if below else [],
        }

    @staticmethod
    def _below(name: str, entries: dict[str, dict]) -> list[dict]:
        return [e for n, e in entries.items() if n == name or n.startswith(name + SEPARATOR)]

    def _attach(self, op: dict, entries: dict[str, dict], now: int, garbage: list[str]) -> None:
        for e in self._below(op["target"], entries):
            e.update(state=ATTACHED, detached_at=None)

    def _detach(self, op: dict, entries: dict[str, dict], now: int, garbage: list[str]) -> None:
        for e in self._below(op["target"], entries):
            e.update(state=DETACHED, detached_at=now, detach_pending=None)

    def _drop(self, op: dict, entries: dict[str, dict], now: int, garbage: list[str]) -> None:
        for e in self._below(op["target"], entries):
            if e["state"] != DETACHED:
                raise PlanStale(f"{e['name']} is attached")
            garbage += e["folders"] or []
            del entries[e["name"]]

    def _default_rows(self, folders: list[str]) -> DataFrame:
        """The rows of DEFAULT with __file and __row, which tell each from all others."""
        rows = self.spark.read.schema(self.store.schema).parquet(*[self.store.files.path(f) for f in folders])
        return rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))

    def _filled(self, entries: dict[str, dict], made: list[str] | None, garbage: list[str], eligible: Column | None = None) -> Moved:
        """Move rows of DEFAULT into partitions: all that those just ``made`` take, or the ``eligible`` ones into any; both sides are in the same version."""
        moved = Moved()
        default = entries.get(self.default_name)
        if made == [] or not default or not default["folders"]:
            return moved
        leaves = [n for n, e in entries.items() if e["state"] == ATTACHED and e["folders"] is not None and (made is None or any(n == m or n.startswith(m + SEPARATOR) for m in made))]
        known = self.spark.createDataFrame([(n,) for n in leaves] or [("",)], "partition string")
        home = f"{self.table.name}{SEPARATOR}{DEFAULT}"
        routed = route(self._default_rows(default["folders"]), self.table.scheme, table=self.table.name, known=known)
        if eligible is not None:
            routed = routed.withColumn("partition", F.when(eligible, F.col("partition")).otherwise(F.lit(home)))
        counts = {r.partition: r["count"] for r in routed.groupBy("partition").count().collect()}  # a row a partition
        if not set(counts) - {home, self.default_name}:
            return moved
        staged = self.store.stage(routed, "partition")
        garbage += default["folders"]
        default["folders"] = [staged.pop(n) for n in (home, self.default_name) if n in staged]
        for name, folder in staged.items():
            entries[name]["folders"] = [*entries[name]["folders"], folder]
            top = SEPARATOR.join(name[len(self.table.name) + len(SEPARATOR) :].split(SEPARATOR)[:1])
            moved.by_window[f"{self.table.name}{SEPARATOR}{top}"] = moved.by_window.get(f"{self.table.name}{SEPARATOR}{top}", 0) + counts[name]
            moved.rows += counts[name]
        moved.partitions = sorted(moved.by_window)
        return moved

    # --- runs ---------------------------------------------------------------------------------------------------------

    def maintain(self, now: dt.datetime, **how: bool) -> Result:
        """Plan and apply under the lock.  A half-finished detach is completed first, and the rest planned anew."""
        with self.store.lock() as lock:
            plan = self.plan(now)
            unfinished = plan.operations.where("reason = 'detach_finalize'")
            if not unfinished.isEmpty():
                self._applied(Plan(unfinished, plan.findings, plan.table, plan.fingerprint, plan.now), lock=lock, **how)
                plan = self.plan(now)
            return self._applied(plan, lock=lock, **how)[0]

    maintain_lifecycle = maintain

    def _run(self, now: dt.datetime, some: Callable[[Plan], DataFrame] | None = None, mode: str = MAINTAIN, explicit: Mapping[str, Iterable[int]] | None = None) -> Result:
        """Plan and apply, or apply ``some`` of the operations, under the lock."""
        with self.store.lock() as lock:
            plan = self.plan(now, mode, explicit)
            return self._applied(Plan(some(plan), plan.findings, plan.table, plan.fingerprint, plan.now) if some else plan, lock=lock)[0]

    def reconcile(self, now: dt.datetime) -> Result:
        return self._run(now, mode=RECONCILE)

    def ensure_partitions(self, now: dt.datetime, positions: Iterable[dt.datetime | int]) -> Result:
        """The partitions of these positions exist afterwards, subtrees included."""
        level = self.table.scheme
        if level.progression is None:
            raise ConfigError("the root has no windows")
        ordinals = sorted({level.progression.ordinal_at(micros(p) if isinstance(p, dt.datetime) else p) for p in positions})
        return self._run(now, mode=EXPLICIT, explicit={level.column: ordinals})

    def ensure_partition(self, now: dt.datetime, position: dt.datetime | int) -> Result:
        return self.ensure_partitions(now, [position])

    def create_future_partitions(self, now: dt.datetime) -> Result:
        return self._run(now, lambda plan: plan.only("create", "attach"))

    def detach_old_partitions(self, now: dt.datetime) -> Result:
        return self._run(now, lambda plan: plan.only("detach"))

    def drop_detached_partitions(self, now: dt.datetime) -> Result:
        return self._run(now, lambda plan: plan.operations.where("kind = 'drop' and not coalesce(follows_detach, false)"))

    # --- moving rows --------------------------------------------------------------------------------------------------

    def partition_data(self, now: dt.datetime, *, max_windows: int | None = None, max_batches: int | None = None, batch: int = 10_000) -> Moved:
        """Drain DEFAULT: create the windows that its rows need and move them, oldest first.

        Without a limit all windows are moved by one pass over the rows.  With
        ``max_windows``, so many of the oldest; with ``max_batches``, so many times
        ``batch`` rows, of which the last window may get a part.  A later call goes on
        from there.  ``complete`` tells whether DEFAULT has no row of any window left.
        """
        root = self.table.scheme
        if not isinstance(root, Range):
            raise ConfigError("only a RANGE root is drained by windows")
        with self.store.lock() as lock:
            default = self.store.entries().where(F.col("name") == self.default_name).first()
            if default is None or not default.folders:
                return Moved()
            at, whole = root.axis.ordinal(root.axis.position(F.col(root.column))), mover.whole_key(root)
            rows = self._default_rows(list(default.folders)).where(whole)
            windows = rows.groupBy(at.alias("o")).agg(F.count("*").alias("n")).orderBy("o").collect()  # a row a window
            take, left, part = [], max_batches, 0
            for w in windows if max_windows is None else windows[:max_windows]:
                need = -(-w.n // batch)
                if left is not None and need > left:
                    part = left * batch  # of this window; the budget is spent
                    take += [w] * (left > 0)
                    break
                take.append(w)
                left = None if left is None else left - need
            if not take:
                return Moved(complete=not windows)
            eligible = whole & ((at < take[-1].o) if part else (at <= take[-1].o))
            if part:
                eligible = eligible | (whole & (at == take[-1].o) & mover.first_rows(rows.where(at == take[-1].o), part))
            result, moved = self._applied(self.plan(now, EXPLICIT, {root.column: [w.o for w in take]}), eligible=eligible, lock=lock)
            moved.batches = sum(-(-n // batch) for n in moved.by_window.values())
            moved.complete = moved.rows == sum(w.n for w in windows)
            moved.issues = result.issues
            return moved

    def unpartition(self, path: str, *, orphans: bool = True) -> int:
        """Write all rows, those of detached partitions too, as one table; how many there are."""
        names = [self.table.name] if orphans else []
        rows = self.store.read(*names)
        rows.write.parquet(path)
        return self.spark.read.parquet(path).count()
