"""Queries that run the lifecycle service end to end over a stored table, each with its SQL.

Every query makes a table of ``events`` (days, four buckets each) in the shared
folder, lets the service work on it and returns what is stored afterwards.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace import report
from terrace.catalogue_queries import _MONTHS_SQL, EVENT_GROUPS, NOW, _as_nodes, _candidates, _order_months, query, values
from terrace.functions.axis import FiscalAxis, NumericAxis, TimeAxis, Window, instant_of, micros
from terrace.hooks import Hooks
from terrace.operators import mover
from terrace.plans import planner, policy
from terrace.plans.scheme import Hash, Range, Table
from terrace.service import LifecycleService
from terrace.sources import catalogue as C
from terrace.sources.document import from_data
from terrace.sources.shared import shared_folder
from terrace.streaming.sink import to_table

AT = instant_of(NOW)
SCHEME = Range(("ts",), Hash(("user_id",), modulus=4), TimeAxis("day"))
RULES = policy.Lifecycle(policy.CreateAhead(3), policy.KeepNewest(5), policy.DropAfter(dt.timedelta(days=2)))
DAY_SQL = "'events__' || strftime(ts, '%Y_%m_%d')"
KEPT_FROM = "TIMESTAMP '2024-01-16'"


def stored(spark: SparkSession, df: DataFrame, name: str, *, scheme: Range = SCHEME, rules: policy.Lifecycle = RULES, **how: object) -> LifecycleService:
    """A new table with the rows of ``df``, all in DEFAULT."""
    service = LifecycleService(spark, shared_folder(spark, name), Table("events", scheme, rules), df.schema, **how)
    service.initialise()
    service.append(df)
    return service


def other_rules(service: LifecycleService, rules: policy.Lifecycle) -> LifecycleService:
    """The same stored table under another configuration."""
    return LifecycleService(service.spark, service.store.root, Table("events", service.table.scheme, rules), service.store.schema)


def by_leaf(service: LifecycleService, *names: str) -> DataFrame:
    """(partition, n): how many rows the files of each leaf hold."""
    leaf = F.regexp_extract(F.input_file_name(), "__leaf=([^/]+)/", 1)
    return service.store.read(*names).groupBy(leaf.alias("partition")).agg(F.count("*").alias("n"))


def moves(spark: SparkSession, moved: object, batch: int = 100) -> DataFrame:
    return values(spark, [(k, n, -(-n // batch)) for k, n in moved.by_window.items()], "partition string, moved long, batches long")


# --- moving rows ------------------------------------------------------------------------------------------------------


@query(f"SELECT {DAY_SQL} || '__h' || (user_id % 4) AS partition, count(*) AS n FROM events GROUP BY ALL")
def backfill_leaves(spark: SparkSession, t: Callable) -> DataFrame:
    """Where every row lies after DEFAULT has been drained."""
    service = stored(spark, t("events"), "backfill")
    service.partition_data(AT)
    return by_leaf(service)


@query(f"SELECT {DAY_SQL} AS partition, count(*) AS moved, (count(*) + 99) // 100 AS batches FROM events GROUP BY ALL")
def backfill_batches(spark: SparkSession, t: Callable) -> DataFrame:
    return moves(spark, stored(spark, t("events"), "batches").partition_data(AT, batch=100))


_BUDGET = "(SELECT count(*) // 250 FROM events)"


@query(
    f"WITH w AS (SELECT {DAY_SQL} AS partition, count(*) AS n, (count(*) + 99) // 100 AS need FROM events GROUP BY ALL), c AS (SELECT *, sum(need) OVER (ORDER BY partition) AS upto FROM w), "
    f"f AS (SELECT partition, n, CASE WHEN upto <= {_BUDGET} THEN n ELSE greatest({_BUDGET} - (upto - need), 0) * 100 END AS moved FROM c) "
    "SELECT partition, 1 AS call, CAST(moved AS BIGINT) AS moved, false AS complete FROM f WHERE moved > 0 UNION ALL SELECT partition, 2, CAST(n - moved AS BIGINT), true FROM f WHERE n > moved"
)
def backfill_budget(spark: SparkSession, t: Callable) -> DataFrame:
    """A first call with a budget of batches stops within a window; the second goes on from there."""
    service = stored(spark, t("events"), "budget")
    calls = [service.partition_data(AT, max_batches=t("events").count() // 250, batch=100), service.partition_data(AT, batch=100)]
    rows = [(k, number, n, moved.complete) for number, moved in enumerate(calls, 1) for k, n in moved.by_window.items()]
    return values(spark, rows, "partition string, call int, moved long, complete boolean")


@query(
    f"SELECT partition, count(*) AS n FROM (SELECT CASE WHEN ts < TIMESTAMP '2024-01-05' THEN {DAY_SQL} ELSE 'events__default' END AS partition FROM events) GROUP BY ALL"
)
def backfill_oldest_first(spark: SparkSession, t: Callable) -> DataFrame:
    """A budget of windows takes the oldest; the first two exist already, the others are new."""
    first = t("events").agg(F.to_date(F.min("ts")).alias("d")).first().d
    service = stored(spark, t("events"), "windows", scheme=Range(("ts",), axis=TimeAxis("day")))
    made = service.plan(AT, planner.EXPLICIT, {"ts": [TimeAxis("day").ordinal_at(micros(dt.datetime(first.year, first.month, first.day) + dt.timedelta(days=k))) for k in (0, 1)]})
    service._applied(made, eligible=F.lit(False))  # the windows appear, their rows stay in DEFAULT
    service.partition_data(AT, max_windows=(dt.date(2024, 1, 5) - first).days)
    return by_leaf(service)


@query(
    f"WITH w AS (SELECT {DAY_SQL} AS p, count(*) AS n, (count(*) + 99) // 100 AS need FROM events GROUP BY ALL) "
    "SELECT 'terrace_moved_rows{table=\"events\"} ' || sum(n) AS line FROM w UNION ALL SELECT 'terrace_moved_batches{table=\"events\"} ' || sum(need) FROM w UNION ALL SELECT 'terrace_moved_partitions{table=\"events\"} ' || count(*) FROM w"
)
def backfill_metrics(spark: SparkSession, t: Callable) -> DataFrame:
    return report.move_metrics(moves(spark, stored(spark, t("events"), "metrics").partition_data(AT, batch=100)), "events")


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events WHERE ts >= TIMESTAMP '2024-01-08 00:00:00' AND ts < TIMESTAMP '2024-01-09 00:00:00' AND event_id % 7 <> 0")
def row_window(spark: SparkSession, t: Callable) -> DataFrame:
    """The rows of one window with a whole key."""
    df = t("events").withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    day = mover.in_window(df, Range(("ts", "value"), axis=TimeAxis("day")), micros(dt.datetime(2024, 1, 8)), micros(dt.datetime(2024, 1, 9)))
    return day.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events")
def unpartition_all(spark: SparkSession, t: Callable) -> DataFrame:
    """All rows of a table with attached, detached and DEFAULT partitions as one table."""
    service = stored(spark, t("events"), "flat")
    service.partition_data(AT, max_windows=6)
    service.maintain(AT)
    path = shared_folder(spark, "flat-out")
    service.unpartition(path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


# --- maintenance ------------------------------------------------------------------------------------------------------


def _past(t: Callable) -> DataFrame:
    return t("events").where("ts < timestamp'2024-01-20'")


def _maintained(spark: SparkSession, t: Callable, name: str) -> LifecycleService:
    service = stored(spark, _past(t), name)
    service.partition_data(AT)
    service.maintain(AT)
    return service


_AHEAD_SQL = "ahead AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-20', TIMESTAMP '2024-01-22', INTERVAL 1 DAY)) AS d)"
_PAST_SQL = "past AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-20'), days AS (SELECT DISTINCT CAST(date_trunc('day', ts) AS TIMESTAMP) AS d FROM past)"
_TOPS_SQL = f"{_PAST_SQL}, {_AHEAD_SQL}, every AS (SELECT d FROM days UNION SELECT d FROM ahead)"
_TOP = "'events__' || strftime(d, '%Y_%m_%d')"


@query(f"WITH {_TOPS_SQL} SELECT {_TOP} AS name, d >= {KEPT_FROM} AS attached FROM every UNION ALL SELECT 'events__default', true")
def maintain_listing(spark: SparkSession, t: Callable) -> DataFrame:
    """Partitions that exist after a run: those created ahead, those kept and the detached ones."""
    return _maintained(spark, t, "maintain").list_partitions().select("name", "attached")


@query(
    f"WITH {_TOPS_SQL} SELECT (SELECT CAST(count(*) AS INTEGER) FROM ahead WHERE d NOT IN (SELECT d FROM days)) AS created, 0 AS repaired, 0 AS attached, (SELECT CAST(count(*) AS INTEGER) FROM days WHERE d < {KEPT_FROM}) AS detached, 0 AS dropped, 0 AS issues, "
    "0 AS again"
)
def maintain_tallies(spark: SparkSession, t: Callable) -> DataFrame:
    """What a run counts, and that a second one has nothing to do."""
    service = stored(spark, _past(t), "tallies")
    service.partition_data(AT)
    r, again = service.maintain(AT), service.maintain(AT)
    row = (r.created, r.repaired, r.attached, r.detached, r.dropped, len(r.issues), again.created + again.attached + again.detached + again.dropped)
    return values(spark, [row], "created int, repaired int, attached int, detached int, dropped int, issues int, again int")


@query(f"WITH {_TOPS_SQL} SELECT {_TOP} AS name, 'attach' AS kind, 'reattach' AS reason FROM days WHERE d < {KEPT_FROM}")
def reattach_plan(spark: SparkSession, t: Callable) -> DataFrame:
    """A longer retention brings detached partitions back."""
    service = _maintained(spark, t, "reattach")
    plan = other_rules(service, policy.Lifecycle(policy.CreateAhead(3), policy.KeepNewest(60))).plan(AT)
    return plan.operations.where("counts_as is null or counts_as <> 'subtree'").select(F.col("target").alias("name"), "kind", "reason")


@query(f"SELECT {DAY_SQL} || '__h' || (user_id % 4) AS partition, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY ALL")
def reattach_rows(spark: SparkSession, t: Callable) -> DataFrame:
    """Re-attached partitions come back with their rows."""
    service = _maintained(spark, t, "back")
    longer = other_rules(service, policy.Lifecycle(policy.CreateAhead(3), policy.KeepNewest(60)))
    longer.maintain(AT)
    return by_leaf(longer)


@query(f"WITH {_TOPS_SQL} SELECT (SELECT CAST(count(*) AS INTEGER) FROM days WHERE d < {KEPT_FROM}) AS dropped, (SELECT count(*) FROM past WHERE ts >= {KEPT_FROM}) AS n")
def drop_after_two_days(spark: SparkSession, t: Callable) -> DataFrame:
    """Once their grace is over detached partitions go with their rows; ``n`` rows are left in the whole store."""
    service = _maintained(spark, t, "drop")
    done = service.drop_detached_partitions(AT + dt.timedelta(days=3))
    return values(spark, [(done.dropped, service.store.read("events").count())], "dropped int, n long")


@query(f"WITH {_TOPS_SQL} SELECT {_TOP} AS name FROM days WHERE d < {KEPT_FROM}")
def drop_never(spark: SparkSession, t: Callable) -> DataFrame:
    """Without a drop rule detached partitions stay for ever."""
    service = _maintained(spark, t, "never")
    keep = other_rules(service, policy.Lifecycle(policy.CreateAhead(3), policy.KeepNewest(5), policy.DropNever()))
    keep.maintain(AT + dt.timedelta(days=400))
    names = F.col("name").isin([f"events__2024_01_{d:02d}" for d in range(1, 16)])
    return keep.list_partitions().where("not attached").where(names).select("name")


@query(
    f"WITH {_TOPS_SQL}, ops AS (SELECT 1 AS phase, {_TOP} AS target FROM ahead WHERE d NOT IN (SELECT d FROM days) UNION ALL SELECT 3, {_TOP} FROM days WHERE d < {KEPT_FROM}) "
    "SELECT CAST(row_number() OVER (ORDER BY phase, target) AS INTEGER) AS step, target, CASE phase WHEN 1 THEN 'create' ELSE 'detach' END AS kind FROM ops"
)
def operation_order(spark: SparkSession, t: Callable) -> DataFrame:
    """Creates come before detaches, each in the order of the windows."""
    service = stored(spark, _past(t), "order")
    service.partition_data(AT)
    rows = [r for r in service.plan(AT).ordered().collect() if r.counts_as != "subtree"]
    return values(spark, [(k, r.target, r.kind) for k, r in enumerate(rows, 1)], "step int, target string, kind string")


@query(f"WITH {_TOPS_SQL} SELECT 'create' AS kind, {_TOP} AS target FROM ahead WHERE d NOT IN (SELECT d FROM days)")
def plan_create_only(spark: SparkSession, t: Callable) -> DataFrame:
    """Plan filters: only what creates, parts of a subtree left out."""
    service = stored(spark, _past(t), "filters")
    service.partition_data(AT)
    return service.plan(AT).only("create").where("counts_as <> 'subtree'").select("kind", "target")


@query("SELECT 'events__2024_03_' || d || s AS target, 'explicit' AS mode FROM (SELECT unnest(['01', '05']) AS d), (SELECT '' AS s UNION ALL SELECT '__h' || b FROM range(4) AS r(b))")
def ensure_explicit(spark: SparkSession, t: Callable) -> DataFrame:
    """Windows asked for by position exist afterwards with all their buckets, and nothing else does."""
    service = stored(spark, t("events"), "explicit")
    service.ensure_partitions(AT, [dt.datetime(2024, 3, 5, 7), dt.datetime(2024, 3, 1), dt.datetime(2024, 3, 5)])
    return service.store.nodes().where("kind <> 'default'").select(F.col("name").alias("target"), F.lit("explicit").alias("mode"))


@query(f"WITH {_TOPS_SQL} SELECT {_TOP} AS partition, 'create' AS step, true AS refused FROM ahead WHERE d = TIMESTAMP '2024-01-21' UNION ALL SELECT {_TOP}, 'create', false FROM ahead WHERE d <> TIMESTAMP '2024-01-21'")
def hooks_refuse(spark: SparkSession, t: Callable) -> DataFrame:
    """A hook that fails before an operation stops that one and what depends on it; the others are done."""

    def refuse(event: dict) -> None:
        if event["partition"].endswith("21"):
            raise ValueError("not that one")

    service = LifecycleService(spark, shared_folder(spark, "hooks"), Table("events", SCHEME, RULES), t("events").schema, Hooks().add("before_create", refuse))
    service.initialise()
    found = service.maintain(AT)
    done = [(r.name, "create", False) for r in service.store.nodes().where("kind = 'range'").collect()]
    return values(spark, [(i["partition"], i["step"], True) for i in found.issues] + done, "partition string, step string, refused boolean")


@query(f"SELECT {DAY_SQL} AS name, count(*) AS row_estimate, bool_or(event_id % 200 = 0) AS referenced, count(*) FILTER (WHERE user_id = 7) <= 2 AS quiet FROM events GROUP BY ALL")
def measured_facts(spark: SparkSession, t: Callable) -> DataFrame:
    """Row counts, references and the answers of a rule's own query, all partitions in one pass each."""
    quiet = policy.SqlPredicate("SELECT (SELECT count(*) FROM {partition} WHERE user_id = 7) <= 2")
    rules = policy.Lifecycle(policy.CreateAhead(1), policy.AllOf((policy.KeepNewest(5), policy.Unreferenced(), policy.RowsAbove(0), quiet)))
    marked = t("events").where("event_id % 200 = 0").select(F.col("event_id").alias("event"))
    service = stored(spark, t("events"), "facts", scheme=Range(("ts",), axis=TimeAxis("day")), rules=rules, referencing=[(marked, {"event_id": "event"})])
    service.partition_data(AT)
    return service.measure().select("name", "row_estimate", "referenced", F.col("predicates")[quiet.id].alias("quiet"))


@query(
    f"SELECT name FROM (SELECT {DAY_SQL} AS name, min(ts) AS d, bool_or(event_id % 200 = 0) AS used, count(*) FILTER (WHERE user_id = 7) <= 2 AS quiet FROM events GROUP BY ALL) WHERE d < {KEPT_FROM} AND NOT used AND quiet"
)
def expire_measured(spark: SparkSession, t: Callable) -> DataFrame:
    """Retention by all of: old, referred to by nothing, and a query over the partition."""
    quiet = policy.SqlPredicate("SELECT (SELECT count(*) FROM {partition} WHERE user_id = 7) <= 2")
    rules = policy.Lifecycle(policy.CreateAhead(1), policy.AllOf((policy.KeepNewest(5), policy.Unreferenced(), quiet)))
    marked = t("events").where("event_id % 200 = 0").select(F.col("event_id").alias("event"))
    service = stored(spark, t("events"), "expire", scheme=Range(("ts",), axis=TimeAxis("day")), rules=rules, referencing=[(marked, {"event_id": "event"})])
    service.partition_data(AT)
    service.detach_old_partitions(AT)
    return service.list_partitions().where("not attached").select("name")


@query("SELECT 'events__2024_01_18__h1' AS name UNION ALL SELECT 'events__default'")
def pruning_names(spark: SparkSession, t: Callable) -> DataFrame:
    """The leaves that can hold a day's rows of one user."""
    service = stored(spark, t("events"), "prune")
    service.partition_data(AT)
    return service.get_partitions_for_pruning({"ts": (micros(dt.datetime(2024, 1, 18)), micros(dt.datetime(2024, 1, 19)))}, {"user_id": 5})


@query(f"WITH {_TOPS_SQL} SELECT 'create' AS kind, {_TOP} || s AS target FROM ahead, (SELECT '' AS s UNION ALL SELECT '__h' || b FROM range(4) AS r(b)) WHERE d NOT IN (SELECT d FROM days) UNION ALL SELECT 'detach', {_TOP} FROM days WHERE d < {KEPT_FROM}")
def saved_plan(spark: SparkSession, t: Callable) -> DataFrame:
    """A plan written as JSON and read again."""
    import json

    service = stored(spark, _past(t), "saved")
    service.partition_data(AT)
    data = json.loads(report.to_json(service.plan(AT)))
    return values(spark, [(o["kind"], o["target"]) for o in data["operations"]], "kind string, target string")


@query(f"SELECT CASE WHEN ts < TIMESTAMP '2024-01-11' THEN {DAY_SQL} || '__h' || (user_id % 4) ELSE 'events__default' END AS partition, count(*) AS n FROM events GROUP BY ALL")
def stream_into_table(spark: SparkSession, t: Callable) -> DataFrame:
    """A stream goes to the leaves that exist, and to DEFAULT otherwise."""
    service = LifecycleService(spark, shared_folder(spark, "stream"), Table("events", SCHEME, RULES), t("events").schema)
    service.initialise()
    first = t("events").agg(F.to_date(F.min("ts")).alias("d")).first().d
    days = (dt.date(2024, 1, 11) - first).days
    service.ensure_partitions(AT, [dt.datetime(first.year, first.month, first.day) + dt.timedelta(days=k) for k in range(days)])
    source = shared_folder(spark, "stream-in")
    t("events").repartition(3).write.parquet(source)
    stream = spark.readStream.schema(t("events").schema).option("maxFilesPerTrigger", 1).parquet(source)
    to_table(stream, service, shared_folder(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    return by_leaf(service)


@query(f"WITH {_TOPS_SQL} SELECT {_TOP} AS name, d + INTERVAL 1 DAY + INTERVAL 6 HOUR <= TIMESTAMP '2024-01-20 12:00:00' AS closed FROM days WHERE d >= {KEPT_FROM} UNION ALL SELECT 'events__default', false")
def closed_partitions(spark: SparkSession, t: Callable) -> DataFrame:
    """Whether a stored partition is due no more rows, six hours allowed; DEFAULT never is."""
    service = _maintained(spark, t, "closed")
    names = [r.d for r in _past(t).where("ts >= '2024-01-16'").select(F.date_format("ts", "yyyy_MM_dd").alias("d")).distinct().collect()]
    asked = [*(f"events__{d}" for d in names), "events__default"]
    return values(spark, [(n, service.is_partition_closed(n, AT, dt.timedelta(hours=6))) for n in asked], "name string, closed boolean")


# --- rules and plans that need no store -------------------------------------------------------------------------------


@query(f"WITH {_MONTHS_SQL} SELECT strftime(d, '%Y_%m') AS label FROM m WHERE d + INTERVAL 1 MONTH <= TIMESTAMP '1994-01-01' OR n < 180")
def any_of_rules(spark: SparkSession, t: Callable) -> DataFrame:
    rule = policy.AnyOf((policy.KeepNewest(66), ~policy.RowsAbove(179)))
    return _order_months(t, 66).where(rule.holds()).select("label")


@query(f"WITH {_MONTHS_SQL} SELECT strftime(d, '%Y_%m') AS label FROM m WHERE n % 2 = 1 AND NOT month(d) = 2")
def callback_rule(spark: SparkSession, t: Callable) -> DataFrame:
    """A rule of one's own over the measured facts."""
    odd = policy.Callback(lambda: F.col("row_estimate") % 2 == 1, needs=frozenset({"rows"}), label="odd")
    february = policy.Callback(lambda: F.col("label").endswith("_02"), label="february")
    return _order_months(t).where((odd & ~february).holds()).select("label")


@query("SELECT 'nation__looking' AS target, 'list_group_missing' AS reason UNION ALL SELECT 'nation__other', 'list_default_missing'")
def list_level_plan(spark: SparkSession, t: Callable) -> DataFrame:
    """A LIST root that has one of its groups lacks the other and DEFAULT."""
    rows = [("nation", None, None, "partitioned", "list", ["event_type"], None, None), ("nation__buying", "nation", "list", "table", None, None, ["purchase", "signup"], True)]
    nodes = _as_nodes(values(spark, rows, "name string, parent_name string, kind string, relkind string, partition_type string, partition_columns array<string>, values array<string>, includes_null boolean"))
    plan = planner.plan(Table("nation", EVENT_GROUPS), nodes, C.empty(spark, C.ORPHANS), planner.Context(NOW))
    return plan.operations.select("target", "reason")


@query("SELECT CAST(sum(n_nationkey) AS BIGINT) AS keys, CAST(max(level) AS INTEGER) AS depth, count(*) AS nodes FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS level FROM nation)")
def deep_tree(spark: SparkSession, t: Callable) -> DataFrame:
    """A tree as deep as it has nodes: every nation hangs on the one before."""
    chain = t("nation").select(F.col("n_nationkey").cast("string").alias("name"), F.when(F.col("n_nationkey") > 0, (F.col("n_nationkey") - 1).cast("string")).alias("parent_name"))
    found = C.tree(chain)
    return found.agg(F.sum(F.col("name").cast("long")).alias("keys"), F.max("level").alias("depth"), F.count("*").alias("nodes"))


@query("SELECT CAST(row_number() OVER (ORDER BY level, name) AS INTEGER) AS place, name FROM (SELECT 'world' AS name, 0 AS level UNION ALL SELECT 'r' || r_regionkey, 1 FROM region UNION ALL SELECT 'n' || n_nationkey, 2 FROM nation)")
def tree_order(spark: SparkSession, t: Callable) -> DataFrame:
    """Nodes by level and then name, as a reader of the tree lists them."""
    rows = t("region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("name"), F.lit("world").alias("parent_name"))
    rows = rows.unionByName(t("nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("name"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent_name")))
    rows = rows.unionByName(values(spark, [("world", None)], "name string, parent_name string"))
    listed = C.tree(rows).orderBy("level", "name").collect()  # a tree of partitions, not of rows
    return values(spark, [(k, r.name) for k, r in enumerate(listed, 1)], "place int, name string")


@query(
    "SELECT o_orderkey // 1000 AS o, count(*) AS n, o_orderkey // 1000 * 1000 AS low, o_orderkey // 1000 * 1000 + 1000 AS high, 'orders__' || (o_orderkey // 1000 * 1000) AS name FROM orders GROUP BY ALL"
)
def numeric_windows(spark: SparkSession, t: Callable) -> DataFrame:
    axis = NumericAxis(1000)
    found = t("orders").groupBy(axis.ordinal(F.col("o_orderkey")).alias("o")).agg(F.count("*").alias("n"))
    found = _candidates(found, axis, 0)
    return found.select("o", "n", F.col("pos_start").alias("low"), F.col("pos_end").alias("high"), F.concat(F.lit("orders__"), "label").alias("name"))


@query("SELECT name, method, levels FROM (VALUES ('a', 'range', 2), ('b', 'hash', 1)) AS v(name, method, levels)")
def document_tables(spark: SparkSession, t: Callable) -> DataFrame:
    """A configuration document with defaults, read into tables."""
    scheme = {"method": "range", "columns": "ts", "axis": {"kind": "time", "granularity": "month"}, "child": {"method": "hash", "columns": "k", "modulus": 4}}
    document = {
        "version": 1, "root": "/data", "defaults": {"lifecycle": {"create": {"ahead": 2}, "retain": {"keep_newest": 3}}},
        "tables": [{"name": "a", "schema": "ts timestamp, k int", "scheme": scheme}, {"name": "b", "schema": "k int", "scheme": {"method": "hash", "columns": "k", "modulus": 8}, "lifecycle": {}}],
    }
    return values(spark, [(x.name, x.scheme.method, len(list(x.scheme.walk()))) for x in from_data(document).tables], "name string, method string, levels int")


@query(
    "WITH f AS (SELECT o_orderdate - INTERVAL 3 MONTH AS d FROM orders) "
    "SELECT 'orders__fy' || year(d) || '_q' || quarter(d) AS partition, min(date_trunc('quarter', d)) + INTERVAL 3 MONTH AS starts, min(date_trunc('quarter', d)) + INTERVAL 6 MONTH AS ends, count(*) AS n FROM f GROUP BY 1"
)
def route_fiscal(spark: SparkSession, t: Callable) -> DataFrame:
    """Orders by the quarters of a year that begins in April."""
    axis = FiscalAxis()
    found = t("orders").groupBy(axis.ordinal(axis.position(F.col("o_orderdate"))).alias("o")).agg(F.count("*").alias("n"))
    at = lambda p: F.timestamp_micros(p).cast("timestamp_ntz")
    return found.select(F.concat(F.lit("orders__"), axis.label(F.col("o"))).alias("partition"), at(axis.start(F.col("o"))).alias("starts"), at(axis.end(F.col("o"))).alias("ends"), "n")


@query("SELECT DISTINCT date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS following, date_trunc('month', o_orderdate) < TIMESTAMP '1995-01-01' AS before FROM orders")
def window_order(spark: SparkSession, t: Callable) -> DataFrame:
    """The windows after those of the orders' months, and which come before January 1995."""
    axis = TimeAxis("month")
    pivot = Window.holding(axis, micros(dt.datetime(1995, 1, 1)))
    months = t("orders").select(axis.ordinal(axis.position(F.col("o_orderdate"))).alias("o")).distinct().collect()  # a row a window
    found = [Window(axis, r.o) for r in months]
    return values(spark, [((w + 1).start, w < pivot) for w in found], "p long, before boolean").select(F.timestamp_micros("p").cast("timestamp_ntz").alias("following"), "before")


@query(
    f"WITH d AS (SELECT DISTINCT date_trunc('day', ts) AS ts FROM events), w AS (SELECT {DAY_SQL} AS name, ts FROM d UNION ALL SELECT 'events__none', NULL UNION ALL SELECT 'events__default', NULL) "
    "SELECT name, CASE WHEN name = 'events__default' THEN 'attached' WHEN ts IS NULL THEN NULL WHEN day(ts) % 3 = 0 THEN 'attached' WHEN day(ts) % 3 = 1 THEN 'detached' ELSE 'unattached' END AS found, "
    "CASE WHEN name = 'events__default' OR day(ts) % 3 < 2 THEN 'events' END AS parent_name, "
    "CASE WHEN name = 'events__default' THEN 'DEFAULT' WHEN day(ts) % 3 = 0 THEN 'FOR VALUES FROM (' || chr(39) || strftime(ts, '%Y-%m-%d') || chr(39) || ') TO (' || chr(39) || strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d') || chr(39) || ')' END AS bounds FROM w"
)
def partition_lookup(spark: SparkSession, t: Callable) -> DataFrame:
    """Whether names are attached, detached or stray tables, and the boundaries of those attached."""
    axis = TimeAxis("day")
    days = t("events").select(axis.ordinal(axis.position(F.col("ts"))).alias("o")).where("o is not null").distinct()
    third = F.pmod(F.day(axis.first_day(F.col("o"))), F.lit(3))
    days = days.select(F.concat(F.lit("events__"), axis.label(F.col("o"))).alias("name"), F.lit("events").alias("parent_name"), F.lit("table").alias("relkind"), third.alias("third"), *(axis.key_literal(f(F.col("o"))).alias(c) for f, c in ((axis.start, "from_value"), (axis.end, "to_value"))))
    nodes = days.where("third = 0").withColumn("kind", F.lit("range"))
    default = values(spark, [("events__default", "events", "default")], "name string, parent_name string, kind string")
    names = days.select("name").unionByName(values(spark, [("events__none",), ("events__default",)], "name string"))
    found = C.lookup(names, _as_nodes(nodes).unionByName(_as_nodes(default)), days.where("third = 1"), days.where("third = 2"))
    return found.select("name", "found", "parent_name", "bounds")
