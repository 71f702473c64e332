"""Queries over the shared tables for the library's own operators, each with its SQL.

The clock is fixed (2024-01-20 12:00 UTC for ``events``, 1999-06-15 for ``orders``);
catalogues that a query needs are derived from the tables or given as values.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions import bounds as B
from terrace.functions import codecs as K
from terrace.functions import names as N
from terrace.functions.axis import GRANULARITIES, NumericAxis, TimeAxis, micros
from terrace.operators import mover, routing
from terrace.operators.pruning import prune
from terrace.plans import planner, policy
from terrace.plans.scheme import Group, Hash, List, Range, Table
from terrace.report import metrics
from terrace.sources import catalogue as C
from terrace.sources.shared import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "route_day_hash"
NOW = micros(dt.datetime(2024, 1, 20, 12))
ORDERS_NOW = micros(dt.datetime(1999, 6, 15))


def query(sql: str | None = None):
    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(_at_utc(spark), lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _at_utc(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def in_sql(rows: list[tuple], names: str) -> str:
    """The same rows for SQL."""

    def one(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(one, v)) + "]"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS v({names})"


# --- routing ----------------------------------------------------------------------------------------------------------

EVENTS = Table("events", Range(("ts",), Hash(("user_id",), modulus=4), TimeAxis("day")))


@query("SELECT strftime(ts, '%Y_%m_%d') AS day, 'h' || (user_id % 4) AS bucket, count(*) AS n FROM events GROUP BY ALL")
def route_day_hash(spark: SparkSession, t: Callable) -> DataFrame:
    return routing.route(t("events"), EVENTS.scheme).groupBy(F.col("p0").alias("day"), F.col("p1").alias("bucket")).agg(F.count("*").alias("n"))


_LABELS = {
    "hour": ("events", "ts", "strftime(ts, '%Y_%m_%d_%H')", "date_trunc('hour', ts)"),
    "week": ("events", "ts", "printf('%04d_w%02d', isoyear(ts), weekofyear(ts))", "date_trunc('week', ts)"),
    "month": ("orders", "o_orderdate", "strftime(o_orderdate, '%Y_%m')", "date_trunc('month', o_orderdate)"),
    "quarter": ("orders", "o_orderdate", "year(o_orderdate) || '_q' || quarter(o_orderdate)", "date_trunc('quarter', o_orderdate)"),
    "year": ("lineitem", "l_shipdate", "strftime(l_shipdate, '%Y')", "date_trunc('year', l_shipdate)"),
}


def _by_label(granularity: str) -> None:
    source, key, label, start = _LABELS[granularity]

    def f(spark: SparkSession, t: Callable) -> DataFrame:
        axis = TimeAxis(granularity)
        o = axis.ordinal(axis.position(F.col(key)))
        return t(source).groupBy(o.alias("o")).agg(F.count("*").alias("n")).select(axis.label(F.col("o")).alias("label"), axis.start(F.col("o")).alias("start_us"), "n")

    f.__name__ = f"route_{granularity}"
    query(f"SELECT {label} AS label, epoch_us({start}) AS start_us, count(*) AS n FROM {source} GROUP BY ALL")(f)


for _g in _LABELS:
    _by_label(_g)


@query("SELECT o_orderkey - (((o_orderkey - 37) % 1000) + 1000) % 1000 AS start, count(*) AS n FROM orders GROUP BY ALL")
def route_numeric_origin(spark: SparkSession, t: Callable) -> DataFrame:
    axis = NumericAxis(1000, 37)
    o = axis.ordinal(axis.position(F.col("o_orderkey")))
    return t("orders").groupBy(o.alias("o")).agg(F.count("*").alias("n")).select(axis.start(F.col("o")).alias("start"), "n")


@query("SELECT 'nation__' || n_regionkey AS partition, count(*) AS n FROM nation GROUP BY ALL")
def route_sequence(spark: SparkSession, t: Callable) -> DataFrame:
    from terrace.plans.scheme import SlidingList

    return routing.route(t("nation"), SlidingList(("n_regionkey",)), table="nation").groupBy("partition").agg(F.count("*").alias("n"))


EVENT_GROUPS = List(("event_type",), groups=(Group("buying", ("purchase", "signup"), True), Group("looking", ("view", "click"))))


@query(
    "SELECT CASE WHEN e IN ('purchase', 'signup') OR e IS NULL THEN 'buying' WHEN e IN ('view', 'click') THEN 'looking' ELSE 'other' END AS grp, count(*) AS n "
    "FROM (SELECT CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_type END AS e FROM events) GROUP BY ALL"
)
def route_list_default_null(spark: SparkSession, t: Callable) -> DataFrame:
    df = t("events").withColumn("event_type", F.when(F.col("event_id") % 10 != 0, F.col("event_type")))
    return routing.route(df, EVENT_GROUPS).groupBy(F.col("p0").alias("grp")).agg(F.count("*").alias("n"))


ORDER_SCHEME = Range(("o_orderdate",), List(("o_orderpriority",), Hash(("o_custkey",), modulus=4), groups=(Group("urgent", ("1-URGENT", "2-HIGH")),)), TimeAxis("quarter"))


@query(
    "SELECT 'orders__' || year(o_orderdate) || '_q' || quarter(o_orderdate) || '__' || CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'urgent' ELSE 'other' END || '__h' || (o_custkey % 4) AS partition, count(*) AS n "
    "FROM orders GROUP BY ALL"
)
def route_nested_three(spark: SparkSession, t: Callable) -> DataFrame:
    return routing.route(t("orders"), ORDER_SCHEME, table="orders").groupBy("partition").agg(F.count("*").alias("n"))


@query(
    "SELECT CASE WHEN value IS NULL THEN 'events__default' WHEN strftime(ts, '%Y_%m_%d') IN ('2024_01_05', '2024_01_11') THEN 'events__default' ELSE 'events__' || strftime(ts, '%Y_%m_%d') END AS partition, count(*) AS n "
    "FROM (SELECT ts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events) GROUP BY ALL"
)
def route_to_known(spark: SparkSession, t: Callable) -> DataFrame:
    """Rows of days without a partition, and rows with a null in a trailing key column, go to DEFAULT."""
    df = t("events").withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    axis = TimeAxis("day")
    days = t("events").select(F.concat(F.lit("events__"), axis.label(axis.ordinal(axis.position(F.col("ts"))))).alias("partition")).distinct()
    known = days.where(~F.col("partition").isin("events__2024_01_05", "events__2024_01_11"))
    return routing.route(df, Range(("ts", "value"), axis=axis), table="events", known=known).groupBy("partition").agg(F.count("*").alias("n"))


# --- axes and labels --------------------------------------------------------------------------------------------------


@query(
    "SELECT strftime(d, '%Y_%m_%d') AS label, epoch_us(timezone('Europe/Berlin', d::timestamp)) AS start_us, epoch_us(timezone('Europe/Berlin', (d + INTERVAL 1 DAY)::timestamp)) AS end_us, "
    "(epoch_us(timezone('Europe/Berlin', (d + INTERVAL 1 DAY)::timestamp)) - epoch_us(timezone('Europe/Berlin', d::timestamp))) // 3600000000 AS hours "
    "FROM (SELECT unnest(generate_series(DATE '2026-03-27', DATE '2026-03-31', INTERVAL 1 DAY)) AS d UNION ALL SELECT unnest(generate_series(DATE '2026-10-24', DATE '2026-10-27', INTERVAL 1 DAY)))"
)
def window_bounds_tz_berlin(spark: SparkSession, t: Callable) -> DataFrame:
    axis = TimeAxis("day", "Europe/Berlin")
    days = spark.sql("SELECT explode(sequence(DATE '2026-03-27', DATE '2026-03-31')) AS d UNION ALL SELECT explode(sequence(DATE '2026-10-24', DATE '2026-10-27'))")
    rows = days.select(F.unix_date("d").cast("long").alias("o")).select(axis.label(F.col("o")).alias("label"), axis.start(F.col("o")).alias("start_us"), axis.end(F.col("o")).alias("end_us"))
    return rows.withColumn("hours", F.expr("(end_us - start_us) div 3600000000"))


_SHIFT_FROM = ["2024-02-29 10:30:00", "2026-12-31 23:59:59", "2027-01-01 00:00:00", "1969-12-31 23:00:00"]
_SHIFTS = [-13, -1, 0, 1, 5]


@query(
    "WITH p AS (SELECT CAST(x AS TIMESTAMP) AS ts, n FROM (SELECT unnest(" + str(_SHIFT_FROM) + ") AS x), (SELECT unnest(" + str(_SHIFTS) + ") AS n)) "
    + " UNION ALL ".join(f"SELECT '{g}' AS granularity, epoch_us(ts) AS at_us, n, epoch_us(date_trunc('{g}', ts) + n * INTERVAL '{3 if g == 'quarter' else 1} {'month' if g == 'quarter' else g}') AS start_us FROM p" for g in GRANULARITIES)
)
def window_shift_all(spark: SparkSession, t: Callable) -> DataFrame:
    points = values(spark, [(x, n) for x in _SHIFT_FROM for n in _SHIFTS], "x string, n int").select(F.unix_micros(F.col("x").cast("timestamp")).alias("at_us"), "n")
    return C.first_of([points.select(F.lit(g).alias("granularity"), "at_us", "n", TimeAxis(g).start(TimeAxis(g).ordinal(F.col("at_us")) + F.col("n")).alias("start_us")) for g in GRANULARITIES])


@query(
    " UNION ALL ".join(
        f"SELECT '{g}' AS granularity, count(*) AS windows, count(*) AS same FROM (SELECT DISTINCT date_trunc('{g}', ts) FROM events)" for g in GRANULARITIES
    )
)
def label_roundtrip(spark: SparkSession, t: Callable) -> DataFrame:
    """Windows whose label is read back as the same window: all of them."""
    out = []
    for g in GRANULARITIES:
        axis = TimeAxis(g)
        rows = t("events").select(axis.ordinal(axis.position(F.col("ts"))).alias("o")).distinct()
        out.append(rows.agg(F.lit(g).alias("granularity"), F.count("*").alias("windows"), F.count(F.when(axis.parse(axis.label(F.col("o"))) == F.col("o"), 1)).alias("same")))
    return C.first_of(out)


_LABEL_CASES = [
    ("month", "2024_13", None), ("month", "2024_02", 24289), ("week", "2024_w54", None), ("week", "2026_w53", 2974), ("week", "2024_w53", None), ("day", "2024_02_30", None),
    ("day", "2024_02_29", 19782), ("day", "2023_02_29", None), ("hour", "2024_01_01_24", None), ("hour", "2024_01_01_23", 473375), ("quarter", "2024_q5", None), ("quarter", "2024_q4", 8099),
    ("year", "2024", 2024), ("year", "24", None), ("month", "2024-02", None), ("day", "x2024_02_01", None),
]


@query(f"SELECT granularity, label, CAST(ordinal AS BIGINT) AS ordinal FROM {in_sql(_LABEL_CASES, 'granularity, label, ordinal')}")
def label_invalid(spark: SparkSession, t: Callable) -> DataFrame:
    rows = values(spark, [c[:2] for c in _LABEL_CASES], "granularity string, label string")
    found = F.lit(None).cast("long")
    for g in GRANULARITIES:
        found = F.when(F.col("granularity") == g, TimeAxis(g).parse(F.col("label"))).otherwise(found)
    return rows.select("granularity", "label", found.alias("ordinal"))


@query(
    "WITH v AS (SELECT unnest(range(-250, 251, 25)) AS v), s AS (SELECT v, v - ((v % 100) + 100) % 100 AS start FROM v) "
    "SELECT v, start, replace(CAST(start AS VARCHAR), '-', 'm') AS label, start // 100 AS parsed FROM s"
)
def numeric_negative(spark: SparkSession, t: Callable) -> DataFrame:
    axis = NumericAxis(100)
    rows = spark.range(-250, 251, 25).select(F.col("id").alias("v"), axis.ordinal(F.col("id")).alias("o"))
    return rows.select("v", axis.start(F.col("o")).alias("start"), axis.label(F.col("o")).alias("label"), axis.parse(axis.label(F.col("o"))).alias("parsed"))


# --- codecs -----------------------------------------------------------------------------------------------------------

_UUID_SQL = "substr(lpad(printf('%x', (epoch_us(ts) // 1000)), 12, '0'), 1, 8) || '-' || substr(lpad(printf('%x', (epoch_us(ts) // 1000)), 12, '0'), 9, 4) || '-7000-8000-000000000000'"


def _position(column: str = "ts") -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


@query(f"SELECT event_id, {_UUID_SQL} AS id FROM events")
def uuidv7_encode(spark: SparkSession, t: Callable) -> DataFrame:
    return t("events").select("event_id", K.uuid7_of(_position()).alias("id"))


@query("SELECT event_id, (epoch_us(ts) // 1000) * 1000 AS at_us, CAST(NULL AS BIGINT) AS other FROM events")
def uuidv7_decode(spark: SparkSession, t: Callable) -> DataFrame:
    """Version 7 is read back; the same digits as version 4 are not."""
    ids = t("events").select("event_id", K.uuid7_of(_position()).alias("id"))
    return ids.select("event_id", K.micros_of_uuid7(F.upper("id")).alias("at_us"), K.micros_of_uuid7(F.overlay("id", F.lit("4"), F.lit(15), F.lit(1))).alias("other"))


@query("SELECT count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'")
def uuidv7_range_filter(spark: SparkSession, t: Callable) -> DataFrame:
    ids = t("events").select("event_id", K.uuid7_of(_position()).alias("id"))
    week = ids.where(K.key_range(F.col("id"), "uuidv7", micros(dt.datetime(2024, 1, 8)), micros(dt.datetime(2024, 1, 15))))
    return week.agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("SELECT event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) * 1000000 AS by_seconds, (epoch_us(ts) // 1000) * 1000 AS by_millis FROM events")
def epoch_codec(spark: SparkSession, t: Callable) -> DataFrame:
    both = t("events").select("event_id", _position().alias("p"))
    back = lambda name: K.CODECS[name].decode(K.CODECS[name].encode(F.col("p")).cast("long"))
    return both.select("event_id", back("epoch_seconds").alias("by_seconds"), back("epoch_milliseconds").alias("by_millis"))


# --- bounds and names -------------------------------------------------------------------------------------------------

_BOUND_CASES = [
    ("FOR VALUES FROM ('2024-01-01') TO ('2024-02-01')", "range", "2024-01-01", "2024-02-01", None, False, None, None),
    ("FOR VALUES FROM (MINVALUE) TO (100)", "range", "MINVALUE", "100", None, False, None, None),
    ("FOR VALUES FROM ('2024-01-01 00:00:00+00', MINVALUE) TO ('2024-02-01 00:00:00+00', MINVALUE)", "range", "2024-01-01 00:00:00+00", "2024-02-01 00:00:00+00", None, False, None, None),
    ("FOR VALUES IN ('a', 'it''s', NULL)", "list", None, None, ["a", "it's"], True, None, None),
    ("FOR VALUES IN ('x, y', 'z')", "list", None, None, ["x, y", "z"], False, None, None),
    ("FOR VALUES WITH (modulus 8, remainder 3)", "hash", None, None, None, False, 8, 3),
    ("DEFAULT", "default", None, None, None, False, None, None),
    ("FOR SOMETHING ELSE", None, None, None, None, None, None, None),
]


@query(f"SELECT text, kind, from_value, to_value, array_to_string(vals, '|') AS vals, includes_null, CAST(modulus AS INTEGER) AS modulus, CAST(remainder AS INTEGER) AS remainder FROM {in_sql(_BOUND_CASES, 'text, kind, from_value, to_value, vals, includes_null, modulus, remainder')}")
def parse_bounds(spark: SparkSession, t: Callable) -> DataFrame:
    rows = values(spark, [(c[0],) for c in _BOUND_CASES], "text string").withColumn("b", B.parse(F.col("text")))
    return rows.select("text", *[F.array_join("b.values", "|").alias("vals") if c == "values" else F.col(f"b.{c}") for c in ("kind", "from_value", "to_value", "values", "includes_null", "modulus", "remainder")])


_RENDER = [
    ("FOR VALUES FROM ('2024-01-01') TO ('2024-02-01')",), ("FOR VALUES FROM (MINVALUE) TO ('100')",), ("FOR VALUES IN ('a', 'it''s', NULL)",), ("FOR VALUES WITH (modulus 8, remainder 3)",), ("DEFAULT",),
]


@query(f"SELECT text, text AS again FROM {in_sql(_RENDER, 'text')}")
def render_bounds(spark: SparkSession, t: Callable) -> DataFrame:
    return values(spark, _RENDER, "text string").select("text", B.render(B.parse(F.col("text"))).alias("again"))


_INSTANTS = [
    ("2024-01-01", "UTC", 1704067200000000), ("2024-01-01", "Europe/Berlin", 1704063600000000), ("2024-07-01 12:00:00", "Europe/Berlin", 1719828000000000),
    ("2024-01-01 00:00:00+00", "Europe/Berlin", 1704067200000000), ("2024-01-01 02:00:00+02", "UTC", 1704067200000000), ("MINVALUE", "UTC", None), ("12345", "UTC", None), ("20-x:1", "UTC", None),
]


@query(f"SELECT text, tz, CAST(at_us AS BIGINT) AS at_us FROM {in_sql(_INSTANTS, 'text, tz, at_us')}")
def parse_instants(spark: SparkSession, t: Callable) -> DataFrame:
    rows = values(spark, [c[:2] for c in _INSTANTS], "text string, tz string")
    return rows.select("text", "tz", F.when(F.col("tz") == "UTC", B.instant(F.col("text"))).otherwise(B.instant(F.col("text"), "Europe/Berlin")).alias("at_us"))


_NAMES = [("events__2024_01",), ("a.b",), ("x" * 63,), ("é" * 32,), ("events",)]


@query(f"SELECT name, strlen(name) <= 63 AS fits, NOT contains(name, '.') AS addressable, CASE WHEN starts_with(name, 'events__') THEN substr(name, 9) END AS label FROM {in_sql(_NAMES, 'name')}")
def name_checks(spark: SparkSession, t: Callable) -> DataFrame:
    return values(spark, _NAMES, "name string").select("name", N.name_fits(F.col("name")).alias("fits"), N.is_addressable(F.col("name")).alias("addressable"), N.label_of(F.lit("events"), F.col("name")).alias("label"))


_MARKERS = [("events\n2024-01-02 03:04:05", "events", 1704164645000000, ""), ("events\n\nold words\nmore", "events", None, "old words\nmore"), ("\n2024-01-02", None, 1704153600000000, ""), ("events\nsoon", "events", None, "")]


@query("SELECT comment, parent, CAST(at_us AS BIGINT) AS at_us, rest FROM " + in_sql(_MARKERS, "comment, parent, at_us, rest"))
def orphan_markers(spark: SparkSession, t: Callable) -> DataFrame:
    c = F.col("comment")
    return values(spark, [m[:1] for m in _MARKERS], "comment string").select("comment", N.marker_parent(c).alias("parent"), N.marker_detached_at(c).alias("at_us"), N.marker_rest(c).alias("rest"))


_DURATIONS = [(0, "0ms"), (250_000, "250ms"), (1_500_000, "1.5s"), (90_000_000, "1.5m"), (5_400_000_000, "1.5h")]


@query(f"SELECT us, text FROM {in_sql(_DURATIONS, 'us, text')}")
def duration_texts(spark: SparkSession, t: Callable) -> DataFrame:
    return values(spark, [d[:1] for d in _DURATIONS], "us long").select("us", N.duration_text(F.col("us")).alias("text"))


# --- the catalogue ----------------------------------------------------------------------------------------------------


def _edges(t: Callable) -> DataFrame:
    """region, nation and customer as a tree of three levels under one root."""
    root = t("region").limit(1).select(F.lit("world").alias("name"), F.lit(None).cast("string").alias("parent_name"))
    regions = t("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("name"), F.lit("world").alias("parent_name"))
    nations = t("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_name"))
    customers = t("customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent_name"))
    lost = t("region").limit(1).select(F.lit("lost").alias("name"), F.lit("gone").alias("parent_name"))
    return C.first_of([root, regions, nations, customers, lost])


_EDGES_SQL = (
    "edges AS (SELECT 'world' AS name, NULL AS parent_name UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation "
    "UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'lost', 'gone')"
)


@query(
    f"WITH RECURSIVE {_EDGES_SQL}, t AS (SELECT name, parent_name, 0 AS level, name AS path FROM edges WHERE name = 'world' UNION ALL SELECT e.name, e.parent_name, t.level + 1, t.path || '/' || e.name FROM edges e JOIN t ON e.parent_name = t.name) SELECT * FROM t"
)
def tree_walk(spark: SparkSession, t: Callable) -> DataFrame:
    return C.tree(_edges(t))


@query(
    f"WITH RECURSIVE {_EDGES_SQL}, up AS (SELECT name AS ancestor, name FROM edges UNION ALL SELECT e.parent_name, up.name FROM up JOIN edges e ON e.name = up.ancestor WHERE e.parent_name IS NOT NULL AND e.parent_name <> 'gone'), "
    "leaf AS (SELECT name FROM edges WHERE name NOT IN (SELECT parent_name FROM edges WHERE parent_name IS NOT NULL)), "
    "stats AS (SELECT 'c' || o_custkey AS name, count(*) AS row_estimate, sum(CAST(round(o_totalprice) AS BIGINT)) AS size_bytes FROM orders GROUP BY ALL) "
    "SELECT ancestor AS name, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS size_bytes, CAST(coalesce(sum(row_estimate), 0) AS BIGINT) AS row_estimate FROM up JOIN leaf USING (name) LEFT JOIN stats USING (name) GROUP BY ALL"
)
def subtree_facts(spark: SparkSession, t: Callable) -> DataFrame:
    stats = t("orders").groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("name")).agg(F.sum(F.round("o_totalprice").cast("long")).alias("size_bytes"), F.count("*").alias("row_estimate"))
    return C.facts(_edges(t), stats).where("name != 'gone'")


_TABLES = [("events__2024_01_03", "events"), ("events__2024_01_04", None), ("events__2024_01_05", "events"), ("orders__1999", "orders"), ("events__notes", None), ("events__2024_01_06", None)]
_ATTACHED = [("events__2024_01_05", "events"), ("events__2024_01_06", "events")]


@query(f"SELECT name FROM {in_sql(_TABLES, 'name, marker')} WHERE marker IN ('events') AND name NOT IN ('events__2024_01_05', 'events__2024_01_06')")
def orphans(spark: SparkSession, t: Callable) -> DataFrame:
    return C.orphans(values(spark, _TABLES, "name string, marker string"), values(spark, _ATTACHED, "name string, parent_name string"), ["events"]).select("name")


@query(
    f"SELECT v.name, strptime(substr(v.name, 9), '%Y_%m_%d') IN (SELECT date_trunc('day', ts) FROM events) AS holds_rows FROM {in_sql(_TABLES, 'name, marker')} "
    "WHERE starts_with(name, 'events__') AND marker IS NULL AND name NOT IN ('events__2024_01_05', 'events__2024_01_06') AND regexp_matches(name, '^events__[0-9]{4}_[0-9]{2}_[0-9]{2}$')"
)
def unattached(spark: SparkSession, t: Callable) -> DataFrame:
    axis = TimeAxis("day")
    stray = C.unattached(values(spark, _TABLES, "name string, marker string"), values(spark, _ATTACHED, "name string, parent_name string"), "events")
    stray = stray.withColumn("o", axis.parse(N.label_of(F.lit("events"), F.col("name")))).where("o is not null")
    there = t("events").select(axis.ordinal(_position()).alias("o"), F.lit(True).alias("some")).distinct()
    return stray.join(there, "o", "left").select("name", F.coalesce("some", F.lit(False)).alias("holds_rows"))


_NODES = [("events", None, None), ("events__2024_01_01", "events", "range"), ("events__2024_01_02", "events", "range"), ("events__default", "events", "default"), ("events__2024_01_01__h0", "events__2024_01_01", "hash")]


def _nodes(spark: SparkSession) -> DataFrame:
    return values(spark, _NODES, "name string, parent_name string, kind string").withColumns({"pos_start": F.lit(None).cast("long"), "pos_end": F.lit(None).cast("long")})


@query("SELECT * FROM (VALUES ('events__2024_01_01', true, 'range'), ('events__2024_01_02', true, 'range'), ('events__default', true, 'default'), ('events__2023_12_31', false, NULL)) AS v(name, attached, kind)")
def list_partitions(spark: SparkSession, t: Callable) -> DataFrame:
    gone = values(spark, [("events__2023_12_31", "events", 5), ("orders__1999", "orders", 6)], "name string, parent_name string, detached_at long")
    return C.listing(_nodes(spark), gone, "events").select("name", "attached", "kind")


@query("SELECT 'events__default' AS name")
def default_partition(spark: SparkSession, t: Callable) -> DataFrame:
    return C.default_partition(_nodes(spark), "events").select("name")


@query("SELECT max(o_orderkey) AS newest, max(o_orderkey) - max(o_orderkey) % 1000 AS window_start FROM orders")
def high_water_mark(spark: SparkSession, t: Callable) -> DataFrame:
    axis = NumericAxis(1000)
    return t("orders").agg(F.max("o_orderkey").alias("newest")).select("newest", axis.start(axis.ordinal(F.col("newest"))).alias("window_start"))


@query("SELECT epoch_us(min(ts)) AS earliest FROM events WHERE ts IS NOT NULL AND event_id % 7 <> 0")
def default_minimum(spark: SparkSession, t: Callable) -> DataFrame:
    df = t("events").withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return mover.earliest(df, Range(("ts", "value"), axis=TimeAxis("day"))).select(F.col("position").alias("earliest"))


# --- windows that should be -------------------------------------------------------------------------------------------


def _days(t: Callable) -> DataFrame:
    """Days of ``events`` as members, without the 5th, 11th and 12th."""
    axis = TimeAxis("day")
    days = t("events").select(axis.ordinal(_position()).alias("o")).distinct().where(~F.date_format(axis.first_day(F.col("o")), "dd").isin("05", "11", "12"))
    return days.select("o", axis.start(F.col("o")).alias("pos_start"), axis.end(F.col("o")).alias("pos_end"))


_DAYS_SQL = "days AS (SELECT DISTINCT CAST(date_trunc('day', ts) AS TIMESTAMP) AS d FROM events WHERE day(ts) NOT IN (5, 11, 12))"


@query(f"WITH {_DAYS_SQL} SELECT strftime(d, '%Y_%m_%d') AS label FROM (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS d FROM days) WHERE d NOT IN (SELECT d FROM days)")
def missing_windows(spark: SparkSession, t: Callable) -> DataFrame:
    days = _days(t)
    every = days.agg(F.min("o").alias("a"), F.max("o").alias("b")).select(F.explode(F.sequence("a", "b")).alias("o"))
    return every.join(days, "o", "left_anti").select(TimeAxis("day").label(F.col("o")).alias("label"))


@query(f"WITH {_DAYS_SQL} SELECT epoch_us(d + INTERVAL 1 DAY) AS gap_start, epoch_us(nxt) AS gap_end FROM (SELECT d, lead(d) OVER (ORDER BY d) AS nxt FROM days) WHERE nxt > d + INTERVAL 1 DAY")
def contiguous_gaps(spark: SparkSession, t: Callable) -> DataFrame:
    return C.gaps(_days(t).withColumn("parent_name", F.lit("events")), "parent_name").select("gap_start", "gap_end")


def _created(t: Callable, creation: policy.CreateAhead | policy.CreateUntil, now: int = NOW) -> DataFrame:
    axis = TimeAxis("day")
    cursor = F.lit(axis.ordinal_at(now)).cast("long")
    wanted = t("region").limit(1).select(F.explode(F.sequence(cursor, creation.last(axis, cursor))).alias("o"))
    return wanted.join(_days(t), "o", "left_anti").select(axis.label(F.col("o")).alias("label"))


@query("SELECT strftime(d, '%Y_%m_%d') AS label FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-20', TIMESTAMP '2024-02-02', INTERVAL 1 DAY)) AS d) WHERE d NOT IN (SELECT date_trunc('day', ts) FROM events)")
def create_ahead(spark: SparkSession, t: Callable) -> DataFrame:
    return _created(t, policy.CreateAhead(14))


@query("SELECT strftime(d, '%Y_%m_%d') AS label FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-20', TIMESTAMP '2024-02-03', INTERVAL 1 DAY)) AS d) WHERE d NOT IN (SELECT date_trunc('day', ts) FROM events)")
def create_until(spark: SparkSession, t: Callable) -> DataFrame:
    return _created(t, policy.CreateUntil(micros(dt.datetime(2024, 2, 3, 7))))


@query("SELECT max(n_regionkey) + 1 AS next FROM nation HAVING (SELECT count(*) FROM nation WHERE n_regionkey = (SELECT max(n_regionkey) FROM nation)) > 3")
def create_next_if(spark: SparkSession, t: Callable) -> DataFrame:
    """The sequence of regions goes on once its newest partition has more than three rows."""
    newest = t("nation").groupBy(F.col("n_regionkey").alias("value")).agg(F.count("*").alias("row_estimate")).orderBy(F.desc("value")).limit(1)
    rule = policy.CreateNextIf(policy.RowsAbove(3))
    return newest.where(rule.when.holds()).select((F.col("value") + 1).alias("next"))


# --- coverage of sets -------------------------------------------------------------------------------------------------

_BUCKETS = [("half", 2, 1), ("half", 4, 0), ("mixed", 2, 1), ("mixed", 4, 0), ("mixed", 4, 2), ("gaps", 4, 0), ("gaps", 4, 3), ("full", 2, 0), ("full", 2, 1)]


def _buckets(spark: SparkSession) -> DataFrame:
    return values(spark, _BUCKETS, "parent string, modulus int, remainder int")


@query(f"SELECT CAST(r AS INTEGER) AS remainder FROM range(4) AS x(r) WHERE r NOT IN (SELECT remainder FROM {in_sql(_BUCKETS, 'parent, modulus, remainder')} WHERE parent = 'gaps' AND modulus = 4)")
def missing_remainders(spark: SparkSession, t: Callable) -> DataFrame:
    return C.missing_remainders(_buckets(spark).where("parent = 'gaps'"), 4)


_COVERAGE = f"b AS (SELECT * FROM {in_sql(_BUCKETS, 'parent, modulus, remainder')}), l AS (SELECT parent, count(*) AS members, CASE WHEN count(DISTINCT modulus) = 1 THEN CAST(min(modulus) AS INTEGER) END AS modulus, max(modulus) AS lcm FROM b GROUP BY ALL), c AS (SELECT parent, count(DISTINCT r) AS n FROM (SELECT b.parent, unnest(range(b.remainder, l.lcm, b.modulus)) AS r FROM b JOIN l USING (parent)) GROUP BY ALL)"


@query(f"WITH {_COVERAGE} SELECT parent, members, modulus, n = lcm AS complete FROM l JOIN c USING (parent)")
def hash_coverage(spark: SparkSession, t: Callable) -> DataFrame:
    return C.hash_coverage(_buckets(spark), "parent")


@query(f"WITH {_COVERAGE} SELECT parent, CASE WHEN modulus IS NULL THEN CASE WHEN n = lcm THEN 'non_uniform_complete' ELSE 'non_uniform_incomplete' END WHEN modulus <> 4 THEN CASE WHEN n = lcm THEN 'modulus_preserved' ELSE 'modulus_repaired' END ELSE 'same' END AS verdict FROM l JOIN c USING (parent)")
def effective_modulus(spark: SparkSession, t: Callable) -> DataFrame:
    """What becomes of each set if the scheme asks for four buckets, as the planner finds it."""
    rows = [("root", None, None, None, None, "partitioned", "range", ["ts"])] + [(p, "root", "range", None, None, "partitioned", "hash", ["k"]) for p in ("half", "mixed", "gaps", "full")]
    rows += [(f"{p}__{m}_{r}", p, "hash", m, r, "table", None, None) for p, m, r in _BUCKETS]
    nodes = values(spark, rows, "name string, parent_name string, kind string, modulus int, remainder int, relkind string, partition_type string, partition_columns array<string>")
    sets = values(spark, [(p,) for p in ("half", "mixed", "gaps", "full")], "parent string")
    found = []
    for p in ("half", "mixed", "gaps", "full"):
        plan = planner.plan(Table(p, Hash(("k",), modulus=4)), _as_nodes(nodes), C.empty(spark, C.ORPHANS), planner.Context(NOW))
        found.append(plan.findings.select(F.col("partition_name").alias("parent"), F.col("reason").alias("verdict")))
    return sets.join(C.first_of(found), "parent", "left").select("parent", F.coalesce("verdict", F.lit("same")).alias("verdict"))


def _as_nodes(df: DataFrame) -> DataFrame:
    """The columns of a catalogue, null where ``df`` does not have them."""
    from pyspark.sql.types import _parse_datatype_string

    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in _parse_datatype_string(C.NODES).fields])


_CLAIMS = [("p_a", ["purchase", "view"]), ("p_b", ["click"])]


@query(
    f"WITH g AS (SELECT grp, unnest(vals) AS value FROM (VALUES ('buying', ['purchase', 'signup']), ('looking', ['click']), ('leaving', ['logout'])) AS v(grp, vals)), c AS (SELECT name, unnest(vals) AS value FROM {in_sql(_CLAIMS, 'name, vals')}) "
    "SELECT grp, string_agg(value, ', ' ORDER BY value) AS clash FROM g JOIN c USING (value) WHERE grp <> 'looking' GROUP BY ALL"
)
def list_conflicts(spark: SparkSession, t: Callable) -> DataFrame:
    scheme = List(("event_type",), groups=(Group("buying", ("purchase", "signup")), Group("looking", ("click",)), Group("leaving", ("logout",))))
    rows = [("events", None, None, None, "partitioned", "list", ["event_type"])] + [(n, "events", "list", v, "table", None, None) for n, v in _CLAIMS]
    nodes = _as_nodes(values(spark, rows, "name string, parent_name string, kind string, values array<string>, relkind string, partition_type string, partition_columns array<string>"))
    plan = planner.plan(Table("events", scheme), nodes, C.empty(spark, C.ORPHANS), planner.Context(NOW))
    return plan.findings.where("reason = 'list_values_conflict'").select(F.split_part("detail", F.lit(": "), F.lit(1)).alias("grp"), F.split_part("detail", F.lit(": "), F.lit(2)).alias("clash"))


_DAY = 86_400_000_000
_D = micros(dt.datetime(2024, 1, 1))
_MEMBERS = [
    ("m_day", _D, _D + _DAY), ("m_open_low", None, _D - 5 * _DAY), ("m_two_days", _D + 2 * _DAY, _D + 4 * _DAY), ("m_half", _D + 5 * _DAY, _D + 5 * _DAY + _DAY // 2), ("m_open_high", _D + 9 * _DAY, None), ("m_off", _D + 6 * _DAY + 1, _D + 7 * _DAY + 1),
]
_WANTED = [(k, _D + k * _DAY, _D + (k + 1) * _DAY) for k in range(-7, 12)]


@query(f"SELECT k, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT * FROM {in_sql(_WANTED, 'k, s, e')}) w JOIN (SELECT * FROM {in_sql(_MEMBERS, 'name, ms, me')}) m ON coalesce(ms < e, true) AND coalesce(s < me, true) GROUP BY ALL")
def range_overlap(spark: SparkSession, t: Callable) -> DataFrame:
    wanted, members = values(spark, _WANTED, "k int, s long, e long"), values(spark, _MEMBERS, "name string, ms long, me long")
    hit = wanted.join(members, C.overlaps(F.col("s"), F.col("e"), F.col("ms"), F.col("me")))
    return hit.groupBy("k").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


@query(f"SELECT name, coalesce(ms - ms % {_DAY} <= ms AND me <= ms - ms % {_DAY} + {_DAY}, false) AS on_grid FROM {in_sql(_MEMBERS, 'name, ms, me')}")
def on_grid(spark: SparkSession, t: Callable) -> DataFrame:
    return values(spark, _MEMBERS, "name string, ms long, me long").select("name", planner.on_grid(TimeAxis("day"), F.col("ms"), F.col("me")).alias("on_grid"))


_STATUS_ROWS = [
    ("e__day", "2024-01-01", "2024-01-02", "table", 0, 1), ("e__old", "MINVALUE", "2024-01-01", "table", None, 0), ("e__text", "abc", "abd", "table", None, None), ("e__wide", "2024-01-03", "2024-01-05", "table", 2, 4), ("e__far", "2024-01-06", "2024-01-07", "foreign", 5, 6),
]


@query("SELECT * FROM (VALUES ('e__old', 'unbounded_partition', 'info'), ('e__text', 'unreadable_bound', 'warning'), ('e__wide', 'unmanaged_partition', 'info'), ('e__far', 'foreign_partition', 'info')) AS v(name, status, severity)")
def member_status(spark: SparkSession, t: Callable) -> DataFrame:
    rows = [("e", None, None, None, None, None, None, "partitioned", "range", ["ts"])]
    rows += [(n, "e", "range", a, b, None if s is None else _D + s * _DAY, None if e is None else _D + e * _DAY, k, None, None) for n, a, b, k, s, e in _STATUS_ROWS]
    nodes = _as_nodes(values(spark, rows, "name string, parent_name string, kind string, from_value string, to_value string, pos_start long, pos_end long, relkind string, partition_type string, partition_columns array<string>"))
    lifecycle = policy.Lifecycle(policy.CreateAhead(1), policy.AllOf((policy.Not(policy.AllOf()),)))
    plan = planner.plan(Table("e", Range(("ts",), axis=TimeAxis("day")), lifecycle), nodes, C.empty(spark, C.ORPHANS), planner.Context(_D + 100 * _DAY))
    return plan.findings.where("partition_name != 'e'").select(F.col("partition_name").alias("name"), F.col("reason").alias("status"), "severity")


# --- rules ------------------------------------------------------------------------------------------------------------


def _candidates(df: DataFrame, axis: TimeAxis | NumericAxis, cursor: int, keep: int = 1) -> DataFrame:
    """Partitions (o, ...) as rules look at them."""
    c = axis.ordinal_at(cursor)
    return df.withColumns(
        {
            "pos_start": axis.start(F.col("o")), "pos_end": axis.end(F.col("o")), "label": axis.label(F.col("o")), "axis": F.lit(axis.kind), "now": F.lit(cursor).cast("long"),
            "cursor_ord": F.lit(c).cast("long"), "cursor_start": axis.start(F.lit(c).cast("long")), "keep_from": axis.start(F.lit(c - keep + 1).cast("long")),
        }
    )


def _order_months(t: Callable, keep: int = 1) -> DataFrame:
    axis = TimeAxis("month")
    return _candidates(t("orders").groupBy(axis.ordinal(_position("o_orderdate")).alias("o")).agg(F.count("*").alias("row_estimate"), F.sum(F.octet_length("o_orderpriority")).alias("size_bytes")), axis, ORDERS_NOW, keep)


_MONTHS_SQL = "m AS (SELECT date_trunc('month', o_orderdate) AS d, count(*) AS n, CAST(sum(strlen(o_orderpriority)) AS BIGINT) AS size FROM orders GROUP BY ALL)"


@query(f"WITH {_MONTHS_SQL} SELECT strftime(d, '%Y_%m') AS label FROM m WHERE d + INTERVAL 1 MONTH <= TIMESTAMP '1999-01-01'")
def keep_newest(spark: SparkSession, t: Callable) -> DataFrame:
    return _order_months(t, 6).where(policy.KeepNewest(6).holds()).select("label")


@query(f"WITH {_MONTHS_SQL} SELECT strftime(d, '%Y_%m') AS label FROM m WHERE d + INTERVAL 1 MONTH <= TIMESTAMP '1999-06-15' - INTERVAL 90 DAY")
def keep_for(spark: SparkSession, t: Callable) -> DataFrame:
    return _order_months(t).where(policy.KeepFor(dt.timedelta(days=90)).holds()).select("label")


@query("SELECT DISTINCT o_orderkey // 500 AS o FROM orders WHERE (SELECT max(o_orderkey) // 500 * 500 FROM orders) - (o_orderkey // 500 * 500 + 500) >= 3000")
def keep_behind(spark: SparkSession, t: Callable) -> DataFrame:
    axis = NumericAxis(500)
    newest = t("orders").agg(F.max("o_orderkey").alias("newest"))
    steps = t("orders").select(axis.ordinal(F.col("o_orderkey")).alias("o")).distinct().join(F.broadcast(newest))  # one row
    rows = steps.withColumns({"pos_end": axis.end(F.col("o")), "axis": F.lit("integer"), "cursor_start": axis.start(axis.ordinal(F.col("newest")))})
    return rows.where(policy.KeepBehind(3000).holds()).select("o")


@query("SELECT strftime(d, '%Y_%m_%d') AS label FROM (SELECT date_trunc('day', ts) AS d, bool_or(value IS NULL) AS lacking FROM (SELECT ts, CASE WHEN event_id % 400 = 0 THEN NULL ELSE value END AS value FROM events) GROUP BY ALL) WHERE d + INTERVAL 1 DAY <= TIMESTAMP '2024-01-14' AND NOT lacking")
def expire_if_all_of(spark: SparkSession, t: Callable) -> DataFrame:
    """Old enough, and a query over the partition finds no row without a value."""
    axis, nothing = TimeAxis("day"), policy.SqlPredicate("SELECT NOT EXISTS (SELECT 1 FROM {partition} WHERE value IS NULL)")
    df = t("events").withColumn("value", F.when(F.col("event_id") % 400 != 0, F.col("value")))
    answers = df.groupBy(axis.ordinal(_position()).alias("o")).agg(F.create_map(F.lit(nothing.id), ~F.bool_or(F.col("value").isNull())).alias("predicates"))
    rule = policy.ExpireIf(policy.AllOf((policy.KeepNewest(7), nothing)))
    return _candidates(answers, axis, NOW, 7).where(rule.holds()).select("label")


@query(f"WITH {_MONTHS_SQL} SELECT strftime(d, '%Y_%m') AS label FROM m WHERE size > (SELECT avg(size) FROM m) AND NOT n > 1000000")
def size_above(spark: SparkSession, t: Callable) -> DataFrame:
    months = _order_months(t)
    mean = months.agg(F.avg("size_bytes")).first()[0]
    rule = policy.SizeAbove(int(mean)) & ~policy.RowsAbove(1_000_000)
    return months.where(rule.holds()).select("label")


@query(f"WITH {_MONTHS_SQL} SELECT strftime(d, '%Y_%m') AS label, n > 180 AS large FROM m")
def rows_above(spark: SparkSession, t: Callable) -> DataFrame:
    return _order_months(t).select("label", policy.RowsAbove(180).holds().alias("large"))


@query("SELECT c_custkey // 50 AS o, NOT bool_or(c_custkey IN (SELECT o_custkey FROM orders WHERE o_custkey % 100 < 50)) AS free FROM customer GROUP BY ALL")
def unreferenced(spark: SparkSession, t: Callable) -> DataFrame:
    """Partitions of fifty customers to whom no order refers."""
    axis = NumericAxis(50)
    part = t("customer").withColumn("o", axis.ordinal(F.col("c_custkey")))
    used = mover.referenced(part, t("orders").where("o_custkey % 100 < 50"), {"c_custkey": "o_custkey"}, "o")
    return part.select("o").distinct().join(used, "o", "left").withColumn("referenced", F.coalesce("referenced", F.lit(False))).select("o", policy.Unreferenced().holds().alias("free"))


_DETACHED = [("events__2023_12_01", NOW - 8 * _DAY, 500), ("events__2023_12_02", NOW - 6 * _DAY, 500), ("events__2023_12_03", None, 500), ("events__2023_12_04", NOW - 9 * _DAY, 5000), ("events__2023_12_05", NOW - 7 * _DAY, 500)]


@query(f"SELECT name, CASE WHEN at_us + {7 * _DAY} > {NOW} THEN 'grace_pending' WHEN n > 1000 THEN 'drop_deferred' ELSE 'drop' END AS verdict FROM {in_sql(_DETACHED, 'name, at_us, n')}")
def drop_after_grace(spark: SparkSession, t: Callable) -> DataFrame:
    """What the plan does with orphans: waits for their grace, for a rule, or drops them."""
    lifecycle = policy.Lifecycle(policy.CreateAhead(1), policy.KeepNewest(1), policy.DropAfter(dt.timedelta(days=7), ~policy.RowsAbove(1000)))
    rows = [("events", None, "partitioned", "range", ["ts"])]
    nodes = _as_nodes(values(spark, rows, "name string, parent_name string, relkind string, partition_type string, partition_columns array<string>"))
    gone = values(spark, [(n, "events", "table", at) for n, at, _ in _DETACHED], C.ORPHANS)
    facts = values(spark, [(n, None, rows, None, None) for n, _, rows in _DETACHED], C.FACTS)
    plan = planner.plan(Table("events", Range(("ts",), axis=TimeAxis("day")), lifecycle), nodes, gone, planner.Context(NOW), facts=facts)
    dropped = plan.operations.where("kind = 'drop'").select(F.col("target").alias("name"), F.lit("drop").alias("verdict"))
    return dropped.unionByName(plan.findings.select(F.col("partition_name").alias("name"), F.col("reason").alias("verdict")))


@query(f"WITH {_DAYS_SQL} SELECT strftime(d, '%Y_%m_%d') AS label, d + INTERVAL 1 DAY + INTERVAL 6 HOUR <= TIMESTAMP '2024-01-20 12:00:00' AS closed FROM days")
def partition_closed(spark: SparkSession, t: Callable) -> DataFrame:
    return _candidates(_days(t).select("o"), TimeAxis("day"), NOW).select("label", policy.is_closed(dt.timedelta(hours=6)).alias("closed"))


# --- the plan ---------------------------------------------------------------------------------------------------------

PLANNED = Table("events", Range(("ts",), Hash(("user_id",), modulus=4), TimeAxis("day")), policy.Lifecycle(policy.CreateAhead(14), policy.KeepNewest(7), policy.DropAfter(dt.timedelta(0))))


def _event_nodes(spark: SparkSession, t: Callable, holes: bool = True) -> DataFrame:
    """The catalogue of ``events`` by days with four buckets each; the 16th lacks bucket 2, the 17th is a plain table."""
    axis = TimeAxis("day")
    days = _days(t).withColumn("name", F.concat(F.lit("events__"), axis.label(F.col("o"))))
    plain = F.lit(holes) & (F.col("name") == "events__2024_01_17")
    root = _as_nodes(values(spark, [("events", None, "partitioned", "range", ["ts"])], "name string, parent_name string, relkind string, partition_type string, partition_columns array<string>"))
    spans = days.withColumns({"parent_name": F.lit("events"), "kind": F.lit("range"), "from_value": axis.key_literal(F.col("pos_start")), "to_value": axis.key_literal(F.col("pos_end")), "relkind": F.when(plain, "table").otherwise("partitioned"), "partition_type": F.when(~plain, F.lit("hash")), "partition_columns": F.when(~plain, F.array(F.lit("user_id")))})
    buckets = days.where(~plain).select(F.col("name").alias("parent_name"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("remainder")).where(~(F.lit(holes) & (F.col("parent_name") == "events__2024_01_16") & (F.col("remainder") == 2)))
    buckets = buckets.withColumns({"name": N.bucket_name(F.col("parent_name"), F.col("remainder")), "kind": F.lit("hash"), "modulus": F.lit(4), "relkind": F.lit("table")})
    return root.unionByName(_as_nodes(spans)).unionByName(_as_nodes(buckets))


_WANT_SQL = "w AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-20', TIMESTAMP '2024-02-02', INTERVAL 1 DAY)) AS d), new AS (SELECT 'events__' || strftime(d, '%Y_%m_%d') AS name FROM w WHERE d NOT IN (SELECT d FROM days)), gone AS (SELECT 'events__' || strftime(d, '%Y_%m_%d') AS name FROM days WHERE d + INTERVAL 1 DAY <= TIMESTAMP '2024-01-14')"


@query(
    f"WITH {_DAYS_SQL}, {_WANT_SQL} SELECT 'create' AS kind, name AS target, 'create_ahead' AS reason, 'created' AS counts_as FROM new UNION ALL SELECT 'create', name || '__h' || b, 'subtree', 'subtree' FROM new, range(4) AS r(b) "
    "UNION ALL SELECT 'create', 'events__2024_01_16__h2', 'hash_gap', 'repaired' UNION ALL SELECT 'detach', name, 'retention_expired', NULL FROM gone UNION ALL SELECT 'drop', name, 'follows_detach', NULL FROM gone"
)
def plan_operations(spark: SparkSession, t: Callable) -> DataFrame:
    plan = planner.plan(PLANNED, _event_nodes(spark, t), C.empty(spark, C.ORPHANS), planner.Context(NOW))
    return plan.operations.select("kind", "target", "reason", "counts_as")


@query(
    "SELECT * FROM (VALUES ('events__2024_01_17', 'legacy_leaf', 'info'), ('events__default', 'rows_in_default', 'warning'), ('events__2023_12_30', 'unattached_rows', 'warning')) AS v(partition_name, reason, severity)"
)
def plan_findings(spark: SparkSession, t: Callable) -> DataFrame:
    default = _as_nodes(values(spark, [("events__default", "events", "default", "table")], "name string, parent_name string, kind string, relkind string"))
    stray = values(spark, [("events__2023_12_30", "table", True), ("events__2023_12_29", "table", False), ("events__2024_02_01", "table", True)], C.UNATTACHED)
    context = planner.Context(NOW, default_earliest=micros(dt.datetime(2024, 1, 11, 5)))
    plan = planner.plan(PLANNED, _event_nodes(spark, t).unionByName(default), C.empty(spark, C.ORPHANS), context, unattached=stray)
    return plan.findings.select("partition_name", "reason", "severity")


@query("SELECT 0 AS operations, 0 AS findings")
def plan_converged(spark: SparkSession, t: Callable) -> DataFrame:
    """Once a plan's operations are done there is nothing left to do."""
    nodes = _event_nodes(spark, t, holes=False)
    table = Table("events", PLANNED.scheme, policy.Lifecycle(policy.CreateAhead(3), policy.KeepNewest(40)))
    plan = planner.plan(table, nodes, C.empty(spark, C.ORPHANS), planner.Context(micros(dt.datetime(2024, 1, 27, 9))))
    return plan.operations.agg(F.count("*").cast("int").alias("operations")).join(F.broadcast(plan.findings.agg(F.count("*").cast("int").alias("findings"))))  # one row each


@query(
    "SELECT 'orders__' || q || x.suffix AS target, d AS depth FROM (SELECT unnest(['1999_q2', '1999_q3', '1999_q4']) AS q), (SELECT '' AS suffix, 0 AS d UNION ALL SELECT '__urgent', 1 UNION ALL SELECT '__other', 1 UNION ALL SELECT '__' || g || '__h' || b, 2 FROM (SELECT unnest(['urgent', 'other']) AS g), range(4) AS r(b)) x"
)
def plan_subtree(spark: SparkSession, t: Callable) -> DataFrame:
    root = _as_nodes(values(spark, [("orders", None, "partitioned", "range", ["o_orderdate"])], "name string, parent_name string, relkind string, partition_type string, partition_columns array<string>"))
    plan = planner.plan(Table("orders", ORDER_SCHEME, policy.Lifecycle(policy.CreateAhead(3))), root, C.empty(spark, C.ORPHANS), planner.Context(ORDERS_NOW))
    return plan.operations.select("target", "depth")


@query(
    f"WITH {_DAYS_SQL}, {_WANT_SQL}, ops AS (SELECT 'create' AS kind FROM new UNION ALL SELECT 'create' FROM new, range(4) UNION ALL SELECT 'create' UNION ALL SELECT 'detach' FROM gone UNION ALL SELECT 'drop' FROM gone) "
    "SELECT 'terrace_operations{table=\"events\",kind=\"' || k || '\"} ' || (SELECT count(*) FROM ops WHERE kind = k) AS line FROM (SELECT unnest(['create', 'attach', 'detach', 'drop']) AS k) "
    "UNION ALL SELECT 'terrace_findings{table=\"events\",severity=\"' || s || '\"} ' || n FROM (VALUES ('info', 1), ('warning', 0)) AS v(s, n)"
)
def plan_metrics(spark: SparkSession, t: Callable) -> DataFrame:
    return metrics(planner.plan(PLANNED, _event_nodes(spark, t), C.empty(spark, C.ORPHANS), planner.Context(NOW)))


# --- moving rows ------------------------------------------------------------------------------------------------------


def _with_gaps(t: Callable) -> DataFrame:
    return t("events").withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))


_KEYED = Range(("ts", "value"), axis=TimeAxis("day"))


@query("SELECT 'events__' || strftime(ts, '%Y_%m_%d') AS partition, count(*) AS moved, CAST(ceil(count(*) / 100.0) AS BIGINT) AS batches FROM events WHERE event_id % 7 <> 0 GROUP BY ALL")
def backfill_moved(spark: SparkSession, t: Callable) -> DataFrame:
    """What draining DEFAULT moves into each window, and in how many batches of a hundred rows."""
    return mover.tally(mover.drained(_with_gaps(t), _KEYED, "events"), 100)


@query("SELECT count(*) AS stay, count(DISTINCT date_trunc('day', ts)) AS days FROM events WHERE event_id % 7 = 0")
def backfill_null_stays(spark: SparkSession, t: Callable) -> DataFrame:
    stay = mover.staying(_with_gaps(t), _KEYED)
    return stay.agg(F.count("*").alias("stay"), F.count_distinct(F.to_date("ts")).alias("days"))


@query("SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, count(DISTINCT date_trunc('day', ts)) AS partitions FROM events")
def unpartition_union(spark: SparkSession, t: Callable) -> DataFrame:
    """Rows written by partition and read back as one table are the source's rows."""
    path = shared_folder(spark, "unpartition")
    routing.write(t("events"), EVENTS.scheme, path)
    back = mover.unpartitioned(spark, path, t("events").schema, EVENTS.scheme, keep_labels=True)
    return back.agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.count_distinct("p0").alias("partitions"))


@query("SELECT count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-03-05' AND l_shipdate < TIMESTAMP '1996-04-20' AND l_orderkey IN (10, 99, 1234, 5000)")
def pruned_scan(spark: SparkSession, t: Callable) -> DataFrame:
    """A range and an equality of the raw keys over a layout of months with four buckets each."""
    scheme = Range(("l_shipdate",), Hash(("l_orderkey",), modulus=4), TimeAxis("month"))
    path = shared_folder(spark, "pruned")
    routing.write(t("lineitem"), scheme, path)
    laid = mover.unpartitioned(spark, path, t("lineitem").schema, scheme, keep_labels=True)
    span = {"l_shipdate": (micros(dt.datetime(1996, 3, 5)), micros(dt.datetime(1996, 4, 20)))}
    parts = [prune(laid, scheme, span, {"l_orderkey": k}) for k in (10, 99, 1234, 5000)]
    return C.first_of(parts).agg(F.count("*").alias("n"), F.coalesce(F.sum("l_orderkey"), F.lit(None).cast("long")).alias("keys"))
