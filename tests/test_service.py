import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from terrace import report
from terrace.__main__ import run, saved_plan
from terrace.errors import ConfigError, HookFailed, LockHeld, PlanStale
from terrace.functions.axis import NumericAxis, TimeAxis, micros
from terrace.hooks import Hooks, command
from terrace.operators.mover import unpartitioned
from terrace.operators.pruning import prune
from terrace.operators.routing import route, write
from terrace.plans import policy as R
from terrace.plans.scheme import Group, Hash, List, Range, Table
from terrace.service import LifecycleService
from terrace.sources.document import from_data
from terrace.streaming.sink import to_table

NOW = dt.datetime(2024, 1, 20, 12)


@pytest.fixture
def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def service(spark, path, schema, hooks=None, **rule):
    rule = {"creation": R.CreateAhead(3), "retention": R.KeepNewest(5), "drop": R.DropAfter(dt.timedelta(days=2)), **rule}
    return LifecycleService(spark, str(path), Table("events", Range(("ts",), Hash(("user_id",), modulus=4), TimeAxis("day")), R.Lifecycle(**rule)), schema, hooks)


def test_life_of_a_table(spark, events, tmp_path):
    s, n = service(spark, tmp_path / "t", events.schema), events.count()
    s.initialise()
    s.initialise()
    s.append(events)
    assert s.read().count() == n == s.store.read("events__default").count()
    first = s.maintain(NOW)
    assert first.created == 3 and [f["reason"] for f in first.findings] == ["rows_in_default"]
    assert s.read().count() == n
    part = s.partition_data(NOW, max_windows=2)
    assert not part.complete and len(part.partitions) == 2 and s.read().count() == n
    rest = s.partition_data(NOW)
    assert rest.complete and s.store.read("events__default").count() == 0 and s.read().count() == n
    assert s.partition_data(NOW).rows == 0
    assert s.read().exceptAll(events).count() == 0
    # every row lies in the partition that its key names
    leaves = {r.name for r in s.store.entries().where("folders is not null").collect()}
    day = events.where("user_id % 4 = 1 and to_date(ts) = date'2024-01-19'")
    assert "events__2024_01_19__h1" in leaves and s.store.read("events__2024_01_19__h1").count() == day.count()
    names = {r.name for r in s.get_partitions_for_pruning({"ts": (micros(dt.datetime(2024, 1, 18)), micros(dt.datetime(2024, 1, 19)))}, {"user_id": 5}).collect()}
    assert names == {"events__2024_01_18__h1", "events__default"}
    second = s.maintain(NOW)
    assert second.detached == 15 and second.dropped == 0 and second.issues == []
    again = s.maintain(NOW)
    assert (again.created, again.detached, again.dropped) == (0, 0, 0)
    # a longer retention brings the detached ones back with their rows
    longer = service(spark, tmp_path / "t", events.schema, retention=R.KeepNewest(60))
    assert longer.maintain(NOW).attached == 15 and longer.read().count() == n
    s.maintain(NOW)
    later = s.maintain(NOW + dt.timedelta(days=3))
    assert later.dropped == 15
    assert s.unpartition(str(tmp_path / "flat")) == s.store.read("events").count()


def test_late_rows_and_integer_axis(spark, tmp_path):
    table = Table("q", Range(("id",), axis=NumericAxis(10)), R.Lifecycle(R.CreateAhead(1), R.KeepBehind(1000)))
    s = LifecycleService(spark, str(tmp_path / "q"), table, spark.range(1).withColumn("x", F.lit("a")).schema)
    s.initialise()
    s.append(spark.range(-15, 25).withColumn("x", F.lit("a")))
    s.append(spark.createDataFrame([(None, "b")], "id long, x string"))
    moved = s.partition_data(NOW)
    assert moved.rows == 40 and set(moved.partitions) == {"q__m20", "q__m10", "q__0", "q__10", "q__20"}
    assert [tuple(r) for r in s.store.read("q__default").collect()] == [(None, "b")]
    assert s.ensure_partition(NOW, 95).created == 1
    s.append(spark.createDataFrame([(91, "z")], "id long, x string"))
    assert s.store.read("q__90").count() == 1


def test_hooks_can_refuse(spark, events, tmp_path):
    seen = []

    def refuse(event):
        if event["partition"].endswith("21"):
            raise ValueError("not that one")

    hooks = Hooks(on_event=lambda e: seen.append((e["phase"], e["partition"]))).add("before_create", refuse)
    s = service(spark, tmp_path / "t", events.schema, hooks)
    s.initialise()
    result = s.maintain(NOW)
    assert result.created == 2 and [i["partition"] for i in result.issues] == ["events__2024_01_21"]
    assert {r.name for r in s.store.nodes().where("kind = 'range'").collect()} == {"events__2024_01_20", "events__2024_01_22"}
    assert s.store.nodes().where("parent_name = 'events__2024_01_21'").count() == 0
    assert ("after_create", "events__2024_01_20") in seen and ("after_create", "events__2024_01_21") not in seen
    command(["true"])({"a": 1})
    with pytest.raises(HookFailed):
        command(["false"])({})
    with pytest.raises(ValueError):
        hooks.add("sometime", print)


def test_one_writer_and_stale_plans(spark, events, tmp_path):
    s = service(spark, tmp_path / "t", events.schema)
    s.initialise()
    with s.store.lock():
        assert s.store.lock().held
        with pytest.raises(LockHeld):
            s.maintain(NOW)
    plan = s.plan(NOW)
    other = service(spark, tmp_path / "t", events.schema, creation=R.CreateAhead(1))
    with pytest.raises(PlanStale):
        other.apply(plan)
    with pytest.raises(PlanStale):
        s.store.publish(s.store.entries(), 0)
    data = json.loads(report.to_json(plan))
    again = saved_plan(s, data)
    assert s.apply(again).created == 3
    assert [i["step"] for i in s.apply(again).issues] == ["create"] * 3  # they exist by now
    assert report.describe(s.plan(NOW)).endswith("nothing to do")
    assert report.describe_tree(s.store.nodes(), "events").splitlines()[0] == "events"


def test_command_line(spark, tmp_path, capsys):
    document = {
        "version": 1,
        "root": str(tmp_path),
        "defaults": {"lifecycle": {"create": {"ahead": 2}, "retain": {"any_of": [{"keep_newest": 3}, {"keep_for": "P90D"}]}, "drop": {"after": "P7D"}}},
        "tables": [{"name": "m", "schema": "ts timestamp, v int", "scheme": {"method": "range", "columns": "ts", "axis": {"kind": "time", "granularity": "month"}}}],
    }
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(document))
    made = from_data(document).tables[0]
    s = LifecycleService(spark, str(tmp_path / "m"), made, spark.createDataFrame([], "ts timestamp, v int").schema)
    s.initialise()
    s.append(spark.createDataFrame([(dt.datetime(2023, 5, 5), 1)], "ts timestamp, v int"))
    now = ["--now", "2024-01-20T12:00:00+00:00"]
    assert run(["validate", str(path)]) == 0
    assert run(["plan", str(path), *now, "--save", str(tmp_path / "plans.json")], spark) == 0
    assert "create m__2024_02 (create_ahead)" in capsys.readouterr().out
    assert run(["plan", str(path), *now, "--metrics"], spark) == 0
    assert 'terrace_operations{table="m",kind="create"} 2' in capsys.readouterr().out
    assert run(["apply", str(path), *now, "--plan", str(tmp_path / "plans.json")], spark) == 0
    assert run(["backfill", str(path), *now], spark) == 0
    assert run(["inspect", str(path)], spark) == 0
    assert "m__2023_05" in capsys.readouterr().out
    assert run(["plan", str(path), "--table", "none"], spark) == 6
    with s.store.lock():
        assert run(["apply", str(path), *now], spark) == 5
    assert run(["nothing", str(path)]) == 64 and run(["plan"]) == 64
    capsys.readouterr()
    assert run(["schema"]) == 0
    schema = json.loads(capsys.readouterr().out)
    assert set(document) <= set(schema["properties"]) and "fiscal" in schema["$defs"]["level"]["properties"]["axis"]["properties"]["kind"]["enum"]
    for bad in ({"version": 2}, {"version": 1, "odd": 1}, {"version": 1, "defaults": {"name": "x"}}, {**document, "tables": document["tables"] * 2}):
        with pytest.raises(ConfigError):
            from_data(bad)


def test_stream_into_a_table(spark, events, tmp_path):
    s = service(spark, tmp_path / "t", events.schema)
    s.initialise()
    s.ensure_partitions(NOW, [dt.datetime(2024, 1, d) for d in range(1, 11)])
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    to_table(stream, s, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert s.read().count() == events.count()
    assert s.store.read("events__default").count() == events.where("ts >= '2024-01-11'").count()


def test_layout_is_pruned(spark, sf_dir, tmp_path):
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    scheme = Range(("l_shipdate",), Hash(("l_orderkey",), modulus=4), TimeAxis("month"))
    path = str(tmp_path / "laid")
    write(lineitem, scheme, path)
    laid = unpartitioned(spark, path, lineitem.schema, scheme, keep_labels=True)
    span = (micros(dt.datetime(1996, 3, 1)), micros(dt.datetime(1996, 4, 1)))

    def files(df):
        return int(df._jdf.queryExecution().executedPlan().collectLeaves().head().selectedPartitions().totalNumberOfFiles())

    month = prune(laid, scheme, {"l_shipdate": span})
    one = prune(laid, scheme, {"l_shipdate": span}, {"l_orderkey": 77})
    expected = lineitem.where("l_shipdate >= '1996-03-01' and l_shipdate < '1996-04-01'")
    assert month.count() == expected.count() and one.count() == expected.where("l_orderkey = 77").count()
    assert files(one.select("l_quantity")) <= 1 < files(month.select("l_quantity")) <= 4 < files(laid.select("l_quantity"))


def test_routing_is_a_partition_of_the_rows(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 5), (None, "zz", 7), (3, "b", -9)], "k long, c string, n long")
    scheme = List(("c",), Hash(("k",), modulus=3), groups=(Group("ab", ("a", "b")), Group("none", (), True)), include_default=False)
    got = {(r.k, r.c): r.partition for r in route(df, scheme, table="t").collect()}
    assert got == {(1, "a"): "t__ab__h1", (2, None): "t__none__h2", (None, "zz"): "t__default", (3, "b"): "t__ab__h0"}
    clash = df.withColumn("partition", F.lit("mine"))
    assert route(clash, Range(("n",), axis=NumericAxis(10))).columns == ["k", "c", "n", "partition", "p0"]
    assert route(df.limit(0), scheme, table="t").count() == 0


def test_rules_that_have_to_measure(spark, events, tmp_path):
    nobody = R.SqlPredicate("SELECT (SELECT count(*) FROM {partition} WHERE user_id = 7) <= 2")
    retention = R.AllOf((R.KeepNewest(5), R.Unreferenced(), R.RowsAbove(0), nobody))
    table = Table("events", Range(("ts",), axis=TimeAxis("day")), R.Lifecycle(R.CreateAhead(1), retention, R.DropAfter(dt.timedelta(days=2))))
    marked = events.where("event_id % 200 = 0").select(F.col("event_id").alias("event"))
    s = LifecycleService(spark, str(tmp_path / "t"), table, events.schema, referencing=[(marked, {"event_id": "event"})], options={"compression": "zstd"})
    s.initialise()
    s.validate()
    s.append(events)
    s.partition_data(NOW)
    s.maintain(NOW)
    day = F.to_date("ts")
    kept = events.groupBy(day.alias("d")).agg((F.count(F.when(F.col("user_id") == 7, 1)) > 2).alias("seven"), F.bool_or(F.col("event_id") % 200 == 0).alias("used"))
    expected = {f"events__{r.d:%Y_%m_%d}" for r in kept.where("d < '2024-01-16' and not seven and not used").collect()}
    listed = {r.name: r.attached for r in s.list_partitions().collect()}
    assert expected and {n for n, attached in listed.items() if not attached} == expected
    assert s.is_partition_closed("events__2024_01_19", NOW, dt.timedelta(hours=6))
    assert not s.is_partition_closed("events__2024_01_19", NOW, dt.timedelta(hours=13))
    assert not s.is_partition_closed("events__default", NOW) and not s.is_partition_closed("none", NOW)
    other = LifecycleService(spark, str(tmp_path / "t"), Table("events", Hash(("user_id",))), events.schema)
    with pytest.raises(ConfigError):
        other.validate()
