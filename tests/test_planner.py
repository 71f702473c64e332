import datetime as dt

import pytest

from terrace.errors import ConfigError
from terrace.functions.axis import NumericAxis, TimeAxis, micros
from terrace.plans import planner as P
from terrace.plans import policy as R
from terrace.plans.scheme import Group, Hash, List, Range, SlidingList, Table, level_from
from terrace.sources import catalogue as C

NOW = dt.datetime(2024, 1, 20, 12)
MONTH = TimeAxis("month")
AT = MONTH.ordinal_at(micros(NOW))
NAMES = [c.strip().split()[0] for c in C.NODES.split(",") if " " in c.strip()]


def label(o):
    return f"{o // 12:04d}_{o % 12 + 1:02d}"


def node(name, parent=None, **more):
    more.setdefault("relkind", "table")
    return {"name": name, "parent_name": parent, **more}


def month(o, **more):
    return node(f"t__{label(o)}", "t", kind="range", from_value="a", to_value="b", pos_start=MONTH.start_at(o), pos_end=MONTH.start_at(o + 1), **more)


def root(method="range", columns=("ts",)):
    return node("t", relkind="partitioned", partition_type=method, partition_columns=list(columns))


def plan(spark, scheme, nodes, lifecycle=None, orphans=(), facts=None, unattached=None, **context):
    df = spark.createDataFrame([tuple(n.get(c) for c in NAMES) for n in nodes], C.NODES)
    gone = spark.createDataFrame([tuple(o.get(c) for c in ("name", "parent_name", "relkind", "detached_at")) for o in orphans], C.ORPHANS)
    facts = spark.createDataFrame(facts, C.FACTS) if facts else None
    made = P.plan(Table("t", scheme, lifecycle), df, gone, P.Context(micros(NOW), **context), facts=facts, unattached=unattached)
    ops = [(r.kind, r.target, r.reason) for r in made.ordered().collect()]
    return ops, sorted((r.partition_name, r.reason) for r in made.findings.collect()), made


FLAT = Range(("ts",), axis=MONTH)
KEEP = R.Lifecycle(R.CreateAhead(2), R.KeepNewest(2), R.DropAfter(dt.timedelta(days=7)))


def test_creates_ahead_and_is_then_done(spark):
    ops, findings, _ = plan(spark, FLAT, [root()], KEEP)
    assert ops == [("create", f"t__{label(AT + k)}", "create_ahead") for k in range(2)] and findings == []
    ops, findings, _ = plan(spark, FLAT, [root(), month(AT), month(AT + 1)], KEEP)
    assert ops == [] and findings == []


def test_expires_what_is_old_but_never_the_live_window(spark):
    tree = [root(), *(month(AT - k) for k in range(5)), month(AT + 1)]
    ops, _, made = plan(spark, FLAT, tree, KEEP)
    assert ops == [("detach", f"t__{label(AT - k)}", "retention_expired") for k in (4, 3, 2)]
    assert {r.mode for r in made.operations.collect()} == {"auto"}
    everything = R.Lifecycle(R.CreateAhead(1), R.ExpireIf(R.AllOf()), R.DropAfter(dt.timedelta(0)))
    ops, _, made = plan(spark, FLAT, [*tree, node("t__default", "t", kind="default")], everything)
    assert ("detach", f"t__{label(AT)}", "retention_expired") not in ops
    assert ("drop", f"t__{label(AT - 1)}", "follows_detach") in ops
    assert {r.mode for r in made.operations.where("kind = 'detach'").collect()} == {"blocking"}
    assert made.without("detach").count() == 0 and made.only("detach").count() == 4


def test_finer_windows_are_managed_and_coarser_are_not(spark):
    day = MONTH.start_at(AT - 6)
    fine = node("t__day", "t", kind="range", from_value="a", to_value="b", pos_start=day, pos_end=day + 86_400_000_000)
    wide = node("t__wide", "t", kind="range", from_value="a", to_value="b", pos_start=MONTH.start_at(AT - 9), pos_end=MONTH.start_at(AT - 7))
    ops, findings, _ = plan(spark, FLAT, [root(), month(AT), month(AT + 1), fine, wide], KEEP)
    assert ops == [("detach", "t__day", "retention_expired")]
    assert findings == [("t__wide", "unmanaged_partition")]


def test_overlap_is_reported_and_blocks(spark):
    wide = node("t__wide", "t", kind="range", from_value="a", to_value="MAXVALUE", pos_start=MONTH.start_at(AT + 1))
    ops, findings, _ = plan(spark, FLAT, [root(), wide], KEEP)
    assert ops == [("create", f"t__{label(AT)}", "create_ahead")]
    assert findings == [("t", "range_overlap"), ("t__wide", "unbounded_partition")]


def test_orphans_come_back_wait_or_go(spark):
    old = {"relkind": "table", "parent_name": "t"}
    gone = [
        {"name": f"t__{label(AT)}", "detached_at": micros(NOW), **old},
        {"name": f"t__{label(AT - 1)}", "detached_at": micros(NOW), **old},
        {"name": f"t__{label(AT - 9)}", "detached_at": micros(NOW) - 8 * 86_400_000_000, **old},
        {"name": f"t__{label(AT - 8)}", "detached_at": micros(NOW), **old},
        {"name": "t__odd", "detached_at": None, **old},
        {"name": f"t__{label(AT - 7)}", "detached_at": None, "parent_name": "t", "relkind": "foreign"},
    ]
    ops, findings, _ = plan(spark, FLAT, [root(), month(AT + 1)], KEEP, gone)
    assert sorted(ops) == sorted([("attach", f"t__{label(AT)}", "reattach"), ("attach", f"t__{label(AT - 1)}", "reattach"), ("drop", f"t__{label(AT - 9)}", "grace_elapsed"), ("drop", "t__odd", "grace_elapsed")])
    assert findings == [(f"t__{label(AT - 8)}", "grace_pending"), (f"t__{label(AT - 7)}", "foreign_partition")]
    never = R.Lifecycle(R.CreateAhead(2), R.KeepNewest(2), R.DropNever())
    ops, findings, _ = plan(spark, FLAT, [root(), month(AT + 1)], never, gone[:1])
    assert ops == [] and findings == [("t", "name_unusable")]


def test_pending_detach_is_finished_first(spark):
    half = month(AT, detach_pending=True)
    ops, findings, _ = plan(spark, FLAT, [root(), half, month(AT + 1)], KEEP)
    assert ops == [("detach", half["name"], "detach_finalize")] and findings == [(half["name"], "detach_pending")]
    ops, _, _ = plan(spark, FLAT, [root(), half, month(AT + 1)], KEEP, mode=P.RECONCILE)
    assert ops == []


def test_modes(spark):
    ops, _, _ = plan(spark, FLAT, [root(), month(AT - 20)], KEEP, mode=P.EXPLICIT, explicit={"ts": (AT - 3, AT - 3, AT - 20)})
    assert ops == [("create", f"t__{label(AT - 3)}", "explicit")]
    nested = Range(("ts",), Hash(("k",), modulus=2), MONTH)
    branch = month(AT - 20, relkind="partitioned", partition_type="hash", partition_columns=["k"]) | {"relkind": "partitioned"}
    ops, _, _ = plan(spark, nested, [root(), branch, node("b", branch["name"], kind="hash", modulus=2, remainder=0)], KEEP, mode=P.RECONCILE)
    assert ops == [("create", branch["name"] + "__h1", "hash_gap")]


@pytest.mark.parametrize(
    ("have", "ops", "finding"),
    [
        ([(4, 0), (4, 1), (4, 2)], ["t__h3"], None),
        ([(2, 0), (2, 1)], [], "modulus_preserved"),
        ([(2, 0)], ["t__h1"], "modulus_repaired"),
        ([(2, 1), (4, 0)], [], "non_uniform_incomplete"),
        ([(2, 1), (4, 0), (4, 2)], [], "non_uniform_complete"),
        ([], ["t__h0", "t__h1", "t__h2", "t__h3"], None),
    ],
)
def test_hash_sets(spark, have, ops, finding):
    nodes = [root("hash", ("k",)), *(node(f"x{m}_{r}", "t", kind="hash", modulus=m, remainder=r) for m, r in have)]
    got, findings, _ = plan(spark, Hash(("k",), modulus=4), nodes)
    assert [t for _, t, _ in got] == ops
    assert [r for _, r in findings] == ([finding] if finding else [])


def test_lists(spark):
    scheme = List(("c",), groups=(Group("a", ("1", "2")), Group("b", ("3",)), Group("n", (), True)))
    nodes = [root("list", ("c",)), node("t__x", "t", kind="list", values=["2", "1"]), node("t__y", "t", kind="list", values=["3", "4"])]
    ops, findings, _ = plan(spark, scheme, nodes)
    assert ops == [("create", "t__n", "list_group_missing"), ("create", "t__other", "list_default_missing")]
    assert findings == [("t", "list_values_conflict")]


def test_sliding_list(spark):
    nodes = [root("list", ("k",)), *(node(f"t__{k}", "t", kind="list", values=[str(k)]) for k in (3, 4)), node("t__two", "t", kind="list", values=["8", "9"])]
    rule = R.Lifecycle(R.CreateNextIf(R.RowsAbove(10)), R.KeepNewest(1), R.DropAfter(dt.timedelta(7)))
    ops, findings, _ = plan(spark, SlidingList(("k",)), nodes, rule, facts=[("t__4", None, 11, None, None), ("t__3", None, 99, None, None)])
    assert ops == [("create", "t__5", "create_next"), ("detach", "t__3", "retention_expired")]
    assert findings == [("t__two", "unmanaged_partition")]
    ops, _, _ = plan(spark, SlidingList(("k",)), [root("list", ("k",))], rule)
    assert ops == [("create", "t__1", "create_next")]
    with pytest.raises(ConfigError):
        plan(spark, SlidingList(("k",)), nodes, KEEP)


def test_integer_axis_with_cursor(spark):
    axis = NumericAxis(100, 0)
    rows = [root("range", ("id",)), *(node(f"t__{s}", "t", kind="range", from_value=str(s), to_value=str(s + 100), pos_start=s, pos_end=s + 100) for s in (0, 100, 200))]
    rule = R.Lifecycle(R.CreateAhead(2), R.KeepBehind(100), R.DropAfter(dt.timedelta(7)))
    ops, _, _ = plan(spark, Range(("id",), axis=axis), rows, rule, cursors={"id": 250})
    assert ops == [("create", "t__300", "create_ahead"), ("detach", "t__0", "retention_expired")]


def test_nested_windows_in_every_group(spark):
    scheme = List(("tier",), Range(("ts",), axis=MONTH), groups=(Group("gold", ("g",)),))
    gold = node("t__gold", "t", kind="list", values=["g"], partition_type="range", partition_columns=["ts"]) | {"relkind": "partitioned"}
    ops, _, _ = plan(spark, scheme, [root("list", ("tier",)), gold], R.Lifecycle(R.CreateAhead(1)))
    assert sorted(t for _, t, _ in ops) == [f"t__gold__{label(AT)}", "t__other", f"t__other__{label(AT)}"]


def test_what_does_not_fit_is_left_alone(spark):
    nested = Range(("ts",), Hash(("k",), modulus=2), MONTH)
    cases = {
        "legacy_leaf": {},
        "strategy_mismatch": {"relkind": "partitioned", "partition_type": "list", "partition_columns": ["k"]},
        "column_mismatch": {"relkind": "partitioned", "partition_type": "hash", "partition_columns": ["z"]},
    }
    for reason, more in cases.items():
        ops, findings, _ = plan(spark, nested, [root(), month(AT, **more) | more], R.Lifecycle(R.CreateAhead(1)))
        assert ops == [] and findings == [(f"t__{label(AT)}", reason)]
    ops, findings, _ = plan(spark, FLAT, [root(), node("t.odd", "t", kind="range")], KEEP)
    assert ops == [] and findings == [("t", "coverage_unknown")]


def test_a_name_too_long_refuses_the_whole_branch(spark):
    scheme = Range(("ts",), List(("c",), groups=(Group("g" * 55, ("1",)),)), MONTH)
    ops, findings, _ = plan(spark, scheme, [root()], R.Lifecycle(R.CreateAhead(1)))
    assert ops == [] and findings == [(f"t__{label(AT)}", "name_unusable"), (f"t__{label(AT)}", "unconvergeable")]


def test_configurations_are_checked():
    for bad in (
        lambda: Table("t", Range(("ts",), Hash(("ts",)))),
        lambda: Table("t", Range(("a",), Range(("b",), Range(("c",), Range(("d",), Range(("e",), Hash(("f",)))))))),
        lambda: List(("c",), groups=(Group("a", ("1",)), Group("b", ("1",)))),
        lambda: Hash(("k",), modulus=0),
        lambda: Table("t", FLAT, unique=(("id",),)),
        lambda: level_from({"method": "ring", "columns": "a"}),
        lambda: level_from({"method": "hash", "columns": "a", "modulus": 2, "odd": 1}),
    ):
        with pytest.raises(ConfigError):
            bad()
    made = level_from({"method": "range", "columns": "ts", "axis": {"kind": "time", "granularity": "week"}, "child": {"method": "hash", "columns": ["k"], "modulus": 3}})
    assert made == Range(("ts",), Hash(("k",), modulus=3), TimeAxis("week"))
    assert Table("t", made).fingerprint == Table("t", made).fingerprint != Table("t", FLAT).fingerprint


def test_rules_are_never_null(spark):
    blank = spark.createDataFrame([(None,) * 10], "pos_start long, pos_end long, axis string, now long, cursor_start long, keep_from long, size_bytes long, row_estimate long, referenced boolean, predicates map<string,boolean>")
    rules = [R.SizeAbove(1), R.RowsAbove(1), R.WindowAgeAbove(dt.timedelta(1)), R.Unreferenced(), R.SqlPredicate("x"), R.KeepNewest(1), R.KeepBehind(1)]
    got = blank.select(*[r.holds().alias(f"a{i}") for i, r in enumerate(rules)], *[(~r).holds().alias(f"b{i}") for i, r in enumerate(rules)], R.AllOf().holds().alias("all"), R.AnyOf().holds().alias("any")).first()
    assert [got[f"a{i}"] for i in range(7)] == [False] * 7 and [got[f"b{i}"] for i in range(7)] == [True] * 7
    assert got["all"] and not got["any"]
    assert (R.SizeAbove(1) & R.SqlPredicate("x")).facts == {"size_bytes", f"sql:{R.SqlPredicate('x').id}"}
