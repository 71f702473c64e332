import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrace.functions import codecs
from terrace.functions.axis import GRANULARITIES, FiscalAxis, NumericAxis, TimeAxis, Window, instant_of, micros, spelled, unspelled

ZONES = ["UTC", "Europe/Berlin", "America/New_York", "Asia/Kolkata"]
AXES = [TimeAxis(g) for g in GRANULARITIES] + [TimeAxis(g, z) for g in GRANULARITIES if g != "hour" for z in ZONES[1:]]
AXES += [FiscalAxis(g, first_month=m) for g, m in (("month", 10), ("quarter", 4), ("quarter", 1), ("year", 7))] + [FiscalAxis("quarter", "Europe/Berlin", first_month=2)]


@given(st.datetimes(dt.datetime(1901, 1, 1), dt.datetime(2199, 1, 1)), st.sampled_from(AXES))
@settings(max_examples=300, deadline=None)
def test_windows_tile_the_axis(at, axis):
    p = micros(at)
    o = axis.ordinal_at(p)
    assert axis.start_at(o) <= p < axis.start_at(o + 1)
    assert axis.ordinal_at(axis.start_at(o)) == o
    assert axis.ordinal_at(axis.start_at(o + 1) - 1) == o
    assert micros(instant_of(p)) == p


@pytest.mark.parametrize("axis", AXES, ids=lambda a: f"{a.granularity}-{a.tz}")
def test_columns_agree_with_the_driver(spark, axis):
    points = [micros(dt.datetime(1969, 12, 31, 23, 59, 59)), *(micros(dt.datetime(2024, 1, 1)) + k * 17 * 3_600_000_000 * 7 for k in range(-40, 40)), micros(dt.datetime(2026, 3, 29, 1)), micros(dt.datetime(2026, 10, 25, 0, 30)), micros(dt.datetime(2027, 1, 1))]
    df = spark.createDataFrame([(p,) for p in points], "p long").withColumn("o", axis.ordinal(F.col("p")))
    for r in df.select("p", "o", axis.start(F.col("o")).alias("s"), axis.end(F.col("o")).alias("e"), axis.parse(axis.label(F.col("o"))).alias("back")).collect():
        assert r.o == axis.ordinal_at(r.p)
        assert (r.s, r.e) == (axis.start_at(r.o), axis.start_at(r.o + 1))
        assert r.back == r.o


@given(st.integers(-(2**53), 2**53), st.integers(1, 10**6), st.integers(-1000, 1000))
@settings(deadline=None)
def test_numeric_windows_tile(v, step, origin):
    axis = NumericAxis(step, origin)
    o = axis.ordinal_at(v)
    assert axis.start_at(o) <= v < axis.start_at(o + 1)


def test_numeric_columns_and_spelling(spark):
    axis = NumericAxis(7, 3)
    df = spark.range(-30, 30).select(F.col("id").alias("v"), axis.ordinal(F.col("id")).alias("o"))
    for r in df.select("v", "o", axis.start(F.col("o")).alias("s"), axis.parse(axis.label(F.col("o"))).alias("back")).collect():
        assert (r.o, r.s, r.back) == (axis.ordinal_at(r.v), axis.start_at(r.o), r.o)
    one = spark.createDataFrame([("m5",), ("12",), ("m0",), ("-5",), ("05",), ("x",), ("",)], "t string").select(unspelled(F.col("t")).alias("v"), spelled(F.lit(-5)).alias("s")).collect()
    assert [r.v for r in one] == [-5, 12, None, None, None, None, None] and one[0].s == "m5"
    # a label off the grid names no window
    assert spark.range(1).select(axis.parse(F.lit("4")).alias("x")).first().x is None


def test_settings_are_checked():
    for bad in (lambda: TimeAxis("decade"), lambda: TimeAxis("hour", "Europe/Berlin"), lambda: TimeAxis("day", codec="none"), lambda: NumericAxis(0)):
        with pytest.raises(ValueError):
            bad()


def test_codecs(spark):
    p = micros(dt.datetime(2024, 1, 8, 1, 2, 3, 456_000))
    df = spark.createDataFrame([(p,), (-5,), (2**62,)], "p long")
    got = df.select(codecs.uuid7_of(F.col("p")).alias("u")).collect()
    assert got[0].u == f"{p // 1000:012x}"[:8] + "-" + f"{p // 1000:012x}"[8:] + "-7000-8000-000000000000"
    assert got[1].u.startswith("00000000-0000-7") and got[2].u.startswith("ffffffff-ffff-7")
    texts = ["018cc252-100b-7000-8000-000000000000", "018CC252-100B-7ABC-9000-0000000000FF", "018cc252-100b-4000-8000-000000000000", "018cc252100b70008000000000000000", "", None]
    back = spark.createDataFrame([(t,) for t in texts], "t string").select(codecs.micros_of_uuid7(F.col("t")).alias("p")).collect()
    assert [r.p for r in back] == [0x018CC252100B * 1000] * 2 + [None] * 4
    with pytest.raises(ValueError):
        codecs.register(codecs.CODECS["uuidv7"])


def test_own_codec(spark):
    name = "snowflake_test"
    codecs.CODECS.pop(name, None)
    codecs.register(codecs.Codec(name, lambda p: F.shiftleft(codecs.floor_millis(p) - 1_288_834_974_657, 22).cast("string"), lambda k: (F.shiftright(k.cast("long"), 22) + 1_288_834_974_657) * 1000))
    axis = TimeAxis("day", codec=name)
    p = micros(dt.datetime(2024, 5, 6, 7))
    r = spark.range(1).select(axis.ordinal(axis.position(codecs.CODECS[name].encode(F.lit(p)).cast("long"))).alias("o"), axis.key_literal(F.lit(p)).alias("k")).first()
    assert r.o == axis.ordinal_at(p) and r.k == str(((p // 1000) - 1_288_834_974_657) << 22)


def test_windows_of_one_axis_are_ordered():
    w = Window.holding(TimeAxis("month"), micros(dt.datetime(2024, 2, 29)))
    assert w.end == (w + 1).start == micros(dt.datetime(2024, 3, 1)) and (w - 2).start == micros(dt.datetime(2023, 12, 1))
    assert w < w + 1 <= w + 1 and w > w - 1 and w >= w and w.following(2) == [w + 1, w + 2]
    assert sorted([w + 1, w - 3, w]) == [w - 3, w, w + 1]
    for other in (Window(TimeAxis("day"), w.ordinal), Window(TimeAxis("month", "Asia/Kolkata"), w.ordinal), Window(NumericAxis(5), w.ordinal), w.ordinal):
        with pytest.raises(TypeError):
            w < other  # noqa: B015
    assert w != Window(TimeAxis("day"), w.ordinal)


def test_fiscal_labels(spark):
    labels = [("fy2024_q1", 2024 * 4), ("fy2024_q0", None), ("fy2024_q5", None), ("2024_q1", None), ("fy0000_q1", None), (None, None)]
    df = spark.createDataFrame(labels, "l string, o long")
    assert [r[0] for r in df.select(FiscalAxis().parse(F.col("l"))).collect()] == [o for _, o in labels]
    for bad in ({"granularity": "week"}, {"first_month": 0}):
        with pytest.raises(ValueError):
            FiscalAxis(**bad)
