"""Axes: how positions of a key fall into windows.

A position is a BIGINT: microseconds since the epoch on a time axis, the value
itself on an integer axis.  A window of a grid has an ordinal, and everything
else (start, end, label, shift) is arithmetic on it, so all of it stays in
generated code and runs on a column as well as on a literal.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrace.functions.codecs import CODECS, Codec

DAY_MICROS = 86_400_000_000
HOUR_MICROS = 3_600_000_000
GRANULARITIES = ("hour", "day", "week", "month", "quarter", "year")
_EPOCH = dt.date(1970, 1, 1)


def floor_div(value: Column, by: int) -> Column:
    """Integer division rounding down, exact for all BIGINT values (``div`` rounds towards zero, ``floor`` goes through DOUBLE)."""
    if by == 1:
        return value
    step = F.lit(by).cast("long")
    return F.call_function("div", value - F.pmod(value, step), step)


def micros(instant: dt.datetime) -> int:
    """Microseconds since the epoch; a naive instant is taken as UTC."""
    if instant.tzinfo is None:
        instant = instant.replace(tzinfo=dt.timezone.utc)
    return (instant - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)


def instant_of(position: int) -> dt.datetime:
    return dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=position)


@dataclass(frozen=True)
class TimeAxis:
    """Calendar windows of one granularity, on local days of ``tz``; hours are UTC's.

    ``codec`` names how a key that is not an instant encodes one.
    """

    granularity: str
    tz: str = "UTC"
    codec: str | None = None
    kind: str = "time"

    def __post_init__(self) -> None:
        if self.granularity not in GRANULARITIES:
            raise ValueError(f"unknown granularity {self.granularity!r}")
        if self.codec is not None and self.codec not in CODECS:
            raise ValueError(f"unknown codec {self.codec!r}")
        if self.granularity == "hour" and self.tz != "UTC":
            raise ValueError("hour windows are in UTC")
        ZoneInfo(self.tz)

    # positions ------------------------------------------------------------------------------------------------------

    def position(self, key: Column) -> Column:
        """The key's position; null where it cannot be decoded."""
        found: Codec | None = CODECS.get(self.codec) if self.codec else None
        return found.decode(key) if found else F.unix_micros(key.cast("timestamp"))

    def key_literal(self, position: Column) -> Column:
        """How a bound at ``position`` is spelled: the codec's value, or a local date (an instant for hours)."""
        if self.codec:
            return CODECS[self.codec].encode(position)
        if self.granularity == "hour":
            return F.date_format(F.timestamp_micros(position), "yyyy-MM-dd HH:00:00+00")
        return F.date_format(F.from_utc_timestamp(F.timestamp_micros(position), self.tz), "yyyy-MM-dd")

    # ordinals -------------------------------------------------------------------------------------------------------

    def ordinal(self, position: Column) -> Column:
        if self.granularity == "hour":
            return floor_div(position, HOUR_MICROS)
        local = F.from_utc_timestamp(F.timestamp_micros(position), self.tz)
        if self.granularity == "day":
            return F.unix_date(F.to_date(local)).cast("long")
        if self.granularity == "week":
            return floor_div(F.unix_date(F.to_date(local)).cast("long") + 3, 7)
        years = F.year(local).cast("long")
        if self.granularity == "month":
            return years * 12 + F.month(local) - 1
        if self.granularity == "quarter":
            return years * 4 + F.quarter(local) - 1
        return years

    def first_day(self, ordinal: Column) -> Column:
        """The local date on which the window begins."""
        if self.granularity == "hour":
            return F.date_from_unix_date(floor_div(ordinal, 24).cast("int"))
        if self.granularity == "day":
            return F.date_from_unix_date(ordinal.cast("int"))
        if self.granularity == "week":
            return F.date_from_unix_date((ordinal * 7 - 3).cast("int"))
        per_year = {"month": 12, "quarter": 4, "year": 1}[self.granularity]
        month = F.pmod(ordinal, F.lit(per_year)) * (12 // per_year) + 1
        return F.make_date(floor_div(ordinal, per_year).cast("int"), month.cast("int"), F.lit(1))

    def start(self, ordinal: Column) -> Column:
        if self.granularity == "hour":
            return ordinal * HOUR_MICROS
        return F.unix_micros(F.to_utc_timestamp(self.first_day(ordinal).cast("timestamp"), self.tz))

    def end(self, ordinal: Column) -> Column:
        return self.start(ordinal + 1)

    # labels ---------------------------------------------------------------------------------------------------------

    def label(self, ordinal: Column) -> Column:
        day = self.first_day(ordinal)
        if self.granularity == "hour":
            return F.concat(F.date_format(day, "yyyy_MM_dd_"), F.lpad(F.pmod(ordinal, F.lit(24)).cast("string"), 2, "0"))
        if self.granularity == "day":
            return F.date_format(day, "yyyy_MM_dd")
        if self.granularity == "week":
            thursday = F.date_add(day, 3)
            return F.concat(F.lpad(F.year(thursday).cast("string"), 4, "0"), F.lit("_w"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
        if self.granularity == "month":
            return F.date_format(day, "yyyy_MM")
        if self.granularity == "quarter":
            return F.concat(F.date_format(day, "yyyy"), F.lit("_q"), F.quarter(day).cast("string"))
        return F.date_format(day, "yyyy")

    def parse(self, label: Column) -> Column:
        """The ordinal of a label; null if it is no label of this granularity or names no real window."""
        forms = {
            "hour": r"^(\d{4})_(\d{2})_(\d{2})_(\d{2})$",
            "day": r"^(\d{4})_(\d{2})_(\d{2})()$",
            "week": r"^(\d{4})_w(\d{2})()()$",
            "month": r"^(\d{4})_(\d{2})()()$",
            "quarter": r"^(\d{4})_q(\d)()()$",
            "year": r"^(\d{4})()()()$",
        }
        part = lambda k: F.regexp_extract(label, forms[self.granularity], k).try_cast("int")
        year, second = part(1), part(2)
        if self.granularity in ("hour", "day"):
            day = F.when(second.between(1, 12) & (part(3) >= 1) & (part(3) <= F.day(F.last_day(F.make_date(year, F.least(F.greatest(second, F.lit(1)), F.lit(12)), F.lit(1))))), F.make_date(year, second, F.least(part(3), F.lit(28))))
            number = F.unix_date(day).cast("long") + F.greatest(part(3) - 28, F.lit(0))
            found = number if self.granularity == "day" else F.when(part(4) <= 23, number * 24 + part(4))
        elif self.granularity == "week":
            # The week that holds 4 January is week 1; 53 is real only if its Thursday is in the year.
            first = floor_div(F.unix_date(F.make_date(year, F.lit(1), F.lit(4))).cast("long") + 3, 7)
            found = F.when(second.between(1, 53) & (F.year(F.date_from_unix_date(((first + second - 1) * 7).cast("int"))) == year), first + second - 1)
        elif self.granularity == "month":
            found = F.when(second.between(1, 12), year.cast("long") * 12 + second - 1)
        elif self.granularity == "quarter":
            found = F.when(second.between(1, 4), year.cast("long") * 4 + second - 1)
        else:
            found = year.cast("long")
        return F.when(label.rlike(forms[self.granularity]) & (year >= 1), found)

    # on the driver --------------------------------------------------------------------------------------------------

    def ordinal_at(self, position: int) -> int:
        if self.granularity == "hour":
            return position // HOUR_MICROS
        day = instant_of(position).astimezone(ZoneInfo(self.tz)).date()
        number = (day - _EPOCH).days
        return {"day": number, "week": (number + 3) // 7, "month": day.year * 12 + day.month - 1, "quarter": day.year * 4 + (day.month - 1) // 3, "year": day.year}[self.granularity]

    def start_at(self, ordinal: int) -> int:
        if self.granularity == "hour":
            return ordinal * HOUR_MICROS
        if self.granularity in ("day", "week"):
            day = _EPOCH + dt.timedelta(days=ordinal if self.granularity == "day" else ordinal * 7 - 3)
        else:
            per_year = {"month": 12, "quarter": 4, "year": 1}[self.granularity]
            day = dt.date(ordinal // per_year, ordinal % per_year * (12 // per_year) + 1, 1)
        return micros(dt.datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(self.tz)))


@dataclass(frozen=True)
class FiscalAxis(TimeAxis):
    """Months, quarters or years of a year that begins with ``first_month``, named after the calendar year in which it begins.

    A calendar of one's own is a class like this: ordinals, first days and labels
    as columns, and the same two on the driver.
    """

    granularity: str = "quarter"
    first_month: int = 4

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.granularity not in ("month", "quarter", "year"):
            raise ValueError(f"no fiscal {self.granularity}")
        if not 1 <= self.first_month <= 12:
            raise ValueError("first_month is 1 to 12")

    @property
    def per_year(self) -> int:
        return {"month": 12, "quarter": 4, "year": 1}[self.granularity]

    def ordinal(self, position: Column) -> Column:
        local = F.from_utc_timestamp(F.timestamp_micros(position), self.tz)
        return floor_div(F.year(local).cast("long") * 12 + F.month(local) - self.first_month, 12 // self.per_year)

    def first_day(self, ordinal: Column) -> Column:
        month = ordinal * (12 // self.per_year) + (self.first_month - 1)
        return F.make_date(floor_div(month, 12).cast("int"), (F.pmod(month, F.lit(12)) + 1).cast("int"), F.lit(1))

    def label(self, ordinal: Column) -> Column:
        year = F.concat(F.lit("fy"), F.lpad(floor_div(ordinal, self.per_year).cast("string"), 4, "0"))
        number = (F.pmod(ordinal, F.lit(self.per_year)) + 1).cast("string")
        return {"month": F.concat(year, F.lit("_p"), F.lpad(number, 2, "0")), "quarter": F.concat(year, F.lit("_q"), number), "year": year}[self.granularity]

    def parse(self, label: Column) -> Column:
        form = {"month": r"^fy(\d{4})_p(\d{2})$", "quarter": r"^fy(\d{4})_q(\d)$", "year": r"^fy(\d{4})()$"}[self.granularity]
        year = F.regexp_extract(label, form, 1).try_cast("long")
        number = F.lit(1).cast("long") if self.per_year == 1 else F.regexp_extract(label, form, 2).try_cast("long")
        return F.when(label.rlike(form) & (year >= 1) & number.between(1, self.per_year), year * self.per_year + number - 1)

    def ordinal_at(self, position: int) -> int:
        day = instant_of(position).astimezone(ZoneInfo(self.tz)).date()
        return (day.year * 12 + day.month - self.first_month) // (12 // self.per_year)

    def start_at(self, ordinal: int) -> int:
        month = ordinal * (12 // self.per_year) + self.first_month - 1
        return micros(dt.datetime(month // 12, month % 12 + 1, 1, tzinfo=ZoneInfo(self.tz)))


@dataclass(frozen=True)
class NumericAxis:
    """Windows of ``step`` integers, one of them beginning at ``origin``."""

    step: int
    origin: int = 0
    kind: str = "integer"

    def __post_init__(self) -> None:
        if self.step < 1:
            raise ValueError("step must be at least 1")

    def position(self, key: Column) -> Column:
        return key.cast("long")

    def key_literal(self, position: Column) -> Column:
        return position.cast("string")

    def ordinal(self, position: Column) -> Column:
        return floor_div(position - self.origin, self.step)

    def start(self, ordinal: Column) -> Column:
        return ordinal * self.step + self.origin

    def end(self, ordinal: Column) -> Column:
        return self.start(ordinal + 1)

    def label(self, ordinal: Column) -> Column:
        return spelled(self.start(ordinal))

    def parse(self, label: Column) -> Column:
        value = unspelled(label)
        return F.when(F.pmod(value - self.origin, F.lit(self.step).cast("long")) == 0, floor_div(value - self.origin, self.step))

    def ordinal_at(self, position: int) -> int:
        return (position - self.origin) // self.step

    def start_at(self, ordinal: int) -> int:
        return ordinal * self.step + self.origin


class SequenceAxis(NumericAxis):
    """Every value is a window of its own; the sequence begins at ``first``."""

    def __init__(self, first: int = 1) -> None:
        super().__init__(1, 0)
        object.__setattr__(self, "first", first)


Axis = TimeAxis | NumericAxis


@dataclass(frozen=True)
class Window:
    """One window of an axis, on the driver.  Windows of one axis are ordered; those of different axes are not comparable."""

    axis: Axis
    ordinal: int

    @classmethod
    def holding(cls, axis: Axis, position: int) -> Window:
        return cls(axis, axis.ordinal_at(position))

    @property
    def start(self) -> int:
        return self.axis.start_at(self.ordinal)

    @property
    def end(self) -> int:
        return self.axis.start_at(self.ordinal + 1)

    def __add__(self, by: int) -> Window:
        return Window(self.axis, self.ordinal + by)

    def __sub__(self, by: int) -> Window:
        return self + -by

    def following(self, n: int) -> list[Window]:
        """The ``n`` windows after this one."""
        return [self + k for k in range(1, n + 1)]

    def _other(self, other: object) -> int:
        if not isinstance(other, Window) or type(other.axis) is not type(self.axis) or other.axis != self.axis:
            raise TypeError(f"{self} cannot be compared with {other}")
        return other.ordinal

    def __lt__(self, other: object) -> bool:
        return self.ordinal < self._other(other)

    def __le__(self, other: object) -> bool:
        return self.ordinal <= self._other(other)

    def __gt__(self, other: object) -> bool:
        return self.ordinal > self._other(other)

    def __ge__(self, other: object) -> bool:
        return self.ordinal >= self._other(other)


def spelled(value: Column) -> Column:
    """An integer in a name: a minus sign becomes m."""
    return F.regexp_replace(value.cast("string"), "^-", "m")


def unspelled(text: Column) -> Column:
    """The integer of :func:`spelled`; null for anything else."""
    return F.when(text.rlike("^(m[1-9][0-9]*|0|[1-9][0-9]*)$"), F.regexp_replace(text, "^m", "-").try_cast("long"))
