"""Keys that encode an instant: a pair of Column builders each, by name in a registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_MILLIS = 2**48 - 1
_UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


@dataclass(frozen=True)
class Codec:
    """``encode``: microseconds to the smallest key of that instant, as text; ``decode``: a key to microseconds, or null."""

    name: str
    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]


def floor_millis(position: Column) -> Column:
    return F.call_function("div", position - F.pmod(position, F.lit(1000).cast("long")), F.lit(1000).cast("long"))


def uuid7_of(position: Column) -> Column:
    """The smallest version 7 UUID of the instant's millisecond; instants outside its 48 bits are clamped."""
    millis = F.greatest(F.lit(0).cast("long"), F.least(floor_millis(position), F.lit(MAX_MILLIS)))
    digits = F.lpad(F.lower(F.hex(millis)), 12, "0")
    return F.concat(F.substring(digits, 1, 8), F.lit("-"), F.substring(digits, 9, 4), F.lit("-7000-8000-000000000000"))


def micros_of_uuid7(key: Column) -> Column:
    """Null for other versions and for what is no UUID."""
    text = F.lower(key.cast("string"))
    millis = F.conv(F.substring(F.replace(text, F.lit("-"), F.lit("")), 1, 12), 16, 10).try_cast("long")
    return F.when(text.rlike(_UUID) & (F.substring(text, 15, 1) == "7"), millis * 1000)


def micros_of_seconds(key: Column) -> Column:
    return F.when(F.abs(key.cast("long")) <= 9_223_372_036_854, key.cast("long") * 1_000_000)


def micros_of_millis(key: Column) -> Column:
    return F.when(F.abs(key.cast("long")) <= 9_223_372_036_854_775, key.cast("long") * 1000)


def seconds_of(position: Column) -> Column:
    return F.call_function("div", position - F.pmod(position, F.lit(1_000_000).cast("long")), F.lit(1_000_000).cast("long")).cast("string")


CODECS: dict[str, Codec] = {
    c.name: c
    for c in (
        Codec("uuidv7", uuid7_of, micros_of_uuid7),
        Codec("epoch_seconds", seconds_of, micros_of_seconds),
        Codec("epoch_milliseconds", lambda p: floor_millis(p).cast("string"), micros_of_millis),
    )
}


def register(codec: Codec) -> None:
    """Add a codec of one's own (a Snowflake id, say); its name must be free."""
    if codec.name in CODECS:
        raise ValueError(f"codec {codec.name!r} exists")
    CODECS[codec.name] = codec


def key_range(key: Column, codec: str, low: int, high: int) -> Column:
    """key >= the smallest key of ``low`` and key < that of ``high`` (microseconds): a predicate on the raw key, so it can be pushed down."""
    found = CODECS[codec]
    first, last = found.encode(F.lit(low).cast("long")), found.encode(F.lit(high).cast("long"))
    if codec == "uuidv7":
        return (key >= first) & (key < last)
    return (key >= first.cast("long")) & (key < last.cast("long"))
