"""Bounds of partitions as text: reading and writing them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOUNDS = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("from_value", T.StringType()),
        T.StructField("to_value", T.StringType()),
        T.StructField("values", T.ArrayType(T.StringType())),
        T.StructField("includes_null", T.BooleanType()),
        T.StructField("modulus", T.IntegerType()),
        T.StructField("remainder", T.IntegerType()),
    ]
)
_RANGE = re.compile(r"^FOR VALUES FROM \((.*)\) TO \((.*)\)$", re.S)
_LIST = re.compile(r"^FOR VALUES IN \((.*)\)$", re.S)
_HASH = r"^FOR VALUES WITH \(modulus (\d+), remainder (\d+)\)$"


def split_values(text: str) -> list[str]:
    """Elements between commas, a quoted string being one piece with its quotes."""
    out, piece, quoted, depth = [], "", False, 0
    for c in text:
        if c == "'":
            quoted = not quoted
        elif not quoted and c in "([":
            depth += 1
        elif not quoted and c in ")]":
            depth -= 1
        if c == "," and not quoted and depth == 0:
            out.append(piece.strip())
            piece = ""
        else:
            piece += c
    return [*out, piece.strip()] if piece.strip() or out else []


def plain(element: str) -> str | None:
    """The value without quotes and casts; None for the keyword NULL."""
    element = element.strip()
    if m := re.fullmatch(r"CAST\((.*) AS [^()]+(?:\([\d, ]*\))?\)", element, re.S | re.I):
        element = m[1].strip()
    if m := re.match(r"^'((?:[^']|'')*)'(?:::.*)?$", element, re.S):
        return m[1].replace("''", "'")
    element = re.sub(r"::.*$", "", element, flags=re.S).strip()
    return None if element.upper() == "NULL" else element


def parsed(text: str | None) -> dict | None:
    """The bounds as a dict of :data:`BOUNDS`; None for what is not understood.  Of a composite range the leading element counts."""
    text = (text or "").strip()
    base = dict.fromkeys(f.name for f in BOUNDS.fields) | {"includes_null": False}
    if text == "DEFAULT":
        return base | {"kind": "default"}
    if m := re.match(_HASH, text):
        return base | {"kind": "hash", "modulus": int(m[1]), "remainder": int(m[2])}
    if m := _RANGE.match(text):
        low, high = split_values(m[1]), split_values(m[2])
        return base | {"kind": "range", "from_value": plain(low[0]), "to_value": plain(high[0])} if low and high else None
    if m := _LIST.match(text):
        values = [plain(v) for v in split_values(m[1])]
        return base | {"kind": "list", "values": [v for v in values if v is not None], "includes_null": None in values}
    return None


_parsed = F.udf(lambda text: parsed(text), BOUNDS)


def parse(text: Column) -> Column:
    """A struct of :data:`BOUNDS`.  Quoting inside lists and ranges needs a Python function; catalogues are small."""
    return _parsed(text)


def render(bounds: Column) -> Column:
    """The inverse of :func:`parse`, each value quoted."""
    quote = lambda v: F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("''")), F.lit("'"))
    edge = lambda v: F.when(F.upper(v).isin("MINVALUE", "MAXVALUE"), F.upper(v)).otherwise(quote(v))
    values = F.concat(F.transform(F.coalesce(bounds["values"], F.array().cast("array<string>")), quote), F.when(bounds["includes_null"], F.array(F.lit("NULL"))).otherwise(F.array().cast("array<string>")))
    return (
        F.when(bounds["kind"] == "default", "DEFAULT")
        .when(bounds["kind"] == "hash", F.format_string("FOR VALUES WITH (modulus %d, remainder %d)", bounds["modulus"], bounds["remainder"]))
        .when(bounds["kind"] == "range", F.concat(F.lit("FOR VALUES FROM ("), edge(bounds["from_value"]), F.lit(") TO ("), edge(bounds["to_value"]), F.lit(")")))
        .when(bounds["kind"] == "list", F.concat(F.lit("FOR VALUES IN ("), F.array_join(values, ", "), F.lit(")")))
    )


def is_naive_instant(text: Column) -> Column:
    """A full calendar date without an offset."""
    return text.rlike(r"^\d{4}-\d{2}-\d{2}") & ~text.rlike(r"(Z|[+-]\d{2}(:?\d{2})?)$|^\d{4}-\d{2}-\d{2}[+-]") | text.rlike(r"^\d{4}-\d{2}-\d{2}$")


def instant(text: Column, tz: str = "UTC") -> Column:
    """Microseconds of a bound's literal: an ISO date or instant, naive ones in ``tz``; null for MINVALUE, MAXVALUE and anything else."""
    aware = F.unix_micros(F.try_to_timestamp(F.regexp_replace(text, r"([+-]\d{2})$", "$1:00")))
    naive = F.unix_micros(F.to_utc_timestamp(F.try_to_timestamp(text), tz))
    return F.when(~text.rlike("[-:]"), F.lit(None).cast("long")).when(is_naive_instant(text), naive).when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), aware)
