"""Names of partitions, identifiers, markers and other spelled values."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MAX_NAME_BYTES = 63
SEPARATOR = "__"
BUCKET_SUFFIX = "__h{remainder}"
_IDENTIFIER = re.compile(r"^[a-z_][a-z0-9_]*$")


def identifier(name: str) -> str:
    """The lower-cased identifier; ValueError if it cannot be one."""
    low = name.lower()
    if not _IDENTIFIER.match(low) or len(low.encode()) > MAX_NAME_BYTES:
        raise ValueError(f"{name!r} is not an identifier of at most {MAX_NAME_BYTES} bytes")
    return low


def child_name(parent: Column, label: Column) -> Column:
    return F.concat(parent, F.lit(SEPARATOR), label)


def bucket_name(parent: Column, remainder: Column) -> Column:
    return F.concat(parent, F.lit(SEPARATOR + "h"), remainder.cast("string"))


def label_of(parent: Column, name: Column) -> Column:
    """What follows the parent and the separator in a child's name; null if the name is not made so."""
    prefix = F.concat(parent, F.lit(SEPARATOR))
    return F.when(F.startswith(name, prefix), F.substring(name, F.length(prefix) + 1, F.length(name)))


def name_fits(name: Column) -> Column:
    return F.octet_length(name) <= MAX_NAME_BYTES


def is_addressable(name: Column) -> Column:
    """A name with a dot cannot be told from a qualified one."""
    return F.instr(name, ".") == 0


def split_qualified(name: str) -> tuple[str | None, str]:
    parts = name.split(".")
    if not 1 <= len(parts) <= 2 or not all(parts):
        raise ValueError(f"{name!r} has neither one nor two parts")
    return (parts[0], parts[1]) if len(parts) == 2 else (None, parts[0])


def qualify(schema: str | None, name: str) -> str:
    return f"{schema}.{name}" if schema else name


def quote_identifier(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quote_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lock_id(prefix: str, table: str) -> int:
    """A signed 64-bit number for a table's lock."""
    return int.from_bytes(hashlib.sha256(f"{prefix}:{table}".encode()).digest()[:8], "big", signed=True)


def marker(parent: str, detached_at: str | None, rest: str = "") -> str:
    """The comment of a detached partition: its parent, when it was detached, and what the comment held before."""
    return "\n".join([parent, detached_at or "", *([rest] if rest else [])])


def marker_parent(comment: Column) -> Column:
    return F.nullif(F.split_part(comment, F.lit("\n"), F.lit(1)), F.lit(""))


def marker_detached_at(comment: Column) -> Column:
    """Microseconds; null if unknown or unreadable."""
    return F.unix_micros(F.try_to_timestamp(F.nullif(F.split_part(comment, F.lit("\n"), F.lit(2)), F.lit(""))))


def marker_rest(comment: Column) -> Column:
    return F.regexp_replace(comment, "^[^\n]*\n?[^\n]*\n?", "")


def duration_text(micros: Column) -> Column:
    """Milliseconds under a second, seconds under a minute, then minutes and hours."""
    seconds = micros / F.lit(1_000_000.0)
    return (
        F.when(seconds < 1, F.format_string("%dms", F.round(seconds * 1000).cast("long")))
        .when(seconds < 60, F.format_string("%.1fs", seconds))
        .when(seconds < 3600, F.format_string("%.1fm", seconds / 60))
        .otherwise(F.format_string("%.1fh", seconds / 3600))
    )
