"""Partition schemes: levels of RANGE, LIST, sliding LIST and HASH, nested to a depth of five."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

from terrace.errors import ConfigError
from terrace.functions.axis import Axis, FiscalAxis, NumericAxis, SequenceAxis, TimeAxis
from terrace.functions.names import identifier

MAX_DEPTH = 5


@dataclass(frozen=True)
class Level:
    """One level; ``child`` is the scheme of every partition of it."""

    columns: tuple[str, ...]
    child: Level | None = None

    method = ""

    @property
    def progression(self) -> Axis | None:
        """The axis of a level whose windows follow one another; None for a set of fixed members."""
        return None

    def __post_init__(self) -> None:
        if not self.columns:
            raise ConfigError("a level needs a column")
        object.__setattr__(self, "columns", tuple(identifier(c) for c in self.columns))

    @property
    def column(self) -> str:
        return self.columns[0]

    def walk(self) -> list[Level]:
        return [self, *(self.child.walk() if self.child else [])]


@dataclass(frozen=True)
class Range(Level):
    """Windows of an axis over the leading column; the others must not be null for a row to be routed."""

    axis: Axis = field(default_factory=lambda: TimeAxis("month"))
    method = "range"

    @property
    def progression(self) -> Axis:
        return self.axis


@dataclass(frozen=True)
class Group:
    name: str
    values: tuple[str, ...] = ()
    includes_null: bool = False


@dataclass(frozen=True)
class List(Level):
    """Named groups of values, and a DEFAULT for the rest if asked for."""

    groups: tuple[Group, ...] = ()
    include_default: bool = True
    default_name: str = "other"
    method = "list"

    def __post_init__(self) -> None:
        super().__post_init__()
        seen: set[str] = set()
        for g in self.groups:
            identifier(g.name)
            if not g.values and not g.includes_null:
                raise ConfigError(f"group {g.name!r} is empty")
            if both := seen & set(g.values):
                raise ConfigError(f"values {sorted(both)} are in two groups")
            seen |= set(g.values)
        names = [g.name for g in self.groups] + [self.default_name] * self.include_default
        if len(set(names)) < len(names) or sum(g.includes_null for g in self.groups) > 1:
            raise ConfigError("group names repeat, or two groups take null")


@dataclass(frozen=True)
class SlidingList(Level):
    """Partition N holds the rows whose key is N; the cursor is the newest partition."""

    first: int = 1
    method = "list"

    @property
    def progression(self) -> Axis:
        return SequenceAxis(self.first)


@dataclass(frozen=True)
class Hash(Level):
    """``modulus`` buckets.  One integer column is taken modulo; other keys by xxhash64."""

    modulus: int = 8
    method = "hash"

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.modulus < 1:
            raise ConfigError("modulus must be at least 1")


@dataclass(frozen=True)
class Table:
    """A partitioned table: its scheme, and foreign keys and facts of it that the files do not say."""

    name: str
    scheme: Level
    lifecycle: Any = None
    unique: tuple[tuple[str, ...], ...] = ()
    foreign_leaves: bool = False

    def __post_init__(self) -> None:
        levels = self.scheme.walk()
        if len(levels) > MAX_DEPTH:
            raise ConfigError(f"{len(levels)} levels; {MAX_DEPTH} are allowed")
        columns = [c for level in levels for c in level.columns]
        if len(set(columns)) < len(columns):
            raise ConfigError("levels must not share a column")
        for key in self.unique:
            if missing := set(columns) - set(key):
                raise ConfigError(f"unique key {key} lacks {sorted(missing)}")

    @property
    def fingerprint(self) -> str:
        """What a saved plan is held against."""
        return hashlib.sha256(json.dumps(described(self), sort_keys=True, default=str).encode()).hexdigest()[:16]


def described(value: Any) -> Any:
    """Nested dicts and lists of a scheme, a rule or a table, kinds included."""
    if hasattr(value, "__dataclass_fields__"):
        return {"is": type(value).__name__} | {k: described(getattr(value, k)) for k in value.__dataclass_fields__ if not callable(getattr(value, k))}
    if isinstance(value, (list, tuple)):
        return [described(v) for v in value]
    return value


_AXES: dict[str, type] = {"time": TimeAxis, "fiscal": FiscalAxis, "numeric": NumericAxis, "sequence": SequenceAxis}


def register_axis(kind: str, axis: type) -> None:
    """Let documents name an axis of one's own, its settings being the arguments of ``axis``."""
    if _AXES.get(kind, axis) is not axis:
        raise ConfigError(f"an axis {kind!r} is there already")
    _AXES[kind] = axis


def axis_kinds() -> list[str]:
    return sorted(_AXES)


def level_from(data: dict) -> Level:
    """A level, and those under it, from plain data: method, columns, and axis, groups or modulus."""
    data = dict(data)
    method, columns = data.pop("method"), data.pop("columns")
    child = level_from(data.pop("child")) if data.get("child") else data.pop("child", None)
    base = {"columns": (columns,) if isinstance(columns, str) else tuple(columns), "child": child}
    if method == "range":
        axis = dict(data.pop("axis", {"kind": "time", "granularity": "month"}))
        kind = axis.pop("kind", "time")
        if kind not in _AXES:
            raise ConfigError(f"unknown axis {kind!r}")
        base["axis"] = _AXES[kind](**axis)
        made: type[Level] = Range
    elif method == "list" and "first" in data:
        base["first"], made = data.pop("first"), SlidingList
    elif method == "list":
        base["groups"] = tuple(Group(g["name"], tuple(map(str, g.get("values", ()))), g.get("includes_null", False)) for g in data.pop("groups", ()))
        base |= {k: data.pop(k) for k in ("include_default", "default_name") if k in data}
        made = List
    elif method == "hash":
        base["modulus"], made = data.pop("modulus"), Hash
    else:
        raise ConfigError(f"unknown method {method!r}")
    if data:
        raise ConfigError(f"unknown settings {sorted(data)}")
    return made(**base)

