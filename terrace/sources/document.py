"""Configuration documents: JSON, and YAML where a reader for it is installed."""

from __future__ import annotations

import datetime as dt
import json
import os
import re
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from terrace.errors import ConfigError
from terrace.functions.axis import micros
from terrace.plans import policy as P
from terrace.plans.scheme import Table, axis_kinds, level_from

VERSION = 1
_TOP = {"version", "defaults", "tables", "root", "hooks"}
_TABLE = {"name", "scheme", "lifecycle", "unique", "foreign_leaves", "schema", "hooks"}
_DURATION = re.compile(r"^P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$")
PREFIX = "TERRACE_"


def duration(text: str) -> dt.timedelta:
    """An ISO-8601 duration of weeks, days, hours, minutes and seconds."""
    m = _DURATION.match(text)
    if not m or not any(m.groups()):
        raise ConfigError(f"{text!r} is no duration")
    w, d, h, mi, s = (int(x or 0) for x in m.groups())
    return dt.timedelta(weeks=w, days=d, hours=h, minutes=mi, seconds=s)


def rule_from(data: Any) -> P.Rule:
    """A rule from plain data: one key with its value, such as {"keep_newest": 12} or {"all_of": [...]}."""
    if not isinstance(data, dict) or len(data) != 1:
        raise ConfigError(f"{data!r} is no rule")
    (kind, value), = data.items()
    makers = {
        "size_above": P.SizeAbove, "rows_above": P.RowsAbove, "keep_newest": P.KeepNewest, "keep_behind": P.KeepBehind, "sql": P.SqlPredicate,
        "window_age_above": lambda v: P.WindowAgeAbove(duration(v)), "keep_for": lambda v: P.KeepFor(duration(v)), "unreferenced": lambda v: P.Unreferenced() if v else P.Not(P.Unreferenced()),
        "all_of": lambda v: P.AllOf(tuple(map(rule_from, v))), "any_of": lambda v: P.AnyOf(tuple(map(rule_from, v))), "not": lambda v: P.Not(rule_from(v)), "expire_if": lambda v: P.ExpireIf(rule_from(v)),
    }
    if kind not in makers:
        raise ConfigError(f"unknown rule {kind!r}")
    return makers[kind](value)


def lifecycle_from(data: dict) -> P.Lifecycle:
    data, made = dict(data), {}
    if creation := data.pop("create", None):
        (kind, value), = creation.items()
        makers = {"ahead": P.CreateAhead, "until": lambda v: P.CreateUntil(v if isinstance(v, int) else micros(dt.datetime.fromisoformat(v))), "next_if": lambda v: P.CreateNextIf(rule_from(v))}
        if kind not in makers:
            raise ConfigError(f"unknown creation {kind!r}")
        made["creation"] = makers[kind](value)
    if "retain" in data:
        made["retention"] = rule_from(data.pop("retain"))
    if "drop" in data:
        drop = data.pop("drop")
        made["drop"] = P.DropNever() if drop == "never" else P.DropAfter(duration(drop.get("after", "P7D")), rule_from(drop["when"]) if "when" in drop else None)
    if "detach" in data:
        made["detach"] = data.pop("detach")
    if data:
        raise ConfigError(f"unknown lifecycle settings {sorted(data)}")
    return P.Lifecycle(**made)


@dataclass(frozen=True)
class Document:
    tables: tuple[Table, ...]
    schemas: dict[str, str]
    root: str | None = None
    hooks: dict[str, list[list[str]]] | None = None

    def select(self, names: list[str] | None = None) -> list[Table]:
        """Those tables, or all; an unknown name is refused."""
        if not names:
            return list(self.tables)
        known = {t.name: t for t in self.tables}
        if missing := [n for n in names if n not in known]:
            raise ConfigError(f"no table {missing} in the document")
        return [known[n] for n in names]


def from_data(data: dict) -> Document:
    """Each table's settings over ``defaults``, key by key; unknown keys and repeated tables are refused."""
    if unknown := set(data) - _TOP:
        raise ConfigError(f"unknown settings {sorted(unknown)}")
    if data.get("version") != VERSION:
        raise ConfigError(f"version {data.get('version')!r} is not {VERSION}")
    defaults = data.get("defaults", {})
    if unknown := set(defaults) - (_TABLE - {"name"}):
        raise ConfigError(f"unknown defaults {sorted(unknown)}")
    tables, schemas = [], {}
    for own in data.get("tables", []):
        table = {**defaults, **own}
        if unknown := set(table) - _TABLE:
            raise ConfigError(f"unknown settings {sorted(unknown)} of {table.get('name')}")
        if table["name"] in schemas:
            raise ConfigError(f"{table['name']} is there twice")
        schemas[table["name"]] = table.get("schema", "")
        tables.append(Table(table["name"], level_from(table["scheme"]), lifecycle_from(table.get("lifecycle", {})), tuple(map(tuple, table.get("unique", ()))), table.get("foreign_leaves", False)))
    return Document(tuple(tables), schemas, os.environ.get(PREFIX + "ROOT", data.get("root")), data.get("hooks"))


def json_schema() -> dict:
    """The form of a document as a JSON Schema; what levels and rules mean together is checked on reading."""
    text, names = {"type": "string"}, {"type": "array", "items": {"type": "string"}}
    period = {"type": "string", "pattern": _DURATION.pattern}
    rule = {"$ref": "#/$defs/rule"}
    settings = {
        "size_above": {"type": "integer"}, "rows_above": {"type": "integer"}, "keep_newest": {"type": "integer", "minimum": 0}, "keep_behind": {"type": "integer"}, "sql": text,
        "window_age_above": period, "keep_for": period, "unreferenced": {"type": "boolean"}, "all_of": {"type": "array", "items": rule}, "any_of": {"type": "array", "items": rule}, "not": rule, "expire_if": rule,
    }
    closed = lambda properties, **more: {"type": "object", "additionalProperties": False, "properties": properties, **more}
    one = {"minProperties": 1, "maxProperties": 1}
    level = closed(
        {
            "method": {"enum": ["range", "list", "hash"]}, "columns": {"anyOf": [text, names]}, "child": {"anyOf": [{"$ref": "#/$defs/level"}, {"type": "null"}]},
            "axis": {"type": "object", "properties": {"kind": {"enum": axis_kinds()}}}, "first": {"type": "integer"}, "include_default": {"type": "boolean"}, "default_name": text,
            "groups": {"type": "array", "items": {"type": "object", "required": ["name"]}}, "modulus": {"type": "integer", "minimum": 1},
        },
        required=["method", "columns"],
    )
    lifecycle = closed(
        {
            "create": closed({"ahead": {"type": "integer", "minimum": 0}, "until": {"type": ["integer", "string"]}, "next_if": rule}, **one), "retain": rule,
            "drop": {"anyOf": [{"const": "never"}, closed({"after": period, "when": rule})]}, "detach": text,
        }
    )
    table = {"name": text, "scheme": {"$ref": "#/$defs/level"}, "lifecycle": lifecycle, "unique": {"type": "array", "items": names}, "foreign_leaves": {"type": "boolean"}, "schema": text, "hooks": {"type": "object"}}
    assert set(table) == _TABLE
    defaults = {k: v for k, v in table.items() if k != "name"}
    top = {"version": {"const": VERSION}, "root": text, "hooks": {"type": "object"}, "defaults": closed(defaults), "tables": {"type": "array", "items": closed(table, required=["name"])}}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", **closed(top, required=["version"]), "$defs": {"rule": closed(settings, **one), "level": level}}


def load(path: str) -> Document:
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ConfigError("no YAML reader is installed; use JSON") from e
        return from_data(yaml.safe_load(text))
    return from_data(json.loads(text))
