"""Command line: inspect, plan, validate, apply, backfill, schema.

Exit codes: 0 done, 1 failed, 2 incomplete, 3 issues, 4 stale plan, 5 locked, 6 bad configuration, 64 wrong usage, 130 interrupted, 143 terminated.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import signal
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType, _parse_datatype_string

from terrace import report
from terrace.errors import ConfigError, LockHeld, PlanStale, TerraceError
from terrace.hooks import Hooks, command
from terrace.plans.planner import OPERATION, Plan
from terrace.service import LifecycleService
from terrace.sources.document import Document, json_schema, load


USAGE, INTERRUPTED, TERMINATED = 64, 130, 143


def _service(spark: SparkSession, document: Document, name: str, allow_hooks: bool) -> LifecycleService:
    table = document.select([name])[0]
    schema = _parse_datatype_string(document.schemas[name])
    if not isinstance(schema, StructType) or not document.root:
        raise ConfigError(f"{name} needs a schema, and the document a root")
    hooks = Hooks()
    if document.hooks and allow_hooks:
        for phase, commands in document.hooks.items():
            for argv in commands:
                hooks.add(phase, command(argv))
    return LifecycleService(spark, f"{document.root.rstrip('/')}/{name}", table, schema, hooks)


def saved_plan(service: LifecycleService, data: dict) -> Plan:
    """A plan from its envelope."""
    if data.get("version") != report.VERSION:
        raise ConfigError(f"plan version {data.get('version')!r} is not {report.VERSION}")
    spark = service.spark
    empty = service.plan(dt.datetime.fromtimestamp(data["now"] / 1e6, dt.timezone.utc))
    schema = empty.operations.select(*OPERATION).schema
    operations = spark.createDataFrame([tuple(o.get(f.name) for f in schema.fields) for o in data["operations"]], schema)
    findings = spark.createDataFrame([(f["partition_name"], f["reason"], f["detail"], f["severity"]) for f in data["findings"]], "partition_name string, reason string, detail string, severity string")
    return Plan(operations, findings, data["table"], data["fingerprint"], data["now"])


def run(argv: list[str], spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="terrace")
    parser.add_argument("command", choices=["inspect", "plan", "validate", "apply", "backfill", "schema"])
    parser.add_argument("document", nargs="?")
    parser.add_argument("--table", action="append")
    parser.add_argument("--now", help="ISO instant; the clock if left out")
    parser.add_argument("--save", help="write the plans to this file")
    parser.add_argument("--plan", help="apply the plans of this file")
    parser.add_argument("--metrics", action="store_true", help="Prometheus lines instead of text")
    parser.add_argument("--allow-destructive", action="store_true")
    parser.add_argument("--allow-hooks", action="store_true")
    parser.add_argument("--max-windows", type=int)
    try:
        args = parser.parse_args(argv)
        if args.command != "schema" and args.document is None:
            parser.error("a document is needed")
    except SystemExit as e:
        return USAGE if e.code else 0
    if args.command == "schema":
        print(json.dumps(json_schema(), indent=2))
        return 0
    try:
        document = load(args.document)
        tables = document.select(args.table)
        if args.command == "validate":
            print("\n".join(f"{t.name}: {t.fingerprint}" for t in tables))
            return 0
        now = dt.datetime.fromisoformat(args.now) if args.now else dt.datetime.now(dt.timezone.utc)
        spark = spark or SparkSession.builder.appName("terrace").getOrCreate()
        saved = {p["table"]: p for p in json.loads(Path(args.plan).read_text())} if args.plan else {}
        plans, code = [], 0
        for table in tables:
            service = _service(spark, document, table.name, args.allow_hooks)
            if args.command == "inspect":
                print(report.describe_tree(service.store.nodes(), table.name))
            elif args.command == "plan":
                plan = service.plan(now)
                plans.append(report.envelope(plan))
                print("\n".join(r.line for r in report.metrics(plan).collect()) if args.metrics else report.describe(plan))
            elif args.command == "apply":
                with service.store.lock():
                    plan = saved_plan(service, saved[table.name]) if saved else service.plan(now)
                    result = service.apply(plan, destructive=args.allow_destructive)
                print(f"{table.name}: created {result.created}, repaired {result.repaired}, attached {result.attached}, detached {result.detached}, dropped {result.dropped}")
                for issue in result.issues:
                    print(f"  {issue['step']} {issue['partition']}: {issue['error']}")
                code = max(code, 3 if result.issues else 0)
            else:
                moved = service.partition_data(now, max_windows=args.max_windows)
                print(f"{table.name}: moved {moved.rows} rows in {moved.batches} batches into {len(moved.partitions)} partitions")
                code = max(code, 0 if moved.complete else 2)
        if args.save:
            Path(args.save).write_text(json.dumps(plans, indent=2, sort_keys=True))
        return code
    except PlanStale as e:
        print(e, file=sys.stderr)
        return 4
    except LockHeld as e:
        print(e, file=sys.stderr)
        return 5
    except ConfigError as e:
        print(e, file=sys.stderr)
        return 6
    except TerraceError as e:
        print(e, file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        return INTERRUPTED


def main() -> int:
    """Like :func:`run`; a request to terminate ends it as an error does, so locks are given back."""

    def end(*_: object) -> None:
        raise SystemExit(TERMINATED)

    signal.signal(signal.SIGTERM, end)
    return run(sys.argv[1:])


if __name__ == "__main__":
    sys.exit(main())
