"""Plans for readers and monitors: text, JSON and Prometheus lines."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.plans.planner import OPERATION, PHASES, Plan

VERSION = 1


def escaped(value: str | Column) -> Column:
    """A label's value for Prometheus."""
    text = value if isinstance(value, Column) else F.lit(value)
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def counted(df: DataFrame, column: str, every: tuple[str, ...]) -> DataFrame:
    """(value, n) for each of ``every``, 0 included."""
    spark = df.sparkSession
    zero = spark.createDataFrame([(v,) for v in every], "value string")
    return zero.join(df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")), "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def metrics(plan: Plan) -> DataFrame:
    """One ``line`` a metric: operations by kind and findings by severity."""

    def lines(df: DataFrame, metric: str, label: str) -> DataFrame:
        return df.select(F.concat(F.lit(metric + '{table="'), escaped(plan.table), F.lit(f'",{label}="'), escaped(F.col("value")), F.lit('"} '), F.col("n").cast("string")).alias("line"))

    kinds = lines(counted(plan.operations, "kind", PHASES), "terrace_operations", "kind")
    return kinds.unionByName(lines(counted(plan.findings, "severity", ("info", "warning")), "terrace_findings", "severity"))


def move_metrics(tally: DataFrame, table: str) -> DataFrame:
    """Lines with the rows, batches and partitions of a move."""
    sums = tally.agg(F.coalesce(F.sum("moved"), F.lit(0)).alias("rows"), F.coalesce(F.sum("batches"), F.lit(0)).alias("batches"), F.count("*").alias("partitions"))
    one = lambda c: F.concat(F.lit(f'terrace_moved_{c}{{table="'), escaped(table), F.lit('"} '), F.col(c).cast("string"))
    return sums.select(F.explode(F.array(*[one(c) for c in ("rows", "batches", "partitions")])).alias("line"))


def envelope(plan: Plan) -> dict[str, Any]:
    """The plan as plain data, to be saved and applied later."""
    return {
        "version": VERSION,
        "table": plan.table,
        "fingerprint": plan.fingerprint,
        "now": plan.now,
        "operations": [{k: v for k, v in r.asDict(True).items() if v is not None} for r in plan.ordered().select(*OPERATION).collect()],
        "findings": [r.asDict() for r in plan.findings.orderBy("partition_name", "reason").collect()],
    }


def to_json(plan: Plan) -> str:
    return json.dumps(envelope(plan), indent=2, sort_keys=True)


def describe(plan: Plan) -> str:
    """The plan in words, a line an operation or finding."""
    data = envelope(plan)
    if not data["operations"] and not data["findings"]:
        return f"{plan.table}: nothing to do"
    lines = [f"{plan.table}: {len(data['operations'])} operations, {len(data['findings'])} findings"]
    lines += [f"  {'  ' * o['depth']}{o['kind']} {o['target']} ({o['reason']})" for o in data["operations"]]
    lines += [f"  {f['severity']}: {f['partition_name']}: {f['reason']}" + (f" ({f['detail']})" if f["detail"] else "") for f in data["findings"]]
    return "\n".join(lines)


def describe_tree(nodes: DataFrame, root: str) -> str:
    """The tree, indented by level."""
    from terrace.sources.catalogue import tree

    rows = tree(nodes, root).orderBy("path").collect()
    return "\n".join(f"{'  ' * r.level}{r.name}" for r in rows)
