"""Summaries of runtime traces: memory operations by phase and source host, and core cycles from a statistics file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Names of counters in a memory trace, and the class in which each counts.
OPERATION_CLASSES = {"ATOMIC_LOAD": "load", "ATOMIC_STORE": "rmw", "ATOMIC_COMPARE_EXCHANGE": "rmw", "ATOMIC_INCREMENT": "rmw", "ATOMIC_DECREMENT": "rmw", "ATOMIC_FETCH_ADD": "rmw", "ATOMIC_FETCH_SUB": "rmw", "LOAD": "load", "STORE": "store", "FUNC": "func", "WAIT_GROUP": "waitgroup"}


def memory_summary(trace: DataFrame) -> DataFrame:
    """(host, phase, source, class, count, bytes) from lines (host, line_no, value) of the hosts' traces.

    A ``Phase`` line begins the host's next phase, a ``Source Node n`` line names the source of the counters after it.
    A host's trace is a task's, in line order.
    """
    order = Window.partitionBy("host").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    phase = F.sum(F.col("value").contains("Phase").cast("int")).over(order) - 1
    source = F.last(F.regexp_extract("value", r"Source Node\s+(\d+)", 1).try_cast("int"), ignorenulls=True).over(order)
    name, unit, n = (F.regexp_extract("value", r"([A-Z_]+) \((count|bytes)\)\D*(\d+)", k) for k in (1, 2, 3))
    kind = F.coalesce(*(F.when(name == k, F.lit(v)) for k, v in OPERATION_CLASSES.items()))
    rows = trace.select("host", phase.alias("phase"), source.alias("source"), kind.alias("class"), unit.alias("unit"), n.try_cast("bigint").alias("n")).filter("class is not null and source is not null and phase >= 0")
    total = lambda u: F.coalesce(F.sum(F.when(F.col("unit") == u, F.col("n"))), F.lit(0))
    return rows.groupBy("host", "phase", "source", "class").agg(total("count").alias("count"), total("bytes").alias("bytes"))


def cycle_summary(statistics: DataFrame, phase: str) -> DataFrame:
    """(host, core, stall, busy, total) from statistics (component, statistic, value): cores are ``*_<core>_*_pxn<host>``; command processors don't count."""
    part = F.split("component", "_")
    core, host = F.get(part, F.lit(1)).try_cast("int"), F.substring(F.get(part, F.lit(3)), 4, 9).try_cast("int")
    rows = statistics.filter(~F.col("component").startswith("command")).select(host.alias("host"), core.alias("core"), "statistic", F.col("value").cast("bigint").alias("value"))
    of = lambda s: F.coalesce(F.sum(F.when(F.col("statistic") == f"{phase}_{s}_cycles", F.col("value"))), F.lit(0))
    return rows.filter("host is not null and core is not null").groupBy("host", "core").agg(of("stall").alias("stall"), of("busy").alias("busy")).withColumn("total", F.col("stall") + F.col("busy"))
