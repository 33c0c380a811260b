"""Sums by host, balanced placement, distributed accumulation."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import owner
from .ordering import indexed


def total(df: DataFrame, value: str, name: str = "total", kind: str = "bigint") -> DataFrame:
    """One row with the sum, 0 for no rows."""
    return df.agg(F.coalesce(F.sum(value), F.lit(0)).cast(kind).alias(name))


def grouped_edges(edges: DataFrame) -> DataFrame:
    """(src, edges): every edge under its source. A group is one source's edges; count or join on src where those may be many."""
    others = [c for c in edges.columns if c != "src"]
    return edges.groupBy("src").agg(F.collect_list(F.struct(*others)).alias("edges"))


def virtual_host_counts(edges: DataFrame, n: int) -> DataFrame:
    """(vhost, edges) of each virtual host that has any, by source."""
    return edges.groupBy(owner(F.col("src"), n).alias("vhost")).agg(F.count(F.lit(1)).alias("edges"))


def balanced_hosts(counts: DataFrame, hosts: int) -> DataFrame:
    """(vhost, edges, host): largest first, each to the least loaded host. A row a virtual host, so it is worked out on the driver."""
    rows = counts.collect()
    load = [(0, h) for h in range(hosts)]
    heapq.heapify(load)
    out = []
    for r in sorted(rows, key=lambda r: (-r["edges"], r["vhost"])):
        n, h = heapq.heappop(load)
        out.append((r["vhost"], r["edges"], h))
        heapq.heappush(load, (n + r["edges"], h))
    return counts.sparkSession.createDataFrame(out, "vhost int, edges long, host int")


def round_robin_hosts(counts: DataFrame, hosts: int) -> DataFrame:
    """(vhost, edges, host): in ascending order of counts, dealt out in turn."""
    placed = indexed(counts, ["edges", "vhost"], "place")
    return placed.select("vhost", "edges", F.pmod("place", F.lit(hosts)).cast("int").alias("host"))


def masked_accuracy(df: DataFrame, predicted: str, truth: str, mask: str) -> DataFrame:
    """One row (total, correct) over the masked rows."""
    return df.filter(mask).agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum((F.col(predicted) == F.col(truth)).cast("bigint")), F.lit(0)).alias("correct"))
