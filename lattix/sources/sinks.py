"""What programs write and print: counts by host, distances in order, adjacency, timings."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph


def write_host_counts(graph: Graph, n: int, path: str) -> None:
    """CSV with a header: Host, Category, Count."""
    graph.host_counts(n).write.mode("overwrite").option("header", True).csv(path)


def write_adjacency(graph: Graph, path: str) -> None:
    """A line a vertex: its sorted neighbours, in the order of ids."""
    adjacency = graph.vertices.join(graph.adjacency(), "id", "left")
    line = F.coalesce(F.array_join("neighbours", " "), F.lit(""))
    adjacency.orderBy("id").select(line.alias("value")).write.mode("overwrite").text(path)


def write_distances(distances: DataFrame, path: str) -> None:
    """A line a vertex in the order of ids; empty where it isn't reached."""
    distances.orderBy("id").select(F.coalesce(F.col("distance").cast("string"), F.lit("")).alias("value")).write.mode("overwrite").text(path)


@contextmanager
def timed(name: str, into: dict[str, float]) -> Iterator[None]:
    """Wall seconds of a phase, added to into[name]. Laziness: a phase without an action takes no time."""
    began = time.perf_counter()
    try:
        yield
    finally:
        into[name] = into.get(name, 0.0) + time.perf_counter() - began
