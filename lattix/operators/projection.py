"""Projection of a graph to an induced, relabelled subgraph, and the projections of the workflows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..schemas import NO_UNIVERSITY, PROJECTED_TOPIC, RELATIONS


@dataclass(frozen=True)
class Projection:
    """keep_vertex and keep_edge are conditions on rows; the maps give the columns of the projected rows."""

    keep_vertex: Column
    keep_edge: Column
    map_vertices: Callable[[DataFrame], DataFrame] = lambda v: v
    map_edges: Callable[[DataFrame], DataFrame] = lambda e: e
    keep_edgeless: bool = True


def project(graph: Graph, p: Projection) -> Graph:
    """An edge stays if its source stays and keep_edge holds; without keep_edgeless, vertices need an out-edge that stays."""
    kept = graph.vertices.filter(p.keep_vertex)
    edges = graph.edges.filter(p.keep_edge).join(kept.select(F.col("id").alias("src")), "src", "left_semi").select(*graph.edges.columns)
    if not p.keep_edgeless:
        kept = kept.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_semi")
    return Graph(p.map_vertices(kept), p.map_edges(edges))


def sales_projection(topic: int = PROJECTED_TOPIC, person: str = "PERSON") -> Projection:
    """People who trade in one topic."""
    edge = F.col("type").isin("PURCHASE", "SALE") & (F.col("topic") == topic) & (F.col("amount") > 0) & (F.col("dst_type") == person)
    return Projection(F.col("type") == person, edge, map_edges=lambda e: e.select("src", "dst", "type", "amount"), keep_edgeless=False)


def relation_projection(relations: dict[str, int] = RELATIONS) -> Projection:
    return Projection(F.lit(True), F.col("type").isin(list(relations.values())))


def entity_labels(vertices: DataFrame, edges: DataFrame, *, award: int = RELATIONS["award-winner"], affiliation: int = RELATIONS["affiliated-with"], no_university: tuple[int, ...] = NO_UNIVERSITY) -> DataFrame:
    """(id, entity): PERSON has an own award edge; UNIVERSITY a mirrored affiliation edge and isn't listed; PERSON wins; else NONE."""
    signs = edges.groupBy(F.col("src").alias("id")).agg(F.bool_or((F.col("type") == award) & ~F.col("mirror")).alias("_person"), F.bool_or((F.col("type") == affiliation) & F.col("mirror")).alias("_university"))
    entity = F.when(F.col("_person"), "PERSON").when(F.col("_university") & ~F.col("id").isin(list(no_university)), "UNIVERSITY").otherwise("NONE")
    return vertices.select("id").join(signs, "id", "left").select("id", entity.alias("entity"))
