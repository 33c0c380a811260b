"""Triangle counts by intersection of oriented neighbourhoods.

Edges are made distinct and point from the endpoint of fewer edges to the one of more, so that no neighbourhood has more
than sqrt(2 E) vertices, whatever the largest degree. A neighbourhood travels as one row with an array, once to each block of
vertices (of near ids) that has members of it, instead of a row for each pair of its members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import indexed
from ..operators.sets import blocks, direction_optimised
from ..storage import stored


def oriented(edges: DataFrame, by: str = "degree") -> DataFrame:
    """Distinct edges without self-loops, from the lesser to the greater endpoint by degree and id, or by id."""
    pairs = direction_optimised(edges, self_loops=False)
    if by == "id":
        return pairs
    pairs = stored(pairs)
    degree = pairs.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    at = lambda c: degree.select(F.col("id").alias(c), F.col("degree").alias(f"_{c}"))
    both = pairs.join(at("src"), "src").join(at("dst"), "dst")
    low, high = F.struct(F.col("_src").alias("d"), F.col("src").alias("id")), F.struct(F.col("_dst").alias("d"), F.col("dst").alias("id"))
    ends = both.select(F.least(low, high).alias("a"), F.greatest(low, high).alias("b"))
    return ends.select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"))


def closed(edges: DataFrame) -> DataFrame:
    """(src, dst, closed): for each edge as it points, how many vertices both ends point to. Repeated edges count once."""
    adjacency = stored(edges.groupBy("src").agg(F.collect_set("dst").alias("out")))
    block, tasks = blocks(adjacency.select(F.col("src").alias("id"), F.size("out").alias("n")))
    there = F.array_distinct(F.transform("out", block))
    sent = adjacency.filter(F.size("out") >= 2).select("src", "out", F.explode(there).alias("block")).repartition(tasks, "block")
    asked = sent.select("block", "src", "out", F.explode("out").alias("dst")).filter(block(F.col("dst")) == F.col("block"))
    kept = adjacency.select(block(F.col("src")).alias("block"), F.col("src").alias("dst"), F.col("out").alias("other")).repartition(tasks, "block")
    met = asked.join(kept.hint("shuffle_hash"), ["block", "dst"])
    return stored(met.select("src", "dst", F.size(F.array_intersect("out", "other")).cast("bigint").alias("closed")), placed=True)


def triangle_count(edges: DataFrame, *, orient: bool = True) -> DataFrame:
    """One row: triangles. Without orient, the edges are intersected as they point, which counts directed closures."""
    return closed(oriented(edges) if orient else edges).agg(F.coalesce(F.sum("closed"), F.lit(0)).alias("triangles"))


def triangle_count_by_wedges(edges: DataFrame) -> DataFrame:
    """The same count by a three-way join, for cross-checks: each wedge is a row, but one that no task hands on or keeps.

    An edge travels once to each block of sources that has some which point to it; the block's own edges, which its size
    bounds, begin the wedges and close them. No vertex's edges need to fit in a row."""
    e = stored(oriented(edges))
    block, tasks = blocks(e.select(F.col("src").alias("id"), F.lit(1).alias("n")))
    own = e.select(block(F.col("src")).alias("block"), "src", "dst")
    second = e.select(F.col("src").alias("dst"), F.col("dst").alias("third"))
    sent = second.join(own.select("block", "dst").distinct(), "dst").repartition(tasks, "block")
    placed = own.repartition(tasks, "block")
    wedges = sent.join(placed.hint("shuffle_hash"), ["block", "dst"])
    closing = placed.withColumnRenamed("dst", "third").hint("shuffle_hash")
    return stored(wedges.join(closing, ["block", "src", "third"], "left_semi").agg(F.count(F.lit(1)).alias("triangles")), placed=True)


def triangle_chunks(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(chunk, triangles, running): by chunks of 1, 2, 4, ... vertices in the order of ids, by the least vertex of a triangle."""
    place = indexed(vertices.select("id"), ["id"], "place").select(F.col("id").alias("src"), F.floor(F.log2(F.col("place") + 1)).cast("int").alias("chunk"))
    found = closed(oriented(edges, by="id")).groupBy("src").agg(F.sum("closed").alias("n"))
    counted = place.join(found, "src", "left").groupBy("chunk").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("triangles"))
    return counted.withColumn("running", F.sum("triangles").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)))  # a row a chunk, at most 63


def triangle_edge_chunks(edges: DataFrame) -> DataFrame:
    """(chunk, triangles, running): by chunks of 1, 2, 4, ... edges in the order of their ends, by the edge of a triangle's two least vertices."""
    ordered = stored(oriented(edges, by="id"))
    place = indexed(ordered, ["src", "dst"], "place").select("src", "dst", F.floor(F.log2(F.col("place") + 1)).cast("int").alias("chunk"))
    counted = place.join(closed(ordered), ["src", "dst"], "left").groupBy("chunk").agg(F.coalesce(F.sum("closed"), F.lit(0)).alias("triangles"))
    return counted.withColumn("running", F.sum("triangles").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)))  # a row a chunk, at most 63
