"""Unions, distinct edges, intersections of neighbourhoods, membership."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import INVERSES
from ..storage import stored

#: Edges of a block of vertices, where ids are evenly spread.
BLOCK_EDGES = 1 << 20


def inverse_type(type_: Column, inverses: dict[str, str] = INVERSES) -> Column:
    """The type in the other direction; NONE if it has none."""
    return F.coalesce(*(F.when(type_ == k, F.lit(v)) for k, v in inverses.items()), F.lit("NONE"))


def inverse_union(edges: DataFrame) -> DataFrame:
    """Each edge and the edge in the other direction, in one scan: endpoints and their types swapped, the type inverted."""
    columns = edges.columns
    swapped = {"src": F.col("dst"), "dst": F.col("src"), "type": inverse_type(F.col("type"))}
    if "src_type" in columns:
        swapped |= {"src_type": F.col("dst_type"), "dst_type": F.col("src_type")}
    pair = F.array(F.struct(*columns), F.struct(*(swapped.get(c, F.col(c)).alias(c) for c in columns)))
    return edges.select(F.inline(pair))


def direction_optimised(edges: DataFrame, *, self_loops: bool = True) -> DataFrame:
    """Distinct (least, greatest) endpoint pairs."""
    pairs = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return pairs if self_loops else pairs.filter("src < dst")


def concatenated(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def blocks(sized: DataFrame) -> tuple[Callable[[Column], Column], int]:
    """The block of an id, and how many tasks blocks are dealt to, for the stored rows (id, n) of vertices and their numbers of edges.

    A block is the vertices of a range of ids, all ranges equally wide, so that it has no more vertices than that, however
    ids are spread. What goes to many vertices goes once to each block of theirs."""
    n, low, high = sized.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.min("id"), F.lit(0)), F.coalesce(F.max("id"), F.lit(0))).first()
    width = F.lit(min(max((high - low + 1) * BLOCK_EDGES // max(n, 1), 1), 1 << 62)).cast("bigint")
    tasks = max(int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * n // BLOCK_EDGES)  # Spark doesn't keep fewer than the session's
    return lambda id_: F.call_function("div", id_.cast("bigint"), width), tasks


def common_neighbours(pairs: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(a, b, common): for each pair the vertices that both adjacency lists have.

    The shorter list of a pair travels to the longer one: once to each block of vertices that has such longer ones, with their ids."""
    adjacency = stored(adjacency.select("id", "neighbours"))
    block, tasks = blocks(adjacency.select("id", F.size("neighbours").alias("n")))
    sizes = lambda c: adjacency.select(F.col("id").alias(c), F.size("neighbours").alias(f"_{c}"))
    sized = pairs.join(sizes("a"), "a").join(sizes("b"), "b")
    fewer = F.col("_a") <= F.col("_b")
    turned = sized.select(F.when(fewer, F.col("a")).otherwise(F.col("b")).alias("_few"), F.when(fewer, F.col("b")).otherwise(F.col("a")).alias("_many"), fewer.alias("_turn"))
    asked = turned.groupBy("_few", block(F.col("_many")).alias("_block")).agg(F.collect_list(F.struct("_many", "_turn")).alias("_asked"))
    of = lambda c: adjacency.select(F.col("id").alias(c), F.col("neighbours").alias(f"{c}_list"))
    sent = asked.join(of("_few"), "_few").repartition(tasks, "_block").select("_block", "_few", "_few_list", F.inline("_asked"))
    kept = of("_many").withColumn("_block", block(F.col("_many"))).repartition(tasks, "_block")
    met = sent.join(kept.hint("shuffle_hash"), ["_block", "_many"])
    end = lambda x, y: F.when(F.col("_turn"), F.col(x)).otherwise(F.col(y))
    return stored(met.select(end("_few", "_many").alias("a"), end("_many", "_few").alias("b"), F.array_sort(F.array_intersect("_few_list", "_many_list")).alias("common")), placed=True)


def edge_probe(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, connected) of the asked pairs."""
    there = edges.select("src", "dst", F.lit(True).alias("_there")).distinct()
    return pairs.join(there, ["src", "dst"], "left").select("src", "dst", F.coalesce("_there", F.lit(False)).alias("connected"))
