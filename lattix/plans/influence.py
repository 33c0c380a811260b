"""Influence maximisation: edge probabilities, random reverse-reachable sets, greedy coverage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import DEFAULT_SEED, MODULUS, coin
from ..operators.ordering import arg_max, indexed
from ..storage import dropped, stored
from .traversal import reach

MONEY = "decimal(18,4)"


def traded(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, sold, bought, desired): sums of a vertex's sale and purchase edges."""
    amount = F.col("amount").cast(MONEY)
    of = lambda t: F.coalesce(F.sum(F.when(F.col("type") == t, amount)), F.lit(0).cast("decimal(28,4)")).cast("double")
    sums = edges.groupBy(F.col("src").alias("id")).agg(of("SALE").alias("sold"), of("PURCHASE").alias("bought"))
    zero = F.lit(0.0)
    return vertices.select("id").join(sums, "id", "left").select("id", F.coalesce("sold", zero).alias("sold"), F.coalesce("bought", zero).alias("bought"), F.coalesce("bought", zero).alias("desired"))


def edge_probabilities(edges: DataFrame, trade: DataFrame) -> DataFrame:
    """The edges with weight: a sale's share of what its source sold, a purchase's of what its destination sold; else 0."""
    seller = F.when(F.col("type") == "SALE", F.col("src")).when(F.col("type") == "PURCHASE", F.col("dst"))
    sold = trade.filter("sold > 0").select(F.col("id").alias("_seller"), F.col("sold").alias("_sold"))
    joined = edges.withColumn("_seller", seller).join(sold, "_seller", "left")
    return joined.select(*edges.columns, F.coalesce(F.col("amount") / F.col("_sold"), F.lit(0.0)).alias("weight"))


def influence_totals(weighted: DataFrame) -> DataFrame:
    """One row (total_weight, total_amount) over all edges; a sale's two directions both count."""
    return weighted.agg(F.sum(F.col("weight").cast("decimal(20,12)")).cast("double").alias("total_weight"), F.sum(F.col("amount").cast(MONEY)).cast("double").alias("total_amount"))


def reachable_sets(vertices: DataFrame, weighted: DataFrame, n_sets: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """(set_id, id, distance): from a random root each, along the edges whose coin is at most their weight.

    The coin of (set, src, dst) is a hash, so a set is the same in whatever order edges are met.
    """
    spark = vertices.sparkSession
    places = stored(indexed(vertices.select("id").distinct(), ["id"], "place"))
    size = places.count()
    if not size:
        return spark.createDataFrame([], "set_id long, id long, distance long")
    zero = F.lit(0)
    roots = spark.range(n_sets).select(F.col("id").alias("set_id"), (coin(F.col("id"), zero, zero, seed) % size).alias("place")).join(places, "place").select("set_id", "id")
    live = coin(F.col("set_id"), F.col("src"), F.col("dst"), seed) <= F.col("weight") * float(MODULUS)
    return reach(weighted.select("src", "dst", "weight"), roots, group="set_id", when=live)


def frequencies(sets: DataFrame) -> DataFrame:
    """(id, frequency): in how many sets a vertex is."""
    return sets.groupBy("id").agg(F.count(F.lit(1)).alias("frequency"))


@dataclass(frozen=True)
class Influential:
    picks: DataFrame  # (rank, id, frequency)
    uninfluenced: int  # sets left after all but the last pick's were taken out


def influential_nodes(sets: DataFrame, k: int) -> Influential:
    """Greedy coverage: the vertex in most sets, the least id among equals; its sets go; k times, or until no set is left.

    The sets stay as they are. Kept are the counts, from which those of the sets that a pick covers are taken, and the ids
    of covered sets. So a round reads the covered sets' members and writes a row a vertex, whatever the sets' sizes."""
    sets = stored(sets.select("set_id", "id"))
    counts, covered, picks = stored(frequencies(sets)), None, []
    left = sets.select("set_id").distinct().count()
    for rank in range(k):
        best = arg_max(counts, "frequency").first()
        if best is None:
            break
        picks.append((rank, best["id"], best["frequency"]))
        if rank == k - 1:
            break
        fresh = sets.filter(F.col("id") == best["id"]).select("set_id").distinct()
        fresh = stored(fresh if covered is None else fresh.join(covered, "set_id", "left_anti"))
        left -= fresh.count()
        lost = frequencies(sets.join(fresh, "set_id")).withColumnRenamed("frequency", "_lost")
        fewer = stored(counts.join(lost, "id", "left").select("id", (F.col("frequency") - F.coalesce("_lost", F.lit(0))).alias("frequency")).filter("frequency > 0"))
        dropped(counts)
        counts, covered = fewer, fresh if covered is None else covered.unionAll(fresh)
    dropped(counts, sets)
    return Influential(sets.sparkSession.createDataFrame(picks, "rank int, id long, frequency long"), left)


def report(picks: DataFrame, edges: DataFrame, trade: DataFrame, weighted: DataFrame) -> DataFrame:
    """(rank, id, frequency, degree, bought, sold, influence) of the picked vertices; influence is the weight of their out-edges."""
    sums = weighted.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.sum(F.col("weight").cast("decimal(20,12)")).cast("double").alias("influence"))
    joined = picks.join(trade.select("id", "bought", "sold"), "id", "left").join(sums, "id", "left")
    return joined.select("rank", "id", "frequency", F.coalesce("degree", F.lit(0)).alias("degree"), "bought", "sold", F.coalesce("influence", F.lit(0.0)).alias("influence"))
