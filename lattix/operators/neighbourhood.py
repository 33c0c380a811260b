"""Values that flow along edges: reduction at a destination, broadcast of a master's value to its mirrors, and both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMBINERS = {"min": F.min, "max": F.max, "sum": F.sum}
_MERGE = {"min": F.least, "max": F.greatest, "sum": lambda a, b: a + b}


def along_edges(edges: DataFrame, state: DataFrame, value: str = "value", *, how: str = "sum", message: Column | None = None) -> DataFrame:
    """(id, value): what arrives at each destination from its in-neighbours' values, combined before it is shuffled."""
    sent = edges.join(state.select(F.col("id").alias("src"), F.col(value).alias("value")), "src")
    return sent.select(F.col("dst").alias("id"), (message if message is not None else F.col("value")).alias("value")).groupBy("id").agg(COMBINERS[how]("value").alias("value"))


def reduce_to_masters(mirrors: DataFrame, masters: DataFrame, how: str = "min") -> DataFrame:
    """(id, value, changed): dirty mirrors (id, value, dirty) are combined into the masters (id, value)."""
    sent = mirrors.filter("dirty").groupBy("id").agg(COMBINERS[how]("value").alias("_sent"))
    merged = F.when(F.col("_sent").isNull(), F.col("value")).when(F.col("value").isNull(), F.col("_sent")).otherwise(_MERGE[how](F.col("value"), F.col("_sent")))
    joined = masters.select("id", "value").join(sent, "id", "left")
    return joined.select("id", merged.alias("value"), (~merged.eqNullSafe(F.col("value"))).alias("changed"))


def broadcast_to_mirrors(masters: DataFrame, mirrors: DataFrame) -> DataFrame:
    """(host, id, value, dirty): mirrors of changed masters (id, value, changed) take their value; others keep theirs."""
    fresh = masters.filter("changed").select("id", F.col("value").alias("_fresh"))
    return mirrors.select("host", "id", "value").join(fresh, "id", "left").select("host", "id", F.coalesce("_fresh", "value").alias("value"), F.lit(False).alias("dirty"))


def synchronised(mirrors: DataFrame, masters: DataFrame, how: str = "min") -> tuple[DataFrame, DataFrame]:
    """Masters and mirrors after a reduction and a broadcast."""
    after = reduce_to_masters(mirrors, masters, how)
    return after, broadcast_to_mirrors(after, mirrors)
