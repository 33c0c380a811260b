"""Global order without a single task: ordinals, running sums, sorts, top-k, search in sorted arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

_IN_PARTITION = (1 << 33) - 1


def _ranged(df: DataFrame, keys: list[str]) -> DataFrame:
    """Stored in range partitions by keys; ``_part`` and ``_row`` are each row's partition and its place there."""
    m = F.monotonically_increasing_id()
    sorted_ = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_m", m)
    return stored(sorted_.select(*df.columns, F.shiftright("_m", 33).alias("_part"), F.col("_m").bitwiseAND(_IN_PARTITION).alias("_row")))


def _offsets(kept: DataFrame, value: Column, kind: str) -> DataFrame:
    """(_part, _before): the sum of value over all earlier partitions. A row a partition, so small."""
    totals = kept.groupBy("_part").agg(F.sum(value).cast(kind).alias("_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_part", F.coalesce(F.sum("_total").over(before).cast(kind), F.lit(0).cast(kind)).alias("_before"))


def indexed(df: DataFrame, keys: list[str], name: str = "index") -> DataFrame:
    """Rows with their place (from 0) in the order of keys, which must tell rows apart."""
    kept = _ranged(df, keys)
    offsets = _offsets(kept, F.lit(1), "bigint")
    return kept.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_before") + F.col("_row")).alias(name))


def prefix_sum(df: DataFrame, keys: list[str], value: str, name: str = "running", kind: str = "bigint") -> DataFrame:
    """Inclusive running sum of value in the order of keys: sums within range partitions, plus those of earlier ones."""
    kept = _ranged(df, keys)
    offsets = _offsets(kept, F.col(value), kind)
    here = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = kept.withColumn("_here", F.sum(value).over(here).cast(kind))
    return inner.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_before") + F.col("_here")).cast(kind).alias(name))


def sorted_by(df: DataFrame, *keys: str, descending: bool = False) -> DataFrame:
    return df.orderBy(*(F.col(k).desc() if descending else F.col(k) for k in keys))


def top_k(df: DataFrame, k: int, score: str, tie: str = "id") -> DataFrame:
    """The k rows of the highest score, the least tie first among equals; each task keeps k rows."""
    return df.orderBy(F.col(score).desc(), tie).limit(k)


def top_k_per(df: DataFrame, by: list[str], k: int, score: str, tie: str) -> DataFrame:
    """The k best rows of each group; Spark keeps k of each group before it shuffles."""
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), tie))
    return df.withColumn("_rank", best).filter(F.col("_rank") <= k).drop("_rank")


def arg_max(df: DataFrame, score: str, id_: str = "id") -> DataFrame:
    """One row (id, score) of the highest score; the least id among equals, no row if all scores are 0 or there are none."""
    best = F.max_by(F.col(id_), F.struct(F.col(score), -F.col(id_)))
    return df.agg(best.alias(id_), F.max(score).alias(score)).filter(F.col(score) > 0)


def lower_bound(sorted_array: Column, value: Column) -> Column:
    """How many elements of a sorted array are less than value: the place is halved 31 times, however long the array."""
    begin = F.struct(F.lit(0).alias("lo"), F.size(sorted_array).alias("hi"))

    def halved(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        less = F.coalesce(F.get(sorted_array, mid) < value, F.lit(False))
        on = s["lo"] < s["hi"]
        return F.struct(F.when(on & less, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(on & ~less, mid).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(31)), begin, halved, lambda s: s["lo"])
