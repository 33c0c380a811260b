"""Level-synchronous traversal and shortest paths.

A level is one job: the frontier meets the edges, what was seen before goes, the rest is written to the shared folder. Edges
are placed by source once and kept so; a source of more than ``HEAVY`` edges is divided in as many parts as that takes. The
frontier's size is known, so Spark broadcasts it while it is small and shuffles it, but not the edges, once it isn't.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, stored

#: Levels after which what was seen is written together, so that it is read from a few folders.
MERGE_LEVELS = 16
#: Edges of one source and part.
HEAVY = 1 << 20


class Placed:
    """Edges (src, ...) kept by source and part, and the number of parts of the sources that have several."""

    def __init__(self, edges: DataFrame):
        """Edges are worked out once, where they are placed; their number by source is then known without a shuffle."""
        n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.edges = edges.repartition(n, "src").persist(StorageLevel.MEMORY_AND_DISK)
        many = self.edges.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / HEAVY).cast("int").alias("_parts")).filter("_parts > 1")
        self.heavy = stored(many)
        self.divided = not self.heavy.isEmpty()
        if self.divided:
            whole = self.edges
            part = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("_parts")).cast("int"), F.lit(0))
            self.edges = whole.join(self.heavy, "src", "left").withColumn("_part", part).drop("_parts").repartition(n, *self.key).persist(StorageLevel.MEMORY_AND_DISK)
            self.edges.count()
            whole.unpersist()

    @property
    def key(self) -> list[str]:
        return ["src", "_part"] if self.divided else ["src"]

    def met(self, frontier: DataFrame) -> DataFrame:
        """Edges out of the rows of frontier (src, ...), with its columns."""
        if self.divided:
            parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
            frontier = frontier.join(self.heavy, "src", "left").withColumn("_part", F.explode(parts)).drop("_parts")
        return self.edges.join(frontier, self.key).drop("_part")

    def free(self) -> None:
        self.edges.unpersist()
        dropped(self.heavy)


def reach(edges: DataFrame, start: DataFrame, *, group: str = "source", when: Column | None = None, levels: int | None = None) -> DataFrame:
    """(group, id, distance) of all that can be reached from start (group, id) along edges (src, dst, ...).

    ``when`` is a condition on an edge and the group that goes along it. ``levels`` limits the distance.
    """
    placed = Placed(edges)
    try:
        frontier = stored(start.select(group, "id").distinct().withColumn("distance", F.lit(0).cast("bigint")))
        parts, level = [frontier], 0
        while (levels is None or level < levels) and not frontier.isEmpty():
            level += 1
            seen = parts[0]
            for p in parts[1:]:
                seen = seen.unionAll(p)
            if len(parts) > MERGE_LEVELS:
                old, seen = parts, stored(seen)
                frontier = seen.filter(F.col("distance") == level - 1)
                parts = [seen]
                dropped(*old)
            met = placed.met(frontier.select(group, F.col("id").alias("src")))
            on = met if when is None else met.filter(when)
            fresh = on.select(group, F.col("dst").alias("id")).distinct().join(seen.select(group, "id"), [group, "id"], "left_anti")
            frontier = stored(fresh.withColumn("distance", F.lit(level).cast("bigint")))
            parts.append(frontier)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out
    finally:
        placed.free()


def bfs(edges: DataFrame, sources: list[int]) -> DataFrame:
    """(source, id, distance) of what each source reaches along out-edges; one traversal for all sources."""
    start = edges.sparkSession.createDataFrame([(s, s) for s in sources], "source long, id long")
    return reach(edges.select("src", "dst"), start)


def bfs_push_pull(vertices: DataFrame, edges: DataFrame, source: int, share: float = 0.1) -> DataFrame:
    """(id, distance) from one source. A level goes along the frontier's out-edges (push), or, once the frontier is over ``share``
    of the vertices not yet seen, those look among their in-edges for one from the frontier (pull)."""
    spark = edges.sparkSession
    out, into = Placed(edges.select("src", "dst")), Placed(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    try:
        frontier = stored(spark.createDataFrame([(source,)], "id long").withColumn("distance", F.lit(0).cast("bigint")))
        seen, level = frontier, 0
        unseen = stored(vertices.select("id").distinct().join(seen.select("id"), "id", "left_anti"))
        while size := frontier.count():
            level += 1
            if size > share * unseen.count():
                met = into.met(unseen.select(F.col("id").alias("src"))).join(frontier.select(F.col("id").alias("dst")), "dst", "left_semi")
                fresh = met.select(F.col("src").alias("id")).distinct()
            else:
                met = out.met(frontier.select(F.col("id").alias("src")))
                fresh = met.select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
            frontier = stored(fresh.withColumn("distance", F.lit(level).cast("bigint")))
            seen = seen.unionAll(frontier)
            fewer = stored(unseen.join(frontier.select("id"), "id", "left_anti"))
            dropped(unseen)
            unseen = fewer
        dropped(unseen)
        return seen
    finally:
        out.free()
        into.free()


def with_unreached(vertices: DataFrame, distances: DataFrame, source: int) -> DataFrame:
    """(id, distance) of every vertex; null where it isn't reached."""
    one = distances.filter(F.col("source") == source).select("id", "distance")
    return vertices.select("id").join(one, "id", "left")


def edges_traversed(edges: DataFrame, distances: DataFrame) -> DataFrame:
    """(source, level, frontier, edges) of each level that was expanded."""
    degrees = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    joined = distances.join(degrees, "id", "left")
    return joined.groupBy("source", F.col("distance").alias("level")).agg(F.count(F.lit(1)).alias("frontier"), F.coalesce(F.sum("degree"), F.lit(0)).alias("edges"))


def shortest_paths(edges: DataFrame, source: int, weight: str | None = None) -> DataFrame:
    """(id, distance) by relaxation: candidates of the active vertices, the least of each, kept where it is less than before.

    Weights are whole numbers or doubles and not negative; without a weight each edge counts 1.
    """
    spark = edges.sparkSession
    w = F.col(weight) if weight else F.lit(1).cast("bigint")
    kind = dict(edges.dtypes)[weight] if weight else "bigint"
    placed = Placed(edges.select("src", "dst", w.alias("w")).groupBy("src", "dst").agg(F.min("w").alias("w")))
    try:
        active = stored(spark.createDataFrame([(source,)], "id long").withColumn("distance", F.lit(0).cast(kind)))
        parts = [active]  # a round adds what it made better; merged now and then
        while not active.isEmpty():
            known = _least(parts)
            if len(parts) > MERGE_LEVELS:
                old, known = parts, stored(known)
                parts = [known]
            else:
                old = []
            met = placed.met(active.withColumnRenamed("id", "src"))
            candidates = met.groupBy(F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("w")).alias("_new"))
            better = candidates.join(known, "id", "left").filter(F.col("distance").isNull() | (F.col("_new") < F.col("distance")))
            active = stored(better.select("id", F.col("_new").alias("distance")))
            dropped(*old)
            parts.append(active)
        return _least(parts)
    finally:
        placed.free()


def _least(parts: list[DataFrame]) -> DataFrame:
    known = parts[0]
    for p in parts[1:]:
        known = known.unionAll(p)
    return known.groupBy("id").agg(F.min("distance").alias("distance")) if len(parts) > 1 else known
