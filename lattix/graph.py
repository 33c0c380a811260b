"""A property graph: vertices (id, ...) and edges (src, dst, ...), each a DataFrame. Edges may repeat."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions.scalars import owner
from .operators.ordering import indexed


class UndeclaredEndpoint(ValueError):
    """Edges have endpoints that no vertex declares."""


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame

    # ---- sizes and degrees

    def sizes(self) -> DataFrame:
        """One row: n_vertices, n_edges."""
        v = self.vertices.agg(F.count(F.lit(1)).alias("n"))
        e = self.edges.agg(F.count(F.lit(1)).alias("n"))
        both = v.select(F.lit("v").alias("what"), "n").unionAll(e.select(F.lit("e").alias("what"), "n"))
        return both.agg(F.max(F.when(F.col("what") == "v", F.col("n"))).alias("n_vertices"), F.max(F.when(F.col("what") == "e", F.col("n"))).alias("n_edges"))

    def out_degrees(self) -> DataFrame:
        """(id, degree) of every vertex, 0 included."""
        return self._degrees("src")

    def in_degrees(self) -> DataFrame:
        return self._degrees("dst")

    def _degrees(self, end: str) -> DataFrame:
        counted = self.edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("degree"))
        return self.vertices.select("id").join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("bigint")).alias("degree"))

    # ---- access paths

    def neighbours(self, of: DataFrame) -> DataFrame:
        """Edges out of the vertices in ``of`` (id, ...), with the columns of ``of``."""
        return of.withColumnRenamed("id", "src").join(self.edges, "src")

    def adjacency(self) -> DataFrame:
        """(id, neighbours) of vertices with out-edges; sorted, repeated edges kept."""
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("neighbours"))

    def edge_at(self, offset: int) -> DataFrame:
        """(id, dst) of each vertex's edge at a place in its sorted adjacency."""
        return self._first_edges(offset + 1).filter(F.col("_n") == offset + 1).select(F.col("src").alias("id"), "dst")

    def edge_window(self, offset: int, length: int) -> DataFrame:
        """(id, neighbours) with the part [offset, offset + length) of each sorted adjacency; empty past its end."""
        inside = F.array_sort(F.collect_list(F.when(F.col("_n") > offset, F.col("dst"))))
        return self._first_edges(max(1, offset + length)).groupBy(F.col("src").alias("id")).agg(inside.alias("neighbours"))

    def _first_edges(self, n: int) -> DataFrame:
        """(src, dst, _n): the first n edges of each source; a rank limit, so most edges go before the shuffle."""
        rank = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
        return self.edges.select("src", "dst").withColumn("_n", rank).filter(F.col("_n") <= n)

    def vertex_window(self, offset: int, length: int) -> DataFrame:
        """Vertices at places [offset, offset + length) by id, with their place."""
        return indexed(self.vertices, ["id"], "index").filter((F.col("index") >= offset) & (F.col("index") < offset + length))

    def transpose(self) -> Graph:
        others = [c for c in self.edges.columns if c not in ("src", "dst")]
        return replace(self, edges=self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *others))

    # ---- integrity

    def undeclared(self) -> DataFrame:
        """(id, end) of edge endpoints that aren't vertices."""
        known = self.vertices.select("id")
        both = F.array(*(F.struct(F.col(e).alias("id"), F.lit(e).alias("end")) for e in ("src", "dst")))
        return self.edges.select(F.inline(both)).distinct().join(known, "id", "left_anti")

    def checked(self, *, drop: bool = False) -> Graph:
        """Raise if an endpoint is undeclared, or drop such edges."""
        if drop:
            known = self.vertices.select("id")
            kept = self.edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
            return replace(self, edges=kept.select(*self.edges.columns))
        if some := self.undeclared().limit(5).collect():
            raise UndeclaredEndpoint(f"undeclared endpoints, for example {[(r['end'], r['id']) for r in some]}")
        return self

    # ---- data and changes; a graph is a value, each gives a new one

    def with_vertex_data(self, data: DataFrame) -> Graph:
        """Columns of data (id, ...) set on the vertices that it names; others keep theirs, or null."""
        fresh = [c for c in data.columns if c != "id"]
        right = data.select(F.col("id"), F.lit(True).alias("_set"), *(F.col(c).alias(f"_{c}") for c in fresh))
        joined = self.vertices.join(right, "id", "left")
        old = [c for c in self.vertices.columns if c not in fresh]
        value = lambda c: F.when(F.col("_set"), F.col(f"_{c}")).otherwise(F.col(c)) if c in self.vertices.columns else F.col(f"_{c}")
        return replace(self, vertices=joined.select(*old, *(value(c).alias(c) for c in fresh)))

    def with_edge_column(self, name: str, value: Column) -> Graph:
        return replace(self, edges=self.edges.withColumn(name, value))

    def add_vertices(self, more: DataFrame) -> Graph:
        return replace(self, vertices=self.vertices.unionByName(more, allowMissingColumns=True).dropDuplicates(["id"]))

    def add_edges(self, more: DataFrame) -> Graph:
        return replace(self, edges=self.edges.unionByName(more, allowMissingColumns=True))

    def delete_edges(self, gone: DataFrame) -> Graph:
        return replace(self, edges=self.edges.join(gone.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select(*self.edges.columns))

    # ---- placement

    def partitioned(self, n: int | None = None) -> Graph:
        """Edges placed by source, so that joins and groups on src need no further shuffle."""
        return replace(self, edges=self.edges.repartition(n, "src") if n else self.edges.repartition("src"))

    def striped(self, n: int) -> Graph:
        """Edges dealt out evenly, without regard to vertices."""
        return replace(self, edges=self.edges.repartition(n))

    def mirrors(self, n: int) -> DataFrame:
        """(host, id) of remote destinations: what each of n hosts would need a copy of."""
        far = self.edges.select(owner(F.col("src"), n).alias("host"), F.col("dst").alias("id")).filter(F.col("host") != owner(F.col("id"), n))
        return far.distinct()

    def host_counts(self, n: int) -> DataFrame:
        """(Host, Category, Count) of vertices and edges by virtual host."""
        v = self.vertices.groupBy(owner(F.col("id"), n).alias("Host")).count().select("Host", F.lit("Vertices").alias("Category"), F.col("count").alias("Count"))
        e = self.edges.groupBy(owner(F.col("src"), n).alias("Host")).count().select("Host", F.lit("Edges").alias("Category"), F.col("count").alias("Count"))
        return v.unionAll(e)


def from_edges(edges: DataFrame) -> Graph:
    """Vertices are the endpoints."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return Graph(ends, edges)
