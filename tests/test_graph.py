"""Graph access paths, integrity, changes and placement on small graphs."""

import pytest
from conftest import rows

from lattix.graph import Graph, UndeclaredEndpoint, from_edges
from lattix.operators import aggregates, neighbourhood, ordering, projection, sets

from pyspark.sql import functions as F

EDGES = [(0, 1), (0, 3), (0, 1), (1, 3), (3, 3), (4, 0)]


@pytest.fixture
def graph(spark):
    return Graph(spark.range(6), spark.createDataFrame(EDGES, "src long, dst long"))


def test_sizes_and_degrees(graph):
    assert rows(graph.sizes()) == [(6, 6)]
    assert rows(graph.out_degrees()) == [(0, 3), (1, 1), (2, 0), (3, 1), (4, 1), (5, 0)]
    assert rows(graph.in_degrees()) == [(0, 1), (1, 2), (2, 0), (3, 3), (4, 0), (5, 0)]


def test_empty_graph(spark):
    g = Graph(spark.range(0), spark.createDataFrame([], "src long, dst long"))
    assert rows(g.sizes()) == [(0, 0)]
    assert rows(g.out_degrees()) == []
    assert rows(g.undeclared()) == []


def test_adjacency_keeps_repeated_edges_in_order(graph):
    assert rows(graph.adjacency()) == [(0, [1, 1, 3]), (1, [3]), (3, [3]), (4, [0])]
    assert rows(graph.edge_at(1)) == [(0, 1)]
    assert rows(graph.edge_window(1, 5)) == [(0, [1, 3]), (1, []), (3, []), (4, [])]
    assert rows(graph.vertex_window(4, 10)) == [(4, 4), (5, 5)]
    assert rows(graph.vertex_window(9, 2)) == []


def test_transpose_twice_is_the_same(graph):
    assert rows(graph.transpose().transpose().edges) == rows(graph.edges)
    assert (1, 0) in rows(graph.transpose().edges)


def test_undeclared_endpoints(spark):
    g = Graph(spark.range(2), spark.createDataFrame([(0, 1), (0, 7), (8, 1)], "src long, dst long"))
    assert rows(g.undeclared()) == [(7, "dst"), (8, "src")]
    with pytest.raises(UndeclaredEndpoint):
        g.checked()
    assert rows(g.checked(drop=True).edges) == [(0, 1)]


def test_changes_give_new_graphs(graph, spark):
    more = graph.add_vertices(spark.createDataFrame([(5,), (9,)], "id long")).add_edges(spark.createDataFrame([(9, 0)], "src long, dst long"))
    assert rows(more.sizes()) == [(7, 7)]
    assert rows(graph.sizes()) == [(6, 6)]
    assert rows(graph.delete_edges(spark.createDataFrame([(0, 1)], "src long, dst long")).edges) == [(0, 3), (1, 3), (3, 3), (4, 0)]


def test_vertex_data_is_set_where_named(spark):
    g = Graph(spark.createDataFrame([(0, "a"), (1, "b")], "id long, x string"), spark.createDataFrame([], "src long, dst long"))
    out = g.with_vertex_data(spark.createDataFrame([(1, "c", 5)], "id long, x string, y int")).vertices
    assert rows(out.select("id", "x", "y")) == [(0, "a", None), (1, "c", 5)]


def test_mirrors_are_remote_destinations(graph):
    assert rows(graph.mirrors(2)) == [(0, 1), (0, 3)]
    assert sum(r["Count"] for r in graph.host_counts(3).collect()) == 12


def test_from_edges(graph):
    assert rows(from_edges(graph.edges).vertices) == [(0,), (1,), (3,), (4,)]


# ---- building blocks


def test_direction_optimised(graph):
    assert rows(sets.direction_optimised(graph.edges)) == [(0, 1), (0, 3), (0, 4), (1, 3), (3, 3)]
    assert rows(sets.direction_optimised(graph.edges, self_loops=False)) == [(0, 1), (0, 3), (0, 4), (1, 3)]


def test_common_neighbours_and_probe(graph, spark):
    pairs = spark.createDataFrame([(0, 1), (0, 4)], "a long, b long")
    assert rows(sets.common_neighbours(pairs, graph.adjacency())) == [(0, 1, [3]), (0, 4, [])]
    asked = spark.createDataFrame([(0, 1), (1, 0)], "src long, dst long")
    assert rows(sets.edge_probe(asked, graph.edges)) == [(0, 1, True), (1, 0, False)]


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_index_and_prefix_sum(spark, n):
    df = spark.range(n).select((F.col("id") * 3).alias("k"), (F.col("id") % 5).alias("x")).repartition(5)
    got = {r["k"]: (r["index"], r["running"]) for r in ordering.prefix_sum(ordering.indexed(df, ["k"]), ["k"], "x").collect()}
    total = 0
    for i in range(n):
        total += i % 5
        assert got[3 * i] == (i, total)
    assert len(got) == n


def test_ordering(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 9), (4, 0)], "id long, s long")
    assert [r["id"] for r in ordering.top_k(df, 2, "s").collect()] == [2, 3]
    assert [r["id"] for r in ordering.sorted_by(df, "id", descending=True).collect()] == [4, 3, 2, 1]
    assert rows(ordering.arg_max(df, "s")) == [(2, 9)]
    assert rows(ordering.arg_max(df.filter("s = 0"), "s")) == []
    assert rows(ordering.arg_max(df.filter("s < 0"), "s")) == []


def test_hosts(spark):
    counts = spark.createDataFrame([(0, 5), (1, 9), (2, 4), (3, 4)], "vhost int, edges long")
    placed = {r["vhost"]: r["host"] for r in aggregates.balanced_hosts(counts, 2).collect()}
    load = [sum(n for v, n in ((0, 5), (1, 9), (2, 4), (3, 4)) if placed[v] == h) for h in (0, 1)]
    assert sorted(load) == [9, 13]
    assert rows(aggregates.round_robin_hosts(counts, 2)) == [(0, 5, 0), (1, 9, 1), (2, 4, 0), (3, 4, 1)]


def test_accumulator(spark):
    assert rows(aggregates.total(spark.createDataFrame([(1,), (10,), (-1,), (-1,), (-7,)], "x long"), "x")) == [(2,)]
    assert rows(aggregates.total(spark.createDataFrame([], "x long"), "x")) == [(0,)]


def test_mirror_reduction_then_broadcast(spark):
    masters = spark.createDataFrame([(i, 100) for i in range(4)], "id long, value long")
    mirrors = spark.createDataFrame([(0, 1, 2, True), (1, 1, 7, True), (1, 2, 3, False)], "host int, id long, value long, dirty boolean")
    after, copies = neighbourhood.synchronised(mirrors, masters, "min")
    assert rows(after) == [(0, 100, False), (1, 2, True), (2, 100, False), (3, 100, False)]
    assert rows(copies) == [(0, 1, 2, False), (1, 1, 2, False), (1, 2, 3, False)]
    assert rows(neighbourhood.reduce_to_masters(mirrors, masters, "sum").filter("id = 1")) == [(1, 109, True)]


def test_sales_projection(spark):
    n = 17
    people = [(i, "PERSON") for i in range(n)] + [(100, "DEVICE"), (101, "PERSON")]
    edges = [(i, j, "SALE" if j < i else "PURCHASE", "PERSON", 1.0, 8486) for i in range(n) for j in range(n) if i != j]
    noise = [(i, 100, "USES", "DEVICE", 1.0, 8486) for i in range(n)] + [(i, (i + 1) % n, "SALE", "PERSON", 1.0, 8487) for i in range(n)] + [(i, (i + 1) % n, "SALE", "PERSON", 0.0, 8486) for i in range(n)] + [(101, 100, "USES", "DEVICE", 1.0, 8486), (100, 0, "SALE", "PERSON", 1.0, 8486)]
    g = Graph(spark.createDataFrame(people, "id long, type string"), spark.createDataFrame(edges + noise, "src long, dst long, type string, dst_type string, amount double, topic long"))
    out = projection.project(g, projection.sales_projection())
    assert rows(out.sizes()) == [(17, 272)]


def test_entity_labels(spark):
    edges = spark.createDataFrame([(1, 9, 207, False), (2, 9, 40, True), (3, 9, 207, False), (3, 9, 40, True), (344618, 9, 40, True), (4, 9, 207, True)], "src long, dst long, type long, mirror boolean")
    vertices = spark.createDataFrame([(1,), (2,), (3,), (344618,), (4,), (5,)], "id long")
    assert rows(projection.entity_labels(vertices, edges)) == [(1, "PERSON"), (2, "UNIVERSITY"), (3, "PERSON"), (4, "NONE"), (5, "NONE"), (344618, "NONE")]
