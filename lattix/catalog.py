"""The engine's queries over the relational tables, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog_files, catalog_sql, tables
from .functions.scalars import code_of, softmax
from .graph import Graph
from .operators import aggregates, neighbourhood, ordering, projection, sets
from .plans import features, gcn, influence, reasoning, traversal, triangles
from .sources.edge_lists import exchange_edges
from .sources.records import record_edges, record_vertices
from .storage import stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
HOSTS = 8


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def on_copurchase(name: str, f: Callable[[Graph], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(tables.copurchase(spark, sf_dir))


def on_trade(name: str, f: Callable[[Graph], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(tables.trade(spark, sf_dir))


def _joined(df: DataFrame, column: str = "neighbours") -> DataFrame:
    return df.withColumn(column, F.array_join(column, " "))


# ---- graph access

on_copurchase("triangle_count", lambda g: triangles.triangle_count(g.edges))
on_copurchase("triangle_count_wedges", lambda g: triangles.triangle_count_by_wedges(g.edges))
on_copurchase("triangle_count_literal", lambda g: triangles.triangle_count(g.edges, orient=False))
on_copurchase("triangle_chunks", lambda g: triangles.triangle_chunks(g.vertices, g.edges))
on_copurchase("triangle_edge_chunks", lambda g: triangles.triangle_edge_chunks(g.edges))
on_copurchase("graph_size", lambda g: g.sizes())
on_copurchase("out_degree", lambda g: g.out_degrees())
on_copurchase("in_degree", lambda g: g.in_degrees())
on_copurchase("degree_histogram", lambda g: g.out_degrees().groupBy("degree").agg(F.count(F.lit(1)).alias("vertices")))
on_copurchase("adjacency_sorted", lambda g: _joined(g.adjacency()))
on_copurchase("edge_window", lambda g: _joined(g.edge_window(2, 5)))
on_copurchase("edge_at_offset", lambda g: g.edge_at(2))
on_copurchase("vertex_window", lambda g: g.vertex_window(10, 50))
on_copurchase("transpose", lambda g: g.transpose().edges)
on_copurchase("mirror_list", lambda g: g.mirrors(HOSTS))
on_copurchase("host_counts", lambda g: g.host_counts(HOSTS))

# ---- import


@query
def record_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = record_edges(tables.record_lines(spark, sf_dir))
    return edges.groupBy("src_type", "type", "dst_type").agg(F.count(F.lit(1)).alias("edges"), F.sum("src").alias("src_sum"), F.sum("dst").alias("dst_sum"))


def _vertices_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_vertices(tables.record_lines(spark, sf_dir)).groupBy("type").agg(F.count(F.lit(1)).alias("vertices"), F.sum("id").alias("id_sum"))


QUERIES["record_vertices"] = _vertices_by_type


@query
def undeclared_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = tables.record_lines(spark, sf_dir)
    v, e = record_vertices(text), record_edges(text)
    place = lambda c, t: F.col(c) * 8 + code_of(F.col(t), tables.SPACES)
    g = Graph(v.select(place("id", "type").alias("id")), e.select(place("src", "src_type").alias("src"), place("dst", "dst_type").alias("dst")))
    return g.undeclared().agg(F.count(F.lit(1)).alias("undeclared"))


on_trade("inverse_union", lambda g: sets.inverse_union(g.edges.filter("type = 'SALE'").select("src", "dst", "topic", "type", "amount")))
on_trade("diropt_edges", lambda g: sets.direction_optimised(g.edges))
on_trade("exchange_edges", lambda g: exchange_edges(g.edges, 4))
on_copurchase("virtual_host_counts", lambda g: aggregates.virtual_host_counts(g.edges, 64))
on_copurchase("edge_balance", lambda g: aggregates.balanced_hosts(aggregates.virtual_host_counts(g.edges, 64), HOSTS))
on_copurchase("round_robin_hosts", lambda g: aggregates.round_robin_hosts(aggregates.virtual_host_counts(g.edges, 64), HOSTS))

# ---- projection


def _sales(g: Graph) -> Graph:
    """Suppliers and customers are people, but for every fifth, who is a firm."""
    kind = lambda c: F.when(F.col(c) % 5 == 0, "FIRM").otherwise("PERSON")
    people = Graph(g.vertices.withColumn("type", kind("id")), g.edges.withColumn("src_type", kind("src")).withColumn("dst_type", kind("dst")))
    return projection.project(people, projection.sales_projection(topic=13))


on_trade("project_sales", lambda g: _sales(g).edges)
on_trade("project_drop_edgeless", lambda g: _sales(g).vertices)


@query
def project_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, edges = tables.knowledge(spark, sf_dir)
    return projection.project(Graph(rows.select("id"), edges), projection.relation_projection({"award-winner": 207, "affiliated-with": 40})).edges


@query
def entity_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, edges = tables.knowledge(spark, sf_dir)
    return projection.entity_labels(rows, edges)


# ---- aggregates, order, membership


@query
def accumulator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.total(table(spark, sf_dir, "lineitem"), "l_quantity")


@query
def prefix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    return ordering.prefix_sum(orders, ["o_orderkey"], "price", kind="decimal(28,2)").select("o_orderkey", F.col("running").cast("double").alias("running"))


def _own_ids(g: Graph) -> DataFrame:
    return g.vertices.select("id", F.col("id").alias("value"))


def _synchronised(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Each vertex's value is its id; a mirror of dst on src's host holds the least src that it saw."""
    mirrors = g.edges.select((F.pmod("src", F.lit(HOSTS))).cast("int").alias("host"), F.col("dst").alias("id"), F.col("src").alias("value")).groupBy("host", "id").agg(F.min("value").alias("value")).withColumn("dirty", F.lit(True))
    masters, _ = neighbourhood.synchronised(mirrors, _own_ids(g), "min")
    far = mirrors.filter(F.col("host") != F.pmod("id", F.lit(HOSTS))).withColumn("value", F.col("id"))
    return masters, neighbourhood.broadcast_to_mirrors(masters, far)


on_copurchase("neighbor_min_sync", lambda g: _synchronised(g)[0])
on_copurchase("mirror_broadcast", lambda g: _synchronised(g)[1])
on_copurchase("neighbor_sum", lambda g: neighbourhood.along_edges(g.edges, _own_ids(g), how="sum"))
on_copurchase("topk_degree", lambda g: ordering.top_k(g.out_degrees(), 25, "degree"))
on_trade("topk_neighbours", lambda g: ordering.top_k_per(g.edges.filter("type = 'SALE'").select("src", "dst", "amount"), ["src"], 3, "amount", "dst"))
on_copurchase("argmax_degree", lambda g: ordering.arg_max(g.out_degrees(), "degree"))
on_copurchase("sorted_edges", lambda g: ordering.indexed(g.edges, ["src", "dst"], "place"))
on_copurchase("lower_bound", lambda g: g.adjacency().select("id", ordering.lower_bound(F.col("neighbours"), F.lit(100)).alias("place")))
on_copurchase("common_neighbors", lambda g: sets.common_neighbours(g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), g.adjacency()).select("a", "b", F.size("common").cast("bigint").alias("common")))
on_copurchase("edge_probe", lambda g: sets.edge_probe(g.edges.select(F.col("dst").alias("src"), (F.col("dst") + 1).alias("dst")).distinct(), g.edges))

# ---- traversal

on_copurchase("bfs_levels", lambda g: traversal.bfs(g.edges, [0]).select("id", "distance"))
on_copurchase("bfs_push_pull", lambda g: traversal.bfs_push_pull(g.vertices, g.edges, 0))
on_copurchase("bfs_multi_source", lambda g: traversal.bfs(g.edges, [0, 1, 2, 3]))


def _unreached(g: Graph) -> DataFrame:
    g = Graph(g.vertices, stored(g.edges))
    return traversal.with_unreached(g.vertices, traversal.bfs(g.edges, [0]), 0)


def _traversed(g: Graph) -> DataFrame:
    edges = stored(g.edges)
    return traversal.edges_traversed(edges, traversal.bfs(edges, [0]))


on_copurchase("bfs_unreached", _unreached)
on_copurchase("bfs_edges_traversed", _traversed)
on_copurchase("sssp_relax", lambda g: traversal.shortest_paths(g.edges, 0))
on_copurchase("sssp_weighted", lambda g: traversal.shortest_paths(g.edges.withColumn("w", 1 + (F.col("src") * 31 + F.col("dst") * 17) % 5), 0, "w"))

# ---- influence


def _weighted(g: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    edges = stored(g.edges.select("src", "dst", "type", "topic", "amount"))
    trade = stored(influence.traded(g.vertices, edges))
    return edges, trade, influence.edge_probabilities(edges, trade)


def _sets(g: Graph) -> DataFrame:
    return influence.reachable_sets(g.vertices, _weighted(g)[2], catalog_sql.SETS)


def _influential(g: Graph) -> DataFrame:
    found = influence.influential_nodes(_sets(g), catalog_sql.PICKS)
    return found.picks.withColumn("uninfluenced", F.lit(found.uninfluenced).cast("bigint"))


on_trade("sold_bought", lambda g: influence.traded(g.vertices, g.edges))
on_trade("edge_probability", lambda g: _weighted(g)[2].select("src", "dst", "type", "topic", F.round("weight", 9).alias("weight")))
on_trade("influence_totals", lambda g: influence.influence_totals(_weighted(g)[2]).select(F.round("total_weight", 4).alias("total_weight"), "total_amount"))
on_trade("rrr_sets", lambda g: _sets(g).select("set_id", "id"))
on_trade("vertex_frequency", lambda g: influence.frequencies(_sets(g)))
on_trade("influential_nodes", _influential)


@query
def influence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.trade(spark, sf_dir)
    edges, trade, weighted = _weighted(g)
    found = influence.influential_nodes(influence.reachable_sets(g.vertices, weighted, catalog_sql.SETS), catalog_sql.PICKS)
    return influence.report(found.picks, edges, trade, weighted).withColumn("influence", F.round("influence", 6))


# ---- reasoning


def _reasoning(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Callable[[int], list[float]]]:
    rows, _ = tables.knowledge(spark, sf_dir)
    return rows, lambda k: reasoning.feature_of(rows, k)


@query
def transe_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, of = _reasoning(spark, sf_dir)
    return reasoning.best_tails(rows, of(0), of(207))


@query
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, of = _reasoning(spark, sf_dir)
    return reasoning.reranked(reasoning.best_tails(rows, of(0), of(207)), rows, of(1), of(3))


@query
def reasoning_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, of = _reasoning(spark, sf_dir)
    relations = {"award-winner": of(207), "works-in": of(3), "affiliated-with": of(40)}
    return reasoning.reasoning_chain(rows.filter("label <> 2"), rows.filter("label = 2"), relations, award=of(0), field=of(1))


@query
def beam_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, edges = tables.knowledge(spark, sf_dir)
    return _joined(reasoning.beam_paths(edges, rows, 0, 104, most_vertices=catalog_sql.PATH_VERTICES, k=10, beam=3), "path")


@query
def link_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, edges = tables.knowledge(spark, sf_dir)
    return features.link_scores(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct(), rows)


# ---- features and learning


@query
def two_hop_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.catalogue(spark, sf_dir, checked=False)
    return _joined(features.two_hop_features(g.vertices, g.edges), "features")


on_trade("split_masks", lambda g: features.split_masks(g.vertices))
on_trade("minibatches", lambda g: features.minibatches(features.split_masks(g.vertices).filter("split = 'train'"), 2))
on_copurchase("neighbor_samples", lambda g: features.sampled_edges(g.vertices.select((F.col("id") % 64).alias("batch"), "id"), g.edges))
on_copurchase("ego_graphs", lambda g: features.ego_graphs(g.vertices, g.edges))


@query
def softmax_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = tables.knowledge(spark, sf_dir)
    return rows.select("id", F.posexplode(softmax(F.col("features"))).alias("place", "p")).select("id", "place", F.round("p", 6).alias("p"))


@query
def gcn_train_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(split, total, correct) after training; the features alone tell most classes apart."""
    g = tables.catalogue(spark, sf_dir)
    made, masks = stored(features.two_hop_features(g.vertices, g.edges)), stored(features.split_masks(g.vertices))
    nearest = features.hashed_neighbours(g.edges)
    network, history = gcn.train(g.vertices, g.edges, made, masks, nearest=nearest)
    test = gcn.accuracy(network, g.vertices, g.edges, made, masks, "test", nearest=nearest)
    rows = [("train", history[-1]["total"], history[-1]["correct"]), ("test", test["total"], test["correct"])]
    return spark.createDataFrame(rows, "split string, total long, correct long")


# ---- kernels


@query
def spmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("value"))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.col("s_nationkey").cast("double"), (F.col("s_suppkey") % 7).cast("double")).alias("features"))
    return features.sparse_product(matrix, rows)


@query
def stream_triad(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, c = F.col("o_totalprice"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", b.alias("copied"), F.round(3.0 * b, 4).alias("scaled"), F.round(b + c, 4).alias("added"), F.round(b + 3.0 * c, 4).alias("triad"))


@query
def random_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.random_updates(20_000, 1024, spark)


QUERIES |= catalog_files.QUERIES
ORACLE_SQL: dict[str, str] = {k: v for k, v in catalog_sql.ORACLE_SQL.items() if k in QUERIES} | catalog_files.ORACLE_SQL
