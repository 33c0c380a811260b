"""Queries that go through text files: each writes one to the shared folder and reads it with the library's reader."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .catalog_sql import CATALOGUE, EDGES, RECORDS, TRADE
from .functions.scalars import leaky_relu, leading_number, namespaced, relu, us_date
from .operators import aggregates
from .plans.traversal import bfs, with_unreached
from .sources import edge_lists, records, sinks
from .storage import gone_at_end, new_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
BOUND = 1000


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _line(*columns: Column | str, by: str = " ") -> Column:
    return F.concat_ws(by, *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns)).alias("value")


def _written(lines: DataFrame) -> str:
    path = new_path(lines.sparkSession)
    lines.write.text(path)
    gone_at_end(lines.sparkSession, path)
    return path


def _edge_file(spark: SparkSession, sf_dir: str) -> str:
    edges = tables.copurchase(spark, sf_dir).edges
    comments = spark.range(3).select(F.lit("# source target").alias("value"))
    return _written(comments.unionAll(edges.select(_line("src", "dst"))))


@query(f"WITH {EDGES} SELECT src, dst FROM e")
def edge_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_lists.read_edges(spark, _edge_file(spark, sf_dir))


@query(f"WITH {EDGES} SELECT {BOUND}::BIGINT AS n_vertices, count(*) AS n_edges FROM e WHERE src < {BOUND} AND dst < {BOUND}")
def bounded_edge_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_lists.read_graph(spark, _edge_file(spark, sf_dir), BOUND).sizes()


@query(f"WITH {EDGES} SELECT id, coalesce(string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst DESC), '') AS neighbours FROM range(0, {BOUND}) x(id) LEFT JOIN e ON src = id GROUP BY 1")
def adjacency_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in the order of the lines: each source's from the greatest to the least. The edges come placed by source."""
    edges = tables.copurchase(spark, sf_dir).edges.sortWithinPartitions("src", F.desc("dst"))
    found = edge_lists.read_adjacency(spark, _written(edges.select(_line("src", "dst"))), BOUND, as_read=True)
    return found.select("id", F.array_join("neighbours", " ").alias("neighbours"))


@query(f"WITH {CATALOGUE}, ids AS (SELECT DISTINCT id // 8 AS id FROM cv) SELECT (SELECT count(*) FROM cv) AS n_vertices, (SELECT count(*) FROM both_ WHERE src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids)) AS n_edges")
def record_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.read_records(spark, _written(tables.record_lines(spark, sf_dir)), strict=False).sizes()


_NETWORK_SQL = """WITH n AS (
  SELECT o_custkey AS src, o_custkey + 1 AS dst, 'SALE' AS type, 'PERSON' AS src_type, 'PERSON' AS dst_type, CAST(o_totalprice AS DECIMAL(18, 4)) AS amount, o_orderkey % 50 AS topic, 0 AS duration FROM orders
  UNION ALL SELECT l_partkey, l_suppkey, 'COMMUNICATION', 'DEVICE', 'DEVICE', 0, 0, l_linenumber FROM lineitem
  UNION ALL SELECT c_custkey, c_nationkey, 'FRIEND', 'PERSON', 'PERSON', 0, 0, 0 FROM customer
  UNION ALL SELECT s_suppkey, s_nationkey, 'USES', 'PERSON', 'DEVICE', 0, 0, 0 FROM supplier),
b AS (SELECT * FROM n UNION ALL SELECT dst, src, CASE type WHEN 'SALE' THEN 'PURCHASE' ELSE 'NONE' END, dst_type, src_type, amount, topic, duration FROM n)
SELECT type, src_type, dst_type, count(*) AS edges, CAST(sum(src) AS BIGINT) AS src_sum, CAST(sum(dst) AS BIGINT) AS dst_sum, CAST(sum(topic) AS BIGINT) AS topics, CAST(sum(duration) AS BIGINT) AS duration, CAST(sum(amount) AS DOUBLE) AS amount FROM b GROUP BY 1, 2, 3"""


@query(_NETWORK_SQL)
def network_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commercial, cyber, social and device networks, one file each."""
    none = F.lit("")
    commercial = table(spark, sf_dir, "orders").select(_line(F.lit("Sale"), "o_custkey", F.col("o_custkey") + 1, F.col("o_orderkey") % 50, none, none, none, F.col("o_totalprice").cast("decimal(18,4)"), by=","))
    cyber = table(spark, sf_dir, "lineitem").select(_line("l_partkey", "l_suppkey", F.lit(0), "l_linenumber", *[F.lit(0)] * 7, by=","))
    social = table(spark, sf_dir, "customer").select(_line("c_custkey", "c_nationkey", by=","))
    uses = table(spark, sf_dir, "supplier").select(_line("s_suppkey", "s_nationkey", by=","))
    edges = records.read_network(spark, commercial=_written(commercial), cyber=_written(cyber), social=_written(social), uses=_written(uses))
    total = lambda c: F.sum(c).alias(f"{c}_sum")
    return edges.groupBy("type", "src_type", "dst_type").agg(F.count(F.lit(1)).alias("edges"), total("src"), total("dst"), F.sum("topic").alias("topics"), F.sum("duration").alias("duration"), F.sum(F.col("amount").cast("decimal(18,4)")).cast("double").alias("amount"))


@query("SELECT vec_id AS id, CAST(i - 1 AS INTEGER) AS place, round(CAST(embedding[i] AS DOUBLE), 4) + 0.0 AS x FROM embeddings, range(1, 65) r(i)")
def embedding_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    values = F.transform("embedding", lambda x: F.round(x.cast("double"), 4).cast("decimal(12,4)").cast("string"))
    path = _written(rows.select(F.concat_ws(",", F.col("vec_id").cast("string"), values).alias("value")))
    return records.embedding_rows(edge_lists.lines(spark, path, None)).select("id", F.posexplode("features").alias("place", "x"))


_RELATIONS_SQL = "WITH r AS (SELECT l_partkey AS src, [207, 3, 40][CAST(l_linenumber % 3 AS INTEGER) + 1] AS type, l_suppkey AS dst FROM lineitem) SELECT src, dst, CAST(type AS BIGINT) AS type, false AS mirror FROM r UNION ALL SELECT dst, src, CAST(type AS BIGINT), true FROM r"


@query(_RELATIONS_SQL)
def relation_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit(207), F.lit(3), F.lit(40)), (F.col("l_linenumber") % 3 + 1).cast("int"))
    path = _written(table(spark, sf_dir, "lineitem").select(_line("l_orderkey", "l_partkey", kind, "l_suppkey", by=",")))
    return records.relation_edges(edge_lists.lines(spark, path, None))


@query("SELECT CAST(vec_id AS BIGINT) AS id, round(CAST(embedding[1] AS DOUBLE), 4) AS first, CAST(len(embedding) AS INTEGER) AS length FROM embeddings WHERE vec_id IN (207, 3, 40)")
def relation_feature_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    values = F.transform("embedding", lambda x: F.round(x.cast("double"), 4).cast("decimal(12,4)").cast("string"))
    path = _written(rows.select(F.concat_ws(",", F.col("vec_id").cast("string"), values).alias("value")))
    return records.relation_features(edge_lists.lines(spark, path, None)).select("id", F.element_at("features", 1).alias("first"), F.size("features").alias("length"))


@query("WITH m AS (SELECT CAST(n_nationkey AS BIGINT) AS src, CAST(n_regionkey AS BIGINT) AS dst, CAST(n_nationkey AS DOUBLE) / 2 AS value FROM nation) SELECT src, dst, value FROM m UNION ALL SELECT dst, src, value FROM m")
def matrix_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symmetric Matrix Market file of one part: the header and sizes come first."""
    nation = table(spark, sf_dir, "nation")
    head = spark.createDataFrame([(0, "%%MatrixMarket matrix coordinate real symmetric"), (1, "% nations and regions"), (2, f"30 30 {nation.count()}")], "at int, value string")
    body = nation.select(F.lit(3).alias("at"), _line(F.col("n_nationkey") + 1, F.col("n_regionkey") + 1, F.col("n_nationkey").cast("double") / 2))
    return edge_lists.read_matrix_market(spark, _written(head.unionAll(body).coalesce(1).sortWithinPartitions("at").select("value")))[1]


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS id, CAST(n_nationkey AS DOUBLE) / 2 AS a, CAST(n_regionkey AS DOUBLE) AS b FROM nation")
def feature_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_nationkey")
    found = edge_lists.read_features(spark, _written(nation.select(_line(F.col("n_nationkey").cast("double") / 2, "n_regionkey"))))
    return found.select("id", F.element_at("features", 1).alias("a"), F.element_at("features", 2).alias("b"))


def _read_back(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(place, name): the lines in the order of the files."""
    from .operators.ordering import indexed

    keys = ["file", "start", "at"]
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).withColumn("at", F.monotonically_increasing_id())
    return indexed(text, keys, "place").select("place", F.col("value").alias(name))


@query(f"""WITH RECURSIVE {EDGES}, b AS (SELECT CAST(0 AS BIGINT) AS id, CAST(0 AS BIGINT) AS d UNION SELECT e.dst, b.d + 1 FROM b JOIN e ON e.src = b.id WHERE b.d < 30), m AS (SELECT id, min(d) AS d FROM b GROUP BY 1)
SELECT row_number() OVER (ORDER BY v.id) - 1 AS place, coalesce(CAST(d AS VARCHAR), '') AS distance FROM v LEFT JOIN m ON m.id = v.id""")
def distances_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, path = tables.copurchase(spark, sf_dir), new_path(spark)
    sinks.write_distances(with_unreached(g.vertices, bfs(g.edges, [0]), 0), path)
    gone_at_end(spark, path)
    return _read_back(spark, path, "distance")


@query(f"WITH {EDGES}, a AS (SELECT id, coalesce(string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst), '') AS neighbours FROM v LEFT JOIN e ON src = id GROUP BY 1) SELECT row_number() OVER (ORDER BY id) - 1 AS place, neighbours FROM a")
def adjacency_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, path = tables.copurchase(spark, sf_dir), new_path(spark)
    sinks.write_adjacency(g, path)
    gone_at_end(spark, path)
    return _read_back(spark, path, "neighbours")


@query(f"WITH {EDGES} SELECT CAST(id % 8 AS INTEGER) AS Host, 'Vertices' AS Category, count(*) AS Count FROM v GROUP BY 1 UNION ALL SELECT CAST(src % 8 AS INTEGER), 'Edges', count(*) FROM e GROUP BY 1")
def host_counts_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    sinks.write_host_counts(tables.copurchase(spark, sf_dir), 8, path)
    gone_at_end(spark, path)
    return spark.read.option("header", True).schema("Host int, Category string, Count long").csv(path)


# ---- scalars that no other query uses


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(month(o_orderdate) AS DOUBLE) AS month FROM orders")
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as records have them, month first; as a number such a field is its month."""
    text = F.date_format("o_orderdate", "M/d/yyyy")
    return table(spark, sf_dir, "orders").select("o_orderkey", us_date(text).cast("string").alias("day"), leading_number(text).alias("month"))


@query(f"WITH {TRADE} SELECT type AS kind, id // 2 AS id, count(*) AS n FROM tv GROUP BY 1, 2")
def namespaced_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers of one number stay apart."""
    v = tables.trade(spark, sf_dir).vertices
    key = namespaced(F.col("type"), F.floor(F.col("id") / 2))
    return v.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).select("key.kind", "key.id", "n")


@query("SELECT vec_id AS id, CAST(i - 1 AS INTEGER) AS place, greatest(CAST(embedding[i] AS DOUBLE), 0.0) AS relu, round(CASE WHEN embedding[i] > 0 THEN CAST(embedding[i] AS DOUBLE) ELSE CAST(embedding[i] AS DOUBLE) * 0.01 END, 9) AS leaky FROM embeddings, range(1, 65) r(i)")
def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x").cast("double")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("place", "x"))
    return rows.select("id", "place", relu(x).alias("relu"), F.round(leaky_relu(x), 9).alias("leaky"))


@query("SELECT count(*) AS total, CAST(sum(CAST(label = vec_id % 3 AS BIGINT)) AS BIGINT) AS correct FROM embeddings WHERE vec_id % 2 = 1")
def masked_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 3).alias("predicted"), "label", (F.col("vec_id") % 2 == 1).alias("mask"))
    return aggregates.masked_accuracy(rows, "predicted", "label", "mask")


@query(f"WITH {RECORDS} SELECT src, count(*) AS edges, CAST(sum(dst) AS BIGINT) AS dst_sum FROM r WHERE type = 'AUTHOR' GROUP BY 1")
def grouped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    grouped = aggregates.grouped_edges(orders)
    return grouped.select("src", F.size("edges").cast("bigint").alias("edges"), F.aggregate("edges", F.lit(0).cast("bigint"), lambda s, x: s + x["dst"]).alias("dst_sum"))
