"""Graphs made from the relational tables, on which the catalogue's queries run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph, from_edges
from .storage import stored, table, task_count


def copurchase(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts of one order, from the lesser key to the greater.

    An order's parts are a row. Its pairs are counted before they are made, so that they are dealt to as many tasks as they
    need; they travel once, to their source, which is also where they are grouped by."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").filter("l_orderkey is not null and l_partkey is not null")
    orders = stored(line.repartition(task_count(spark, line.count()), "l_orderkey").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts")).select("parts"))
    n = F.size("parts").cast("bigint")
    pairs = orders.agg(F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0)).cast("bigint")).first()[0]
    both = orders.select("parts", F.explode("parts").alias("src")).select("src", F.explode("parts").alias("dst")).filter("src < dst")
    return from_edges(both.repartition(task_count(spark, pairs), "src").distinct())


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers (even ids) and customers (odd ids): a sale per pair and brand, and the purchase in the other direction."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("amount"))
    order = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.substring("p_brand", 7, 9).cast("bigint").alias("topic"))
    sums = line.join(order, "l_orderkey").join(part, "l_partkey").groupBy((F.col("l_suppkey") * 2).alias("src"), (F.col("o_custkey") * 2 + 1).alias("dst"), "topic").agg(F.sum("amount").cast("double").alias("amount"))
    pair = F.array(
        F.struct("src", "dst", F.lit("SALE").alias("type"), F.lit("SUPPLIER").alias("src_type"), F.lit("CUSTOMER").alias("dst_type"), "amount", "topic"),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("PURCHASE").alias("type"), F.lit("CUSTOMER").alias("src_type"), F.lit("SUPPLIER").alias("dst_type"), "amount", "topic"),
    )
    suppliers = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("id"), F.lit("SUPPLIER").alias("type"))
    customers = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2 + 1).alias("id"), F.lit("CUSTOMER").alias("type"))
    return Graph(suppliers.unionAll(customers), sums.select(F.inline(pair)))


def record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value): the tables as a record file. Customers are people, orders forum events, parts publications, nations topics."""
    read = lambda name: table(spark, sf_dir, name)

    def line(df: DataFrame, label: str, **at: str) -> DataFrame:
        names = ("person", "person_to", "forum", "event", "publication", "topic")
        return df.select(F.concat_ws(",", F.lit(label), *(F.col(at[c]).cast("string") if c in at else F.lit("") for c in names), *[F.lit("")] * 3).alias("value"))

    customer, order, part, supplier = read("customer"), read("orders"), read("part"), read("supplier")
    nation = read("nation")
    out = [
        line(customer, "Person", person="c_custkey"),
        line(order, "ForumEvent", event="o_orderkey"),
        line(part, "Publication", publication="p_partkey"),
        line(supplier, "Forum", forum="s_suppkey"),
        line(nation, "Topic", topic="n_nationkey"),
        line(order, "Author", person="o_custkey", event="o_orderkey"),
        line(read("lineitem"), "Includes", forum="l_suppkey", event="l_orderkey"),
        line(supplier, "HasTopic", forum="s_suppkey", topic="s_nationkey"),
        line(part.withColumn("n", F.pmod("p_partkey", F.lit(25))), "HasOrg", publication="p_partkey", topic="n"),
        line(customer.withColumn("to", F.col("c_custkey") + 1), "Sale", person="c_custkey", person_to="to"),
    ]
    both = out[0]
    for x in out[1:]:
        both = both.unionAll(x)
    return stored(both)  # a file, as records are; each use reads it once


#: distance between the ids of vertex types in one id space.
SPACES = {"PERSON": 0, "FORUM": 1, "FORUMEVENT": 2, "PUBLICATION": 3, "TOPIC": 4}


def catalogue(spark: SparkSession, sf_dir: str, *, checked: bool = True) -> Graph:
    """The records as a typed graph; an id is 8 times the record's, plus its type's number.

    Not checked, it has edges with undeclared endpoints, too: for plans that meet both ends with the vertices anyway."""
    from .functions.scalars import code_of
    from .sources.records import record_edges, record_vertices

    text = record_lines(spark, sf_dir)
    vertices, edges = record_vertices(text), record_edges(text)
    known = vertices.select((F.col("id") * 8 + code_of(F.col("type"), SPACES)).alias("id"), "type")
    placed = edges.select((F.col("src") * 8 + code_of(F.col("src_type"), SPACES)).alias("src"), (F.col("dst") * 8 + code_of(F.col("dst_type"), SPACES)).alias("dst"), "type")
    graph = Graph(stored(known), placed)
    return Graph(graph.vertices, stored((graph.checked(drop=True) if checked else graph).edges))


def knowledge(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entities (id, features, label) and edges (src, dst, type, mirror): five arithmetic links of each vector, of the relation types in turn."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"), "label")
    n = rows.agg(F.max("id") + 1).first()[0]
    links = rows.select("id", F.explode(F.array(*(F.lit(j).cast("bigint") for j in range(1, 6)))).alias("j"))
    type_ = F.element_at(F.array(F.lit(207), F.lit(3), F.lit(40)), (F.col("j") % 3 + 1).cast("int")).cast("bigint")
    edges = links.select(F.col("id").alias("src"), ((F.col("id") * 7 + F.col("j") * 13) % n).alias("dst"), type_.alias("type"), (F.col("id") % 2 == 1).alias("mirror"))
    return rows, edges
