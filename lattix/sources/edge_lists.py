"""Edge lists: whitespace separated ``src dst`` lines, and Matrix Market coordinate files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import optional_number, owner
from ..graph import Graph
from ..operators.sets import direction_optimised


def lines(spark: SparkSession, path: str | list[str], comment: str | None = "#") -> DataFrame:
    """(value): lines that aren't comments."""
    text = spark.read.text(path)
    return text.filter(~F.col("value").startswith(comment)) if comment else text


def _number(c: Column) -> Column:
    """Digits, in which underscores don't count; anything else is null."""
    return optional_number(F.replace(c, F.lit("_"), F.lit("")))


def parse_edges(text: DataFrame, *kept: str) -> DataFrame:
    """(src, dst) of lines (value), and the columns to be kept; lines without two numbers go.

    A line is cut at its first two gaps, not split by a regular expression. The generator keeps filters from cutting it anew."""
    blank = F.lit(" ")
    line = F.trim(F.replace(F.replace("value", F.lit("\t"), blank), F.lit(","), blank))
    first = F.substring_index(line, " ", 1)
    second = F.substring_index(F.ltrim(F.substr(line, F.length(first) + 1)), " ", 1)
    ends = text.select(*kept, F.inline(F.array(F.struct(first.alias("a"), second.alias("b")))))
    return ends.select(_number(F.col("a")).alias("src"), _number(F.col("b")).alias("dst"), *kept).filter("src is not null and dst is not null")


def read_edges(spark: SparkSession, path: str | list[str], n: int | None = None) -> DataFrame:
    """Edges of a file; with n, only those whose endpoints are below it. Repeated edges and self-loops stay."""
    edges = parse_edges(lines(spark, path))
    return edges.filter((F.col("src") < n) & (F.col("dst") < n)) if n is not None else edges


def read_graph(spark: SparkSession, path: str | list[str], n: int) -> Graph:
    """Vertices 0 to n - 1 and the edges among them."""
    return Graph(spark.range(n), read_edges(spark, path, n))


def read_adjacency(spark: SparkSession, path: str, n: int, *, direction_optimise: bool = False, as_read: bool = False) -> DataFrame:
    """(id, neighbours) of vertices 0 to n - 1, sorted, or in the order of the lines; empty for those without edges.

    All lines are read; edges out of other vertices go before lists are made, whatever vertex they lead to."""
    inside = (F.col("src") >= 0) & (F.col("src") < n)
    if as_read:
        # splits of a file needn't be read in order: a line's place is its file, its split and its number in that
        text = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")).alias("at"))
        parts = parse_edges(text.filter(~F.col("value").startswith("#")), "at").filter(inside)
        listed = parts.groupBy(F.col("src").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "dst"))), lambda x: x["dst"]).alias("neighbours"))
        return spark.range(n).join(listed, "id", "left").select("id", F.coalesce("neighbours", F.array().cast("array<bigint>")).alias("neighbours"))
    edges = read_edges(spark, path)
    graph = Graph(spark.range(n), (direction_optimised(edges) if direction_optimise else edges).filter(inside))
    return graph.vertices.join(graph.adjacency(), "id", "left").select("id", F.coalesce("neighbours", F.array().cast("array<bigint>")).alias("neighbours"))


def exchange_edges(edges: DataFrame, hosts: int) -> DataFrame:
    """(bucket, src, dst): least endpoint first, distinct, no self-loops, placed by the least endpoint."""
    pairs = direction_optimised(edges, self_loops=False)
    return pairs.select(owner(F.col("src"), hosts).alias("bucket"), "src", "dst")


def from_adjacency(adjacency: DataFrame) -> Graph:
    """A graph from (id, neighbours); each listed id is a vertex."""
    return Graph(adjacency.select("id"), adjacency.select(F.col("id").alias("src"), F.explode("neighbours").alias("dst")))


def from_sorted_edges(edges: DataFrame) -> Graph:
    """Vertices are the sources, and the destinations that are no source."""
    sources = edges.select(F.col("src").alias("id")).distinct()
    leaves = edges.select(F.col("dst").alias("id")).distinct().join(sources, "id", "left_anti")
    return Graph(sources.unionAll(leaves), edges)


def read_matrix_market(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """Header facts (rows, columns, entries, symmetric, field) and (src, dst, value), from 0.

    A symmetric file gives each entry in both directions, those of the diagonal twice; a pattern's values are 1.
    """
    text = lines(spark, path, None)
    head = text.filter(F.lower(F.substring("value", 1, 14)) == "%%matrixmarket").first()
    words = head["value"].lower().split() if head else []
    if len(words) < 5 or words[2] != "coordinate" or words[3] not in ("real", "integer", "pattern") or words[4] not in ("general", "symmetric"):
        raise ValueError(f"unsupported Matrix Market header {head['value'] if head else None!r}")
    body = text.filter(~F.col("value").startswith("%") & (F.trim("value") != "")).withColumn("at", F.monotonically_increasing_id())
    first = body.orderBy("at").first()  # the line of sizes is the first that is no comment
    size = first["value"].split()
    rows = body.filter(F.col("at") != first["at"]).select(F.split(F.trim("value"), r"\s+").alias("p"))
    value = F.lit(1.0) if words[3] == "pattern" else F.get("p", F.lit(2)).try_cast("double")
    edges = rows.select((F.get("p", F.lit(0)).try_cast("bigint") - 1).alias("src"), (F.get("p", F.lit(1)).try_cast("bigint") - 1).alias("dst"), value.alias("value"))
    if words[4] == "symmetric":
        edges = edges.select(F.inline(F.array(F.struct("src", "dst", "value"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "value"))))
    return {"rows": int(size[0]), "columns": int(size[1]), "entries": int(size[2]), "symmetric": words[4] == "symmetric", "field": words[3]}, edges


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(id, features) of a dense file: a line a row, numbers divided by blanks; the line's place is the id."""
    text = lines(spark, path).filter(F.trim("value") != "").withColumn("_at", F.monotonically_increasing_id())
    from ..operators.ordering import indexed

    placed = indexed(text, ["_at"], "id")
    return placed.select("id", F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.try_cast("double")).alias("features"))
