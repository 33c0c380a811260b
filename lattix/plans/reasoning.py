"""Multi-hop reasoning over translation embeddings, and beam search over paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import l1_norm, translation_score
from ..operators.ordering import top_k, top_k_per
from ..storage import stored

TOP_K = 50


def feature_of(rows: DataFrame, id_: int) -> list[float]:
    """The features of one row (id, features); an error if there is none."""
    found = rows.filter(F.col("id") == id_).select("features").first()
    if found is None:
        raise KeyError(f"no features of {id_}")
    return [float(x) for x in found["features"]]


def _literal(v: list[float]):  # noqa: ANN202
    return F.array(*(F.lit(x) for x in v))


def scored(entities: DataFrame, head: list[float], relation: list[float]) -> DataFrame:
    """(id, score) of entities (id, features) as tails of (head, relation)."""
    return entities.select("id", F.round(translation_score(_literal(head), _literal(relation), F.col("features")), 6).alias("score"))


def best_tails(entities: DataFrame, head: list[float], relation: list[float], k: int = TOP_K) -> DataFrame:
    """The k best, by score and then least id."""
    return top_k(scored(entities, head, relation), k, "score")


def reranked(chosen: DataFrame, entities: DataFrame, head: list[float], relation: list[float]) -> DataFrame:
    """(id, score) of the chosen ids by another head and relation, best first."""
    return scored(entities.join(chosen.select("id"), "id", "left_semi"), head, relation).orderBy(F.col("score").desc(), "id")


def best_tail_each(heads: DataFrame, entities: DataFrame, relation: list[float], k: int = TOP_K) -> DataFrame:
    """(head, id, score): for each of at most k heads (id, features) its best entity. Heads are a stated, bounded query set."""
    asked = [(r["id"], [float(x) for x in r["features"]]) for r in heads.select("id", "features").limit(k).collect()]
    queries = heads.sparkSession.createDataFrame(asked, "head long, of array<double>")
    pairs = entities.join(F.broadcast(queries))
    score = F.round(translation_score(F.col("of"), _literal(relation), F.col("features")), 6)
    best = pairs.select("head", "id", score.alias("score")).groupBy("head").agg(F.max(F.struct("score", (-F.col("id")).alias("neg"))).alias("b"))
    return best.select("head", (-F.col("b.neg")).alias("id"), F.col("b.score").alias("score"))


def reasoning_chain(people: DataFrame, places: DataFrame, relations: dict[str, list[float]], *, award: list[float], field: list[float], k: int = TOP_K) -> DataFrame:
    """(person, person_score, place, place_score): the k best people by award, scored anew by field, each with the best place."""
    chosen = stored(best_tails(people, award, relations["award-winner"], k))
    second = reranked(chosen, people, field, relations["works-in"]).select(F.col("id").alias("person"), F.col("score").alias("person_score"))
    heads = people.join(chosen.select("id"), "id", "left_semi")
    third = best_tail_each(heads, places, relations["affiliated-with"], k).select(F.col("head").alias("person"), F.col("id").alias("place"), F.col("score").alias("place_score"))
    return second.join(third, "person").select("person", "person_score", "place", "place_score")


def beam_paths(edges: DataFrame, entities: DataFrame, start: int, end: int, *, most_vertices: int, k: int, beam: int) -> DataFrame:
    """(path, score): the k best simple paths from start to end with at most most_vertices vertices.

    A path's score is the sum of its vertices' L1 norms. Each path is carried on with its ``beam`` best unfinished
    extensions; those that reach the end are results.
    """
    norms = stored(entities.select("id", l1_norm(F.col("features")).alias("norm")))
    step = stored(edges.select("src", "dst").distinct().join(norms.select(F.col("id").alias("dst"), "norm"), "dst").select("src", "dst", "norm"))
    paths = stored(norms.filter(F.col("id") == start).select(F.array("id").alias("path"), F.col("id").alias("src"), F.col("norm").alias("score")))
    found = None
    for _ in range(most_vertices - 1):
        on = paths.join(step, "src").filter(~F.array_contains("path", F.col("dst")))
        grown = stored(on.select(F.col("path").alias("parent"), F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("src"), F.round(F.col("score") + F.col("norm"), 6).alias("score")))
        done = grown.filter(F.col("src") == end).select("path", "score")
        found = done if found is None else found.unionAll(done)
        paths = stored(top_k_per(grown.filter(F.col("src") != end), ["parent"], beam, "score", "src").select("path", "src", "score"))
        if paths.isEmpty():
            break
    if found is None:
        return entities.sparkSession.createDataFrame([], "path array<long>, score double")
    return found.orderBy(F.col("score").desc(), "path").limit(k)
