"""Work that must not be repeated, and tasks that must not grow with the input."""

import itertools
import random

import numpy as np
import pyarrow as pa
from conftest import rows
from pyspark.sql import functions as F

from lattix import storage, tables
from lattix.graph import Graph
from lattix.operators import sets
from lattix.plans import features, gcn, traversal, triangles
from lattix.schemas import CODES


def lineitem(spark, path, pairs):
    spark.createDataFrame(pairs, "l_orderkey long, l_partkey long").write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def counted(spark, edges):
    """Edges (src, dst), and an accumulator of how often one of them was worked out."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def same(x):
        seen.add(1)
        return x

    return spark.createDataFrame(edges, "src long, dst long").select(same.asNondeterministic()("src").alias("src"), "dst"), seen


def test_copurchase_is_dealt_to_tasks_by_its_pairs(spark, tmp_path, monkeypatch):
    at = lineitem(spark, tmp_path, [(o, (o * 7 + k * 3) % 91) for o in range(300) for k in range(6)])
    monkeypatch.setattr(storage, "TASK_ROWS", 200)
    sizes = [r["count"] for r in tables.copurchase(spark, at).edges.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 10 and max(sizes) < 200


def test_copurchase_of_nulls_and_repeated_lines(spark, tmp_path):
    at = lineitem(spark, tmp_path, [(1, 5), (1, 5), (1, 3), (1, None), (None, 3), (None, 9), (2, 3), (2, 5), (2, 8), (3, 4)])
    g = tables.copurchase(spark, at)
    assert rows(g.edges) == [(3, 5), (3, 8), (5, 8)]
    assert rows(g.vertices) == [(3,), (5,), (8,)]


def test_two_hop_features_of_odd_graphs_against_brute_force(spark):
    """Undeclared ends, vertices declared twice, types without a code, nulls, repeated edges."""
    draw = random.Random(8)
    types = ["PERSON", "TOPIC", "AUTHOR", "ORG_IN", "SALE", "?", None]
    vertices = [(k % 37, draw.choice(types)) for k in range(45)]
    edges = [(draw.randrange(-2, 42), draw.randrange(-2, 42), draw.choice(types)) for _ in range(400)] + [(None, 3, "SALE"), (3, None, "SALE")]
    kinds = {}
    for v, t in vertices:
        kinds.setdefault(v, []).append(t)
    known = [e for e in edges if e[0] in kinds and e[1] in kinds]
    first = {v: [0] * features.LENGTH for v in kinds}
    for s, d, t in known:
        for x in [c for k in kinds[d] for c in (t, k)]:
            if x in CODES:
                first[s][CODES[x]] += 1
    out, half = {v: list(x) for v, x in first.items()}, features.LENGTH // 2
    for s, d, _ in known:
        for k in range(half):
            out[s][half + k] += first[d][k] * len(kinds[d])
    made = features.two_hop_features(spark.createDataFrame(vertices, "id long, type string"), spark.createDataFrame(edges, "src long, dst long, type string"))
    assert rows(made) == sorted((v, out[v]) for v, _ in vertices)


def test_sums_by_id_hold_few_rows(monkeypatch):
    monkeypatch.setattr(features, "ROWS", 8)
    draw = random.Random(9)
    given = [(draw.randrange(5), draw.randrange(-3, 9), draw.randrange(9)) for _ in range(300)]
    batches = [pa.record_batch([pa.array([r[0] for r in given[a : a + 3]]), features._packed(np.array([r[1:] for r in given[a : a + 3]]))], names=["id", "first"]) for a in range(0, 300, 3)]
    held, seen = [], {}
    for b in features._summed(2)(iter(batches)):
        held.append(b.num_rows)
        for k, x in zip(b.column(0).to_pylist(), features._unpacked(b.column(2), 2).tolist()):
            seen[k] = [p + q for p, q in zip(seen.get(k, [0, 0]), x)]
    assert seen == {k: [sum(r[1] for r in given if r[0] == k), sum(r[2] for r in given if r[0] == k)] for k in range(5)}
    assert len(held) > 20 and max(held) <= 5


def test_placed_edges_are_worked_out_once(spark):
    edges, seen = counted(spark, [(k % 7, k) for k in range(100)])
    placed = traversal.Placed(edges)
    assert placed.edges.count() == 100
    placed.free()
    assert seen.value == 100


def test_samples_hash_each_edge_once(spark):
    all_ = [(a, b) for a, b in itertools.permutations(range(12), 2)]
    edges, seen = counted(spark, all_)
    seeds = spark.createDataFrame([(b, v) for b in range(3) for v in range(4)], "batch long, id long")
    found = rows(features.sampled_edges(seeds, edges, (3, 2, 1)))
    assert seen.value == len(all_)
    assert {(r[0], r[2]) for r in found if r[1] == 0} == {(b, v) for b in range(3) for v in range(4)}
    assert max(sum(1 for _ in g) for _, g in itertools.groupby(found, key=lambda r: r[:3])) == 3


def test_neighbourhoods_travel_once_to_a_block(spark, monkeypatch):
    """Blocks of ids, negative ones too, whatever their width and number."""
    draw = random.Random(5)
    edges = spark.createDataFrame([(draw.randrange(-20, 40), draw.randrange(-20, 40)) for _ in range(500)], "src long, dst long").cache()
    distinct = {(min(r), max(r)) for r in map(tuple, edges.collect()) if r[0] != r[1]}
    ids = range(-20, 40)
    expected = sum((a, b) in distinct and (b, c) in distinct and (a, c) in distinct for a, b, c in itertools.combinations(ids, 3))
    out = {}
    for a, b in distinct:
        out.setdefault(a, set()).add(b)
    common = sorted((a, b, sorted(out[a] & out[b])) for a, b in distinct if b in out)
    pairs = spark.createDataFrame(sorted(distinct), "a long, b long").cache()
    adjacency = pairs.groupBy(F.col("a").alias("id")).agg(F.collect_list("b").alias("neighbours")).cache()
    for size in (1, 40, 1 << 20):
        monkeypatch.setattr(sets, "BLOCK_EDGES", size)
        assert rows(triangles.triangle_count(edges)) == [(expected,)]
        assert rows(triangles.triangle_count_by_wedges(edges)) == [(expected,)]
        assert rows(sets.common_neighbours(pairs, adjacency)) == common


def test_placed_joins_are_not_shuffled_again(spark):
    left = spark.range(100).select((F.col("id") % 5).alias("block"), F.col("id").alias("k")).repartition(7, "block")
    right = spark.range(100).select((F.col("id") % 5).alias("block"), F.col("id").alias("k"), F.spark_partition_id().alias("x")).repartition(7, "block")
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition", "true")
    met = storage.stored(left.join(right.hint("shuffle_hash"), ["block", "k"]).select("block", F.spark_partition_id().alias("part")), placed=True)
    assert met.count() == 100 and met.groupBy("block").agg(F.count_distinct("part").alias("n")).filter("n > 1").count() == 0
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition", "true") == before


def test_training_hashes_edges_once_for_all_epochs(spark):
    edges, seen = counted(spark, [(i, (i + k) % 32) for i in range(32) for k in (2, 4)])
    vertices = spark.range(32).select("id", F.when(F.col("id") % 2 == 0, "TOPIC").otherwise("PERSON").alias("type")).cache()
    made = vertices.select("id", F.array(*(F.lit(k + 1).cast("bigint") for k in range(features.LENGTH))).alias("features"))
    _, history = gcn.train(vertices, edges, made, features.split_masks(vertices), epochs=2, size=4, replicas=1)
    assert [h["total"] for h in history] == [8, 8]
    assert seen.value == 64


def test_undeclared_ends_are_found_in_one_pass(spark):
    edges, seen = counted(spark, [(1, 2), (1, 9), (8, 2), (9, 9), (9, 9)])
    assert rows(Graph(spark.range(5), edges).undeclared()) == [(8, "src"), (9, "dst"), (9, "src")]
    assert seen.value == 5
