"""Graph programs against closed forms and plain Python."""

import random
from collections import deque

import numpy as np
import pytest
from conftest import rows

from lattix.plans import features, gcn, influence, reasoning, traversal, triangles

from pyspark.sql import functions as F


def frame(spark, edges, schema="src long, dst long"):
    return spark.createDataFrame(edges, schema)


def random_edges(n, m, seed):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n)) for _ in range(m)]


def plain_bfs(edges, s):
    out, todo = {s: 0}, deque([s])
    while todo:
        u = todo.popleft()
        for a, b in edges:
            if a == u and b not in out:
                out[b] = out[u] + 1
                todo.append(b)
    return out


# ---- traversal


def test_path_from_each_source(spark):
    """Distances along 0 -> 1 -> ... -> 7: v - s, and nothing before s."""
    edges = frame(spark, [(i, i + 1) for i in range(7)])
    found = traversal.bfs(edges, [0, 1, 2, 3, 4, 5])
    assert rows(found) == sorted((s, v, v - s) for s in range(6) for v in range(s, 8))
    assert [d for _, d in rows(traversal.with_unreached(spark.range(8), found, 5))] == [None] * 5 + [0, 1, 2]


def test_long_path_merges_levels(spark):
    edges = frame(spark, [(i, i + 1) for i in range(20)])
    assert rows(traversal.bfs(edges, [0])) == [(0, v, v) for v in range(21)]


def test_fully_connected(spark):
    edges = frame(spark, [(i, j) for i in range(30) for j in range(30)])
    assert rows(traversal.bfs(edges, [0])) == [(0, 0, 0)] + [(0, v, 1) for v in range(1, 30)]


def test_source_without_edges_and_empty_graph(spark):
    assert rows(traversal.bfs(frame(spark, [(1, 2)]), [7])) == [(7, 7, 0)]
    assert rows(traversal.bfs(frame(spark, []), [3])) == [(3, 3, 0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graph(spark, seed):
    edges = random_edges(30, 50, seed)
    assert {r[1]: r[2] for r in rows(traversal.bfs(frame(spark, edges), [0]))} == plain_bfs(edges, 0)
    assert dict(rows(traversal.shortest_paths(frame(spark, edges), 0))) == plain_bfs(edges, 0)


def test_sources_of_many_edges_are_divided(spark, monkeypatch):
    monkeypatch.setattr(traversal, "HEAVY", 3)
    monkeypatch.setattr(traversal, "MERGE_LEVELS", 2)
    edges = [(0, k) for k in range(1, 12)] + [(k, k + 1) for k in range(11, 20)] + [(5, 0), (20, 30)]
    assert {r[1]: r[2] for r in rows(traversal.bfs(frame(spark, edges), [0]))} == plain_bfs(edges, 0)
    assert dict(rows(traversal.shortest_paths(frame(spark, edges), 0))) == plain_bfs(edges, 0)


@pytest.mark.parametrize("share", [0.0, 0.3, 9.0])
def test_push_and_pull_agree(spark, share):
    edges = random_edges(40, 90, 3)
    vertices = spark.range(40).withColumnRenamed("id", "id")
    assert dict(rows(traversal.bfs_push_pull(vertices, frame(spark, edges), 0, share))) == plain_bfs(edges, 0)


def test_weighted_paths_take_the_cheaper_way(spark):
    edges = frame(spark, [(0, 1, 10), (0, 2, 1), (2, 1, 2), (1, 3, 1), (2, 1, 1), (3, 0, 0)], "src long, dst long, w long")
    assert rows(traversal.shortest_paths(edges, 0, "w")) == [(0, 0), (1, 2), (2, 1), (3, 3)]


def test_edges_traversed(spark):
    edges = frame(spark, [(0, 1), (0, 2), (1, 3), (2, 3)])
    assert rows(traversal.edges_traversed(edges, traversal.bfs(edges, [0]))) == [(0, 0, 1, 2), (0, 1, 2, 2), (0, 2, 1, 0)]


# ---- triangles


@pytest.mark.parametrize("seed", [3, 4])
def test_triangles(spark, seed):
    edges = random_edges(25, 120, seed)
    pairs = {(min(e), max(e)) for e in edges if e[0] != e[1]}
    expected = sum((a, b) in pairs and (b, c) in pairs and (a, c) in pairs for a in range(25) for b in range(a + 1, 25) for c in range(b + 1, 25))
    df = frame(spark, edges)
    assert rows(triangles.triangle_count(df)) == [(expected,)]
    assert rows(triangles.triangle_count_by_wedges(df)) == [(expected,)]
    chunks = rows(triangles.triangle_chunks(spark.range(25), df))
    assert chunks[-1][2] == sum(c[1] for c in chunks) == expected
    assert [c[0] for c in chunks] == [0, 1, 2, 3, 4]


def test_no_triangles(spark):
    assert rows(triangles.triangle_count(frame(spark, [(i, i + 1) for i in range(7)]))) == [(0,)]
    assert rows(triangles.triangle_count(frame(spark, []))) == [(0,)]


def test_orientation_bounds_neighbourhoods(spark):
    star = frame(spark, [(0, i) for i in range(1, 50)])
    assert triangles.oriented(star).groupBy("src").count().agg(F.max("count")).first()[0] == 1


# ---- influence


def tournament(spark, n=16):
    edges = [(i, j, "SALE", float(i)) if j < i else (i, j, "PURCHASE", float(j)) for i in range(n) for j in range(n) if i != j]
    return spark.range(n), frame(spark, edges, "src long, dst long, type string, amount double")


def test_tournament_sums(spark):
    n = 16
    vertices, edges = tournament(spark, n)
    trade = influence.traded(vertices, edges)
    for i, sold, bought, desired in rows(trade):
        assert sold == i * i
        assert bought == desired == (n + i) * (n - i - 1) / 2
    weighted = influence.edge_probabilities(edges, trade)
    for s, d, t, _, w in rows(weighted):
        assert w == pytest.approx(1 / (s if t == "SALE" else d))
    weight, amount = rows(influence.influence_totals(weighted))[0]
    assert weight == pytest.approx(2 * (n - 1), abs=1e-6)
    assert amount == 2 * sum(i * i for i in range(n))


def test_reachable_sets(spark):
    vertices, edges = tournament(spark)
    weighted = influence.edge_probabilities(edges, influence.traded(vertices, edges))
    sets = influence.reachable_sets(vertices, weighted, 60).cache()
    by = {}
    for s, v, d in rows(sets):
        by.setdefault(s, {})[v] = d
    assert sorted(by) == list(range(60))
    assert all(sum(d == 0 for d in x.values()) == 1 for x in by.values())
    again = influence.reachable_sets(vertices, weighted.repartition(3), 60)
    assert rows(again) == rows(sets)
    every = influence.reachable_sets(vertices, weighted.withColumn("weight", F.lit(1.0)), 5)
    assert every.count() == 5 * 16
    none = influence.reachable_sets(vertices, weighted.withColumn("weight", F.lit(-1.0)), 5)
    assert none.count() == 5


def test_greedy_cover(spark):
    sets = frame(spark, [(0, 1), (0, 2), (1, 1), (2, 2), (2, 3), (3, 3), (4, 3), (5, 4)], "set_id long, id long")
    found = influence.influential_nodes(sets, 3)
    assert rows(found.picks) == [(0, 3, 3), (1, 1, 2), (2, 4, 1)]
    assert found.uninfluenced == 1
    assert rows(influence.influential_nodes(sets, 9).picks)[-1][0] == 2
    assert rows(influence.influential_nodes(sets.filter("false"), 2).picks) == []


# ---- reasoning


def test_best_tails_and_chain(spark):
    people = frame(spark, [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0])], "id long, features array<double>")
    places = frame(spark, [(8, [1.0, 1.0]), (9, [2.0, 1.0])], "id long, features array<double>")
    got = reasoning.best_tails(people, [0.0, 0.0], [1.0, 0.0], 2).collect()
    assert [(r["id"], r["score"]) for r in got] == [(1, 1.0), (3, 1.0)]
    relations = {"award-winner": [1.0, 0.0], "works-in": [0.0, 0.0], "affiliated-with": [0.0, 1.0]}
    out = rows(reasoning.reasoning_chain(people, places, relations, award=[0.0, 0.0], field=[2.0, 0.0], k=3))
    assert out == [(1, 0.0, 8, 1.0), (2, 1.0, 9, 1.0), (3, 0.0, 8, 1.0)]
    with pytest.raises(KeyError):
        reasoning.feature_of(people, 99)


def test_beam_paths_are_simple(spark):
    edges = frame(spark, [(0, 1), (1, 0), (0, 2), (1, 3), (2, 3), (1, 2)])
    entities = frame(spark, [(0, [1.0]), (1, [5.0]), (2, [-2.0]), (3, [1.0])], "id long, features array<double>")
    out = reasoning.beam_paths(edges, entities, 0, 3, most_vertices=4, k=5, beam=5).collect()
    assert [(r["path"], r["score"]) for r in out] == [([0, 1, 2, 3], 9.0), ([0, 1, 3], 7.0), ([0, 2, 3], 4.0)]
    assert reasoning.beam_paths(edges, entities, 3, 0, most_vertices=4, k=5, beam=5).count() == 0


# ---- features and learning


def test_two_hop_features(spark):
    vertices = frame(spark, [(0, "PERSON"), (1, "PUBLICATION"), (2, "TOPIC"), (3, "TOPIC")], "id long, type string")
    edges = frame(spark, [(0, 1, "AUTHOR"), (1, 0, "WRITTENBY"), (1, 2, "HASORG"), (2, 1, "ORG_IN")], "src long, dst long, type string")
    out = dict(rows(features.two_hop_features(vertices, edges)))
    a = np.array(out[0])
    first1 = np.zeros(30)
    first1[[1, 10, 6, 15]] = 1  # publication 1: a person, written by, a topic, an organisation (in the second half)
    expected = np.zeros(30)
    expected[[5, 9]] = 1
    expected[15:] += first1[:15]
    assert (a == expected).all()
    assert sum(out[3]) == 0
    assert out[2][16] == 1 + first1[1]


def test_splits_and_batches(spark):
    masks = features.split_masks(spark.range(100))
    sizes = dict(rows(masks.groupBy("split").count()))
    assert sizes == {"train": 25, "test": 12, "valid": 12, "none": 51}
    batches = rows(features.minibatches(masks.filter("split = 'train'"), 0, 10).groupBy("batch").count())
    assert batches == [(0, 10), (1, 10), (2, 5)]


def test_samples_are_edges_and_bounded(spark):
    edges = [(i, j) for i in range(12) for j in range(12) if i != j]
    seeds = frame(spark, [(0, 1), (0, 2), (1, 3)], "batch long, id long")
    out = rows(features.sampled_edges(seeds, frame(spark, edges)))
    assert all((s, d) in set(edges) for _, _, s, d in out)
    for level, n in enumerate((3, 2, 1)):
        of = {}
        for b, lv, s, d in out:
            if lv == level:
                of.setdefault((b, s), []).append(d)
        assert of and all(len(x) == n for x in of.values())


def test_ego_graphs(spark):
    out = set(rows(features.ego_graphs(spark.range(8), frame(spark, [(0, 5), (5, 6), (1, 1)]))))
    assert out == {(0, 0, 0), (0, 0, 5), (0, 5, 0), (0, 5, 5), (0, 5, 6), (0, 6, 5), (0, 6, 6), (1, 1, 1)}


def test_sparse_product(spark):
    m = frame(spark, [(0, 1, 2.0), (0, 0, 1.0), (2, 1, -1.0)], "src long, dst long, value double")
    x = frame(spark, [(0, [1.0, 2.0]), (1, [3.0, 4.0])], "id long, features array<double>")
    assert rows(features.sparse_product(m, x)) == [(0, 0, 7.0), (0, 1, 10.0), (2, 0, -3.0), (2, 1, -4.0)]


def test_gradients_match_differences():
    r = np.random.default_rng(0)
    net = gcn.Network({"first": r.normal(size=(4, 3)), "second": r.normal(size=(3, 2))}, np.ones(4))
    a = (r.random((5, 5)) < 0.5).astype(float)
    b = gcn.Batch(a, r.normal(size=(5, 4)), np.array([0, 1, 1, 0, 1]), np.ones(5, dtype=bool))
    loss = lambda: -np.log(net.forward(b)[0][np.arange(5), b.truth]).mean()
    p, kept = net.forward(b)
    for name, g in net.gradients(b, p, kept).items():
        for i in np.ndindex(*g.shape):
            w = net.weights[name]
            old = w[i]
            w[i] = old + 1e-6
            up = loss()
            w[i] = old - 1e-6
            down = loss()
            w[i] = old
            assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_adam_and_layers():
    w = {"x": np.array([1.0])}
    adam = gcn.Adam(decay=0.0)
    for _ in range(300):
        adam.step(w, {"x": 2 * w["x"]})
    assert abs(w["x"][0]) < 0.05
    assert gcn.trace_layer(np.diag([1.0, 2.0]))[0] == 3.0
    assert (gcn.dense_layer(np.array([[1.0, -1.0]]), np.array([[1.0], [3.0]])) == 0).all()


@pytest.mark.parametrize("replicas,epochs", [(1, 3), (2, 5)])
def test_training_learns(spark, replicas, epochs):
    """Two kinds of vertices that only their neighbours tell apart."""
    n = 64
    kind = lambda i: "PERSON" if i % 2 else "TOPIC"
    vertices = frame(spark, [(i, kind(i)) for i in range(n)], "id long, type string")
    edges = frame(spark, [(i, (i + k) % n, "AUTHOR" if i % 2 else "HASTOPIC") for i in range(n) for k in (2, 4)], "src long, dst long, type string")
    made = features.two_hop_features(vertices, edges).cache()
    masks = features.split_masks(vertices).cache()
    net, history = gcn.train(vertices, edges, made, masks, epochs=epochs, size=4, replicas=replicas)
    assert history[-1]["loss"] < history[0]["loss"]
    test = gcn.accuracy(net, vertices, edges, made, masks, "test")
    assert test["correct"] == test["total"] == 8
