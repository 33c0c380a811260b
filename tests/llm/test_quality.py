import math
import random

import numpy as np
import pytest
from conftest import rows
from helpers import AWKWARD, documents, frame

from lattix.llm import quality
from lattix.llm.shared import table


def prose(r, n=120):
    words = "the river town market people house green small walked slowly under bridge morning light found old friend story".split()
    return ". ".join(" ".join(r.choice(words) + str(r.randrange(40)) * (r.random() < 0.05) for _ in range(12)) for _ in range(n // 12)) + "."


def junk(r, n=120):
    return r.choice([lambda: "BUY NOW!!! $$$ CLICK HERE ### " * (n // 6), lambda: "| home | login | cart |\n" * (n // 6)])()


def test_em_recovers_accuracies_without_labels():
    """Votes drawn from known accuracies: the estimates come close, and posteriors beat a majority vote."""
    r = np.random.default_rng(0)
    n, accuracy = 6000, np.array([0.95, 0.9, 0.85, 0.6, 0.8])
    good = r.random(n) < 0.7
    right = r.random((n, 5)) < accuracy
    votes = np.where(right, good[:, None], ~good[:, None]).astype(int)
    votes[r.random((n, 5)) < 0.2] = 2
    counts = {}
    for row in votes:
        key = "".join("01-"[v] for v in row)
        counts[key] = counts.get(key, 0) + 1
    model = quality.fit_labels(counts)
    assert abs(model.good - 0.7) < 0.05
    found = model.vote[1, :, 1] / (model.vote[1, :, 0] + model.vote[1, :, 1])
    assert np.abs(found - accuracy).max() < 0.06
    assert ((model.posterior(votes) > 0.5) == good).mean() > 0.93


def test_scorer_separates_prose_from_junk(spark):
    r = random.Random(1)
    texts = [(prose if i % 4 else junk)(r) for i in range(240)]
    out = quality.score_quality(frame(spark, texts)).orderBy("doc_id").collect()
    assert np.mean([x["kept"] == bool(x["doc_id"] % 4) for x in out]) > 0.97


def test_agrees_with_held_out_labels(spark, testdata):
    """The labels table isn't read by the classifier."""
    d = f"{testdata}/sf0.01"
    out = quality.score_quality(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "kept")
    pairs = out.join(table(spark, d, "labels").filter("quality is not null").select("doc_id", "quality"), "doc_id").collect()
    assert len(pairs) > 50
    assert np.mean([x["kept"] == (x["quality"] == 1) for x in pairs]) > 0.9


def test_awkward_rows(spark):
    out = quality.score_quality(frame(spark, AWKWARD)).collect()
    assert len(out) == len(AWKWARD)
    assert all(0 <= x["score"] <= 1 and 0 <= x["posterior"] <= 1 for x in out)
    by = {x["doc_id"]: x for x in out}
    assert by[0]["votes"] == by[1]["votes"] == by[2]["votes"] == "-" * len(quality.LABELLERS)
    assert by[8]["score"] == by[9]["score"]
    assert quality.score_quality(frame(spark, AWKWARD).filter("false")).count() == 0


def test_stage_keeps_columns(spark):
    r = random.Random(2)
    docs = documents(spark, [(prose if i % 4 else junk)(r) for i in range(80)]).withColumnRenamed("source", "_quality_kept")
    out = quality.keep_good(docs)
    assert out.columns == docs.columns
    assert {x["doc_id"] % 4 > 0 for x in out.collect()} == {True}
    with pytest.raises(ValueError):
        quality.score_quality(docs.withColumnRenamed("lang", "Score"))


def test_same_model_same_scores(spark):
    r = random.Random(3)
    df = frame(spark, [(prose if i % 3 else junk)(r) for i in range(60)])
    model = quality.fit(df)
    assert rows(quality.score_quality(df, classifier=model)) == rows(quality.score_quality(df.repartition(5), classifier=model))


def plain_em(patterns):
    """Expectation-maximisation document by document, in plain Python."""
    k = len(patterns[0])
    post = [1e-3 if "0" in p else 1 - 1e-3 for p in patterns]
    for _ in range(100):
        good = min(max(sum(post) / len(post), 1e-3), 1 - 1e-3)
        vote = {}
        for c in (0, 1):
            for j in range(k):
                mass = {v: 0.1 + sum(q if c else 1 - q for q, p in zip(post, patterns) if p[j] == v) for v in "01-"}
                for v in "01-":
                    vote[c, j, v] = mass[v] / sum(mass.values())
        after = []
        for p in patterns:
            odds = math.log(good) - math.log(1 - good) + sum(math.log(vote[1, j, v]) - math.log(vote[0, j, v]) for j, v in enumerate(p))
            after.append(1 / (1 + math.exp(-odds)))
        if max(abs(x - y) for x, y in zip(post, after)) < 1e-7:
            break
        post = after
    return after


def plain_scorer(rows, steps=300, rate=0.5, l2=1e-5):
    w, seen = {0: 0.0}, {}
    for _ in range(steps):
        g = {}
        for bucket, value, y in rows:
            z = w[0] + sum(w.get(b, 0.0) * v for b, v in zip(bucket, value))
            miss = (1 / (1 + math.exp(-z)) - y) / len(rows)
            g[0, "bias"] = g.get((0, "bias"), 0.0) + miss
            for b, v in zip(bucket, value):
                g[b, ""] = g.get((b, ""), 0.0) + miss * v
        step = {b: x + l2 * w.get(b, 0.0) for (b, kind), x in g.items() if not kind and b} | {0: g[0, "bias"]}
        for b, x in step.items():
            seen[b] = seen.get(b, 1e-8) + x * x
            w[b] = w.get(b, 0.0) - rate * x / math.sqrt(seen[b])
    return w


def test_query_against_plain_python(spark):
    """Posteriors by EM over every document, and scores of a scorer fitted to them row by row; copies count each."""
    r = random.Random(8)
    texts = [(prose if i % 4 else junk)(r, 24) for i in range(30)]
    texts += texts[:6] + [None]
    out = quality.score_quality(frame(spark, texts)).orderBy("doc_id").collect()
    post = plain_em([x["votes"] for x in out])
    assert np.allclose([x["posterior"] for x in out], post, atol=1e-5)
    f = quality.features([(t or "").encode() for t in texts])
    sparse = [(f.bucket[a:b].tolist(), f.value[a:b].tolist()) for a, b in zip(f.at[:-1].tolist(), f.at[1:].tolist())]
    w = plain_scorer([(b, v, y) for (b, v), y in zip(sparse, post)])
    score = [1 / (1 + math.exp(-(w[0] + sum(w.get(b, 0.0) * v for b, v in zip(*x))))) for x in sparse]
    assert np.allclose([x["score"] for x in out], score, atol=1e-3)
    assert [x["kept"] for x in out] == [x["score"] >= quality.THRESHOLD for x in out]
