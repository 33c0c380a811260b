import math
import random

import numpy as np
import pytest
from helpers import AWKWARD, frame

from lattix.llm import toxicity
from lattix.llm.shared import table
from lattix.llm.words import hash_word

BAD = [f"vile{i}" for i in range(12)]


def corpus(n=400, seed=0):
    r = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        w = [f"w{r.randrange(300)}" for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            for _ in range(r.randint(2, 7)):
                w[r.randrange(60)] = r.choice(BAD)
        texts.append(" ".join(w))
        labels.append((i, int(bad)))
    return texts, labels


def test_held_out_documents(spark):
    texts, labels = corpus()
    out = toxicity.score_toxicity(frame(spark, texts), spark.createDataFrame(labels[:250], "doc_id long, toxic int")).collect()
    held = [x for x in out if x["doc_id"] >= 250]
    assert np.mean([x["is_toxic"] == (x["doc_id"] % 5 == 0) for x in held]) > 0.97
    assert all(0 <= x["severity"] <= toxicity.GRADES for x in out)


def test_severity_grows_with_markers(spark):
    texts, labels = corpus()
    model = toxicity.fit(frame(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int"))
    more = [" ".join(BAD[:k]) + " plain words" for k in range(8)]
    got = [x["severity"] for x in toxicity.score_toxicity(frame(spark, more), model=model).orderBy("doc_id").collect()]
    assert got == sorted(got) and got[0] < 0.5 < 2 < got[-1]
    assert (np.diff(model.thresholds) >= 0).all()


def test_ordinal_fit_shares_weights():
    """Grades drawn from known weights and thresholds are given back in order."""
    r = np.random.default_rng(1)
    x = (r.random((4000, 3)) < 0.5).astype(float)
    z = x @ np.array([2.0, 1.0, 0.0]) + r.logistic(size=4000)
    y = (z[:, None] >= np.array([1.0, 2.0, 3.0])).sum(axis=1)
    w, t = toxicity.fit_ordinal(x, y, 3)
    assert w[0] > 1.5 * w[1] > 0 and w[2] < 0.2
    assert t[0] < t[1] < t[2]


def test_given_table(spark, testdata):
    d = f"{testdata}/sf0.01"
    labels = table(spark, d, "labels")
    half = labels.filter("doc_id % 2 = 0")
    out = toxicity.score_toxicity(table(spark, d, "documents").select("doc_id", "text"), half).select("doc_id", "is_toxic")
    pairs = out.join(labels.filter("doc_id % 2 = 1 and toxic is not null"), "doc_id").collect()
    clean = [x for x in pairs if not x["toxic"]]
    assert np.mean([x["is_toxic"] for x in clean]) < 0.05


def test_awkward_rows_and_labels(spark):
    df = frame(spark, AWKWARD)
    none = toxicity.score_toxicity(df, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {x["severity"] for x in none} == {0.0}
    odd = spark.createDataFrame([(None, 1), (3, None), (4, 0), (4, 1), (99, 1)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(df, odd).count() == len(AWKWARD)
    assert toxicity.score_toxicity(df.filter("false"), odd).count() == 0
    with pytest.raises(ValueError):
        toxicity.score_toxicity(df.withColumnRenamed("doc_id", "GRADE").withColumnRenamed("GRADE", "doc_id").selectExpr("doc_id", "text", "1 as Grade"), odd)


def test_grade_column_is_used(spark):
    texts, labels = corpus()
    graded = spark.createDataFrame([(d, t, 2 * t) for d, t in labels], "doc_id long, toxic int, grade int")
    model = toxicity.fit(frame(spark, texts), graded)
    assert model.thresholds[0] == pytest.approx(model.thresholds[1], abs=0.5)


def test_equal_rows_keep_their_count(spark):
    """Clean documents with one word of the toxic ones, as often as theirs: P(toxic) is the share in the labels."""
    rows = [("vile1 vile2 vile3", 1)] * 40 + [("plain words", 0)] * 3960 + [("vile1", 0)] * 40 + [("vile1", 1)] * 40
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.at_least(np.zeros(1))[0, 0] < 0.01  # no document without a feature is toxic
    x = np.array([[1.0], [1.0], [0.0]])
    w, t = toxicity.fit_ordinal(x, np.array([1, 0, 0]), 1, times=np.array([90.0, 10.0, 9900.0]), l1=0.0, steps=3000)
    v, u = toxicity.fit_ordinal(np.repeat(x, [90, 10, 9900], axis=0), np.repeat([1, 0, 0], [90, 10, 9900]), 1, l1=0.0, steps=3000)
    assert np.allclose(w, v) and np.allclose(t, u)


def plain_ordinal(x, y, grades, l1=2e-4, steps=500):
    """The same optimum by plain proximal steps without momentum, in plain Python."""
    n, k = len(x), len(x[0])
    t, w = [1 + j / max(1, grades - 1) for j in range(grades)], [0.0] * k
    rate = 4.0 / (sum(v * v for row in x for v in row) / n * grades + 1)
    for _ in range(steps * 40):
        gw, gt = [0.0] * k, [0.0] * grades
        for row, grade in zip(x, y):
            z = sum(a * b for a, b in zip(w, row))
            for j in range(grades):
                miss = (1 / (1 + math.exp(t[j] - z)) - (grade > j)) / n
                gt[j] += miss
                for i, v in enumerate(row):
                    gw[i] += miss * v
        w = [max(a - rate * g - rate * l1, 0.0) for a, g in zip(w, gw)]
        t = [a + rate * g for a, g in zip(t, gt)]
        for j in range(1, grades):
            t[j] = max(t[j], t[j - 1])
    return w, t


def test_fit_against_plain_python():
    r = random.Random(5)
    x = [[float(r.random() < 0.5), float(r.random() < 0.4)] for _ in range(40)]
    y = [min(3, max(0, round(2 * a + b + r.gauss(0, 0.8)))) for a, b in x]
    w, t = toxicity.fit_ordinal(np.array(x), np.array(y), 3, l1=0.01, steps=3000)
    plain_w, plain_t = plain_ordinal(x, y, 3, l1=0.01, steps=100)
    assert np.allclose(w, plain_w, atol=0.02) and np.allclose(t, plain_t, atol=0.02)


def test_given_grades_and_scores_against_plain_python(spark):
    """Labels with grades 0 to 3; every column of the result follows from the model, word by word."""
    r = random.Random(9)
    texts, labels = [], []
    for i in range(160):
        grade = r.choice([0, 0, 1, 2, 3])
        texts.append(" ".join([f"w{r.randrange(100)}" for _ in range(20)] + r.sample(BAD, 2 * grade)))
        labels.append((i, int(grade > 0), grade))
    model = toxicity.fit(frame(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int, grade int"))
    weight = {int(h): float(v) for h, v in zip(model.words.tolist(), model.weights.tolist())}
    out = toxicity.score_toxicity(frame(spark, [*texts, None, ""]), model=model).orderBy("doc_id").collect()
    for row, text in zip(out, [*texts, "", ""]):
        words = text.lower().split()
        known = {x for x in words if hash_word(x.encode()) in weight}
        z = sum(weight[hash_word(x.encode())] for x in known)
        p = [1 / (1 + math.exp(float(t) - z)) for t in model.thresholds]
        assert (row["n_words"], row["n_markers"]) == (len(words), len(known))
        assert math.isclose(row["severity"], sum(p), abs_tol=1e-9) and math.isclose(row["p_toxic"], p[0], abs_tol=1e-9)
        assert row["grade"] == sum(x >= 0.5 for x in p) and row["is_toxic"] == (p[0] >= 0.5)
    got = np.array([x["severity"] for x in out[:160]])
    grades = np.array([g for _, _, g in labels])
    assert [got[grades == g].mean() for g in range(4)] == sorted(got[grades == g].mean() for g in range(4))
    assert np.mean(np.abs(got - grades) < 1) > 0.8
