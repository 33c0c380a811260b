import hashlib
import random

import pytest
from helpers import AWKWARD, blank_words, frame

from lattix.llm import substring_dedup

from pyspark.sql import functions as F


def brute(docs, window=20):
    seen, words = {}, {d: blank_words(t) for d, t in docs}
    out = []
    for d in sorted(words):
        w, gone = words[d], set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.setdefault(key, (d, i))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def run(df, **options):
    return sorted(tuple(r) for r in substring_dedup.remove_repeats(df, **options).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("window", [20, 5])
def test_against_brute_force(spark, seed, window):
    r = random.Random(seed)
    passages = [" ".join(r.choice("abcdefgh") + str(r.randrange(30)) for _ in range(r.choice([19, 20, 50, 90]))) for _ in range(5)]
    texts = []
    for _ in range(40):
        parts = [" ".join(r.choice("xyz") + str(r.randrange(200)) for _ in range(r.randrange(30))) for _ in range(3)]
        for _ in range(r.randrange(3)):
            parts.insert(r.randrange(len(parts) + 1), r.choice(passages))
        texts.append(r.choice([" ", "\n", "  "]).join(parts))
    texts += texts[:5] + ["k " * 70, "k " * 25]
    assert run(frame(spark, texts).repartition(3), window=window) == brute(list(enumerate(texts)), window)


def test_passage_of_fifty_words_goes_from_later_documents(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    texts = [f"a b {passage} c", f"d {passage}", "clean text stays whole"]
    out = substring_dedup.remove_repeats(frame(spark, texts)).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in out] == [0, 50, 0]
    assert out[1]["kept"] == "d"


def test_awkward_rows(spark):
    assert run(frame(spark, AWKWARD)) == brute(list(enumerate(AWKWARD)))
    assert run(spark.createDataFrame([], "doc_id long, text string")) == []


def test_repeated_equal_rows_are_treated_alike(spark):
    text = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert [(r[0], r[2]) for r in run(df)] == [(1, 0), (1, 0), (2, 30)]


def test_null_id_comes_last(spark):
    text = " ".join(map(str, range(30)))
    out = substring_dedup.remove_repeats(spark.createDataFrame([(None, text), (2, text)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in out} == {None: 30, 2: 0}


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x", 3)], "doc_id long, text string, _spans string, bucket int")
    assert substring_dedup.remove_repeats(df).first()["_spans"] == "x"
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(df.withColumnRenamed("bucket", "Kept"))


def test_frequent_runs_are_no_minimisers(spark, monkeypatch):
    """A run of six words in every text, each time between other words, and one text that consists of such runs."""
    monkeypatch.setattr(substring_dedup, "HOT_BYTES", 0)
    r = random.Random(6)
    run6 = " ".join(f"h{k}" for k in range(6))
    texts = []
    for _ in range(30):
        own = lambda n: " ".join(f"x{r.randrange(10**6)}" for _ in range(n))
        texts.append(f"{own(17)} {run6} {own(17)} {run6} {own(5)}")
    texts += texts[3:6] + [" ".join([run6] * 8)] * 2
    df = frame(spark, texts)
    assert len(substring_dedup.hot_runs(df.select("text", F.lit(0).alias("key")), 20, 1)) > 0
    assert run(df.repartition(3)) == brute(list(enumerate(texts)))
