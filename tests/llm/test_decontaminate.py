import hashlib
import random

import pytest
from conftest import rows
from helpers import AWKWARD, alnum_words, documents, frame

from pyspark.sql import functions as F

from lattix.llm import decontaminate


def brute(docs, items, window=10):
    tests = {}
    for item, text in items:
        w = alnum_words(text)
        m = min(len(w), window)
        for i in range(len(w) - m + 1 if w else 0):
            tests.setdefault(tuple(w[i : i + m]), set()).update([item] if item is not None else [])
    out = []
    for d, text in docs:
        w, hit, found = alnum_words(text), set(), set()
        for m in {len(t) for t in tests}:
            for i in range(len(w) - m + 1):
                if (t := tuple(w[i : i + m])) in tests:
                    hit.update(range(i, i + m))
                    found |= tests[t]
        ids = sorted(str(x) for x in found)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def random_case(seed, n=30):
    r = random.Random(seed)
    word = lambda: r.choice(["alpha", "Beta", "the", "of", "7", "ä"])
    items = [(i, " ".join(word() for _ in range(r.choice([0, 1, 2, 3, 10, 11, 25])))) for i in range(8)] + [(None, "lonely marker words"), (3, "lonely marker")]
    docs = []
    for i in range(n):
        t = [word() for _ in range(r.randrange(60))]
        if r.random() < 0.6:
            t[r.randrange(len(t) + 1) : 0] = r.choice(items)[1].split()
        docs.append((i, (", ".join(t)).upper() if r.random() < 0.2 else "-".join(t)))
    return docs, items


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("block_bytes", [16 << 20, 60])
def test_against_brute_force(spark, seed, block_bytes):
    docs, items = random_case(seed)
    found = decontaminate.find_contamination(frame(spark, dict(docs)), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    assert sorted((tuple(r) for r in decontaminate.digest(found).collect()), key=repr) == brute(docs, items)


def test_awkward_documents_and_items(spark):
    items = [(1, "same text of some words here"), (2, None), (3, ""), (4, "one"), (4, "one"), (5, "word " * 12)]
    found = decontaminate.digest(decontaminate.find_contamination(frame(spark, AWKWARD), spark.createDataFrame(items, "item_id long, text string")))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(list(enumerate(AWKWARD)), items)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert decontaminate.find_contamination(none, items).count() == 0
    out = decontaminate.find_contamination(frame(spark, ["some words"]), items.filter("false"))
    assert rows(decontaminate.digest(out).select("n_hit", "n_items", "contaminated")) == [(0, 0, False)]


def test_stage_keeps_clean_documents_and_columns(spark):
    docs = documents(spark, ["clean prose", "x some benchmark passage y", None]).withColumn("_hit_n_words", F.lit(1))
    out = decontaminate.decontaminate(docs, spark.createDataFrame([(1, "benchmark passage")], "item_id long, text string"))
    assert out.columns == docs.columns
    assert [r["doc_id"] for r in out.orderBy("doc_id").collect()] == [0, 2]


def test_clash_is_an_error(spark):
    docs = spark.createDataFrame([(1, "a", 5)], "doc_id long, text string, N_Words int")
    with pytest.raises(ValueError):
        decontaminate.find_contamination(docs, spark.createDataFrame([(1, "a")], "item_id long, text string"))
