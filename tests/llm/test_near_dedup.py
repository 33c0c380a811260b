import math
import random

import pytest
from helpers import AWKWARD, blank_words, documents, frame, lower

from lattix.llm import near_dedup


def shingles(text, n):
    w = blank_words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if len(w) >= n else frozenset([tuple(w)])


def brute(docs, n=3, percent=85):
    sets = [(d, shingles(t, n)) for d, t in docs]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(s), least[find(i)], d == least[find(i)]) for i, (d, s) in enumerate(sets))


def run(df, **options):
    return sorted(tuple(r) for r in near_dedup.digest(near_dedup.near_components(df, **options)).collect())


def case(seed, n=40):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(400)}"
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.6:
            w = r.choice(texts).split()
            for _ in range(r.randrange(0, max(1, len(w) // 20) + 1)):
                if w:
                    w[r.randrange(len(w))] = word()
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(word() for _ in range(r.choice([1, 2, 3, 8, 40, 150, 300]))))
    return texts


@pytest.mark.parametrize("seed,shingle,percent", [(0, 3, 85), (1, 3, 85), (2, 5, 80)])
def test_against_brute_force(spark, seed, shingle, percent):
    texts = case(seed)
    assert run(frame(spark, texts).repartition(3), shingle=shingle, percent=percent) == brute(list(enumerate(texts)), shingle, percent)


def test_threshold_is_exact(spark):
    """17 of 20 shingles shared is 85 per cent; 16 of 20 isn't enough."""
    base = [f"w{i}" for i in range(22)]  # 20 shingles
    texts = [" ".join(base), " ".join([*base[:19]]), " ".join(base[:18])]
    assert run(frame(spark, texts)) == brute(list(enumerate(texts)))
    assert [x[2] for x in run(frame(spark, texts[::2]))] == [0, 1]


def test_chain_is_one_component(spark):
    words = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(8):  # each near the one before it, the ends far apart
        texts.append(" ".join([f"n{k}x{i}" if i < 0 else w for i, w in enumerate(words)]))
        words = words[2:] + [f"m{k}a", f"m{k}b"]
    out = run(frame(spark, texts))
    assert out == brute(list(enumerate(texts)))
    assert {x[2] for x in out} == {0}


def test_groups_of_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 500)
    r = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for g in range(12):
        own = [f"g{g}w{i}" for i in range(70)]
        for _ in range(4):
            w = passage + own
            w[r.randrange(60, 130)] = f"e{r.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += [texts[0]] * 30
    assert run(frame(spark, texts).repartition(4)) == brute(list(enumerate(texts)))


def test_awkward_rows(spark):
    assert run(frame(spark, AWKWARD)) == brute(list(enumerate(AWKWARD)))
    assert run(spark.createDataFrame([], "doc_id long, text string")) == []


def test_repeated_ids(spark):
    df = spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (7, "a b c d e"), (7, "other words here now"), (None, "a b c d e")], "doc_id long, text string")
    out = near_dedup.near_components(df).collect()
    assert sorted((r["id"] or -1, r["component"]) for r in out) == [(-1, 5), (5, 5), (5, 5), (7, 5), (7, 7)]


def test_stage_keeps_one_of_each_group(spark):
    long = " ".join(f"w{i}" for i in range(100))
    docs = documents(spark, ["clean one here", long, long + " more", None, "", long.upper()])
    out = near_dedup.keep_one(docs, shingle=5, percent=80)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 1, 3, 4]
    clash = docs.withColumnRenamed("lang", "_kept").withColumnRenamed("source", "row")
    assert near_dedup.keep_one(clash).columns == clash.columns


@pytest.mark.parametrize("j,most", [(0.8, 2e-7), (0.85, 2e-9)])
def test_lists_lose_few_pairs_at_the_limit(j, most):
    """A text contained in the other, by the binomial distribution."""
    n, least = near_dedup.INDEX, math.ceil(near_dedup.SHARED * near_dedup.INDEX)
    assert sum(math.comb(n, i) * j**i * (1 - j) ** (n - i) for i in range(least)) < most


def edited(r, words, share):
    """A copy of which each word is replaced, dropped or doubled with a probability."""
    out = []
    for w in words:
        x = r.random()
        out += [f"e{r.randrange(10**9)}"] if x < share / 2 else [] if x < share * 0.75 else [w, w] if x < share else [w]
    return out


@pytest.mark.parametrize("exact", [False, True])
def test_edited_copies_around_the_limit(spark, exact):
    """Families of copies, many of them just over or under the limit to the original, to each other or to a second family."""
    r = random.Random(11)
    texts = []
    for f in range(3):
        base = [f"f{f}w{i}" for i in range(120)]
        second = edited(r, base, 0.06)  # some 0.8 like the first
        for k in range(60):
            texts.append(" ".join(edited(r, base if k % 3 else second, r.choice([0.01, 0.02, 0.04, 0.06, 0.08]))))
    r.shuffle(texts)
    want = brute(list(enumerate(texts)))
    assert len({x[2] for x in want}) > 20 and sum(not x[3] for x in want) > 60
    assert run(frame(spark, texts).repartition(4), exact=exact) == want


def test_texts_that_share_all_frequent_values(spark, monkeypatch):
    """Lists of nodes that are unlike their hub go on to further levels and to prefixes of whole sets."""
    monkeypatch.setattr(near_dedup, "LEVELS", 1)
    r = random.Random(3)
    common = [[f"c{k}x{i}" for i in range(6)] for k in range(8)]
    texts = []
    for _ in range(80):
        w = [x for part in r.sample(common, 5) for x in part]
        texts += [" ".join(w)] + [" ".join([*w, f"t{r.randrange(10**6)}"])] * (r.random() < 0.3)
    assert run(frame(spark, texts).repartition(3)) == brute(list(enumerate(texts)))


def test_no_row_for_each_pair(spark):
    """A group's rows and links grow in proportion to it."""
    r = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    made = {}
    for n in (100, 300):
        df = frame(spark, [" ".join(edited(r, base, 0.02 + 0.08 * (k % 2))) for k in range(n)])
        nodes = near_dedup.sketch(df, "doc_id", "text", 3, False)
        nodes = near_dedup.stored(nodes)
        lists = near_dedup.posted_lists(nodes, near_dedup.SHARED)
        made[n] = near_dedup.hub_pairs(lists).count()
    assert made[300] < 6 * made[100]
