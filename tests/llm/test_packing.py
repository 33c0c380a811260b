import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import AWKWARD, frame
from tokenizers import Tokenizer

from lattix.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_ids(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 0]


def pieces(docs, capacity):
    out = []
    for d, t in docs:
        ids = plain_ids(t)
        for k, s in enumerate(range(0, len(ids), capacity)):
            cut = ids[s : s + capacity]
            out.append((d, k, s, len(cut), zlib.crc32(np.array(cut, dtype="<u4").tobytes())))
    return sorted(out)


def check(rows, docs, capacity):
    assert sorted(tuple(r[:5]) for r in rows) == pieces(docs, capacity)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


TEXTS = [*AWKWARD[:6], "word " * 300, "Hello, World! it's (fine); <|endoftext|> #5 don't", "naïve CAFÉ ¡hola! 東京  x y", "a.b.c, d!? x|y)", "...", "mid-word's end.", "1,000.50"]


@pytest.mark.parametrize("capacity", [16, 64, 2048])
def test_round_trip(spark, capacity):
    out = packing.pack(frame(spark, TEXTS).repartition(3), PATH, capacity=capacity).collect()
    check(out, list(enumerate(TEXTS)), capacity)


def test_long_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "word " * 5000), (1, "word " * 5000), (None, "a")], "doc_id long, text string")
    out = packing.pack(df, PATH).collect()
    assert sum(r["length"] for r in out) == 2 * 5001 + 2
    assert packing.pack(df.filter("false"), PATH).count() == 0


def test_tokenizer_forgets_and_still_agrees(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 40)
    monkeypatch.setattr(packing, "ENCODE_WORDS", 7)
    t = packing.WordTokenizer(PATH)
    r = random.Random(1)
    for _ in range(30):
        texts = [" ".join(f"{r.choice('abcdé')}{r.randrange(99)}{r.choice(['', '.', ',', '!?'])}" for _ in range(20)) for _ in range(3)]
        ids, at = t([x.encode() for x in texts])
        for k, x in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == plain_ids(x)


def best(sizes, capacity):
    """Fewest bins, by search."""
    sizes = sorted(sizes, reverse=True)
    for n in itertools.count(-(-sum(sizes) // capacity)):

        def fill(i, bins):
            if i == len(sizes):
                return True
            for room in set(bins):
                if room >= sizes[i]:
                    k = bins.index(room)
                    if fill(i + 1, bins[:k] + [room - sizes[i]] + bins[k + 1 :]):
                        return True
            return False

        if fill(0, [capacity] * n):
            return n


def used(patterns):
    return sum(n for _, n in patterns)


@pytest.mark.parametrize("seed", range(40))
def test_dominated_sets_are_never_worse(seed):
    """Fixing the dominant sets leaves an optimal solution reachable: fixed bins plus the best of the rest is the best of all."""
    r = random.Random(seed)
    cap = r.choice([10, 13, 20])
    sizes = [r.randint(1, cap) for _ in range(r.randint(1, 9))]
    counts = np.bincount(sizes, minlength=cap + 1)
    rest = counts.copy()
    fixed = packing.reduce_dominated(rest)
    left = [s for s in range(cap + 1) for _ in range(rest[s])]
    assert used(fixed) + (best(left, cap) if left else 0) == best(sizes, cap)
    total = np.zeros(cap + 1, dtype=int)
    for pattern, n in packing.pack_counts(counts):
        assert sum(pattern) <= cap
        for s in pattern:
            total[s] += n
    assert (total == counts).all()


def test_close_to_the_bound():
    r = np.random.default_rng(3)
    counts = np.bincount(np.minimum(r.geometric(1 / 500, 50_000), 2048), minlength=2049)
    bound = -(-int((counts * np.arange(2049)).sum()) // 2048)
    assert used(packing.pack_counts(counts)) <= 1.002 * bound + 1
