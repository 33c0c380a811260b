import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from helpers import AWKWARD, blank_words, frame, lower

from lattix.llm import language_model as lm


def brute(docs):
    out_of = {d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs}
    tokens = [(d, [*blank_words(lower(t)), None]) for d, t in docs]
    counts = Counter(x for d, t in tokens if not out_of[d] for x in t)
    n, v = sum(counts.values()), len(counts)
    return sorted((d, out_of[d], len(t), sum(counts[x] > 0 for x in t), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t), 6)) for d, t in tokens)


def contract(df):
    return sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in df.collect())


def sentences(n, seed=0):
    r = random.Random(seed)
    grammar = {"<": ["the", "a"], "the": ["cat", "dog"], "a": ["bird", "fish"], "cat": ["sat", "ran"], "dog": ["ran", "slept"], "bird": ["flew"], "fish": ["swam"]}
    out = []
    for _ in range(n):
        words = []
        for _ in range(r.randint(3, 40)):
            x = "<"
            while x in grammar:
                x = r.choice(grammar[x])
                words.append(x)
        out.append(" ".join(words))
    return out


def test_counts_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 400)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 300)
    texts = sentences(60) + ["THE Cat", "rare words here", "", None]
    assert contract(lm.score_documents(frame(spark, texts).repartition(4))) == brute(list(enumerate(texts)))


def test_texts_are_kept_as_numbers_of_a_chunks_words(spark, monkeypatch):
    """Split and looked up once: later uses read numbers, in the order in which buckets answer."""
    texts = [*sentences(30), "Rare RARE words", "", None, "a\tb\n\x0bc  a"]
    made = lm.chunks(frame(spark, texts).coalesce(2), "doc_id", "text", 5).collect()
    unpack, back = zstandard.ZstdDecompressor().decompress, []
    for r in (r for r in made if r["bucket"] is None):
        words = unpack(bytes(r["packed"])).split(b"\n")
        mine = sorted((x for x in made if x["chunk"] == r["chunk"] and x["bucket"] is not None), key=lambda x: x["bucket"])
        assert words == [w for x in mine for w in unpack(bytes(x["packed"])).split(b"\n")] and len(set(words)) == len(words)
        lengths = np.frombuffer(unpack(bytes(r["counts"])), dtype=np.int64)
        for i, t in zip(r["ids"], np.split(lm._from_planes(unpack(bytes(r["numbers"]))), np.cumsum(lengths)[:-1])):
            back.append((i, [words[k] for k in t]))
    assert sorted(back) == [(i, [*lm.split((t or "").encode()), lm.END]) for i, t in enumerate(texts)]


def test_planes():
    for x in ([], [0], [1, 70_000, 1 << 30, 255, 256]):
        assert lm._from_planes(lm._planes(np.array(x, dtype=np.int32))).tolist() == x


def test_exponentials_of_tame_rows_are_as_of_others():
    r = np.random.default_rng(3)
    x, column = (r.standard_normal((50, 7)) * 9).astype(np.float32), r.integers(0, 7, 50)
    assert np.allclose(lm._softmax(x.copy()), lm._softmax(x.copy(), True), atol=1e-6)
    assert np.allclose(lm._log_chosen(x.copy(), column), lm._log_chosen(x.copy(), column, True), atol=1e-4)
    model = lm.new_model([(b" ", 5), (b"w", 2)], 60, 12)
    assert model.tame
    model.p["Wo"][1] = 50
    assert not model.tame
    model.p["Wo"][1] = np.nan
    assert not model.tame


def test_model_beats_base_on_held_out_text(spark):
    out = lm.score_documents(frame(spark, sentences(400))).filter("held_out").collect()
    assert len(out) > 30
    assert sum(r["score"] for r in out) > 0.8 * sum(r["base_score"] for r in out)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in out)


def test_gradients_match_differences():
    """One window from a zero state: training's step follows the numeric gradient."""
    model = lm.new_model([(b" ", 5), *[(f"w{i}".encode(), 9 - i) for i in range(8)]], 60, 12)
    for k in ("Wc", "Wo"):
        model.p[k] += np.random.default_rng(1).standard_normal(model.p[k].shape).astype(np.float32) * 0.1
    texts = [np.array([1, 2, 3, 1, 2, 4, 5, 0])] * 40
    before = model.score(texts[:1])[0]
    lm.train(model, texts, epochs=20, lanes=4, rate=1e-2)
    assert model.score(texts[:1])[0] > before + 3


def test_probabilities_add_up_to_one():
    model = lm.new_model([(f"w{i}".encode(), 30 - i) for i in range(25)], 700, 40)
    h = np.random.default_rng(0).standard_normal((3, lm.HIDDEN)).astype(np.float32)
    total = sum(np.exp(model.log_p(h, np.full(3, y))) for y in range(26))
    assert np.allclose(total, 1, atol=1e-4)


def test_state_is_carried_across_windows():
    """Scores don't depend on the windows' length or on the texts beside."""
    model = lm.new_model([(f"w{i}".encode(), 30 - i) for i in range(25)], 700, 40)
    for k in ("Wc", "Wo"):
        model.p[k] += np.random.default_rng(1).standard_normal(model.p[k].shape).astype(np.float32)
    r = np.random.default_rng(2)
    texts = [r.integers(0, 26, n) for n in (1, 31, 32, 33, 200)]
    together = model.score(texts)
    old = lm.WINDOW
    try:
        lm.WINDOW = 7
        assert np.allclose(together, [model.score([t])[0] for t in texts], rtol=1e-4)
    finally:
        lm.WINDOW = old


def test_awkward_rows(spark):
    assert contract(lm.score_documents(frame(spark, AWKWARD))) == brute(list(enumerate(AWKWARD)))
    assert lm.score_documents(frame(spark, AWKWARD).filter("false")).count() == 0
    same = lm.score_documents(spark.createDataFrame([(4, "a b"), (4, "a b"), (None, "c")], "doc_id long, text string")).collect()
    assert len(same) == 3 and {r["held_out"] for r in same if r["doc_id"] is None} == {False}


def test_only_held_out_documents(spark):
    d = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    [r] = lm.score_documents(spark.createDataFrame([(d, "a b c")], "doc_id long, text string")).collect()
    assert (r["train_tokens"], r["n_known"], r["base_score"]) == (0, 0, pytest.approx(0.0))
    assert np.isfinite(r["score"])


def test_long_documents_train_too(spark):
    """Texts of 20,000 bytes and more, and no others."""
    texts = [" ".join(sentences(100, seed)) for seed in range(24)]
    assert min(map(len, texts)) > 20_000
    out = lm.score_documents(frame(spark, texts)).filter("held_out").collect()
    assert out and sum(r["score"] for r in out) > 0.8 * sum(r["base_score"] for r in out)


def test_every_training_token_is_gone_through(spark):
    docs = frame(spark, sentences(700)).repartition(3)
    gathered = lm.chunks(docs, "doc_id", "text", 4).filter("bucket is null")
    expected = brute([(r["doc_id"], r["text"]) for r in docs.collect()])[0][4]
    model = lm.new_model([(x.encode(), 9) for x in ["the", "a", "cat", "dog", " "]], expected, 12)
    assert lm.learned(gathered, model, 2, 3) == expected


def test_vocabulary_grows(spark, monkeypatch):
    """It follows the root of the types; with 16 times that, 2,500 tokens that come twice each among 40,000 that come once are all its own."""
    assert [lm.own_words(n) for n in (100, 10**6, 10**8)] == [1000, 1000, 10_000]
    monkeypatch.setattr(lm, "GROWTH", 16)
    r = random.Random(3)
    words = [f"often{i}" for i in range(2500)] * 2 + [f"once{i}" for i in range(40_000)]
    r.shuffle(words)
    docs = frame(spark, [" ".join(words)]).selectExpr("CAST(NULL AS BIGINT) doc_id", "text")
    gathered = lm.chunks(docs, "doc_id", "text", 4)
    rows = lm.answers(gathered.filter("bucket is not null").select("chunk", "bucket", "packed", "counts"), None, 4).filter("tokens is not null").collect()
    top = sorted(((x["n"], bytes(x["word"])) for row in rows for x in row["top"]), reverse=True)[: lm.own_words(sum(row["types"] for row in rows))]
    assert sum(n == 2 for n, _ in top) == 2500
