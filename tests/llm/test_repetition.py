import random
from collections import Counter

import pytest
from helpers import AWKWARD, blank_words, frame

from lattix.llm import repetition


def covered(w, n):
    at = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    many = Counter(at)
    out = set()
    for i, g in enumerate(at):
        if many[g] > 1:
            out.update(range(i, i + n))
    return out


def brute(docs):
    out = []
    for d, text in docs:
        text = text or ""
        w = blank_words(text)
        chars = sum(map(len, w))
        seen, again, size = set(), 0, 0
        for line in text.split("\n"):
            if blank_words(line):
                if line in seen:
                    again += 1
                    size += sum(map(len, blank_words(line)))
                seen.add(line)
        symbols = sum(c in "#*$%&|<>" for c in text)
        repeat = len(covered(w, 8))
        failed = len(w) < 20 or 100 * repeat > 30 * len(w)
        kept = not failed and 100 * symbols <= 10 * len(w) and 100 * size <= 30 * chars and all(100 * sum(len(w[i]) for i in covered(w, n)) <= p * chars for n, p in repetition.NGRAMS.items())
        out.append((d, len(w), chars, symbols, again, repeat, failed, kept))
    return out


def run(df, **options):
    return [tuple(r) for r in repetition.repetition_coverage(df, **options).orderBy("doc_id").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()]


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    texts = []
    for _ in range(40):
        lines = [" ".join(r.choice(["ab", "ü", "c#", "d|e", "word"]) + str(r.randrange(r.choice([2, 50]))) for _ in range(r.randrange(14))) for _ in range(r.randrange(1, 9))]
        lines += [r.choice(lines) for _ in range(r.randrange(4))]
        texts.append(r.choice(["\n", "\r\n", "\n\n", " "]).join(lines))
    assert run(frame(spark, texts)) == brute(list(enumerate(texts)))


def test_awkward_rows(spark):
    texts = [*AWKWARD, "\n" * 500, "a\x0bb\x0cc\rd", "line \n line \nline ", "nb sp ace " * 9, "\x1c x \x85 y " * 3]
    assert run(frame(spark, texts)) == brute(list(enumerate(texts)))
    assert run(frame(spark, texts).filter("false")) == []


def test_windows_do_not_cross_documents(spark):
    text = " ".join(f"w{i}" for i in range(30))
    assert [r[5] for r in run(frame(spark, [text, text]).coalesce(1))] == [0, 0]


def test_clean_prose_is_kept_and_columns_clash(spark):
    text = " ".join(f"word{i}" for i in range(100))
    assert run(frame(spark, [text]))[0][-1] is True
    with pytest.raises(ValueError):
        repetition.repetition_coverage(frame(spark, ["a"]).selectExpr("doc_id", "text", "1 as KEPT"))
    assert repetition.repetition_coverage(frame(spark, ["a"]).selectExpr("doc_id", "text", "1 as kept"), prefix="r_").columns[2] == "kept"
