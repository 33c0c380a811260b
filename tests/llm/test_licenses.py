import random
import re

import pytest
from helpers import AWKWARD, alnum_words, frame

from lattix.llm import licenses


def brute(docs):
    out = []
    for d, text in docs:
        w, found = alnum_words(text), []
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at = [i for i, _ in found]
        out.append((d, len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))))
    return out


def run(df, **options):
    return licenses.scan_licenses(df, **options).orderBy("doc_id").collect()


def base(found):
    return [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found]


def test_base_places_against_brute_force(spark):
    r = random.Random(0)
    texts = []
    for _ in range(60):
        parts = [r.choice([*licenses.PHRASES, "under the mit", "license", "cc by", "Under The MIT License!", "cc-by-nc"]) for _ in range(r.randrange(8))]
        texts.append(r.choice([" ", ", ", "\n"]).join(parts))
    assert base(run(frame(spark, texts))) == brute(list(enumerate(texts)))


def test_awkward_rows(spark):
    out = run(frame(spark, AWKWARD))
    assert base(out) == brute(list(enumerate(AWKWARD)))
    assert {r["labels"] for r in out} == {""} and {r["score"] for r in out} == {0.0}
    assert run(frame(spark, AWKWARD).filter("false")) == []


def test_phrases_do_not_cross_documents(spark):
    assert base(run(frame(spark, ["under the mit", "license here"]).coalesce(1))) == [(0, 3, 0, None, None, ""), (1, 2, 0, None, None, "")]


def test_optional_and_replaceable_regions():
    a = licenses.Automaton("may [[freely and]] use <<3>> at will")
    yes = ["may use at will", "may freely and use at will", "may use it x y at will", "may freely and use it at will"]
    no = ["may freely use at will", "may use a b c d at will", "may use at", "may not use at will", "may use it at wil"]
    assert all(a.match([x.encode() for x in t.split()]) == len(t.split()) for t in yes)
    assert not any(a.match([x.encode() for x in t.split()]) for t in no)


def test_replaceable_region_may_hold_the_wording_after_it():
    a = licenses.Automaton("in no event shall <<3>> be liable")
    assert a.match(b"in no event shall be it be liable".split()) == 8


@pytest.mark.parametrize("label", list(licenses.TEMPLATES))
def test_each_template_accepts_its_text_and_no_changed_wording(spark, label):
    markup = licenses.TEMPLATES[label]
    words, mandatory = [], []
    for part in re.findall(r"\[\[.*?\]\]|<<\d+>>|\S+", markup):
        if part.startswith("<<"):
            words += ["ACME"]
        elif not part.startswith("[["):
            mandatory.append(len(words))
            words.append(part)
    broken = list(words)
    broken[mandatory[len(mandatory) // 2]] = "zzz"
    out = run(frame(spark, ["intro words. " + " ".join(words) + " and more", " ".join(broken)]))
    assert label in out[0]["labels"].split(",")
    assert label not in out[1]["labels"].split(",")
    assert 0 < out[0]["score"] <= 1
    span = next(s for s in out[0]["spans"] if s["label"] == label)
    assert span["begin"] == 2


def test_base_labels_stay(spark):
    [r] = run(frame(spark, ["released under the MIT license"]))
    assert set(r["base_labels"].split(",")) <= set(r["labels"].split(","))
    with pytest.raises(ValueError):
        licenses.scan_licenses(frame(spark, ["a"]).selectExpr("doc_id", "text", "1 as LABELS"))
