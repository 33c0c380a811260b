"""Quality classifier from weak labels.

Heuristic labellers vote bad (0), good (1) or abstain (-) on each whole text. The votes of all documents are counted by
pattern (at most 3^labellers of them), and expectation-maximisation on those counts estimates, without any gold label, the
share of good documents and each labeller's accuracy, as its vote probabilities for good and for bad documents. The
posterior of a document's pattern is its label. A hashed linear scorer on word shapes is fitted to the posteriors of a
sample of at most ``SAMPLE`` documents (the one bounded sample here) and scores every document.

Scans without a shuffle of texts; only vote patterns with counts and the sample's features go to the driver.

Defined cases. Null or empty text: all labellers abstain, so its posterior is the share of good documents; the scorer sees
the bias only. Very long texts are scanned whole, one at a time. Repeated rows each count, in the fit too, and get their row.
Ties: a score equal to the threshold keeps. Empty table: no rows. Other columns stay as they are; one called like a result's
column raises ValueError, and ``prefix`` renames those.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import plus
from .words import BLANK_WORD, Words, hash_slices, pieces, sums, window_hashes

SAMPLE = 6000
BUCKETS = 1 << 14
THRESHOLD = 0.5
LABELLERS = ("capitals", "symbols", "exclamation", "columns", "stutter", "variety", "lines", "lengths", "tails", "bare")

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&<>{}[]^~\\")] = True
#: class of each byte for word shapes: a letter, a capital, a digit, others are themselves; a letter's later bytes are letters
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[0x80:] = 97, 65, 48, 97


@dataclass
class Features:
    n_words: np.ndarray
    votes: np.ndarray  # texts x labellers: 0 bad, 1 good, 2 abstains
    bucket: np.ndarray  # of all texts, by text
    value: np.ndarray
    at: np.ndarray  # of each text in bucket and value; one more at the end


def features(texts: list[bytes]) -> Features:
    w = Words(texts, BLANK_WORD, lower=False)
    n = w.per_text
    h = w.hashes()
    text_of = w.text_of_word()
    count = np.concatenate([[0], np.cumsum(_LETTER[w.norm])])
    letters = count[w.ends] - count[w.starts]
    count = np.concatenate([[0], np.cumsum(_UPPER[w.norm])])
    capitals = count[w.ends] - count[w.starts]
    one = np.maximum(n, 1)
    all_caps = sums((capitals >= 2) & (2 * capitals > letters), w.first) / one
    symbol = sums(_SYMBOL[w.raw], w.text_at) / one
    exclaim = sums(w.raw == 33, w.text_at) / one
    bars = sums(w.raw == 124, w.text_at) / one
    again = np.zeros(w.n, dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (text_of[1:] == text_of[:-1])
    stutter = sums(again, w.first) / one
    fresh = np.zeros(w.n, dtype=bool)  # four-word runs that the text doesn't have before
    run = window_hashes(h, 4)
    inside = np.flatnonzero(text_of[: len(run)] == text_of[w.n - len(run) :])
    fresh[inside[np.unique(run[inside] + text_of[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)[1]]] = True
    variety = np.where(n > 3, sums(fresh, w.first) / np.maximum(n - 3, 1), 1.0)
    lines = np.ones(len(texts))
    for d, t in enumerate(texts):
        if t.count(b"\n") >= 3:
            x = [y for y in t.split(b"\n") if y]
            lines[d] = len(set(x)) / max(1, len(x))
    size = sums(letters, w.first) / one
    tails = sums(_SYMBOL[w.norm[w.ends - 1]], w.first) / one
    bare = sums(letters == 0, w.first) / one
    limits = ((all_caps, 0.2, 0.05), (symbol, 0.1, 0.02), (exclaim, 0.2, 0.05), (bars, 0.1, 0.02), (stutter, 0.1, 0.02), (-variety, -0.25, -0.6), (-lines, -0.5, -0.8), (np.abs(size - 6.5), 5.0, 4.0), (tails, 0.1, 0.02), (bare, 0.15, 0.1))
    votes = np.stack([np.where(x > bad, 0, np.where(x < good, 1, 2)) for x, bad, good in limits], axis=1).astype(np.uint8)
    votes[n == 0] = 2

    shape = _SHAPE[w.norm]
    keep = np.ones(len(shape), dtype=bool)
    keep[1:] = (shape[1:] != shape[:-1]) | (shape[1:] == 32)
    at = np.concatenate([[0], np.cumsum(keep)])
    code = hash_slices(shape[keep], at[w.starts], at[w.ends] - at[w.starts])
    bucket = (code >> np.uint64(40)).astype(np.int64) % (BUCKETS - 1) + 1
    bucket[again] = (bucket[again] + BUCKETS // 2) % (BUCKETS - 1) + 1
    key, times = np.unique(text_of * BUCKETS + bucket, return_counts=True)
    return Features(n, votes, key % BUCKETS, np.sqrt(times / one[key // BUCKETS]), np.searchsorted(key, np.arange(len(texts) + 1) * BUCKETS))


def pattern(votes: np.ndarray) -> list[str]:
    return ["".join("01-"[v] for v in row) for row in votes.tolist()]


@dataclass
class LabelModel:
    """P(good), and P(vote | class) by class (bad, good), labeller and vote (bad, good, abstains)."""

    good: float
    vote: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        k = np.arange(votes.shape[1])
        logs = np.log(self.vote)[:, k, votes].sum(axis=2) + np.log([1 - self.good, self.good])[:, None]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit_labels(counts: dict[str, int], rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over vote patterns and the number of documents with each."""
    if not counts:
        return LabelModel(0.5, np.full((2, len(LABELLERS), 3), 1 / 3))
    keys = sorted(counts)
    votes = np.array([["01-".index(c) for c in p] for p in keys])
    n = np.array([counts[p] for p in keys], dtype=float)
    one = np.eye(3)[votes]
    post = np.where((votes == 0).any(axis=1), 1e-3, 1 - 1e-3)  # any bad vote, to start with
    for _ in range(rounds):
        weight = np.stack([(1 - post) * n, post * n])
        vote = np.einsum("cp,plv->clv", weight, one) + 0.1
        model = LabelModel(float(np.clip(weight[1].sum() / n.sum(), 1e-3, 1 - 1e-3)), vote / vote.sum(axis=2, keepdims=True))
        after = model.posterior(votes)
        if np.abs(after - post).max() < 1e-7:
            break
        post = after
    return model


def fit_scorer(rows: list[tuple[list[int], list[float], float]], times: np.ndarray | None = None, steps: int = 300, rate: float = 0.5, l2: float = 1e-5) -> np.ndarray:
    """Weights by bucket; bucket 0 is the bias. Soft targets; full-batch Adagrad. A row counts ``times``."""
    w = np.zeros(BUCKETS)
    if not rows:
        return w
    size = np.array([len(r[0]) for r in rows])
    of, y = np.repeat(np.arange(len(rows)), size), np.array([r[2] for r in rows])
    col, val = np.concatenate([np.asarray(r[0], dtype=np.int64) for r in rows]), np.concatenate([np.asarray(r[1], dtype=float) for r in rows])
    seen, part = np.full(BUCKETS, 1e-8), np.full(len(rows), 1 / len(rows)) if times is None else times / times.sum()
    for _ in range(steps):
        z = w[0] + np.bincount(of, w[col] * val, minlength=len(rows))
        miss = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * part
        g = np.bincount(col, miss[of] * val, minlength=BUCKETS) + l2 * w
        g[0] = miss.sum()
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


def _scan(docs: DataFrame, text: str, keep: list[str], fields: list, build) -> DataFrame:
    schema = plus(T.StructType([docs.schema[c] for c in keep]), *fields)
    names = [n for n, _ in fields]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, text):
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), *build(features(texts))], names=[*keep, *names])

    return docs.mapInArrow(scan, schema)


@dataclass
class Classifier:
    labels: LabelModel
    weights: np.ndarray
    threshold: float = THRESHOLD

    def score(self, f: Features) -> np.ndarray:
        n = np.diff(f.at)
        linear = np.bincount(np.repeat(np.arange(len(n)), n), self.weights[f.bucket] * f.value, minlength=len(n))  # the same whatever texts are beside
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + linear, -50, 50)))


def fit(docs: DataFrame, *, text: str = "text", sample: int = SAMPLE) -> Classifier:
    only = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    votes = _scan(only, "text", [], [("votes", T.StringType())], lambda f: [pa.array(pattern(f.votes), pa.string())])
    counts = {r["votes"]: r["n"] for r in votes.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    labels = fit_labels(counts)
    total = sum(counts.values())
    share = min(1.0, 0.9 * sample / total) if total else 0
    some = only.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else only
    some = some.groupBy("text").agg(F.count(F.lit(1)).alias("times"))  # copies are one row that counts as often, at every size

    def build(f: Features) -> list[pa.Array]:
        cut = pa.array(f.at, pa.int32())
        return [pa.ListArray.from_arrays(cut, pa.array(f.bucket, pa.int32())), pa.ListArray.from_arrays(cut, pa.array(f.value, pa.float64())), pa.array(labels.posterior(f.votes))]

    fields = [("bucket", T.ArrayType(T.IntegerType())), ("value", T.ArrayType(T.DoubleType())), ("y", T.DoubleType())]
    rows = _scan(some, "text", ["times"], fields, build).limit(sample).collect()
    return Classifier(labels, fit_scorer([(r["bucket"], r["value"], r["y"]) for r in rows], np.array([r["times"] for r in rows], dtype=float)))


def score_quality(docs: DataFrame, *, text: str = "text", sample: int = SAMPLE, classifier: Classifier | None = None, prefix: str = "") -> DataFrame:
    """The documents and, by row: ``n_words``, ``votes``, ``posterior`` (of the votes), ``score`` (of the scorer), ``kept``."""
    fields = [(f"{prefix}{n}", t) for n, t in (("n_words", T.LongType()), ("votes", T.StringType()), ("posterior", T.DoubleType()), ("score", T.DoubleType()), ("kept", T.BooleanType()))]
    if clash := {c.lower() for c in docs.columns} & {n for n, _ in fields}:
        raise ValueError(f"columns {sorted(clash)} are there already; give a prefix")
    model = classifier or fit(docs, text=text, sample=sample)

    def build(f: Features) -> list[pa.Array]:
        score = model.score(f)
        return [pa.array(f.n_words, pa.int64()), pa.array(pattern(f.votes), pa.string()), pa.array(model.labels.posterior(f.votes)), pa.array(score), pa.array(score >= model.threshold)]

    return _scan(docs, text, docs.columns, fields, build)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that the classifier keeps, with their columns as they were."""
    prefix = "_quality_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return score_quality(docs, prefix=prefix, **options).filter(F.col(f"{prefix}kept")).select(*(F.col(f"`{c}`") for c in docs.columns))
