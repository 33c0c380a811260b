"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

A feature is a word's presence (alphanumeric words, lower case). From at most ``SAMPLE`` labelled documents, the one
bounded sample here, words that stand in toxic rather than clean documents become ``FEATURES`` candidates; one weight
vector is shared by all thresholds, P(grade >= k) = sigmoid(w.x - t_k) with t_1 < t_2 < ..., fitted with an L1 penalty, so
that few words keep a weight, never a negative one. The result is the expected grade, the sum of P(grade >= k).

Labels say toxic or not; the training grade of a toxic document is 1 to 3 by how many distinct marker words it has
(1-2, 3-4, more), a clean one's is 0. A ``grade`` column of the labels is used as it is.

Defined cases. Null or empty text: no features, so the thresholds alone give its severity. Repeated labels of a document:
the highest counts. Without labelled rows, or without toxic ones: severity 0 for all. Empty table: no rows. Very long texts
are scanned whole, one at a time. Ties: a probability of exactly a half reaches the grade; of equally telling words the least
hash is taken. Repeated rows each get their row. Other columns stay as they are; one called like a result's column raises
ValueError, and ``prefix`` renames those.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import plus
from .words import ALNUM_WORD, Words, pieces, sums

SAMPLE = 20_000
FEATURES = 256
GRADES = 3
MIN_DOCUMENTS = 3
#: least log of how much oftener a candidate word stands in toxic than in clean documents.
ODDS = 2.0


@dataclass
class Model:
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))  # sorted hashes
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES, np.inf))

    def at_least(self, linear: np.ndarray) -> np.ndarray:
        """P(grade >= k) by text and k = 1, 2, ..."""
        away = self.thresholds[None, :] - linear[:, None]
        return np.where(np.isinf(away), 0.0, 1 / (1 + np.exp(np.clip(away, -60, 60))))


def present(w: Words, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) of the sorted feature hashes that stand in the texts."""
    if not len(words) or not w.n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    h = w.hashes()
    k = np.minimum(np.searchsorted(words, h), len(words) - 1)
    found = np.flatnonzero(words[k] == h)
    key = np.unique(w.text_of_word()[found] * len(words) + k[found])
    return key // len(words), key % len(words)


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int, l1: float = 2e-4, steps: int = 500, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by accelerated proximal gradient steps; L1 on the weights, none below 0. A row counts ``times``."""
    share = np.full(len(x), 1 / len(x)) if times is None else times / times.sum()
    t = np.linspace(1.0, 2.0, grades)
    w = np.zeros(x.shape[1])
    reached = (y[:, None] >= np.arange(1, grades + 1)).astype(float)
    at_w, at_t, old_w, old_t, momentum = w, t, w, t, 1.0
    rate = 4.0 / max(1.0, float(np.linalg.norm(x * np.sqrt(share)[:, None], 2) ** 2) * grades + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(at_t[None, :] - (x @ at_w)[:, None], -60, 60)))
        # likelihood of the cells P(>=k) - P(>=k+1), as shared logistic losses of the cumulative events
        miss = (p - reached) * share[:, None]
        w = at_w - rate * (x.T @ miss.sum(axis=1))
        w = np.maximum(w - rate * l1, 0)
        t = np.maximum.accumulate(at_t + rate * miss.sum(axis=0))
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        at_w, at_t = w + (momentum - 1) / following * (w - old_w), t + (momentum - 1) / following * (t - old_t)
        old_w, old_t, momentum = w, t, following
    return w, t


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    graded = "grade" in labels.columns
    named = labels.filter(F.col(doc_id).isNotNull() & F.col(toxic).isNotNull()).groupBy(doc_id).agg(F.max(F.col("grade" if graded else toxic).cast("int")).alias("y"))
    total = named.count()
    if not total:
        return Model()
    share = min(1.0, 0.9 * sample / total)
    some = named.filter(F.pmod(F.xxhash64(doc_id), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else named
    label_of = spark.sparkContext.broadcast({r[doc_id]: r["y"] for r in some.limit(sample).collect()})
    labelled = docs.filter(F.col(doc_id).isNotNull()).select(doc_id, text)

    def chosen(batch: pa.RecordBatch) -> Iterator[tuple[Words, np.ndarray]]:
        ids = batch.column(0).to_pylist()
        rows = [i for i, d in enumerate(ids) if d in label_of.value]
        if rows:
            for part, texts in pieces(batch.take(pa.array(rows, pa.int64())), text):
                yield Words(texts, ALNUM_WORD, lower=True), np.array([label_of.value[d] for d in part.column(0).to_pylist()])

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, y in chosen(batch):
                h, of = w.hashes(), w.text_of_word()
                order = np.lexsort((of, h))
                h, of = h[order], of[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
                h, bad = h[new], y[of[new]] > 0
                words, at = np.unique(h, return_index=True)
                n = np.diff(np.append(at, len(h)))
                k = np.add.reduceat(bad.astype(np.int64), at) if len(at) else n
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(k, pa.int64()), pa.array(n - k, pa.int64())], names=["word", "toxic", "clean"])

    counts = labelled.mapInArrow(count_words, "word long, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    n_toxic = sum(y > 0 for y in label_of.value.values())
    n_clean = len(label_of.value) - n_toxic
    if not n_toxic:
        return Model()
    odds = F.log((F.col("a") + 0.5) / (n_toxic + 1)) - F.log((F.col("b") + 0.5) / (n_clean + 1))
    weight = odds * F.sqrt("a")
    top = counts.filter((F.col("a") >= MIN_DOCUMENTS) & (odds > ODDS)).orderBy(weight.desc(), "word").limit(FEATURES).collect()
    if not top:
        return Model()
    words = np.array([r["word"] for r in top], dtype=np.int64).view(np.uint64)
    marker = np.array([r["b"] * n_toxic * 20 < r["a"] * n_clean for r in top])
    order = np.argsort(words)
    words, marker = words[order], marker[order]

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, y in chosen(batch):
                of, k = present(w, words)
                cut = pa.array(np.searchsorted(of, np.arange(len(y) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.ListArray.from_arrays(cut, pa.array(k, pa.int32()))], names=["y", "x"])

    # equal (label, features) are one row with a count: documents without any feature are one row
    rows = labelled.mapInArrow(matrix, "y int, x array<int>").groupBy("y", "x").count().limit(sample).collect()
    times = np.array([r["count"] for r in rows], dtype=float)
    x = np.zeros((len(rows), len(words)))
    for i, r in enumerate(rows):
        x[i, r["x"]] = 1
    y = np.array([r["y"] for r in rows])
    if not graded:
        n = x[:, marker].sum(axis=1)
        y = np.where(y > 0, 1 + (n > 2) + (n > 4), 0)
    w, t = fit_ordinal(x, y, int(max(y.max(), GRADES)), times=times)
    used = w != 0
    return Model(words[used], w[used], t)


def score_toxicity(docs: DataFrame, labels: DataFrame | None = None, *, doc_id: str = "doc_id", text: str = "text", model: Model | None = None, prefix: str = "", **options) -> DataFrame:
    """The documents and, by row: ``n_words``, ``n_markers``, ``severity`` (expected grade), ``p_toxic`` = P(grade >= 1), ``grade`` (most that is likelier than not), ``is_toxic``."""
    fields = [(f"{prefix}{n}", t) for n, t in (("n_words", T.LongType()), ("n_markers", T.LongType()), ("severity", T.DoubleType()), ("p_toxic", T.DoubleType()), ("grade", T.IntegerType()), ("is_toxic", T.BooleanType()))]
    if clash := {c.lower() for c in docs.columns} & {n for n, _ in fields}:
        raise ValueError(f"columns {sorted(clash)} are there already; give a prefix")
    use = model or fit(docs, labels, doc_id=doc_id, text=text, **options)
    names = [*docs.columns, *(n for n, _ in fields)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, text):
                w = Words(texts, ALNUM_WORD, lower=True)
                of, k = present(w, use.words)
                linear = np.bincount(of, use.weights[k] if len(k) else None, minlength=len(texts)).astype(float)
                p = use.at_least(linear)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(w.per_text, pa.int64()), pa.array(np.bincount(of, minlength=len(texts)), pa.int64()), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array((p >= 0.5).sum(axis=1), pa.int32()), pa.array(p[:, 0] >= 0.5)], names=names)

    return docs.mapInArrow(scan, plus(docs.schema, *fields))
