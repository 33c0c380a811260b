"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every run of ``window`` consecutive words of a benchmark item is a test string; an item of fewer words is one. For each
length of test strings there is a SHIFT table over blocks of two words, which tells how far the cursor may jump, and
buckets of test strings by the hash of their last block; the first block and then the bytes are compared directly. Many
cursors move through a group of texts at once, in numpy.

Documents are scanned once, without a shuffle. Benchmark text is broadcast in blocks of at most ``block_bytes``; a larger
benchmark is several blocks, for which the scan's batches pass through one step each, in the same stage.

Defined cases. Null or empty text: no words, not contaminated. An item with a null text or without words gives no test
string. An item with a null id marks words but isn't listed. Repeated item ids count once; repeated documents each get
their row. Very long texts are searched whole, one at a time. Ties: all items with an equal test string are listed. Empty
tables: no documents, no rows; no items, no hits. Columns of the same names as new ones raise ValueError; the caller chooses
other names by ``prefix``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import plus, text_bytes
from .words import ALNUM_WORD, Words, covered, mix, pieces, sums

BLOCK_BYTES = 16 << 20
LANE = 256
_K = np.uint64(0xA24BAED4963EE407)
_BITS = 18


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((a ^ (a >> np.uint64(33))) * _K + b)


class Table:
    """Test strings of one length in words."""

    def __init__(self, m: int, strings: list[bytes], hashes: np.ndarray):
        self.m, self.strings, self.block = m, strings, 2 if m > 1 else 1
        blocks = [self.of(hashes, np.full(len(strings), q), rows=True) for q in range(self.block - 1, m)]
        self.shift = np.full(1 << _BITS, m - self.block + 1, dtype=np.int16)
        for q, b in enumerate(blocks, self.block - 1):
            np.minimum.at(self.shift, b >> np.uint64(64 - _BITS), m - 1 - q)
        self.suffix = np.unique(blocks[-1])
        ends = mix(blocks[-1] ^ mix(blocks[0]))  # of a suffix's bucket, those with the same first block
        self.order = np.argsort(ends, kind="stable")
        self.ends_of = ends[self.order]

    def of(self, h: np.ndarray, at: np.ndarray, rows: bool = False) -> np.ndarray:
        """Hash of the block that ends at a word."""
        last = h[np.arange(len(at)), at] if rows else h[at]
        if self.block == 1:
            return mix(last * _K)
        return _pair(h[np.arange(len(at)), at - 1] if rows else h[at - 1], last)

    def ends(self, h: np.ndarray) -> np.ndarray:
        """Positions of words where a test string may end."""
        n, m = len(h), self.m
        cur = np.arange(m - 1, n, LANE)
        stop = np.minimum(cur + LANE, n)
        found = []
        while len(cur):
            step = self.shift[self.of(h, cur) >> np.uint64(64 - _BITS)]
            found.append(cur[step == 0])
            cur = cur + np.maximum(step, 1)
            on = cur < stop
            cur, stop = cur[on], stop[on]
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)

    def find(self, w: Words, h: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words and numbers of the test strings that stand in the texts."""
        e = self.ends(h)
        e = e[text_of[e] == text_of[e - self.m + 1]]
        tail = self.of(h, e)
        there = self.suffix[np.minimum(np.searchsorted(self.suffix, tail), len(self.suffix) - 1)] == tail
        e, tail = e[there], tail[there]
        ends = mix(tail ^ mix(self.of(h, e - self.m + self.block)))
        lo, hi = np.searchsorted(self.ends_of, ends, "left"), np.searchsorted(self.ends_of, ends, "right")
        at, which = [], []
        for begin, a, b in zip((e - self.m + 1).tolist(), lo.tolist(), hi.tolist()):
            if a == b:
                continue
            own = w.slice(begin, self.m)
            for p in self.order[a:b].tolist():
                if own == self.strings[p]:
                    at.append(begin)
                    which.append(p)
        return np.array(at, dtype=np.int64), np.array(which, dtype=np.int64)


class Searcher:
    """Test strings of some items: (id as text or None, text)."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        w = Words([(t or "").encode() for _, t in items], ALNUM_WORD, lower=True)
        h = w.hashes()
        by_length: dict[int, dict[bytes, tuple[np.ndarray, set]]] = {}
        for k, (item, _) in enumerate(items):
            begin, n = int(w.first[k]), int(w.per_text[k])
            m = min(n, window)
            for i in range(begin, begin + n - m + 1) if n else ():
                of = by_length.setdefault(m, {}).setdefault(w.slice(i, m), (h[i : i + m], set()))
                if item is not None:
                    of[1].add(item)
        self.tables = [(Table(m, list(x), np.array([v[0] for v in x.values()])), [v[1] for v in x.values()]) for m, x in sorted(by_length.items())]

    def __call__(self, w: Words) -> tuple[np.ndarray, list[set]]:
        """Boolean per word, and the set of item ids per text."""
        h, text_of = w.hashes(), w.text_of_word()
        hit, items = np.zeros(w.n, dtype=bool), [set() for _ in w.per_text]
        for t, ids in self.tables:
            at, which = t.find(w, h, text_of)
            hit |= covered(at, t.m, w.n)
            for d, p in set(zip(text_of[at].tolist(), which.tolist())):
                items[d] |= ids[p]
        return hit, items


def searchers(benchmark: DataFrame, id_column: str, text_column: str, window: int, block_bytes: int) -> Iterator[Searcher]:
    """One for each block of items. What a block holds is bounded by block_bytes, or is one longer item."""
    items = benchmark.select(F.col(id_column).cast("string").alias("i"), F.col(text_column).cast("string").alias("t"))
    n = max(1, -(-2 * text_bytes(items, "t") // block_bytes))
    for k in range(n):
        yield Searcher([(r.i, r.t) for r in (items if n == 1 else items.filter(F.expr(f"pmod(xxhash64(i, t), {n}) = {k}"))).collect()], window)


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES, prefix: str = "") -> DataFrame:
    """The documents and, by row: ``n_words``, ``hits`` (word intervals [begin, end) inside test strings), ``items``."""
    sc = docs.sparkSession.sparkContext
    names = [f"{prefix}{c}" for c in ("n_words", "hits", "items")]
    if clash := {c.lower() for c in docs.columns} & set(names):
        raise ValueError(f"columns {sorted(clash)} are there already; give a prefix")
    schema = plus(docs.schema, (names[0], T.LongType()), (names[1], T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))), (names[2], T.ArrayType(T.StringType())))
    out = docs.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema.fields[-3:]})
    hit_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    for searcher in searchers(benchmark, item_id, item_text, window, block_bytes):
        shared = sc.broadcast(searcher)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            find = shared.value
            for batch in batches:
                for part, texts in pieces(batch, text):
                    w = Words(texts, ALNUM_WORD, lower=True)
                    hit, items = find(w)
                    before_hits, before_items = part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist()
                    spans = []
                    for d, old in enumerate(before_hits):
                        own = hit[w.first[d] : w.first[d + 1]]
                        for x in old or ():
                            own[x["begin"] : x["end"]] = True
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).view(np.int8))).tolist() if own.any() else []
                        spans.append([{"begin": a, "end": b} for a, b in zip(edge[0::2], edge[1::2])])
                    columns = [*part.columns[:-3], pa.array(w.per_text, pa.int64()), pa.array(spans, hit_type), pa.array([sorted(x | set(y or ())) for x, y in zip(items, before_items)], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

        out = out.mapInArrow(search, schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no test string stands, with their columns as they were."""
    prefix = "_hit_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    found = find_contamination(docs, benchmark, prefix=prefix, **options)
    return found.filter(F.size(f"{prefix}hits") == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["begin"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))
