"""Best-fit packing of tokenized documents after Martello-Toth dominance reduction.

Sizes of pieces are whole numbers up to the capacity, so an instance is its histogram: a few thousand counts, whatever the
number of documents. The driver solves that histogram only. First sets of one to three sizes that provably dominate every
other set with their largest size are fixed, as often as the counts allow; then the rest is packed best fit, decreasing.
The solution is a list of patterns with multiplicities; each piece finds its place from its rank among pieces of its size.

Documents are tokenized once; pieces (without text) are kept in the shared folder. Ranks are counted within (size, salt)
cells, whose counts go to the driver (at most capacity x 1024), so that one frequent size is many groups. Pieces of the
whole capacity, the commonest size, are sequences of their own and need no rank.

Defined cases. Null or empty text: only the end id, a piece of length 1. A longer document than the capacity is cut in
pieces of the capacity; the last may be shorter. Very long texts are tokenized whole, one at a time. Repeated rows are
packed each. Ties between sets of equal rooms go to the one opened last. Empty table: no rows. Rows with equal
(doc_id, piece, crc) may take each other's places. Other columns are not read; a document id called like a result's
column raises ValueError.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import plus, stored
from .words import LOWER, pieces

CAPACITY = 2048
CELL_ROWS = 1 << 22  # a cell's rows on average over all lengths; the number of salts follows from it
SALTS = (64, 1024)  # at least and at most
CACHE_WORDS = 200_000
CACHE_BYTES = 8 << 20  # of the words in the cache
ENCODE_WORDS = 2048
END_ID = 0


#: After a letter this tokenizer always divides before these.
_TAIL = b".,;:!?|)"
#: Lower-case letters that the tokenizer's normalization leaves as they are and that are one run for it.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+\Z")


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a printable byte as itself and the n-th of the others as the letter 256 + n."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(others)}


class _Places(dict):
    """Numbers of words in the order in which they are first asked for; ``fresh`` are those not yet encoded."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        self.fresh.append(word)
        return k


class WordTokenizer:
    """Ids of texts from those of their blank-separated words, which this tokenizer never joins; distinct words are encoded once.

    It lower-cases, so ASCII is lower-cased before; a text with the start of a special token's name is left as it is.
    """

    _open: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.clear()

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def clear(self) -> None:
        self.place = _Places()
        self.place[b" "] = 0  # a blank stands for the end of a text
        self.bytes = 1
        self.size, self.begin, self.ids = np.array([1], dtype=np.int32), np.array([0], dtype=np.int32), np.array([END_ID], dtype="<u4")

    def shrink(self) -> None:
        """Forget all but the words first seen, which are mostly the frequent ones: half of what the cache holds."""
        kept, held = _Places(), 0
        for w in islice(self.place, CACHE_WORDS // 2):
            held += len(w)
            if held > CACHE_BYTES // 2 and kept:
                break
            kept[w] = len(kept)
        self.place, self.bytes, self.size, self.begin = kept, held, self.size[: len(kept)].copy(), self.begin[: len(kept)].copy()
        self.ids = self.ids[: int(self.begin[-1] + self.size[-1])].copy()

    def learn(self) -> None:
        """Encode the fresh words. Letters go to the model as they are, a tail of punctuation has ids of its own; other words go through the tokenizer."""
        words, self.place.fresh = self.place.fresh, []
        model, letters, tails = self.tokenizer.model, self.letters, {b"": []}
        ids: list[list[int] | None] = []
        for w in words:
            core = w.rstrip(_TAIL)
            if _LETTERS.match(core):
                tail = w[len(core) :]
                if tail not in tails:
                    tails[tail] = self.tokenizer.encode(tail.decode(), add_special_tokens=False).ids
                ids.append([x.id for x in model.tokenize(core.decode("latin-1").translate(letters))] + tails[tail])
            else:
                ids.append(None)
        other = [i for i, x in enumerate(ids) if x is None]
        for k in range(0, len(other), ENCODE_WORDS):  # an encoding is many times its ids
            some = other[k : k + ENCODE_WORDS]
            for i, x in zip(some, self.tokenizer.encode_batch([words[i].decode() for i in some], add_special_tokens=False)):
                ids[i] = x.ids
        self.bytes += sum(map(len, words))
        size = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
        self.begin = np.concatenate([self.begin, (len(self.ids) + np.cumsum(size) - size).astype(np.int32)])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), dtype="<u4", count=int(size.sum()))])

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, the end id after each text, and where each text's begin (one more at the end)."""
        if len(self.place) > CACHE_WORDS or self.bytes > CACHE_BYTES:
            self.shrink()
        get, flat, last = self.place.__getitem__, [], []
        for t in texts:
            flat += map(get, (t if b"<|" in t else t.translate(LOWER)).split())
            last.append(len(flat))
            flat.append(0)
        if self.place.fresh:
            self.learn()
        words = np.array(flat, dtype=np.int32)
        size = self.size[words]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.begin[words] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends[last]])


def tokenize(docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece."""
    kept = [(doc_id, docs.schema[doc_id].dataType)]
    if doc_id.lower() in {"piece", "start", "length", "ids_crc32", "sequence_id", "offset", "_salt", "_rank"}:
        raise ValueError(f"a document id called {doc_id} would clash with the result's columns")
    schema = plus(T.StructType([T.StructField(n, t) for n, t in kept]), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.of(tokenizer_path)
        for batch in batches:
            for part, texts in pieces(batch, text, 1 << 20):
                ids, at = tokenizer(texts)
                row, piece, length, crc = [], [], [], []
                for d, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    for k, s in enumerate(range(a, b, capacity)):
                        cut = ids[s : min(s + capacity, b)]
                        row.append(d)
                        piece.append(k)
                        length.append(len(cut))
                        crc.append(zlib.crc32(cut.tobytes()))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(doc_id)).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array([k * capacity for k in piece], pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=schema.names)

    return docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).mapInArrow(scan, schema)


Pattern = tuple[tuple[int, ...], int]


def reduce_dominated(counts: np.ndarray) -> list[Pattern]:
    """Take out sets that dominate every feasible set with their first size, as often as that holds; counts change."""
    cap, out = len(counts) - 1, []

    def least(n: int, j: int) -> list[int]:
        """The n smallest items besides one of size j."""
        found: list[int] = []
        for s in np.flatnonzero(counts).tolist():
            found += [s] * min(n, int(counts[s]) - (s == j))
            if len(found) >= n:
                break
        return found[:n]

    def largest(most: int, *without: int) -> int:
        for s in np.flatnonzero(counts[: most + 1])[::-1].tolist() if most > 0 else ():
            if counts[s] > without.count(s):
                return s
        return 0

    def fix(*sizes: int) -> None:
        times = min(int(counts[s]) // sizes.count(s) for s in set(sizes))
        for s in sizes:
            counts[s] -= times
        out.append((sizes, times))

    changed = True
    while changed:
        changed = False
        for j in np.flatnonzero(counts)[::-1].tolist():
            while counts[j]:
                rest = cap - j
                k = largest(rest, j)
                if not k:
                    fix(j)
                    changed = True
                    continue
                small = least(3, j)
                if k == rest or len(small) < 2 or small[0] + small[1] > rest:
                    fix(j, k)
                    changed = True
                    continue
                if len(small) < 3 or sum(small) > rest:  # two more at most
                    sizes = [s for s in np.flatnonzero(counts[: rest + 1]).tolist() if counts[s] > (s == j)]
                    pairs = [(x, y) for y in sizes if (x := largest(rest - y, j, y)) >= y]  # for each y the largest x
                    if max(x + y for x, y in pairs) <= k:
                        fix(j, k)
                        changed = True
                        continue
                    b = largest(rest - k, j, k)
                    if b and all(y <= b or x + y <= k for x, y in pairs):
                        fix(j, k, b)
                        changed = True
                        continue
                break
    return out


def best_fit(counts: np.ndarray) -> list[Pattern]:
    """Best fit decreasing over size classes: each step fills many equal bins at once."""
    cap = len(counts) - 1
    open_bins: list[list[list]] = [[] for _ in range(cap + 1)]  # by room: [sizes, bins]
    for s in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[s])
        room = s
        while n:
            while room <= cap and not open_bins[room]:
                room += 1
            if room > cap:
                sizes, bins, room = (), max(1, n // (cap // s)), cap
            else:
                sizes, bins = open_bins[room].pop()
            each = room // s
            full = min(bins, n // each)
            if full:
                open_bins[room - each * s].append([(*sizes, *[s] * each), full])
                n -= full * each
            elif n:
                open_bins[room - n * s].append([(*sizes, *[s] * n), 1])
                n, full = 0, 1
            if full < bins and sizes:
                open_bins[room].append([sizes, bins - full])
            room = s
    return [(tuple(sizes), bins) for x in open_bins for sizes, bins in x]


def pack_counts(counts: np.ndarray) -> list[Pattern]:
    """Patterns (sizes, times) that use every item of the histogram once. counts[s]: items of size s."""
    counts = counts.copy()
    return reduce_dominated(counts) + best_fit(counts)


def places(patterns: list[Pattern], cap: int) -> tuple[np.ndarray, ...]:
    """Runs of ranks: key (size << 50 | first rank), first sequence, offset; sorted by key."""
    taken, key, seq, offset, base = np.zeros(cap + 1, dtype=np.int64), [], [], [], 0
    for sizes, times in patterns:
        at = 0
        for s in sizes:
            key.append((s << 50) + int(taken[s]))
            seq.append(base)
            offset.append(at)
            taken[s] += times
            at += s
        base += times
    order = np.argsort(key)
    return tuple(np.array(x, dtype=np.int64)[order] for x in (key, seq, offset))


def pack(docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    spark = docs.sparkSession
    cut = stored(tokenize(docs, tokenizer_path, doc_id=doc_id, text=text, capacity=capacity))
    salts = int(np.clip(cut.count() // CELL_ROWS, *SALTS))
    part = cut.filter(F.col("length") < capacity)
    salted = part.withColumn("_salt", F.pmod(F.xxhash64(F.col(f"`{doc_id}`"), "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    cells = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")).toArrow()
    grid = np.zeros((capacity + 1, salts), dtype=np.int64)
    grid[cells["length"].to_numpy(), cells["_salt"].to_numpy()] = cells["n"].to_numpy()
    before = np.cumsum(grid, axis=1) - grid
    shared = spark.sparkContext.broadcast((before, places(pack_counts(grid.sum(axis=1)), capacity)))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(F.col(f"`{doc_id}`"), "piece", "ids_crc32")).cast("long"))
    names = cut.columns
    schema = plus(cut.schema, ("sequence_id", T.LongType()), ("offset", T.LongType()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, (key, seq, offset) = shared.value
        for batch in batches:
            length, salt, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_salt", "_rank"))
            own = (length << 50) + before[length, salt] + rank - 1
            run = np.searchsorted(key, own, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(seq[run] + own - key[run]), pa.array(offset[run])], names=[*names, "sequence_id", "offset"])

    # a piece of the whole capacity is a sequence; such sequences have numbers under 0
    full = cut.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return ranked.mapInArrow(place, schema).unionByName(full)
