"""Removal of repeated word windows, by super-k-mer partitioning.

A window is ``window`` consecutive words of one text. Each window has a minimiser, the least hash among its runs of
``MINIMISER`` words; consecutive windows with the same minimiser travel as one packed string to the minimiser's bucket.
Equal windows have equal minimisers, so each bucket sees all occurrences of its windows; it sorts them by hash, confirms
equal ones on their bytes and finds the first by (document id, start). Every other occurrence marks the words it covers.

What travels is packed once per scan batch and bucket: equal strings of one batch are one string with its occurrences, so
that copies weigh little, and the rest is compressed. A bucket is sized by ``BUCKET_BYTES`` of packed words. Any order of
the runs gives the same result, so runs that would bring over ``HOT_BYTES`` to their bucket come last in it and are minimisers
only of windows that consist of such runs, whose strings are repeats themselves. They are found in a hashed sample of the
texts (a 64th, at least ``SAMPLE_BYTES``), which decides on balance alone.

Texts are scanned twice: once for the windows, once to remove words, when the marked intervals of a document, kept in the
shared folder, are joined to its row by (id, hash of the text).

Defined cases. Null or empty text: no words, nothing removed. A text of fewer words than the window is kept whole. Very long
texts are scanned whole, one at a time; their strings go to many buckets. Rows of one document id are one document in which
starts are compared; of repeated equal rows none is earlier, so all are treated alike (a tie). Ids are whole numbers or
strings of such; a null id comes after all others. Empty table: no rows. Other columns stay as they are; one called like a
result's column raises ValueError, and ``prefix`` renames those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import dropped, free_name, plus, stored, text_bytes
from .words import BLANK_WORD, Words, covered, mix, pieces, window_hashes

WINDOW = 20
MINIMISER = 6
MOST_WINDOWS = 64  # of one packed string
BUCKET_BYTES = 6 << 20
BATCH_BYTES = 4 << 20
LEVEL = 6  # of compression
HOT_BYTES = 32 << 20
SAMPLE_BYTES = 8 << 20
MOST_HOT = 1 << 20


def _sliding_min(h: np.ndarray, n: int) -> np.ndarray:
    """Least of each n values in a row, by doubling."""
    width = 1
    while 2 * width <= n:
        h = np.minimum(h[: len(h) - width], h[width:])
        width *= 2
    return h if width == n else np.minimum(h[: len(h) - (n - width)], h[n - width :])


def _runs(w: Words, window: int) -> np.ndarray:
    return mix(window_hashes(w.hashes(), min(MINIMISER, window)))


def hot_runs(texts: DataFrame, window: int, size: int) -> np.ndarray:
    """Sorted hashes of runs so frequent that a bucket of their strings would be too large; by a sample, at most ``MOST_HOT``."""
    parts = max(1, min(64, size // max(1, SAMPLE_BYTES)))
    least = max(8, HOT_BYTES // (2 * window * 6) // parts)  # a string has up to two windows' words

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, some in pieces(batch, "text", BATCH_BYTES):
                run, n = np.unique(_runs(Words(some, BLANK_WORD, lower=False), window), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(run.view(np.int64)), pa.array(n)], names=["run", "n"])

    some = texts.filter(F.pmod(F.col("key"), F.lit(parts)) == 0).select("text").mapInArrow(scan, "run long, n long")
    found = stored(some.groupBy("run").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "run").limit(MOST_HOT))
    out = np.sort(found.select("run").toArrow()["run"].to_numpy().view(np.uint64))
    dropped(found)
    return out


def super_kmers(w: Words, window: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, windows and minimiser of each string; windows don't cross texts, runs of ``hot`` (sorted) come last."""
    if w.n < window:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.uint64),)
    runs = _runs(w, window)
    order = runs >> np.uint64(1)
    if len(hot):
        order |= (hot[np.minimum(np.searchsorted(hot, runs), len(hot) - 1)] == runs).astype(np.uint64) << np.uint64(63)
    least = _sliding_min(order, window - min(MINIMISER, window) + 1)
    text_of = w.text_of_word()
    inside = text_of[: len(least)] == text_of[window - 1 :]
    at = np.flatnonzero(inside)
    if not len(at):
        return at, at, least[:0]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (least[at][1:] != least[at][:-1]) | (np.diff(at) != 1)
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(at)))
    more = np.maximum(-(-n // MOST_WINDOWS), 1)
    k = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
    first = np.repeat(at[head], more) + k * MOST_WINDOWS
    count = np.minimum(np.repeat(n, more) - k * MOST_WINDOWS, MOST_WINDOWS)
    return first, count, np.repeat(least[at[head]], more)


def _send(docs: DataFrame, window: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """Per scan batch and bucket: packed strings, and of each its occurrences (id or null, text hash, first word)."""
    schema = "bucket int, strings binary, places binary"
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            for part, texts in pieces(batch, "text", BATCH_BYTES):
                w = Words(texts, BLANK_WORD, lower=False)
                first, count, least = super_kmers(w, window, shared.value)
                if not len(first):
                    continue
                text_of = np.searchsorted(w.first, first, "right") - 1
                ids = part.column(0)
                null = np.array(ids.is_null())
                id_ = ids.fill_null(0).to_numpy(zero_copy_only=False)[text_of]
                key = part.column(1).to_numpy()[text_of]
                start = first - w.first[text_of]
                begin, end = w.starts[first].tolist(), w.ends[first + count + window - 2].tolist()
                bucket = (mix(least) >> np.uint64(16)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
                data = w.data
                out: tuple[list, list, list] = ([], [], [])
                for b in np.flatnonzero(np.diff(cut)).tolist():
                    rows = order[cut[b] : cut[b + 1]]
                    number: dict[bytes, int] = {}
                    of = np.array([number.setdefault(data[begin[i] : end[i]], len(number)) for i in rows.tolist()], dtype=np.int32)
                    places = np.empty(len(rows), dtype=_PLACE)
                    places["string"], places["null"], places["id"], places["text"], places["start"] = of, null[text_of[rows]], id_[rows], key[rows], start[rows]
                    out[0].append(b)
                    out[1].append(pack(b"\n".join(number)))
                    out[2].append(pack(places.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["bucket", "strings", "places"])

    return docs.mapInArrow(scan, schema)


_PLACE = np.dtype([("string", "<i4"), ("start", "<i4"), ("id", "<i8"), ("text", "<i8"), ("null", "?")])


def _equal_windows(w: Words, at: np.ndarray, window: int, group: np.ndarray) -> np.ndarray:
    """Exact classes: at (sorted by hash) with group = run of equal hashes; a run with different bytes is divided."""
    head = np.flatnonzero(np.diff(np.concatenate([[-1], group])))
    first = at[head][group]
    data, starts, ends = w.data, w.starts, w.ends
    a, b, c = starts[at].tolist(), ends[at + window - 1].tolist(), starts[first].tolist()
    same = np.fromiter((data[x:y] == data[z : z + y - x] for x, y, z in zip(a, b, c)), dtype=bool, count=len(at))
    if same.all():
        return group
    group = group.copy()
    names: dict[tuple[int, bytes], int] = {}
    following = int(group.max()) + 1
    for i in np.flatnonzero(~same).tolist():
        group[i] = names.setdefault((int(group[i]), data[a[i] : b[i]]), following + len(names))
    return group


def repeats(strings: list[list[bytes]], places: list[np.ndarray], window: int) -> np.ndarray:
    """Of one bucket: occurrences (null, id, text, start, end) of windows that start earlier elsewhere, merged where they follow."""
    offset = np.cumsum([0, *map(len, strings)])
    w = Words([x for s in strings for x in s], BLANK_WORD, lower=False)
    place = np.concatenate(places)
    string = place["string"].astype(np.int64) + np.repeat(offset[:-1], [len(p) for p in places])
    # distinct strings may come from several batches: windows are counted on their occurrences
    n_windows = w.per_text - window + 1
    first_window = np.cumsum(n_windows) - n_windows
    at = np.repeat(w.first[:-1], n_windows) + np.arange(n_windows.sum()) - np.repeat(first_window, n_windows)  # first word of each
    h = window_hashes(w.hashes(), window)[at]
    uses = np.bincount(string, minlength=len(n_windows))
    owner = np.repeat(np.arange(len(n_windows)), n_windows)
    order = np.argsort(h, kind="stable")
    run = np.cumsum(np.concatenate([[True], h[order][1:] != h[order][:-1]])) - 1
    total = np.bincount(run, uses[owner[order]])
    keep = total[run] > 1
    order, run = order[keep], run[keep]
    if not len(order):
        return np.zeros(0, dtype=_SPAN)
    run = np.unique(run, return_inverse=True)[1]
    cls = np.full(len(h), -1, dtype=np.int64)
    cls[order] = _equal_windows(w, at[order], window, run)
    # occurrences of the windows that stand more than once
    wanted = np.zeros(len(n_windows), dtype=bool)
    wanted[owner[order]] = True
    use = wanted[string]
    place, string = place[use], string[use]
    by = np.lexsort((place["start"], place["id"], place["null"]))
    place, string = place[by], string[by]
    rank = np.cumsum(np.concatenate([[0], (place["id"][1:] != place["id"][:-1]) | (place["null"][1:] != place["null"][:-1])]))
    n = n_windows[string]
    occ = np.repeat(np.arange(len(place)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    c = cls[first_window[string][occ] + k]
    there = c >= 0
    occ, k, c = occ[there], k[there], c[there]
    start = place["start"][occ].astype(np.int64) + k
    when = (rank[occ].astype(np.int64) << 32) + start
    earliest = np.full(int(c.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(earliest, c, when)
    late = when > earliest[c]
    occ, start = occ[late], start[late]
    if not len(occ):
        return np.zeros(0, dtype=_SPAN)
    new = np.concatenate([[True], (occ[1:] != occ[:-1]) | (start[1:] != start[:-1] + 1)])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(occ)) - 1
    out = np.empty(len(head), dtype=_SPAN)
    p = place[occ[head]]
    out["null"], out["id"], out["text"], out["start"], out["end"] = p["null"], p["id"], p["text"], start[head], start[tail] + window
    return out


_SPAN = np.dtype([("null", "?"), ("id", "<i8"), ("text", "<i8"), ("start", "<i8"), ("end", "<i8")])


def repeated_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, text_hash, start, end): word intervals to remove; they may overlap. Ids are whole numbers."""
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("key"), F.col(f"`{text}`").alias("text")).filter("text is not null")
    size = text_bytes(source, "text")
    buckets = max(8, -(-3 * size // BUCKET_BYTES))

    def merge(group: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        strings = [unpack(x).split(b"\n") for x in group.column("strings").to_pylist()]
        found = repeats(strings, [np.frombuffer(unpack(x), dtype=_PLACE) for x in group.column("places").to_pylist()], window)
        return pa.table({"id": pa.array(found["id"], mask=found["null"]), "text_hash": pa.array(found["text"]), "start": pa.array(found["start"]), "end": pa.array(found["end"])})

    return _send(source, window, buckets, hot_runs(source, window, size)).groupBy("bucket").applyInArrow(merge, "id long, text_hash long, start long, end long")


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, prefix: str = "") -> DataFrame:
    """The documents and, by row: ``kept`` (kept words joined by one space), ``n_words``, ``n_removed``, ``kept_sha256``."""
    fields = [(f"{prefix}{n}", t) for n, t in (("kept", T.StringType()), ("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()))]
    if clash := {c.lower() for c in docs.columns} & {n for n, _ in fields}:
        raise ValueError(f"columns {sorted(clash)} are there already; give a prefix")
    spans = stored(repeated_spans(docs, doc_id=doc_id, text=text, window=window))
    marked = spans.groupBy("id", "text_hash").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    held = free_name(docs, "_spans")
    right = marked.select(F.col("id").alias("_i"), F.col("text_hash").alias("_h"), F.col("spans").alias(held))
    names = docs.columns
    joined = docs.join(right, docs[doc_id].cast("long").eqNullSafe(right["_i"]) & (F.xxhash64(docs[text]) == right["_h"]), "left").select(*(docs[c] for c in names), held)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, text):
                w = Words(texts, BLANK_WORD, lower=False)
                kept, removed, sha = [], [], []
                for d, found in enumerate(part.column(part.num_columns - 1).to_pylist()):
                    a, n = int(w.first[d]), int(w.per_text[d])
                    if found:
                        gone = covered(np.array([x["start"] for x in found]), np.array([x["end"] - x["start"] for x in found]), n)
                        left = np.flatnonzero(~gone) + a
                        out = b" ".join([w.data[s:e] for s, e in zip(w.starts[left].tolist(), w.ends[left].tolist())])
                        removed.append(int(gone.sum()))
                    else:
                        out = w.slice(a, n) if n else b""
                        removed.append(0)
                    kept.append(out)
                    sha.append(hashlib.sha256(out).hexdigest())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(w.per_text, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)], names=[*names, *(n for n, _ in fields)])

    return joined.mapInArrow(strip, plus(docs.schema, *fields))
