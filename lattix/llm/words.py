"""Byte-level word splitting and hashing in numpy, shared by the text operators.

A ``Words`` object holds the words of a group of whole texts: ``norm`` is every word followed by one space, so a run of
consecutive words of one text is one contiguous slice of ``norm`` and can be compared byte by byte. Hashes only select;
every caller confirms equality on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_ALL = np.arange(256)
#: ``[^\x20\x09-\x0D]+``
BLANK_WORD = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
ALNUM_WORD = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)
PIECE_BYTES = 3 << 20

_K1 = np.uint64(0x9E3779B97F4A7C15)
_K2 = np.uint64(0xC2B2AE3D27D4EB4F)
_S = np.uint64(29)
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)
WINDOW_K = 0xD6E8FEB86659FD93


def mix(h: np.ndarray) -> np.ndarray:
    h = h * _K2
    return h ^ (h >> _S)


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch of about ``most`` bytes of text; a longer text is a slice of its own and stays whole."""
    texts = texts_of(batch.column(batch.schema.get_field_index(column)))
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > most:
            yield batch.slice(begin, i - begin), texts[begin:i]
            begin, size = i, 0
        size += len(t)
    if len(texts) > begin:
        yield batch.slice(begin), texts[begin:]


class Words:
    """Words of several texts. ``first[d]:first[d+1]`` are those of text d; ``starts``/``ends`` index ``norm``."""

    def __init__(self, texts: list[bytes], table: np.ndarray, lower: bool):
        joined = b" ".join(texts) + b" "
        if lower:
            joined = joined.translate(LOWER)
        raw = np.frombuffer(joined, dtype=np.uint8)
        lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.text_at = np.concatenate([[0], np.cumsum(lens + 1)])  # of each text in raw
        self.raw = raw
        is_word = table[raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], is_word]).view(np.int8)))
        self.raw_starts, self.raw_ends = edge[0::2], edge[1::2]
        self.n = len(self.raw_starts)
        self.lens = self.raw_ends - self.raw_starts
        is_word[self.raw_ends] = True
        norm = raw[is_word]
        self.ends = np.cumsum(self.lens + 1) - 1
        self.starts = self.ends - self.lens
        norm[self.ends] = 32
        self.norm = norm
        self.first = np.searchsorted(self.raw_starts, self.text_at)
        self.per_text = np.diff(self.first)
        self._bytes: bytes | None = None

    @property
    def data(self) -> bytes:
        if self._bytes is None:
            self._bytes = self.norm.tobytes()
        return self._bytes

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.per_text)), self.per_text)

    def hashes(self) -> np.ndarray:
        return hash_slices(self.norm, self.starts, self.lens)

    def slice(self, word: int, count: int) -> bytes:
        """Bytes of ``count`` words from ``word``, joined by one space."""
        return self.data[self.starts[word] : self.ends[word + count - 1]]


def hash_slices(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64-bit hash of each slice: eight bytes a step over the slices that are not used up; xxHash for long ones."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    padded = np.concatenate([buf, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded.data, strides=(1,))
    h = mix(lens.astype(np.uint64) * _K1 ^ (eight[starts] & _MASKS[np.minimum(lens, 8)]))
    at = 8
    live = np.flatnonzero(lens > at)
    while len(live) and at < 64:
        left = np.minimum(lens[live] - at, 8)
        h[live] = mix((h[live] ^ (eight[starts[live] + at] & _MASKS[left])) * _K1)
        at += 8
        live = live[lens[live] > at]
    if len(live):
        view = memoryview(np.ascontiguousarray(buf))
        h[live] = [xxhash.xxh64_intdigest(view[starts[i] : starts[i] + lens[i]]) for i in live.tolist()]
    h ^= h >> np.uint64(32)
    return h * _K1


def hash_word(word: bytes) -> int:
    return int(hash_slices(np.frombuffer(word, dtype=np.uint8), np.array([0]), np.array([len(word)]))[0])


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n word hashes, by doubling; shorter input gives none."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    out, have = None, 0
    power, width, bit = h, 1, n
    while bit:
        if bit & 1:
            if out is None:
                out, have = power, width
            else:
                k = np.uint64(pow(WINDOW_K, width, 1 << 64))
                size = len(h) - (have + width) + 1
                out = out[:size] * k + power[have : have + size]
                have += width
        bit >>= 1
        if bit:
            k = np.uint64(pow(WINDOW_K, width, 1 << 64))
            size = len(h) - 2 * width + 1
            power = power[:size] * k + power[width : width + size]
            width *= 2
    return mix(out ^ (out >> np.uint64(31)))


def covered(starts: np.ndarray, n: np.ndarray | int, total: int) -> np.ndarray:
    """Boolean per word: inside one of the runs [start, start+n)."""
    d = np.zeros(total + 1, dtype=np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + n, -1)
    return np.cumsum(d[:-1]) > 0


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values within each [first[d], first[d+1])."""
    c = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return c[first[1:]] - c[first[:-1]]
