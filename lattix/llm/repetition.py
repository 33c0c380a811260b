"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths, in numpy.

For every whole text: characters, symbols, repeated lines, words in repeated 8-word windows, and for each length of
``NGRAMS`` the share of the characters of words that stand inside an n-gram found twice or more in that text. A text is
kept when none of the limits is passed. Rows are scanned once, without a shuffle.

Defined cases. Null or empty text: no words, all counts 0, not kept (fewer than ``min_words``). Repeated rows each get
their row. Very long texts are scanned whole, one at a time. Ties: a share equal to its limit is within it. Empty table: no
rows. Lines without a word are not counted as repeated lines. Hashes only select: equal windows are confirmed on their bytes.
Other columns stay as they are; one called like a result's column raises ValueError, and ``prefix`` renames those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import plus
from .words import BLANK_WORD, Words, covered, pieces, sums, window_hashes

#: n-gram length: most per cent of word characters inside n-grams of that length that stand twice or more.
NGRAMS = {5: 30, 6: 28, 7: 26, 8: 24, 9: 22, 10: 20}
#: most per cent of word characters in lines that repeat an earlier line.
LINE_PERCENT = 30
#: most symbols per 100 words.
SYMBOL_PERCENT = 10
REPEAT_WINDOW = 8
REPEAT_PERCENT = 30
MIN_WORDS = 20
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def repeated_windows(w: Words, h: np.ndarray, n: int) -> np.ndarray:
    """First words of the n-word windows that stand twice or more in their text."""
    if w.n < n:
        return np.zeros(0, dtype=np.int64)
    text_of = w.text_of_word()
    inside = np.flatnonzero(text_of[: w.n - n + 1] == text_of[n - 1 :])
    key = window_hashes(h, n)[inside] + text_of[inside].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    order = np.argsort(key, kind="stable")
    key, at = key[order], inside[order]
    same = np.concatenate([[False], key[1:] == key[:-1], [False]])
    dup = np.flatnonzero(same[1:] | same[:-1])
    if not len(dup):
        return at[:0]
    head = np.flatnonzero(~same[:-1][dup])  # the first of each run of equal keys
    run = np.cumsum(~same[:-1][dup]) - 1
    first = at[dup[head]][run]
    here = at[dup]
    ok = np.fromiter((w.slice(a, n) == w.slice(b, n) for a, b in zip(first.tolist(), here.tolist())), dtype=bool, count=len(here))
    ok &= text_of[first] == text_of[here]
    if ok.all():
        return here
    out = []  # different windows of one hash: compare each run exactly
    for r in np.split(here, np.flatnonzero(np.diff(run)) + 1):
        seen: dict[tuple[int, bytes], list[int]] = {}
        for a in r.tolist():
            seen.setdefault((int(text_of[a]), w.slice(a, n)), []).append(a)
        out += [a for x in seen.values() if len(x) > 1 for a in x]
    return np.array(out, dtype=np.int64)


def measure(texts: list[bytes], ngrams: tuple[int, ...]) -> dict[str, np.ndarray]:
    w = Words(texts, BLANK_WORD, lower=False)
    h = w.hashes()
    lead = (w.norm & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(lead)])
    chars = chars[w.ends] - chars[w.starts]
    out = {"n_words": w.per_text, "word_chars": sums(chars, w.first), "n_symbols": sums(_SYMBOL[w.raw], w.text_at)}
    lines, line_chars = [], []
    for t in texts:
        seen, again, size = set(), 0, 0
        if b"\n" in t:
            for line in t.split(b"\n"):
                if line in seen:
                    again += 1
                    size += sum(len(x.decode()) for x in line.split())
                elif line and not line.isspace():
                    seen.add(line)
        lines.append(again)
        line_chars.append(size)
    out["n_dup_lines"], out["dup_line_chars"] = np.array(lines), np.array(line_chars)
    for n in dict.fromkeys((REPEAT_WINDOW, *ngrams)):
        mask = covered(repeated_windows(w, h, n), n, w.n)
        if n == REPEAT_WINDOW:
            out["n_repeat_words"] = sums(mask, w.first)
        if n in ngrams:
            out[f"dup_{n}gram_chars"] = sums(chars * mask, w.first)
    return out


def repetition_coverage(docs: DataFrame, *, text: str = "text", ngrams: dict[int, int] = NGRAMS, prefix: str = "") -> DataFrame:
    """The documents with, by row, the measures, ``base_failed`` and ``kept``."""
    lengths = tuple(ngrams)
    names = [f"{prefix}{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "dup_line_chars", "n_repeat_words", *(f"dup_{n}gram_chars" for n in lengths))]
    if clash := {c.lower() for c in docs.columns} & {*names, f"{prefix}base_failed", f"{prefix}kept"}:
        raise ValueError(f"columns {sorted(clash)} are there already; give a prefix")
    strip = len(prefix)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, text):
                found = measure(texts, lengths)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(found[c[strip:]], pa.int64()) for c in names)], names=[*part.schema.names, *names])

    out = docs.mapInArrow(scan, plus(docs.schema, *((c, T.LongType()) for c in names)))
    col = lambda c: F.col(f"{prefix}{c}")
    base = (col("n_words") < MIN_WORDS) | (100 * col("n_repeat_words") > REPEAT_PERCENT * col("n_words"))
    over = (100 * col("n_symbols") > SYMBOL_PERCENT * col("n_words")) | (100 * col("dup_line_chars") > LINE_PERCENT * col("word_chars"))
    for n, percent in ngrams.items():
        over |= 100 * col(f"dup_{n}gram_chars") > percent * col("word_chars")
    return out.withColumns({f"{prefix}base_failed": base, f"{prefix}kept": ~base & ~over})
