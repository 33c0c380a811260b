"""Plain Python for what the operators do, and frames of awkward rows."""

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def lower(text):
    return (text or "").translate(LOWER)


def frame(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)] if not isinstance(texts, dict) else list(texts.items()), schema)


def documents(spark, texts):
    """With the columns of the table."""
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


AWKWARD = [None, "", " \t\n ", "one", "ünïcode ŵörds  here", "a " * 40, "word " * 60_000, "x" * 50_000, "same text of some words here", "same text of some words here"]
