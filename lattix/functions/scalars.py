"""Parsing, placement, hashing and scoring of single values. All built-in expressions, inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CLASSES, CODES, VERTEX_CODES

# Multipliers and modulus of the integer hash that gives the same coins in any engine.
MODULUS = 2_147_483_647
_A, _B, _C, _D, _E = 69_621, 48_271, 40_692, 16_807, 48_271
DEFAULT_SEED = 9801


#: Delimiters that are split at without a regular expression.
_PLAIN = frozenset(",;: \t")


def tokens(line: Column, n: int, delimiter: str = ",") -> list[Column]:
    """The first n fields of a line; fields that it doesn't have are null."""
    literal = delimiter if delimiter in _PLAIN else f"\\Q{delimiter}\\E"
    parts = F.split(line, literal, -1)
    return [F.get(parts, F.lit(k)) for k in range(n)]


def whole_number(c: Column) -> Column:
    """Digits as a number; anything else is 0."""
    return F.coalesce(optional_number(c), F.lit(0).cast("bigint"))


def optional_number(c: Column) -> Column:
    """Digits as a number; anything else is null. Only what isn't written as numbers are goes through the regular expression."""
    n = c.try_cast("bigint")
    return F.when((n >= 0) & ((n.cast("string") == c) | c.rlike("^[0-9]+$")), n)


def fixed_point(c: Column) -> Column:
    """Sign and digits with an optional point; no exponent. Anything else is null."""
    return F.when(F.trim(c).rlike(r"^[-+]?[0-9]*\.?[0-9]+$|^[-+]?[0-9]+\.$"), F.trim(c)).try_cast("double")


def leading_number(c: Column) -> Column:
    """The longest numeric prefix, so that 4/1/2013 is 4; none is 0."""
    return F.coalesce(F.regexp_extract(c, r"^-?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?", 0).try_cast("double"), F.lit(0.0))


def us_date(c: Column) -> Column:
    return F.to_date(F.try_to_timestamp(c, F.lit("M/d/yyyy")))


def owner(id_: Column, n: int) -> Column:
    """Virtual host of an id."""
    return F.pmod(id_, F.lit(n)).cast("int")


def namespaced(kind: Column | str, id_: Column) -> Column:
    """An id that can't meet one of another kind."""
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), id_.cast("bigint").alias("id"))


def coin(s: Column, a: Column, b: Column, seed: int = DEFAULT_SEED) -> Column:
    """Integer hash in [0, MODULUS) of three numbers under about 4e9; no product leaves 63 bits."""
    s, a, b = (x.cast("bigint") for x in (s, a, b))
    m = F.lit(MODULUS).cast("bigint")
    first = (s * _A + a * _B) % m
    return ((first * _C + b * _D + seed) % m) * _E % m


def code_of(kind: Column, codes: dict[str, int] = CODES) -> Column:
    """Code of a type name; null if there is none."""
    known = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))
    return F.element_at(known, kind).cast("int")


def class_of(kind: Column) -> Column:
    return code_of(kind, CLASSES)


def vertex_id_column(kind: Column, fields: list[Column]) -> Column:
    """The field that holds a vertex's id, by its type."""
    return F.coalesce(*(F.when(kind == k, fields[v]) for k, v in VERTEX_CODES.items()))


# ---- vectors as arrays


def l1_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))


def translation_residual(head: Column, relation: Column, tail: Column) -> Column:
    """head + relation - tail, by element."""
    moved = F.zip_with(head, relation, lambda h, r: h.cast("double") + r.cast("double"))
    return F.zip_with(moved, tail, lambda x, t: x - t.cast("double"))


def translation_score(head: Column, relation: Column, tail: Column, gamma: float = 1.0) -> Column:
    return F.lit(gamma) - l1_norm(translation_residual(head, relation, tail))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def softmax(v: Column) -> Column:
    """exp(x - max) over its sum."""
    top = F.array_max(v)
    powers = F.transform(v, lambda x: F.exp(x.cast("double") - top.cast("double")))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda s, x: s + x))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def leaky_relu(x: Column, slope: float = 0.01) -> Column:
    return F.when(x > 0, x).otherwise(x * slope)
