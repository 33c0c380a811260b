"""Where results are kept between jobs, and small helpers on frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import dropped, shared_dir, stored, table  # noqa: F401


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the frame doesn't have yet, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def plus(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(n, t, True) for n, t in fields)])


def text_bytes(df: DataFrame, column: str) -> int:
    return df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0
