"""Filters as column expressions, over arrays that stay in Spark.

A chunk's cells are ordered by their position in it, so the filters that look back are windows
over a chunk; no window is wider than one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import quantize_bits


def _in_chunk(chunk: str, position: str) -> Window:
    return Window.partitionBy(chunk).orderBy(position)


def delta_encode(df: DataFrame, chunk: str = "chunk", position: str = "position") -> DataFrame:
    """value less the one before it in its chunk; the first as it is."""
    before = F.lag("value").over(_in_chunk(chunk, position))
    return df.withColumn("value", F.coalesce(F.col("value") - before, F.col("value")))


def delta_decode(df: DataFrame, chunk: str = "chunk", position: str = "position") -> DataFrame:
    frame = _in_chunk(chunk, position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("value", F.sum("value").over(frame))


def scale_offset_encode(x: Column, offset: float, scale: float, kind: str = "int") -> Column:
    y = (x.cast("double") - F.lit(float(offset))) * F.lit(float(scale))
    return F.rint(y).cast(kind) if kind in ("tinyint", "smallint", "int", "bigint") else y.cast(kind)


def scale_offset_decode(x: Column, offset: float, scale: float) -> Column:
    return x.cast("double") / F.lit(float(scale)) + F.lit(float(offset))


def quantize(x: Column, digits: int) -> Column:
    scale = 2.0 ** quantize_bits(digits)
    return F.rint(x.cast("double") * F.lit(scale)) / F.lit(scale)


def fixed_string(x: Column, size: int) -> Column:
    """A text as a field of fixed size holds it: an error if it is longer, NULs cut off."""
    clean = F.rtrim(F.substring_index(x, "\0", 1), F.lit("\0"))
    return F.when(F.length(x) > size, F.raise_error(F.lit("a text is longer than its field"))).otherwise(clean)
