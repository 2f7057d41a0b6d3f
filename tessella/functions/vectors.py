"""Vector scalars as Column expressions: int8 quantisation, dot products, cosine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import half_up


def scale_of(vector: Column) -> Column:
    """max|x| / 127, or 1 for a zero vector."""
    top = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    return F.when(top > 0, top / 127).otherwise(1.0)


def quantize(vector: Column) -> Column:
    """struct<q array<tinyint>, scale float>: values are rounded by the double scale."""
    bound = lambda s: F.struct(F.transform(vector, lambda x: half_up(x / s).cast("tinyint")).alias("q"), s.cast("float").alias("scale"))
    return F.transform(F.array(scale_of(vector)), bound)[0]


def dequantize(q: Column, scale: Column) -> Column:
    return F.transform(q, lambda x: (x * scale).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.when(norm == 0, 1.0).otherwise(norm)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
