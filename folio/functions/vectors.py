"""Vector functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantize(v: Column) -> Column:
    """int8 codes of components in [-1, 1]: times 127, halves to even, clamped."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.bround(x.cast("double") * 127, 0))).cast("tinyint"))


def dequantize(q: Column) -> Column:
    return F.transform(q, lambda x: x.cast("double") / 127)


def dot(a: Column, b: Column) -> Column:
    """Over as many components as both have."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def truncate_and_normalize(v: Column, dim: int) -> Column:
    head = F.transform(F.slice(v, 1, dim), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(head, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(head, lambda x: x / F.greatest(norm, F.lit(1e-12)))


def pack(q: Column) -> Column:
    """base64 of an array of int8 codes, one signed byte each."""
    packed = F.unhex(F.array_join(F.transform(q, lambda x: F.lpad(F.hex(x.cast("int").bitwiseAND(255)), 2, "0")), ""))
    return F.replace(F.base64(packed), F.lit("\r\n"), F.lit(""))  # Spark breaks lines


def unpack(text: Column) -> Column:
    """The int8 codes of :func:`pack`."""
    digits = F.hex(F.unbase64(text))
    value = lambda i: F.conv(F.substring(digits, i * 2 + 1, 2), 16, 10).cast("int")
    codes = F.transform(F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1), lambda i: F.when(value(i) > 127, value(i) - 256).otherwise(value(i)).cast("tinyint"))
    return F.when(F.length(digits) > 0, codes).otherwise(F.array().cast("array<tinyint>"))
