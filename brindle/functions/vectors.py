"""Vector functions as column expressions, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine clamped to 0..1; 0 if sizes differ or a vector is null, empty or zero."""
    size = norm(a) * norm(b)
    fine = (F.size(a) == F.size(b)) & (size > 0)
    return F.coalesce(F.when(fine, F.least(F.greatest(dot(a, b) / size, F.lit(0.0)), F.lit(1.0))), F.lit(0.0))


def sign_words(a: Column, dim: int) -> Column:
    """Signs of a vector as 32-bit words in longs: bit i of word w is set if element 32 w + i is above 0."""
    words = []
    for w in range(0, dim, 32):
        part = F.slice(a, w + 1, min(32, dim - w))
        words.append(F.aggregate(F.transform(part, lambda x, i: F.when(x > 0, F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x))
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def hash_bucket(token: Column, dim: int) -> Column:
    """First four bytes of sha256, big-endian, modulo dim."""
    return (F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long") % dim).cast("int")


def half(x: Column) -> Column:
    """x rounded to half precision: eleven significant bits, ties to even, in steps of 2^-24 below 2^-14, infinite from 65520 on."""
    power = F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14))
    step = F.pow(F.lit(2.0), power - 10)
    return F.when(x == 0, 0.0).when(F.abs(x) >= 65520, F.signum(x) * float("inf")).otherwise(F.rint(x / step) * step)


def halved(vector: Column) -> Column:
    """Every component of a vector in half precision."""
    return F.transform(vector, lambda x: half(x.cast("double")))
