"""Vector functions: Columns of arrays, in double precision, for plans that SQL checks; bulk search uses ``operators.knn``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from skerry.errors import require

#: Fixed value: a cosine vector of a shorter norm is refused.
LEAST_NORM = 1e-30


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row; a lambda over an array would compute it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def is_valid(v: Column, dim: int) -> Column:
    """Of the dimension, all components finite, and not without length."""
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dim) & finite & (norm(v) > LEAST_NORM), F.lit(False))


def normalized(v: Column) -> Column:
    """Of length 1; one without length stays as it is."""
    return let(v, lambda a: let(let(norm(a), lambda n: F.when(n > 0, n).otherwise(F.lit(1.0))), lambda n: F.transform(a, lambda x: x / n)))


def cosine_distance(a: Column, b: Column) -> Column:
    """Of vectors of length 1."""
    return 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def quantized(v: Column) -> Column:
    """Affine 8-bit codes: a struct ``q, scale, offset, sum_q, sum_q2``."""

    def codes(a: Column, b: Column) -> Column:
        return F.transform(a, lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x - b["low"]) * 255 / b["span"] + 0.5).cast("int"))))

    def bounds(a: Column) -> Column:
        low, width = F.array_min(a), F.array_max(a) - F.array_min(a)
        return F.struct(low.alias("low"), F.when(width < 1e-30, F.lit(1.0)).otherwise(width).alias("span"))

    def whole(q: Column, b: Column) -> Column:
        sum_q = F.aggregate(q, F.lit(0).cast("long"), lambda s, x: s + x)
        sum_q2 = F.aggregate(q, F.lit(0).cast("long"), lambda s, x: s + x * x)
        return F.struct(q.alias("q"), (b["span"] / 255).alias("scale"), b["low"].alias("offset"), sum_q.alias("sum_q"), sum_q2.alias("sum_q2"))

    return let(v, lambda a: let(bounds(a), lambda b: let(codes(a, b), lambda q: whole(q, b))))


def dequantized(q: Column, scale: Column, offset: Column) -> Column:
    return F.transform(q, lambda x: offset + scale * x)


def asymmetric_cosine(y: Column, q: Column, scale: Column, offset: Column) -> Column:
    """Distance of a query of length 1 to a coded row, without decoding it."""
    near = offset * total(y) + scale * dot(y, q.cast("array<double>"))
    return 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), near))


def asymmetric_l2(y: Column, q: Column, scale: Column, offset: Column) -> Column:
    return l2_distance(y, dequantized(q.cast("array<double>"), scale, offset))


def symmetric_dot(a: Column, b: Column, dim: int) -> Column:
    """Dot product of two coded rows (structs of :func:`quantized`) from the sums of their codes."""
    codes = dot(a["q"].cast("array<double>"), b["q"].cast("array<double>"))
    return (
        F.lit(float(dim)) * a["offset"] * b["offset"] + a["offset"] * b["scale"] * b["sum_q"] + b["offset"] * a["scale"] * a["sum_q"] + a["scale"] * b["scale"] * codes
    )


def coded_square(a: Column, dim: int) -> Column:
    """Squared length of a coded row, from the sums of its codes."""
    return F.lit(float(dim)) * a["offset"] * a["offset"] + F.lit(2.0) * a["offset"] * a["scale"] * a["sum_q"] + a["scale"] * a["scale"] * a["sum_q2"]


def symmetric_cosine(a: Column, b: Column, dim: int) -> Column:
    """Distance of two coded rows of length 1."""
    return 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), symmetric_dot(a, b, dim)))


def symmetric_l2(a: Column, b: Column, dim: int) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), coded_square(a, dim) + coded_square(b, dim) - 2 * symmetric_dot(a, b, dim)))


def pooled(v: Column, pool: int) -> Column:
    """Means of ``pool`` neighbouring components."""
    require(pool > 0, "pool must be positive")

    def means(a: Column) -> Column:
        places = F.sequence(F.lit(0), (F.size(a) / pool).cast("int") - 1)
        return F.transform(places, lambda i: total(F.slice(a, i * pool + 1, F.lit(pool))) / pool)

    return let(v, means)


def sketched(q: Column, pool: int, bits: int = 4) -> Column:
    """The sketch of 8-bit codes: rounded means of neighbours, in 4 or 8 bits."""
    mean = F.transform(pooled(q.cast("array<double>"), pool), lambda x: F.floor(x + 0.5).cast("int"))
    if bits == 8:
        return mean
    require(bits == 4, "a sketch has 4 or 8 bits")
    return F.transform(mean, lambda x: F.least(F.lit(15), F.floor(x / 17 + 0.5).cast("int")))


def sketch_values(sketch: Column, bits: int = 4) -> Column:
    return F.transform(sketch.cast("array<double>"), lambda x: x * (17 if bits == 4 else 1))


def sketch_cosine(pooled_query: Column, sketch: Column, scale: Column, offset: Column, pool: int, bits: int = 4) -> Column:
    near = pool * dot(pooled_query, F.transform(sketch_values(sketch, bits), lambda x: offset + scale * x))
    return 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), near))


def hash_embedding(words: Column, dims: int) -> Column:
    """A text's vector without a model: each word adds a weight at a place, both from its SHA-256; length 1."""
    place = lambda w: (F.conv(F.concat(*[F.substring(F.sha2(w, 256), i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("long") % dims).cast("int")
    weight = lambda w: F.conv(F.substring(F.sha2(w, 256), 9, 2), 16, 10).cast("double") / 255 * 2 - 1
    pairs = F.transform(words, lambda w: F.struct(place(w).alias("i"), weight(w).alias("x")))

    def sums(p: Column) -> Column:
        places = F.sequence(F.lit(0), F.lit(dims - 1))
        return F.transform(places, lambda d: F.aggregate(F.filter(p, lambda y: y["i"] == d), F.lit(0.0), lambda a, y: a + y["x"]))

    return let(let(pairs, sums), lambda v: let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x))))
