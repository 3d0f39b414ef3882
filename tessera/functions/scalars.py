"""Column functions: hex, Hamming distance, vectors, paths, intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_int(text: Column, first: int = 1) -> Column:
    """The eight hex digits from `first` as a number; longer runs would overflow."""
    return F.conv(F.substring(text, first, 8), 16, 10).cast("bigint")


def hamming_hex(a: Column, b: Column, digits: int = 64) -> Column:
    """Differing bits of two hex strings, by blocks of eight digits."""
    a, b = F.lpad(a, digits, "0"), F.lpad(b, digits, "0")
    return sum((F.bit_count(hex_int(a, i).bitwiseXOR(hex_int(b, i))) for i in range(1, digits, 8)), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def valid_vector(v: Column) -> Column:
    """Not empty, finite, and longer than 1e-12."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & (norm(v) > 1e-12), F.lit(False))


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once for a row however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(v: Column) -> Column:
    """The vector at length one; null if it isn't valid."""
    return F.when(valid_vector(v), let(norm(v), lambda n: F.transform(v, lambda x: x.cast("double") / n)))


def clip(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ancestors(path: Column) -> Column:
    """All directories above a path, the outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))


def wilson(numerator: Column, denominator: Column, population: Column, z: float = 1.96) -> Column:
    """struct(value, low, high, method): a census is exact and has no interval; nothing measured is unavailable."""
    n, p, z2 = denominator.cast("double"), F.try_divide(numerator.cast("double"), denominator.cast("double")), z * z
    centre = (p + F.try_divide(F.lit(z2), 2 * n)) / (1 + F.try_divide(F.lit(z2), n))
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z2), 4 * n * n)) / (1 + F.try_divide(F.lit(z2), n))
    none, census = numerator.isNull() | (denominator == 0), denominator == population
    return F.struct(
        F.when(~none, p).alias("value"),
        F.when(~none & ~census, F.greatest(F.lit(0.0), centre - half)).alias("low"),
        F.when(~none & ~census, F.least(F.lit(1.0), centre + half)).alias("high"),
        F.when(none, "unavailable").when(census, "census-exact").otherwise("Wilson-95%-z=1.96-SRS").alias("method"),
    )


def displayed_rect(box: Column, width: Column, height: Column, content: Column, canvas: Column, rotated: Column) -> Column:
    """struct(left, top, width, height) of a box of the original image inside its displayed rectangle; null where either is empty.

    box, content: struct(left, top, width, height); canvas: struct(left, top); rotated: a quarter turn clockwise.
    """
    finite = [x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) for x in (box[c].cast("double") for c in ("left", "top", "width", "height"))]
    good = finite[0] & finite[1] & finite[2] & finite[3] & (box["width"] > 0) & (box["height"] > 0) & (width > 0) & (height > 0)
    turn = lambda a, b: F.when(rotated, a).otherwise(b)
    sx, sy = content["width"] / turn(height, width), content["height"] / turn(width, height)
    left, top = turn(height - box["top"] - box["height"], box["left"]), turn(box["left"], box["top"])
    wide, high = turn(box["height"], box["width"]), turn(box["width"], box["height"])
    return F.when(good, F.struct((content["left"] - canvas["left"] + left * sx).alias("left"), (content["top"] - canvas["top"] + top * sy).alias("top"), (wide * sx).alias("width"), (high * sy).alias("height")))


def natural_key(text: Column) -> Column:
    """A string whose order is that of the text in lower case with runs of digits (up to 20) compared as numbers."""
    parts = F.regexp_extract_all(F.lower(text), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, 20, "0")).otherwise(x)), "")
