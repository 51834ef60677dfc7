"""Dense vectors as array columns: higher-order functions in the JVM, summed in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row; a column used inside a lambda is evaluated anew for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scale(a: Column, by: Column) -> Column:
    return let(by, lambda f: F.transform(a, lambda x: x.cast("double") * f))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def unit(a: Column) -> Column:
    """The vector over its length; a null vector where the length is 0."""
    return let(a, lambda v: let(norm(v), lambda n: F.when(n > 1e-12, F.transform(v, lambda x: x.cast("double") / n))))


def cosine(a: Column, b: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b) / (norm(a) * norm(b))))


def fused(base: Column, other: Column, alpha: float) -> Column:
    """Unit (1 - alpha) * base + alpha * other; the base as it is where there is no other."""
    mixed = F.zip_with(base, other, lambda x, y: (1 - alpha) * x.cast("double") + alpha * y.cast("double"))
    return F.when(other.isNull(), F.transform(base, lambda x: x.cast("double"))).otherwise(unit(mixed))


def recovered(base: Column, mixed: Column, alpha: float) -> Column:
    """The unit vector that fused() mixed into a unit base."""

    def size(c: Column) -> Column:
        s2 = F.greatest(F.lit(0.0), 1 - c * c)
        return (1 - alpha) * c + F.sqrt(F.greatest(F.lit(0.0), alpha * alpha - (1 - alpha) ** 2 * s2))

    back = lambda n: F.zip_with(mixed, base, lambda m, b: (m.cast("double") * n - (1 - alpha) * b.cast("double")) / alpha)
    return unit(let(let(dot(base, mixed), size), back))


def projection_residual(x: Column, center: Column) -> Column:
    """Unit part of x that is orthogonal to the centre."""
    less = lambda share: F.zip_with(x, center, lambda a, b: a.cast("double") - share * b.cast("double"))
    return unit(let(dot(x, center) / dot(center, center), less))


def centred(x: Column, mean: Column) -> Column:
    """Unit x less mean; null where nothing is left."""
    return unit(subtract(x, mean))


def rotated(x: Column, angles: Column, segment: int) -> Column:
    """Even and odd neighbours of each segment turned by that segment's angle."""

    def all_of(v: Column) -> Column:
        def turn(value, i):
            angle = F.element_at(angles, (F.floor(i / segment) + 1).cast("int"))
            other = F.element_at(v, (F.when(i % 2 == 0, i + 2).otherwise(i)).cast("int")).cast("double")
            return F.when(i % 2 == 0, value * F.cos(angle) - other * F.sin(angle)).otherwise(other * F.sin(angle) + value * F.cos(angle))

        return F.transform(v, lambda value, i: turn(value.cast("double"), i))

    return let(x, all_of)


def blocks(parts: list[tuple[Column, float]]) -> Column:
    """Vectors side by side, each times its weight, over the length of the weights."""
    total = sum(w * w for _, w in parts) ** 0.5
    weighed = lambda w: lambda x: x.cast("double") * (w / total)
    return F.concat(*[F.transform(v, weighed(w)) for v, w in parts])


def one_hot(index: Column, size: int) -> Column:
    """1 at a 0-based index, else 0; all 0 for an index outside."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == index, 1.0).otherwise(0.0))
