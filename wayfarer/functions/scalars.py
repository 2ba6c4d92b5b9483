"""Scalar expressions: angles, read-back matching, parsing and reproducible uniforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap(angle: Column) -> Column:
    return F.atan2(F.sin(angle), F.cos(angle))


def yaw(x: Column, y: Column, z: Column, w: Column) -> Column:
    return F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def quaternion(angle: Column) -> Column:
    """Of a turn about the vertical axis."""
    return F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.sin(angle / 2).alias("z"), F.cos(angle / 2).alias("w"))


def truthy(x: Column) -> Column:
    return F.lower(F.trim(x)).isin("1", "true", "yes", "on")


def word(*parts: Column) -> Column:
    """A number below 2^32 of its arguments alone, so that it doesn't depend on the layout of partitions."""
    return F.conv(F.substr(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), F.lit(1), F.lit(8)), 16, 10).cast("long")


def uniform(*parts: Column) -> Column:
    """U[0, 1) of its arguments alone."""
    return word(*parts).cast("double") / 4294967296.0


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is computed once however often f has it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def permuted(x: Column, n: Column, *key: Column, tries: int = 40) -> Column:
    """The place of x in a permutation of 0 to n - 1 that key draws, by arithmetic on x alone.

    A Feistel network of four rounds on pairs below a and b, a b being n and at most a more; what it takes beyond n - 1
    goes through it again (fewer than one of a in each try), and an error says if all tries did.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def turned(x: Column) -> Column:
        def last(l: Column, r: Column, k: int) -> Column:  # noqa: E741
            if k == 4:
                return l + a * r
            own, other, size = (l, r, a) if k % 2 == 0 else (r, l, b)
            return bound((own + word(*key, F.lit(k), other)) % size, lambda new: last(new, r, k + 1) if k % 2 == 0 else last(l, new, k + 1))

        return last(x % a, F.floor(x / a).cast("long"), 0)

    found = F.aggregate(F.sequence(F.lit(1), F.lit(tries)), turned(x.cast("long")), lambda y, _: F.when(y < n, y).otherwise(turned(y)))
    return bound(found, lambda y: F.when(y < n, y).otherwise(F.raise_error(F.lit("no place in the permutation")).cast("long")))


def read_back(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, r"value is:(.*)", 1))


def matches(kind: Column, target: Column, got: Column) -> Column:
    """If a value read back equals its target; whatever can't be parsed doesn't."""
    t, g = target.try_cast("double"), got.try_cast("double")
    return F.coalesce(
        F.when(kind == "continuous", F.abs(g - t) <= F.greatest(F.lit(1e-3), 0.01 * F.abs(t)))
        .when(kind == "discrete", g.cast("long") == t.cast("long"))
        .when(kind == "boolean", F.lower(F.trim(got)) == F.lower(F.trim(target)))
        .when(kind == "footprint", _polygons(target, got))
        .otherwise(F.trim(got) == F.trim(target)),
        F.lit(False),
    )


def _polygons(a: Column, b: Column) -> Column:
    x, y = (F.from_json(c, "array<array<double>>") for c in (a, b))
    near = F.forall(F.zip_with(x, y, lambda p, q: (F.abs(p[0] - q[0]) <= 1e-3) & (F.abs(p[1] - q[1]) <= 1e-3)), lambda ok: ok)
    return (F.size(x) == F.size(y)) & near
