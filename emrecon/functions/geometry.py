"""Scanner and voxel geometry as column expressions.

Vectors are structs of x, y, z. Nulls give nulls throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def vec(x, y, z, kind: str = "double") -> Column:
    return F.struct(*(_c(v).cast(kind).alias(n) for v, n in ((x, "x"), (y, "y"), (z, "z"))))


def voxel_of(number, nx, ny) -> Column:
    """Position in the grid of a voxel number; x runs fastest."""
    n, nx, ny = _c(number).cast("long"), _c(nx).cast("long"), _c(ny).cast("long")
    return F.struct((n % nx).alias("x"), F.call_function("div", n % (nx * ny), nx).alias("y"), F.call_function("div", n, nx * ny).alias("z"))


def voxel_number(x, y, z, nx, ny) -> Column:
    x, y, z, nx, ny = (_c(v).cast("long") for v in (x, y, z, nx, ny))
    return x + y * nx + z * nx * ny


def crystals(blocksize, blocks, layers, rings) -> Column:
    return _c(blocksize).cast("long") * _c(blocks) * _c(layers) * _c(rings)


def lines_of_response(n_crystals) -> Column:
    return _c(n_crystals).cast("long") * _c(n_crystals).cast("long")


def voxels(nx, ny, nz) -> Column:
    return _c(nx).cast("long") * _c(ny) * _c(nz)


def with_gaps(gaps) -> Column:
    """Blocks or rings that an array of the gaps between them stands for."""
    return F.size(_c(gaps)) + 1


def _by(f, *vectors) -> Column:
    vs = [_c(v) for v in vectors]
    return F.struct(*(f(*(v[n] for v in vs)).alias(n) for n in "xyz"))


def add(a, b) -> Column:
    return _by(lambda p, q: p + q, a, b)


def subtract(a, b) -> Column:
    return _by(lambda p, q: p - q, a, b)


def negate(a) -> Column:
    return _by(lambda p: -p, a)


def scale(a, s) -> Column:
    return _by(lambda p: p * _c(s), a)


def dot(a, b) -> Column:
    a, b = _c(a), _c(b)
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def squared_norm(a) -> Column:
    return dot(a, a)


def norm(a) -> Column:
    return F.sqrt(squared_norm(a))


def unit(a) -> Column:
    """Of length 1; a zero vector stays zero."""
    length = norm(a)
    return _by(lambda p: F.when(length == 0, F.lit(0.0)).otherwise(p / F.when(length != 0, length)), a)


def cross(a, b) -> Column:
    a, b = _c(a), _c(b)
    turn = lambda i, j: a[i] * b[j] - a[j] * b[i]
    return F.struct(turn("y", "z").alias("x"), turn("z", "x").alias("y"), turn("x", "y").alias("z"))


def from_sphere(phi, theta, r=1.0) -> Column:
    """Cartesian from azimuth and polar angle."""
    phi, theta, r = _c(phi), _c(theta), _c(r)
    return F.struct((r * F.sin(theta) * F.cos(phi)).alias("x"), (r * F.sin(theta) * F.sin(phi)).alias("y"), (r * F.cos(theta)).alias("z"))


def as_text(*parts) -> Column:
    """``(a, b, c)``."""
    return F.concat(F.lit("("), F.concat_ws(", ", *(_c(p).cast("string") for p in parts)), F.lit(")"))
