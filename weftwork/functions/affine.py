"""Homogeneous 3x3 transforms (x, y, 1) as arrays in row order; products and inverses are expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)


def identity() -> Column:
    return F.array(*(F.lit(x) for x in IDENTITY))


def rotation(degrees: Column, tx: Column, ty: Column) -> Column:
    c, s, one, zero = F.cos(F.radians(degrees)), F.sin(F.radians(degrees)), F.lit(1.0), F.lit(0.0)
    return F.array(c, -s, tx, s, c, ty, zero, zero, one)


def about(degrees: Column, cx: Column, cy: Column) -> Column:
    """A rotation around a point."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return rotation(degrees, cx - c * cx + s * cy, cy - s * cx - c * cy)


def product(a: Column, b: Column) -> Column:
    return F.array(*(sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)))


def determinant(m: Column) -> Column:
    return m[0] * m[4] - m[1] * m[3]


def inverse(m: Column) -> Column:
    d = determinant(m)
    a, b, c, e = m[4] / d, -m[1] / d, -m[3] / d, m[0] / d
    return F.array(a, b, -(a * m[2] + b * m[5]), c, e, -(c * m[2] + e * m[5]), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def difference(a: Column, b: Column) -> Column:
    """What leads from a to b: inverse(a) times b."""
    return product(inverse(a), b)


def applied(m: Column, x: Column, y: Column) -> Column:
    return F.array(m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5])


def scale(m: Column) -> Column:
    """Mean length of the columns."""
    return (F.sqrt(m[0] * m[0] + m[3] * m[3]) + F.sqrt(m[1] * m[1] + m[4] * m[4])) / 2


def angle(m: Column) -> Column:
    return F.degrees(F.atan2(m[3], m[0]))


def wrapped(degrees: Column) -> Column:
    """An angle from -180 to 180, both included."""
    w = F.pmod(degrees + 180, F.lit(360.0)) - 180
    return F.when((w == -180) & (degrees > 0), F.lit(180.0)).otherwise(w)


def center(m: Column) -> Column:
    """The point that a rotation leaves in place."""
    a, b, c, e = 1 - m[0], -m[1], -m[3], 1 - m[4]
    d = a * e - b * c
    return F.array((e * m[2] - b * m[5]) / d, (a * m[5] - c * m[2]) / d)


def valid(m: Column, max_scale: float = 1.25, max_rotation: float | None = None) -> Column:
    """Finite, invertible, of a mean scale within limits, and turned no further than allowed."""
    finite = F.forall(m, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ok = finite & (determinant(m) != 0) & scale(m).between(1 / max_scale, max_scale)
    if max_rotation is not None:
        ok &= F.abs(wrapped(angle(m))) <= max_rotation
    return F.coalesce(ok, F.lit(False))


def folded(matrices: Column) -> Column:
    """The product T_n ... T_1 of an ordered array of transforms."""
    return F.aggregate(matrices, identity(), lambda acc, m: product(m, acc))


def centered(degrees: Column, scale_: Column, cx: Column, cy: Column, tx: Column, ty: Column) -> Column:
    """A turn (positive from y to x, as image rows go down) and scale around a point, then a shift."""
    c, s, zero = scale_ * F.cos(F.radians(degrees)), scale_ * F.sin(F.radians(degrees)), F.lit(0.0)
    return F.array(c, s, (1 - c) * cx - s * cy + tx, -s, c, s * cx + (1 - c) * cy + ty, zero, zero, F.lit(1.0))


def turned(degrees: Column, center_: Column, shift: Column, size: int = 3) -> Column:
    """A turn by minus an angle in the plane of x and y around a point (x, y and more), then a shift, as a square matrix of a size."""
    c, s = F.cos(F.radians(F.coalesce(degrees, F.lit(0.0)))), F.sin(F.radians(F.coalesce(degrees, F.lit(0.0))))
    cx, cy = center_[0], center_[1]
    part = lambda i: F.coalesce(F.get(shift, F.lit(i)), F.lit(0.0))
    tx, ty = cx - (c * cx + s * cy) + part(0), cy - (c * cy - s * cx) + part(1)
    flat = F.array(c, s, tx, -s, c, ty, F.lit(0.0), F.lit(0.0), F.lit(1.0))
    if size == 3:
        return flat
    lifted = in_3d(flat)
    return F.array(*(lifted[i] if i != 11 else lifted[i] + part(2) for i in range(16)))


def in_3d(m: Column) -> Column:
    """A 3x3 transform of x and y as a 4x4 one of x, y and z that leaves z as it is."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(m[0], m[1], zero, m[2], m[3], m[4], zero, m[5], zero, zero, one, zero, zero, zero, zero, one)


def for_dims(m: Column, have: str, want: str) -> Column:
    """The part of a square transform over some dimensions that concerns others; one that it lacks stays as it is."""
    n = len(have) + 1
    at = {d: i for i, d in enumerate(have)} | {"1": n - 1}
    order = [*want, "1"]
    return F.array(*(m[at[r] * n + at[c]] if r in at and c in at else F.lit(float(r == c)) for r in order for c in order))


def product_n(a: Column, b: Column, n: int) -> Column:
    """The product of two n x n matrices."""
    return F.array(*(sum((a[n * i + k] * b[n * k + j] for k in range(1, n)), a[n * i] * b[j]) for i in range(n) for j in range(n)))


def applied_n(m: Column, point: Column, n: int) -> Column:
    """An n x n transform of a point with n - 1 values."""
    return F.array(*(sum((m[n * i + k] * point[k] for k in range(n - 1)), m[n * i + n - 1]) for i in range(n - 1)))


def applied_map(m: Column, point: Column) -> Column:
    """A 3x3 transform of a point as a map of x and y; other dimensions stay."""
    new = applied(m, F.element_at(point, "x"), F.element_at(point, "y"))
    return F.map_concat(F.map_filter(point, lambda d, _: ~d.isin("x", "y")), F.create_map(F.lit("x"), new[0], F.lit("y"), new[1]))


def properties(m: Column) -> Column:
    """(x, y, rotation, scale) of a transform."""
    return F.struct(m[2].alias("x"), m[5].alias("y"), angle(m).alias("rotation"), scale(m).alias("scale"))


def mapping(origin: Column, rotation_: Column, m: Column, stored: Column | None = None) -> Column:
    """(x, y, rotation): an origin moved by a transform's shift, and rotations added up, a stored transform's too."""
    turn = F.coalesce(rotation_, F.lit(0.0)) + F.coalesce(angle(m), F.lit(0.0))
    if stored is not None:
        turn = turn + F.coalesce(angle(stored), F.lit(0.0))
    return F.struct((origin["x"] + F.coalesce(m[2], F.lit(0.0))).alias("x"), (origin["y"] + F.coalesce(m[5], F.lit(0.0))).alias("y"), turn.alias("rotation"))


def final_position(x: Column, y: Column, transforms: Column, width: Column | float = 0.0, height: Column | float = 0.0) -> Column:
    """Where a position is after all transforms, in their order; with a size, the center of what starts there."""
    moved = F.transform(F.array(folded(transforms)), lambda m: applied(m, x, y))[0]
    return F.array(moved[0] + width / 2, moved[1] + height / 2)


def from_pixels(m: Column, fixed: Column, moving: Column) -> Column:
    """A transform of pixel places as one of positions; ``fixed`` and ``moving`` have px, py, x and y of both grids."""
    zero = F.lit(0.0)
    to = F.array(fixed["px"], zero, fixed["x"], zero, fixed["py"], fixed["y"], zero, zero, F.lit(1.0))
    back = F.array(1 / moving["px"], zero, -moving["x"] / moving["px"], zero, 1 / moving["py"], -moving["y"] / moving["py"], zero, zero, F.lit(1.0))
    return F.transform(F.array(product(to, m)), lambda p: product(p, back))[0]
