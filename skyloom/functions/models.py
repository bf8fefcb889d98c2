"""Coordinate and magnitude models: their bases, evaluation, and propagation of errors and velocities.

A model is a small frozen object on the driver. It evaluates on Spark columns (staying within generated code) as well as
on numbers and numpy arrays. A two-dimensional polynomial is a mapping from powers (i, j) of x and y to coefficients.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Poly = dict[tuple[int, int], float]


def powers(order: int) -> list[tuple[int, int]]:
    """The powers of x and y up to a total degree, degree by degree: 1, x, y, x^2, x y, y^2, ..."""
    return [(total - j, j) for total in range(order + 1) for j in range(total + 1)]


def _sqrt(v):
    return F.sqrt(v) if isinstance(v, Column) else np.sqrt(v)


def _power(v, n: int):
    out = v
    for _ in range(n - 1):
        out = out * v
    return out


def value(p: Poly, x, y):
    """The polynomial at x and y."""
    out = 0.0
    for (i, j), c in p.items():
        if c == 0.0:
            continue
        term = c if not (i or j) else c * (_power(x, i) * _power(y, j) if i and j else _power(x, i) if i else _power(y, j))
        out = term + out
    return out + 0.0 * x


def slope(p: Poly, axis: int) -> Poly:
    """The partial derivative by x (0) or y (1)."""
    out: Poly = {}
    for (i, j), c in p.items():
        n = (i, j)[axis]
        if n:
            out[(i - 1, j) if axis == 0 else (i, j - 1)] = c * n
    return out


@dataclass(frozen=True)
class Transform:
    """x' = px(x, y), y' = py(x, y), m' = m + mag_offset, with what every model shares."""

    px: tuple[tuple[tuple[int, int], float], ...]
    py: tuple[tuple[tuple[int, int], float], ...]
    mag_offset: float = 0.0
    kind: str = "PolyTransform"

    @property
    def order(self) -> int:
        return max((i + j for (i, j), _ in (*self.px, *self.py)), default=0)

    def position(self, x, y):
        return value(dict(self.px), x, y), value(dict(self.py), x, y)

    def position_error(self, x, y, xe, ye):
        out = []
        for p in (dict(self.px), dict(self.py)):
            a, b = value(slope(p, 0), x, y) * xe, value(slope(p, 1), x, y) * ye
            out.append(_sqrt(a * a + b * b))
        return tuple(out)

    def velocity(self, x, y, vx, vy):
        return tuple(value(slope(p, 0), x, y) * vx + value(slope(p, 1), x, y) * vy for p in (dict(self.px), dict(self.py)))

    def velocity_error(self, x, y, vx, vy, xe, ye, vxe, vye):
        out = []
        for p in (dict(self.px), dict(self.py)):
            gx, gy = slope(p, 0), slope(p, 1)
            by_x = (value(slope(gx, 0), x, y) * vx + value(slope(gx, 1), x, y) * vy) * xe
            by_y = (value(slope(gx, 1), x, y) * vx + value(slope(gy, 1), x, y) * vy) * ye
            by_v = (value(gx, x, y) * vxe, value(gy, x, y) * vye)
            out.append(_sqrt(by_x * by_x + by_y * by_y + by_v[0] * by_v[0] + by_v[1] * by_v[1]))
        return tuple(out)

    def magnitude(self, m):
        return m + self.mag_offset

    def magnitude_error(self, m, me):
        return me

    @property
    def coefficients(self) -> tuple[list[float], list[float]]:
        """Of x' and y' in the order of ``powers``."""
        a, b = dict(self.px), dict(self.py)
        return [a.get(k, 0.0) for k in powers(self.order)], [b.get(k, 0.0) for k in powers(self.order)]


def polynomial(cx: list[float], cy: list[float], mag_offset: float = 0.0) -> Transform:
    """A polynomial from its coefficients in the order of ``powers``; a single one each is a shift (order 0)."""
    if len(cx) != len(cy):
        raise ValueError("as many coefficients of x' as of y' are needed")
    if len(cx) == 1:
        cx, cy = [cx[0], 1.0, 0.0], [cy[0], 0.0, 1.0]
    order = int((np.sqrt(1 + 8 * len(cx)) - 3) / 2 + 1e-9)
    keys = powers(order)
    if len(keys) != len(cx):
        raise ValueError(f"{len(cx)} coefficients fit no order")
    return Transform(tuple(zip(keys, map(float, cx))), tuple(zip(keys, map(float, cy))), float(mag_offset))


@dataclass(frozen=True)
class Shift(Transform):
    """A shift with its own error, which adds to that of the positions; velocities stay."""

    shift_error: tuple[float, float] = (0.0, 0.0)

    def position_error(self, x, y, xe, ye):
        a, b = self.shift_error
        return _sqrt(xe * xe + a * a), _sqrt(ye * ye + b * b)


def shift(dx: float, dy: float, error: tuple[float, float] = (0.0, 0.0), mag_offset: float = 0.0) -> Shift:
    return Shift((((0, 0), dx), ((1, 0), 1.0)), (((0, 0), dy), ((0, 1), 1.0)), mag_offset, "Shift", error)


def similarity(a0: float, b0: float, a1: float, a2: float, mag_offset: float = 0.0) -> Transform:
    """x' = a0 + a1 x + a2 y, y' = b0 - a2 x + a1 y."""
    return Transform((((0, 0), a0), ((1, 0), a1), ((0, 1), a2)), (((0, 0), b0), ((1, 0), -a2), ((0, 1), a1)), mag_offset, "four_paramNW")


def scale_offset(low: float, high: float) -> tuple[float, float]:
    """(scale, offset) that map an interval to [-1, 1]."""
    return 2.0 / (high - low), -(high + low) / (high - low)


def to_domain(v, low: float, high: float):
    s, o = scale_offset(low, high)
    return s * v + o


def from_domain(v, low: float, high: float):
    s, o = scale_offset(low, high)
    return (v - o) / s


def error_to_domain(e, low: float, high: float):
    return e * scale_offset(low, high)[0]


def error_from_domain(e, low: float, high: float):
    return e / scale_offset(low, high)[0]


def legendre_powers(order: int) -> list[tuple[int, int]]:
    """The degrees of the products L_i(x) L_j(y): the full square up to ``order``."""
    return [(i, j) for j in range(order + 1) for i in range(order + 1)]


def legendre(cx: list[float], cy: list[float], order: int, mag_offset: float = 0.0) -> Transform:
    """A Legendre series over [-1, 1], written out in powers, so errors and velocities propagate like any polynomial's."""

    def expand(c: list[float]) -> tuple[tuple[tuple[int, int], float], ...]:
        out: Poly = {}
        for (i, j), v in zip(legendre_powers(order), c):
            a, b = np.polynomial.legendre.leg2poly([0] * i + [1]), np.polynomial.legendre.leg2poly([0] * j + [1])
            for p, u in enumerate(a):
                for q, w in enumerate(b):
                    if u and w:
                        out[p, q] = out.get((p, q), 0.0) + v * u * w
        return tuple(sorted(out.items()))

    return Transform(expand(cx), expand(cy), float(mag_offset), "LegTransform")
