"""Periodic-box geometry as Column expressions: whole-stage code, no Python on the rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


@dataclass(frozen=True)
class Box:
    """Edges along three axes and the tilts of a triclinic cell (0 for an orthorhombic one)."""

    lo: tuple[float, float, float]
    hi: tuple[float, float, float]
    xy: float = 0.0
    xz: float = 0.0
    yz: float = 0.0

    def __post_init__(self) -> None:
        if any(h == l for l, h in zip(self.lo, self.hi)):
            raise ValueError("a box edge has no length")

    @property
    def edges(self) -> tuple[float, float, float]:
        return tuple(float(h - l) for l, h in zip(self.lo, self.hi))  # type: ignore[return-value]

    @property
    def triclinic(self) -> bool:
        return bool(self.xy or self.xz or self.yz)

    @staticmethod
    def from_bounds(bounds: list[tuple[float, float]], xy: float = 0.0, xz: float = 0.0, yz: float = 0.0) -> Box:
        """From the bounding box that a dump of a tilted cell gives."""
        (xl, xh), (yl, yh), (zl, zh) = bounds
        return Box((xl - min(0.0, xy, xz, xy + xz), yl - min(0.0, yz), zl), (xh - max(0.0, xy, xz, xy + xz), yh - max(0.0, yz), zh), xy, xz, yz)


def unwrap(box: Box, x: Column, y: Column, z: Column, ix: Column, iy: Column, iz: Column) -> Vec:
    """Positions moved by whole box vectors, as the image flags say."""
    lx, ly, lz = box.edges
    return x + ix * lx + iy * box.xy + iz * box.xz, y + iy * ly + iz * box.yz, z + iz * lz


def to_fractional(box: Box, x: Column, y: Column, z: Column) -> Vec:
    """Cell coordinates, not wrapped: back substitution through the tilts."""
    lx, ly, lz = box.edges
    c = (z - box.lo[2]) / lz
    b = (y - box.lo[1] - c * box.yz) / ly
    return (x - box.lo[0] - b * box.xy - c * box.xz) / lx, b, c


def from_fractional(box: Box, a: Column, b: Column, c: Column) -> Vec:
    lx, ly, lz = box.edges
    return a * lx + b * box.xy + c * box.xz + box.lo[0], b * ly + c * box.yz + box.lo[1], c * lz + box.lo[2]


def wrap(box: Box, x: Column, y: Column, z: Column) -> Vec:
    """The image inside the cell."""
    return from_fractional(box, *(v - F.floor(v) for v in to_fractional(box, x, y, z)))


def minimum_image(box: Box, dx: Column, dy: Column, dz: Column) -> Vec:
    """A displacement less its nearest whole number of box vectors; halves round to even, all axes are periodic."""
    lx, ly, lz = box.edges
    if not box.triclinic:
        return dx - F.rint(dx / lx) * lx, dy - F.rint(dy / ly) * ly, dz - F.rint(dz / lz) * lz
    c = dz / lz
    b = (dy - c * box.yz) / ly
    a = (dx - b * box.xy - c * box.xz) / lx
    a, b, c = (v - F.rint(v) for v in (a, b, c))
    return a * lx + b * box.xy + c * box.xz, b * ly + c * box.yz, c * lz


def distance_squared(box: Box, p: Vec, q: Vec) -> Column:
    d = minimum_image(box, *(u - v for u, v in zip(p, q)))
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
