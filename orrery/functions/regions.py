"""Regions of the sphere as a small algebra that compiles to predicates."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions import sphere as S


class RegionError(ValueError):
    """A region with bounds that make no sense."""


class Region:
    """``sql()`` needs the columns ``r, theta, phi`` and ``ux, uy, uz``."""

    def sql(self) -> str:
        raise NotImplementedError

    def column(self) -> Column:
        return F.expr(self.sql())

    def sectors(self, theta_parts: int, phi_parts: int) -> set[int] | None:
        """Cells that can hold points of the region; ``None``: any."""
        return None

    def radii(self) -> tuple[float, float] | None:
        """Between which radii its points lie; ``None``: any."""
        return None

    def shells(self, bounds: list[float]) -> list[int] | None:
        """Shells, numbered as by ``with_cells``, that can hold points of the region; ``None``: any."""
        if (r := self.radii()) is None:
            return None
        cuts = sorted(set(bounds))
        of = lambda x: min(sum(x >= b for b in cuts), max(len(cuts) - 1, 0))
        return list(range(of(r[0]), of(r[1]) + 1)) if r[0] <= r[1] else []


def sector_centres(theta_parts: int, phi_parts: int) -> list[tuple[int, float, float, float]]:
    """``sector_id, theta, phi, diagonal`` of each cell: its middle, and a bound of how far apart its points are."""
    return [(c, (t0 + t1) / 2, (p0 + p1) / 2, math.hypot(t1 - t0, p1 - p0)) for c, t0, t1, p0, p1 in _cells(theta_parts, phi_parts)]


def _cells(theta_parts: int, phi_parts: int):
    dt, dp = 2 * math.pi / theta_parts, math.pi / phi_parts
    for t in range(theta_parts):
        for p in range(phi_parts):
            yield t * phi_parts + p, t * dt, (t + 1) * dt, p * dp, (p + 1) * dp


@dataclass(frozen=True)
class Cap(Region):
    """All within ``half_angle`` of a direction, borders included."""

    theta: float
    phi: float
    half_angle: float

    def __post_init__(self):
        if not 0 < self.half_angle <= math.pi:
            raise RegionError("half_angle must lie in (0, pi]")

    @property
    def axis(self):
        return math.sin(self.phi) * math.cos(self.theta), math.sin(self.phi) * math.sin(self.theta), math.cos(self.phi)

    def sql(self) -> str:
        return f"({S.angular(S.vec('u'), S.literal(self.axis))} <= {S.num(self.half_angle)})"

    def sectors(self, theta_parts, phi_parts):
        out = set()
        for cell, t0, t1, p0, p1 in _cells(theta_parts, phi_parts):
            t, p = (t0 + t1) / 2, (p0 + p1) / 2
            x = math.sin(p) * math.cos(t), math.sin(p) * math.sin(t), math.cos(p)
            d = math.acos(max(-1, min(1, sum(a * b for a, b in zip(x, self.axis, strict=True)))))
            if d <= self.half_angle + math.hypot(t1 - t0, p1 - p0) / 2 + 1e-9:
                out.add(cell)
        return out


class Cone(Cap):
    """A cone from the centre: the same directions as its cap, whatever the radius."""


@dataclass(frozen=True)
class Shell(Region):
    inner: float
    outer: float

    def __post_init__(self):
        if not 0 <= self.inner < self.outer:
            raise RegionError("0 <= inner < outer is needed")

    def sql(self) -> str:
        return f"(r >= {S.num(self.inner)} AND r <= {S.num(self.outer)})"

    def radii(self):
        return self.inner, self.outer


@dataclass(frozen=True)
class Band(Region):
    phi_min: float
    phi_max: float

    def __post_init__(self):
        if not 0 <= self.phi_min < self.phi_max <= math.pi:
            raise RegionError("0 <= phi_min < phi_max <= pi is needed")

    def sql(self) -> str:
        return f"(phi >= {S.num(self.phi_min)} AND phi <= {S.num(self.phi_max)})"

    def sectors(self, theta_parts, phi_parts):
        return {c for c, _, _, p0, p1 in _cells(theta_parts, phi_parts) if p1 >= self.phi_min - 1e-9 and p0 <= self.phi_max + 1e-9}


@dataclass(frozen=True)
class Wedge(Region):
    """From ``theta_min`` on to ``theta_max``, through 0 where the first is larger."""

    theta_min: float
    theta_max: float

    def __post_init__(self):
        if not (0 <= self.theta_min < 2 * math.pi and 0 <= self.theta_max < 2 * math.pi) or self.theta_min == self.theta_max:
            raise RegionError("bounds must differ and lie in [0, 2 pi)")

    def sql(self) -> str:
        word = "AND" if self.theta_min <= self.theta_max else "OR"
        return f"(theta >= {S.num(self.theta_min)} {word} theta <= {S.num(self.theta_max)})"

    def sectors(self, theta_parts, phi_parts):
        def meets(a, b):
            if self.theta_min <= self.theta_max:
                return b >= self.theta_min - 1e-9 and a <= self.theta_max + 1e-9
            return b >= self.theta_min - 1e-9 or a <= self.theta_max + 1e-9

        return {c for c, t0, t1, _, _ in _cells(theta_parts, phi_parts) if meets(t0, t1)}


@dataclass(frozen=True)
class Intersection(Region):
    """All of them; of none: everything."""

    parts: tuple[Region, ...]

    def sql(self) -> str:
        return "(" + " AND ".join(p.sql() for p in self.parts) + ")" if self.parts else "(1 = 1)"

    def sectors(self, theta_parts, phi_parts):
        found = [c for p in self.parts if (c := p.sectors(theta_parts, phi_parts)) is not None]
        return set.intersection(*found) if found else None

    def radii(self):
        found = [r for p in self.parts if (r := p.radii()) is not None]
        return (max(r[0] for r in found), min(r[1] for r in found)) if found else None


@dataclass(frozen=True)
class Union(Region):
    """Any of them; of none: nothing."""

    parts: tuple[Region, ...]

    def sql(self) -> str:
        return "(" + " OR ".join(p.sql() for p in self.parts) + ")" if self.parts else "(1 = 0)"

    def sectors(self, theta_parts, phi_parts):
        found = [p.sectors(theta_parts, phi_parts) for p in self.parts]
        return None if None in found else set().union(*found)

    def radii(self):
        found = [p.radii() for p in self.parts]
        return None if None in found or not found else (min(r[0] for r in found), max(r[1] for r in found))


_KINDS = {"cone": Cone, "cap": Cap, "shell": Shell, "band": Band, "wedge": Wedge}


def from_dict(spec: dict) -> Region:
    """A region from nested dictionaries, each with one key that names its kind."""
    given = {k: v for k, v in spec.items() if v is not None}
    if len(given) != 1:
        raise RegionError("exactly one kind of region must be given")
    ((kind, value),) = given.items()
    if kind in ("intersection", "union"):
        return (Intersection if kind == "intersection" else Union)(tuple(from_dict(x) for x in value))
    if kind not in _KINDS:
        raise RegionError(f"no region {kind!r}")
    return _KINDS[kind](**value)


def semantic(theta: float, phi: float, angle: float | None = None, similarity: float | None = None, shell: tuple[float, float] | None = None) -> Region:
    """Around a direction: within an angle, or of at least a similarity, and in a shell."""
    parts: list[Region] = []
    if similarity is not None:
        angle = math.acos(max(-1.0, min(1.0, similarity)))
    if angle is not None:
        parts.append(Cap(theta, phi, max(1e-10, min(math.pi, angle))))
    if shell is not None:
        parts.append(Shell(*shell))
    return parts[0] if len(parts) == 1 else Intersection(tuple(parts))
