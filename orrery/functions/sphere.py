"""Scalar functions of spherical geometry, as SQL expressions.

Each function takes and returns SQL text, so that one definition serves Catalyst
(``col``, ``register``), plain SQL and any other engine with the same elementary
functions.  A point is ``(r, theta, phi)``: azimuth ``theta`` in [0, 2 pi), polar
angle ``phi`` in [0, pi].  A direction is a triple of expressions, a unit vector.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

TAU, PI = repr(2 * math.pi), repr(math.pi)
Vec = tuple[str, str, str]


def col(expression: str) -> Column:
    return F.expr(expression)


def num(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def clamp(x: str, lo: str = "-1.0", hi: str = "1.0") -> str:
    return f"greatest({lo}, least({hi}, {x}))"


def wrap(theta: str) -> str:
    return f"(({theta}) - floor(({theta}) / {num(2 * math.pi)}) * {num(2 * math.pi)})"


def vec(prefix: str) -> Vec:
    return f"{prefix}x", f"{prefix}y", f"{prefix}z"


def literal(v) -> Vec:
    return tuple(num(x) for x in v)


def direction(theta: str, phi: str) -> Vec:
    return f"(sin({phi}) * cos({theta}))", f"(sin({phi}) * sin({theta}))", f"cos({phi})"


def to_cartesian(r: str, theta: str, phi: str) -> Vec:
    return tuple(f"(({r}) * {c})" for c in direction(theta, phi))


def norm(v: Vec) -> str:
    return f"sqrt(({v[0]}) * ({v[0]}) + ({v[1]}) * ({v[1]}) + ({v[2]}) * ({v[2]}))"


def dot(a: Vec, b: Vec) -> str:
    return f"(({a[0]}) * ({b[0]}) + ({a[1]}) * ({b[1]}) + ({a[2]}) * ({b[2]}))"


def cross(a: Vec, b: Vec) -> Vec:
    return tuple(f"(({a[i]}) * ({b[j]}) - ({a[j]}) * ({b[i]}))" for i, j in ((1, 2), (2, 0), (0, 1)))


def normalize(v: Vec) -> Vec:
    """The zero vector stays."""
    n = norm(v)
    return tuple(f"(CASE WHEN {n} < 1e-15 THEN 0.0 ELSE ({c}) / {n} END)" for c in v)


def to_spherical(v: Vec) -> Vec:
    """``r, theta, phi``; all zero below 1e-15."""
    n = norm(v)
    small = f"{n} < 1e-15"
    theta = wrap(f"atan2({v[1]}, {v[0]})")
    return n, f"(CASE WHEN {small} THEN 0.0 ELSE {theta} END)", f"(CASE WHEN {small} THEN 0.0 ELSE acos({clamp(f'({v[2]}) / {n}')}) END)"


def to_geo(r: str, theta: str, phi: str) -> Vec:
    """Latitude, longitude and altitude over the unit sphere."""
    lon = f"degrees({theta})"
    return f"(90.0 - degrees({phi}))", f"(CASE WHEN {lon} > 180.0 THEN {lon} - 360.0 ELSE {lon} END)", f"greatest(({r}) - 1.0, 0.0)"


def from_geo(lat: str, lon: str, alt: str) -> Vec:
    return f"(1.0 + ({alt}))", wrap(f"radians({lon})"), f"radians(90.0 - ({lat}))"


def angular(a: Vec, b: Vec) -> str:
    return f"atan2({norm(cross(a, b))}, {dot(a, b)})"


def cosine_proxy(a: Vec, b: Vec) -> str:
    return f"(1.0 - {clamp(dot(a, b))})"


def great_circle(a: Vec, b: Vec, radius: str) -> str:
    return f"(({radius}) * {angular(a, b)})"


def euclidean(a: Vec, b: Vec) -> str:
    return norm(tuple(f"({x}) - ({y})" for x, y in zip(a, b, strict=True)))


#: Chord distance: the same, of points with their radii.
chord = euclidean


def _mixed(a: Vec, b: Vec, t: str, spherical: bool) -> Vec:
    t = f"least(1.0, greatest(0.0, {t}))"
    if spherical:
        w = f"acos({clamp(dot(a, b))})"
        s = f"sin({w})"
        return tuple(f"(CASE WHEN {w} < 1e-10 OR {s} < 1e-10 THEN {x} ELSE (sin((1.0 - {t}) * {w}) * ({x}) + sin({t} * {w}) * ({y})) / {s} END)" for x, y in zip(a, b, strict=True))
    mid = tuple(f"((1.0 - {t}) * ({x}) + {t} * ({y}))" for x, y in zip(a, b, strict=True))
    n = norm(mid)
    return tuple(f"(CASE WHEN {n} < 1e-15 THEN {x} ELSE {m} / {n} END)" for x, m in zip(a, mid, strict=True))


def slerp(a: Vec, b: Vec, t: str) -> Vec:
    return _mixed(a, b, t, True)


def nlerp(a: Vec, b: Vec, t: str) -> Vec:
    return _mixed(a, b, t, False)


def full_slerp(a: Vec, ra: str, b: Vec, rb: str, t: str) -> Vec:
    """The direction of ``slerp`` with the radius on a straight line."""
    u = f"least(1.0, greatest(0.0, {t}))"
    return tuple(f"(({ra}) + (({rb}) - ({ra})) * {u}) * {c}" for c in slerp(a, b, t))


def antipode(theta: str, phi: str) -> tuple[str, str]:
    return wrap(f"({theta}) + {num(math.pi)}"), f"({num(math.pi)} - ({phi}))"


def cap_area(alpha: str) -> str:
    return f"({num(2 * math.pi)} * (1.0 - cos({alpha})))"


def _huilier(a: str, b: str, c: str) -> str:
    s = f"((({a}) + ({b}) + ({c})) / 2.0)"
    return f"(tan({s} / 2.0) * tan(({s} - ({a})) / 2.0) * tan(({s} - ({b})) / 2.0) * tan(({s} - ({c})) / 2.0))"


def excess(ab: str, bc: str, ca: str) -> str:
    """Spherical excess of a triangle from its sides; degenerate ones give 0."""
    return f"(4.0 * atan(sqrt(greatest(0.0, {_huilier(ab, bc, ca)}))))"


def cap_overlap(d: str, a: str, b: str) -> str:
    """Area shared by two caps of half angles ``a`` and ``b``, ``d`` apart."""
    pa = f"acos({clamp(f'(cos({b}) - cos({a}) * cos({d})) / (sin({a}) * sin({d}))')})"
    pb = f"acos({clamp(f'(cos({a}) - cos({b}) * cos({d})) / (sin({b}) * sin({d}))')})"
    lens = f"2.0 * {pa} * (1.0 - cos({a})) + 2.0 * {pb} * (1.0 - cos({b})) - 2.0 * {excess(a, b, d)}"
    return (
        f"(CASE WHEN ({d}) >= ({a}) + ({b}) THEN 0.0 WHEN ({d}) + ({b}) <= ({a}) THEN {cap_area(b)} WHEN ({d}) + ({a}) <= ({b}) THEN {cap_area(a)}"
        f" WHEN abs(sin({d})) < 1e-15 THEN {cap_area(f'least({a}, {b})')} ELSE {lens} END)"
    )


def bisector_normal(a: Vec, b: Vec) -> Vec:
    d = tuple(f"(({x}) - ({y}))" for x, y in zip(a, b, strict=True))
    n = norm(d)
    return tuple(f"(CASE WHEN {n} < 1e-15 THEN {z} ELSE {c} / {n} END)" for c, z in zip(d, ("0.0", "0.0", "1.0"), strict=True))


def lune_side(p: Vec, a: Vec, b: Vec) -> str:
    s = f"({dot(p, a)} - {dot(p, b)})"
    return f"(CASE WHEN {s} > 1e-12 THEN 'closer_to_a' WHEN {s} < -1e-12 THEN 'closer_to_b' ELSE 'on_bisector' END)"


def arc_distance(p: Vec, a, b) -> str:
    """Distance of ``p`` from the shorter arc between two fixed directions."""
    n = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    size = math.sqrt(sum(x * x for x in n))
    la, lb = literal(a), literal(b)
    if size < 1e-15:
        return angular(p, la)
    ln = literal([x / size for x in n])
    s = dot(p, ln)
    # The foot of the perpendicular is p - s n, inside between the planes through n and an end.
    f = f"sqrt(greatest(0.0, 1.0 - {s} * {s}))"
    ends = f"least({angular(p, la)}, {angular(p, lb)})"
    side = lambda u, v: literal([(u[i] * v[j] - u[j] * v[i]) / size for i, j in ((1, 2), (2, 0), (0, 1))])
    on = f"{dot(p, side(n, a))} >= 0.0 AND {dot(p, side(b, n))} >= 0.0"
    return f"(CASE WHEN {f} < 1e-15 THEN {ends} WHEN {on} THEN abs({num(math.pi / 2)} - acos(least(1.0, abs({s})))) ELSE {ends} END)"


def gap_confidence(void: str, sharpness: str) -> str:
    return f"(1.0 / (1.0 + exp(({sharpness}) * ({void}))))"


def quality_level(combined: str) -> str:
    """A bound itself belongs to the level below it."""
    return f"(CASE WHEN ({combined}) > 0.10 THEN 'high' WHEN ({combined}) > 0.03 THEN 'moderate' WHEN ({combined}) > 0.005 THEN 'low' ELSE 'unreliable' END)"


def quality(evr: str, certainty: str) -> str:
    """The combined quality signal: EVR, certainty and the gap it implies."""
    return f"(({evr}) * ({certainty}) * greatest(sqrt({certainty}), 0.01))"


def void_quality(evr: str, certainty: str, void: str, sharpness: str) -> str:
    """The combined signal where the distance to the nearest cap is known."""
    return f"(({evr}) * ({certainty}) * {gap_confidence(void, sharpness)})"


def geo_from_cartesian(v: Vec) -> Vec:
    """Latitude, longitude and altitude of a Cartesian point."""
    return to_geo(*to_spherical(v))


def cartesian_from_geo(lat: str, lon: str, alt: str) -> Vec:
    return to_cartesian(*from_geo(lat, lon, alt))


def plane_coordinates(v: Vec, centre, u, w, normal) -> Vec:
    """Coordinates of a point in a plane's basis, and its signed distance from the plane."""
    d = tuple(f"(({x}) - {num(c)})" for x, c in zip(v, centre, strict=True))
    return dot(d, literal(u)), dot(d, literal(w)), dot(d, literal(normal))


def bridge_threshold(evr: str, base: str, penalty: str) -> str:
    return f"(({base}) + (1.0 - ({evr})) * (1.0 - ({evr})) * ({penalty}))"


def territorial(ea: str, eb: str) -> str:
    return f"greatest(sqrt(({ea}) * ({eb})), 0.05)"


def hop_weight(distance: str, strength: str, kind: str) -> str:
    """Weight of a hop between categories by the bridge that carries it."""
    return f"(CASE WHEN ({kind}) = 'genuine' THEN ({distance}) / (({strength}) + 0.1) WHEN ({kind}) = 'overlap' THEN 2.0 * ({distance}) ELSE ({distance}) / (({strength}) + 0.01) END)"


SIGNATURES = {
    "angular_distance": (("ax", "ay", "az", "bx", "by", "bz"), lambda: angular(vec("a"), vec("b"))),
    "chord_distance": (("ax", "ay", "az", "bx", "by", "bz"), lambda: chord(vec("a"), vec("b"))),
    "cosine_proxy": (("ax", "ay", "az", "bx", "by", "bz"), lambda: cosine_proxy(vec("a"), vec("b"))),
    "cap_solid_angle": (("alpha",), lambda: cap_area("alpha")),
    "cap_intersection_area": (("d", "a", "b"), lambda: cap_overlap("d", "a", "b")),
    "spherical_excess": (("ab", "bc", "ca"), lambda: excess("ab", "bc", "ca")),
    "normalize_theta": (("theta",), lambda: wrap("theta")),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to SQL, as ``orrery_<name>``, inlined by Catalyst."""
    for name, (parameters, body) in SIGNATURES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION orrery_{name}({', '.join(f'{p} DOUBLE' for p in parameters)}) RETURNS DOUBLE RETURN {body()}")
    return [f"orrery_{name}" for name in SIGNATURES]
