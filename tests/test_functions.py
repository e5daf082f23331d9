import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.functions import regions as G
from orrery.functions import sphere as S
from orrery.functions import vectors as V


def value(spark, expression):
    return spark.range(1).select(F.expr(expression).cast("double")).first()[0]


def unit(theta, phi):
    return math.sin(phi) * math.cos(theta), math.sin(phi) * math.sin(theta), math.cos(phi)


ANGLES = [(0.0, 0.0), (0.0, math.pi), (1.2, 0.4), (5.9, 2.2), (3.14, 1.57), (2.0, 3.0)]


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(*unit(*a), *unit(*b)) for a in ANGLES for b in ANGLES]
    df = spark.createDataFrame(rows, "ax double, ay double, az double, bx double, by double, bz double")
    return df, np.array(rows)


def test_distances(pairs):
    df, x = pairs
    a, b = S.vec("a"), S.vec("b")
    got = df.select(F.expr(S.angular(a, b)), F.expr(S.cosine_proxy(a, b)), F.expr(S.chord(a, b))).toPandas().to_numpy()
    dots = np.clip((x[:, :3] * x[:, 3:]).sum(axis=1), -1, 1)
    np.testing.assert_allclose(got[:, 0], np.arccos(dots), atol=1e-7)
    np.testing.assert_allclose(got[:, 1], 1 - dots, atol=1e-12)
    np.testing.assert_allclose(got[:, 2], np.linalg.norm(x[:, :3] - x[:, 3:], axis=1), atol=1e-12)


def test_slerp_ends_and_middle(pairs):
    df, x = pairs
    for t, want in ((-1.0, x[:, :3]), (0.0, x[:, :3])):
        got = df.select(*map(F.expr, S.slerp(S.vec("a"), S.vec("b"), str(t)))).toPandas().to_numpy()
        np.testing.assert_allclose(got, want, atol=1e-9)
    mid = df.select(F.expr(S.norm(S.nlerp(S.vec("a"), S.vec("b"), "0.5")))).toPandas().to_numpy()
    np.testing.assert_allclose(mid, 1, atol=1e-9)


@settings(max_examples=8, deadline=None)
@given(st.floats(-50, 50), st.floats(0.01, 3.13), st.floats(0.1, 9))
def test_round_trip(spark, theta, phi, r):
    xyz = S.to_cartesian(S.num(r), S.num(theta), S.num(phi))
    got = [value(spark, e) for e in S.to_spherical(xyz)]
    assert got == pytest.approx([r, theta % (2 * math.pi), phi], abs=1e-6) or abs(abs(got[1] - theta % (2 * math.pi)) - 2 * math.pi) < 1e-6


def test_caps_and_triangles(spark):
    assert value(spark, S.cap_area(S.num(math.pi))) == pytest.approx(4 * math.pi)
    o = lambda d, a, b: value(spark, S.cap_overlap(S.num(d), S.num(a), S.num(b)))
    assert o(2.0, 0.5, 0.5) == 0
    assert o(0.1, 0.9, 0.2) == pytest.approx(2 * math.pi * (1 - math.cos(0.2)))
    rng = np.random.default_rng(0)
    p = rng.normal(size=(400_000, 3))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    a, b = np.array(unit(0, 0.5)), np.array(unit(0, 1.2))
    mc = ((p @ a >= math.cos(0.6)) & (p @ b >= math.cos(0.5))).mean() * 4 * math.pi
    assert o(0.7, 0.6, 0.5) == pytest.approx(mc, abs=0.01)
    q = math.pi / 2
    assert value(spark, S.excess(*map(S.num, (q, q, q)))) == pytest.approx(math.pi / 2)
    assert value(spark, S.excess("0.4", "0.4", "0.8")) == pytest.approx(0, abs=1e-6)


def test_arc_distance_of_long_arcs(spark):
    """The far side of the great circle is within 120 degrees and more of both ends, and yet not on the arc."""
    for length in (1.0, 2.0, 2.5, 3.0):
        a, b = unit(0.0, math.pi / 2), unit(length, math.pi / 2)
        t = np.linspace(0, length, 2000)
        arc = np.stack([np.cos(t), np.sin(t), 0 * t], axis=1)
        places = np.array([unit(x, y) for x in np.arange(0.1, 6.2, 0.7) for y in (1.2, math.pi / 2, 2.5)])
        rows = spark.createDataFrame([tuple(map(float, p)) for p in places], "ux double, uy double, uz double")
        got = [r.d for r in rows.select(F.expr(S.arc_distance(S.vec("u"), a, b)).alias("d")).collect()]
        np.testing.assert_allclose(got, np.arccos(np.clip(places @ arc.T, -1, 1)).min(axis=1), atol=2e-3)


def test_arc_distance(spark):
    a, b = unit(0, math.pi / 2), unit(1.0, math.pi / 2)
    d = lambda t, p: value(spark, S.arc_distance(S.literal(unit(t, p)), a, b))
    assert d(0.5, math.pi / 2 - 0.2) == pytest.approx(0.2)
    assert d(1.3, math.pi / 2) == pytest.approx(0.3)
    assert d(0.5, 0.0) == pytest.approx(math.pi / 2)
    assert value(spark, S.arc_distance(S.literal(b), a, a)) == pytest.approx(1.0)


def test_quality_and_bridges(spark):
    text = lambda e: spark.range(1).select(F.expr(e)).first()[0]
    assert [text(S.quality_level(str(x))) for x in (0.11, 0.1, 0.03, 0.005)] == ["high", "moderate", "low", "unreliable"]
    assert value(spark, S.bridge_threshold("0.5", "0.5", "0.4")) == pytest.approx(0.6)
    assert value(spark, S.territorial("0.0", "1.0")) == 0.05
    assert value(spark, S.hop_weight("1.0", "0.4", "'genuine'")) == pytest.approx(2.0)
    assert value(spark, S.hop_weight("1.0", "0.4", "'overlap'")) == 2.0


def test_sql_functions(spark):
    names = S.register(spark)
    assert "orrery_angular_distance" in names
    assert spark.sql("SELECT orrery_angular_distance(1, 0, 0, 0, 1, 0)").first()[0] == pytest.approx(math.pi / 2)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = df.select(V.norm("a"), V.cosine("a", "b"), V.euclidean("a", "b"), V.normalized("a"), V.jaccard(V.active_axes("a", 3.5), V.active_axes("b", 0.5)), V.gaussian("a", "b", 1.0)).collect()
    assert got[0][:3] == (5.0, pytest.approx(0.96), pytest.approx(math.sqrt(2)))
    assert got[1][1] == 0.0 and got[1][3] == [1.0, 0.0]
    assert got[0][4] == 0.5 and got[1][4] == 0.0
    assert got[0][5] == pytest.approx(math.exp(-1))
    with pytest.raises(Exception, match="different dimension"):
        df.select(V.cosine("a", F.array(F.lit(1.0)))).collect()


def test_regions_and_their_sectors(spark):
    from orrery.operators import knn
    from orrery.sources import points as P

    rng = np.random.default_rng(1)
    rows = [(i, float(r), float(t), float(p)) for i, (r, t, p) in enumerate(zip(rng.uniform(0, 4, 3000), rng.uniform(0, 2 * math.pi, 3000), np.arccos(rng.uniform(-1, 1, 3000)), strict=True))]
    points = P.with_cells(P.from_spherical(spark.createDataFrame(rows, "ordinal int, r double, theta double, phi double")), [1.0, 2.0]).cache()
    for region in (G.Cap(0.3, 1.0, 0.5), G.Cone(6.0, 0.1, 1.2), G.Band(0.2, 0.9), G.Wedge(6.0, 0.5), G.Wedge(1.0, 2.0), G.Intersection((G.Shell(1, 2), G.Cap(2, 2, 0.7))), G.Union((G.Cap(1, 1, 0.2), G.Band(2.5, 3.1))), G.Intersection(()), G.Union(())):
        plain = {r.ordinal for r in knn.in_region(points, region).collect()}
        pruned = {r.ordinal for r in knn.in_region(points, region, 12, 6).collect()}
        assert plain == pruned
    assert knn.in_region(points, G.Intersection(())).count() == 3000
    assert knn.in_region(points, G.Union(())).count() == 0


@pytest.mark.parametrize("bad", [lambda: G.Cap(0, 0, 0), lambda: G.Shell(2, 1), lambda: G.Band(1, 1), lambda: G.Wedge(1, 1), lambda: G.Wedge(-1, 1), lambda: G.from_dict({}), lambda: G.from_dict({"cap": {}, "shell": {}}), lambda: G.from_dict({"blob": {}})])
def test_bad_regions(bad):
    with pytest.raises((G.RegionError, TypeError)):
        bad()


def test_region_from_dictionaries():
    r = G.from_dict({"union": [{"shell": {"inner": 0, "outer": 1}}, {"intersection": [{"band": {"phi_min": 0.1, "phi_max": 1}}]}]})
    assert isinstance(r, G.Union) and isinstance(r.parts[1], G.Intersection)
    assert G.semantic(0, 1, similarity=0.5, shell=(0, 1)) == G.Intersection((G.Cap(0, 1, math.acos(0.5)), G.Shell(0, 1)))
