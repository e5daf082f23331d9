from datetime import datetime, timedelta

import numpy as np
import pytest

from orrery.functions import regions as G
from orrery.operators import clusters as K
from orrery.operators import knn as N
from orrery.operators import projections as J
from orrery.operators import sums as Z
from orrery.streaming import regions as ST


def cloud(n, seed=0):
    """Half of the points in five heaps, some at one place, the rest anywhere."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    x[: n // 2] = rng.normal(size=(5, 3))[np.arange(n // 2) % 5] + 0.05 * x[: n // 2]
    x[:7] = x[0]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def counted(kernel):
    def run(x, y):
        run.pairs += len(x) * len(y)
        return kernel(x, y)

    run.pairs = 0
    return run


@pytest.mark.parametrize("kernel", [Z.pushes, Z.angles])
def test_sums_over_cells_equal_those_over_all_pairs(kernel):
    x = cloud(4000)
    charges = np.concatenate([np.ones((4000, 1)), x], axis=1)
    cells = Z.Cells(x, charges, target=64)
    got = np.empty_like(charges)
    for leaf in np.flatnonzero(cells.leaf):
        got[cells.order[cells.low[leaf] : cells.high[leaf]]] = cells.sums(leaf, kernel)
    want = kernel(x, x) @ charges
    np.testing.assert_allclose(got, want, atol=2e-9 * np.abs(want).max())


def test_work_grows_with_the_points(monkeypatch):
    monkeypatch.setattr(Z, "angles", counted(Z.angles))
    pairs = []
    for n in (40_000, 160_000):
        cells, Z.angles.pairs = Z.Cells(cloud(n)[n // 2 :], labels=[(np.zeros(n // 2, int), 1)]), 0
        for leaf in np.flatnonzero(cells.leaf)[::16]:
            cells.sums(leaf, Z.angles)
        pairs.append(Z.angles.pairs)
    assert pairs[1] < 7 * pairs[0]  # 16 times as many, where all pairs are taken


def test_own_and_next_equal_brute_force(monkeypatch, spark):
    monkeypatch.setattr(Z, "TARGET", 64)
    monkeypatch.setattr(Z, "WIDTH", 3)
    x, rng = cloud(900), np.random.default_rng(1)
    label = np.stack([rng.integers(4, size=900), np.where(np.arange(900) == 5, 1, 0), np.zeros(900, int)], axis=1)
    points = spark.createDataFrame([(i, *map(float, p), *map(int, g)) for i, (p, g) in enumerate(zip(x, label, strict=True))], "ordinal long, ux double, uy double, uz double, p int, q int, s int")
    got = {(r.label, r.ordinal): (r.a, r.b) for r in Z.own_and_next(points, "p", "q", "s").collect()}
    d = Z.angles(x, x)
    assert len(got) == 3 * 900
    for c in range(3):
        for i in range(0, 900, 5):
            mean = {g: d[i, (label[:, c] == g) & (np.arange(900) != i)] for g in set(label[:, c])}
            own = mean.pop(label[i, c])
            assert got[c, i][0] == (pytest.approx(own.mean(), abs=1e-9) if len(own) else None)
            assert got[c, i][1] == (pytest.approx(min(m.mean() for m in mean.values()), abs=1e-9) if mean else None)


def test_forces_over_cells_equal_those_in_one_place(monkeypatch, spark):
    x = cloud(1500)[7:]
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "ordinal long, ux double, uy double, uz double")
    whole = np.array(sorted(map(tuple, K.force_layout(points, rounds=2).collect())))
    monkeypatch.setattr(K, "FORCE_ROWS", 10)
    monkeypatch.setattr(Z, "TARGET", 64)
    parts = np.array(sorted(map(tuple, K.force_layout(points, rounds=2).collect())))
    np.testing.assert_allclose(parts, whole, atol=1e-7)


@pytest.mark.parametrize("block", [1 << 19, 300])
def test_jaccard_edges_equal_brute_force_and_make_no_pairs(monkeypatch, spark, block):
    monkeypatch.setattr(N, "AXES_BLOCK", block)
    x = np.random.default_rng(2).random((700, 10)) < 0.3
    x[:3] = False
    corpus = spark.createDataFrame([(3 * i, v.astype(float).tolist()) for i, v in enumerate(x)], "ordinal long, embedding array<double>")
    edges = N.jaccard_edges(corpus, 0.5, 4)
    assert "Join" not in edges._jdf.queryExecution().toString()
    got = {}
    for r in edges.collect():
        got.setdefault(r.i, []).append((-r.similarity, -r.j))
    for i in range(700):
        both, union = (x & x[i]).sum(axis=1), (x | x[i]).sum(axis=1)
        want = sorted((-both[j] / union[j], -3 * j) for j in range(700) if j != i and both[j])[:4]
        assert sorted(got.get(3 * i, [])) == want


@pytest.mark.parametrize("kind", [J.KernelPca, J.Laplacian])
def test_fits_in_blocks_equal_those_in_one_place(monkeypatch, spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 12)) * np.linspace(2, 1, 12)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "ordinal long, embedding array<double>")
    fit = (lambda: kind.fit(corpus)) if kind is J.KernelPca else lambda: kind.fit(corpus, threshold=0.25)
    whole = fit()
    for name, v in (("DENSE", 10), ("ROWS", 128), ("COLUMNS", 256)):
        monkeypatch.setattr(J, name, v)
    parts = fit()
    assert parts.values == pytest.approx(whole.values, rel=1e-9)
    at = lambda m: m.transform(corpus).orderBy("ordinal").select("x", "y", "z", "certainty").toPandas().to_numpy()
    np.testing.assert_allclose(at(parts), at(whole), atol=2e-7)
    if kind is J.KernelPca:
        assert parts.sigma == pytest.approx(whole.sigma, abs=1e-12) and parts.total == pytest.approx(whole.total)


@pytest.mark.parametrize("groups", [1, 7])
def test_items_that_share_a_state_are_told_apart(monkeypatch, spark, tmp_path, groups):
    monkeypatch.setattr(ST, "GROUPS", groups)
    rng = np.random.default_rng(4)
    rows = [(i, f"u{rng.integers(40)}", datetime(2024, 1, 1) + timedelta(seconds=int(i)), float(rng.integers(4))) for i in range(600)]
    spark.createDataFrame(rows, "event_id long, item_id string, ts timestamp, r double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ST.read_events(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    got = ST.finished(ST.transitions(stream, G.Shell(0.0, 2.0), "0 seconds"), "shared").collect()
    was, want = {}, []
    for _, item, ts, r in rows:
        if (r <= 2.0) != was.get(item, False):
            want.append((item, ts, "entered" if r <= 2.0 else "left"))
        was[item] = r <= 2.0
    assert sorted((r.item_id, r.ts, r.change) for r in got) == sorted(want)
