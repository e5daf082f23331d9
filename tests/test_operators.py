import json
import math
import time
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import regions as G
from orrery.operators import analytics as A
from orrery.operators import blocks as B
from orrery.operators import categories as C
from orrery.operators import clusters as K
from orrery.operators import knn as N
from orrery.operators import places as L
from orrery.operators import projections as J
from orrery.operators import tuning as T
from orrery.plans import catalog
from orrery.plans.engine import Config, Engine, TextEmbedder
from orrery.sources import points as P
from orrery.sources import store as VS
from orrery.sources.index import PointIndex
from orrery.streaming import regions as ST


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(4, 16)) * 3
    rows = [[(centres[i % 4] + rng.normal(size=16)).tolist(), f"c{i % 4}"] for i in range(160)]
    return P.corpus_from_lists(spark, [c for _, c in rows], [e for e, _ in rows]).cache()


@pytest.fixture(scope="module")
def engine(corpus):
    return Engine.build(corpus)


@pytest.fixture(scope="module")
def data(corpus):
    x = np.array([r.embedding for r in corpus.orderBy("ordinal").collect()])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def coordinates(df):
    return df.orderBy("ordinal").select("x", "y", "z").toPandas().to_numpy()


def test_pca_equals_numpy(corpus, data):
    m = J.Pca.fit(corpus)
    c = data - data.mean(axis=0)
    _, s, v = np.linalg.svd(c, full_matrices=False)
    assert m.explained == pytest.approx((s[:3] ** 2).sum() / (s**2).sum())
    got = coordinates(m.transform(corpus))
    np.testing.assert_allclose(np.abs(got), np.abs(c @ v[:3].T), atol=1e-8)
    zero = corpus.sparkSession.createDataFrame([(0, [0.0] * 16)], "ordinal long, embedding array<double>")
    np.testing.assert_allclose(coordinates(m.transform(zero))[0], -m.mean @ m.axes.T, atol=1e-9)


def test_kernel_pca_equals_numpy(corpus, data):
    m = J.KernelPca.fit(corpus, sigma=0.8)
    d2 = ((data[:, None] - data[None]) ** 2).sum(axis=2)
    k = np.exp(-d2 * 0.5 / 0.64)
    h = np.eye(len(k)) - 1 / len(k)
    w, v = np.linalg.eigh(h @ k @ h)
    want = v[:, ::-1][:, :3] * np.sqrt(w[::-1][:3])
    np.testing.assert_allclose(np.abs(coordinates(m.transform(corpus))), np.abs(want), atol=1e-6)
    with pytest.raises(ValueError):
        J.KernelPca.fit(corpus, sigma=0.0)


def test_laplacian_separates_blocks(spark):
    rows = [(i, [1.0 if j // 4 == i % 3 else 0.0 for j in range(12)]) for i in range(60)]
    df = spark.createDataFrame(rows, "ordinal long, embedding array<double>")
    m = J.Laplacian.fit(df, k=5)
    got = coordinates(m.transform(df))
    for g in range(3):
        assert np.ptp(got[g::3], axis=0).max() < 1e-6
    assert 0 < m.explained <= 1 + 1e-9


def test_nearest_and_graph_equal_brute_force(engine):
    pts = engine.points
    u = pts.orderBy("ordinal").select("ux", "uy", "uz").toPandas().to_numpy()
    target = u[7]
    want = np.lexsort((np.arange(len(u)), np.round(-u @ target, 12)))[:6].tolist()
    assert K.nearest_ordinals(pts, target, 6) == want
    near = {}
    for r in N.batch_nearest(pts, pts, 4).collect():
        near.setdefault(r.query_id, {})[r["rank"]] = r.distance
    assert all(len(v) == 4 and v[1] < 1e-7 for v in near.values())
    want = set()
    for i in range(len(u)):
        d = 1 - u @ u[i]
        d[i] = 9
        want |= {(min(i, j), max(i, j)) for j in np.lexsort((np.arange(len(u)), d))[:3].tolist()}
    assert {(r.src, r.dst) for r in N.neighbour_edges(pts, 3).collect()} == want
    assert N.nearest(pts, target, 0).count() == 0


def test_upper_median(spark):
    for n in (1, 2, 7, 200):
        x = np.random.default_rng(n).normal(size=n).tolist()
        df = spark.createDataFrame([(v,) for v in x], "v double")
        assert C.upper_median(df, "v").first()[0] == sorted(x)[n // 2]
    assert C.upper_median(spark.createDataFrame([(1.0,)] * 5, "v double"), "v").first()[0] == 1.0


def test_paths():
    edges = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 3.0), ("c", "d", -1.0), ("d", "c", -1.0)]
    assert [v for v, _, _ in C.shortest_path(edges, "a", "c")] == ["a", "b", "c"]
    assert C.shortest_path(edges, "c", "a") is None
    assert C.shortest_path(edges, "a", "d")[-1][0] == "d"
    assert C.domain_groups({(0, 1): 0.9, (1, 2): 0.1, (2, 3): 0.8}, 4, 2) == [[0, 1], [2, 3]]


def test_category_path_is_the_cheapest(engine):
    rows = engine.graph.collect()
    cost = {(r.src, r.dst): max(r.weight, 0) for r in rows}
    got = C.category_path(engine.graph, 0, 3).orderBy("step").collect()
    import itertools

    best = min(sum(cost[a, b] for a, b in itertools.pairwise(p)) for k in range(3) for m in itertools.permutations((1, 2), k) for p in [(0, *m, 3)])
    assert got[-1].cumulative == pytest.approx(best)
    assert [r.cat_id for r in C.category_path(engine.graph, 2, 2).collect()] == [2]


def test_globs_find_the_clusters(engine):
    rows = K.globs(engine.points, max_k=6).collect()
    assert sum(r.members for r in rows) == 160
    labelled, centres = K.spherical_kmeans(engine.points, 3)
    assert len(centres) == 3 and -1 <= K.silhouette(labelled) <= 1
    with pytest.raises(ValueError):
        K.globs(engine.points, max_k=1)


def test_silhouette_equals_brute_force(engine):
    labelled, _ = K.spherical_kmeans(engine.points, 3)
    r = labelled.select("glob", "ux", "uy", "uz").toPandas()
    u, g = r[["ux", "uy", "uz"]].to_numpy(), r["glob"].to_numpy()
    d, s = np.arccos(np.clip(u @ u.T, -1, 1)), []
    for i in range(len(u)):
        own = (g == g[i]) & (np.arange(len(u)) != i)
        a, b = d[i][own].mean() if own.any() else 0.0, min(d[i][g == k].mean() for k in set(g) - {g[i]})
        s.append((b - a) / max(a, b))
    assert K.silhouette(labelled) == pytest.approx(np.mean(s))


def test_local_plane(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(x), float(y), 0.5 + 1e-6 * float(z)) for i, (x, y, z) in enumerate(rng.normal(size=(50, 3)))]
    plane = K.local_plane(spark.createDataFrame(rows, "ordinal int, x double, y double, z double"), (0, 0, 0.5), 20)
    assert abs(plane["normal"][2]) == pytest.approx(1, abs=1e-4) and plane["variance_ratio"] > 0.999
    with pytest.raises(ValueError):
        K.local_plane(spark.createDataFrame(rows, "ordinal int, x double, y double, z double"), (0, 0, 0), 2)


def test_layouts(engine, spark):
    placed = K.clustered_layout(engine.points, 3)
    q = K.layout_quality(placed, 0.01).first()
    assert 0 <= q.dispersion <= 1 and 0 <= q.overlap <= 1
    q = K.clustered_quality(placed).first()
    assert 0 < q.dispersion <= 1 and 0 <= q.overlap <= 1 and -1 <= q.silhouette <= 1
    m = K.ManagedLayout(spark)
    for x in "abc":
        m.add(x)
    first = {r.item_id: r.theta for r in m.reflow().collect()}
    assert m.remove("c") and not m.remove("zz") and not m.dirty
    m.mark_dirty("b")
    assert {r.item_id for r in m.reflow(only_dirty=True).collect()} == {"a", "b"} and first["a"] == 0


def test_monte_carlo_identities(engine):
    v = A.voronoi(engine.categories, 20_000).collect()
    assert sum(r.area for r in v) == pytest.approx(4 * math.pi)
    for r in v:
        assert all(r.cat_id in next(x for x in v if x.cat_id == j).neighbours for j in r.neighbours)
    whole = engine.spark.createDataFrame([(0, "w", 0.0, 0.0, 1.0, math.pi)], "cat_id int, category string, cx double, cy double, cz double, spread double")
    assert A.coverage(whole, 1000).first()[0] == pytest.approx(1.0, abs=1e-3)
    assert A.exclusivity(whole, 1000).first().exclusivity == 1.0
    half = whole.withColumn("spread", F.lit(math.pi / 2))
    assert A.coverage(half, 100_000).first()[0] == pytest.approx(0.5, abs=0.01)


def test_report_and_deviation(engine):
    for name, t in engine.navigator(samples=2000).items():
        assert t.count() >= 0, name
    assert A.deviation([(1, 0, 0), (0, 0, 1), (0, 1, 0)], engine.spark) == pytest.approx(math.pi / 2)
    assert A.deviation([(1, 0, 0), (0, 1, 0)], engine.spark) == 0.0


def test_engine_queries(engine, data):
    e = data[5].tolist()
    near = engine.nearest(e, 5).collect()
    assert near[0].ordinal == 5 and len(near) == 5
    assert engine.similar_above(e, 0.9).filter("ordinal = 5").count() == 1
    assert engine.drill_down("c1", e, 3).filter("category <> 'c1'").count() == 0
    assert engine.hierarchical_nearest(e, 4).count() == 4
    path = engine.concept_path("s-0000", "s-0004", 12).orderBy("step").collect()
    assert path[0].item_id == "s-0000" and path[-1].item_id == "s-0004"
    assert engine.concept_path("s-0000", "s-0001", 3).count() == 0  # another cluster
    with pytest.raises(KeyError):
        engine.concept_path("s-0000", "gone", 5)
    assert engine.category_neighbors("c0", 2).count() == 2
    assert {r.category for r in engine.stats().collect()} == {"c0", "c1", "c2", "c3"}
    assert engine.warnings() in ([], engine.warnings())
    assert sum(map(len, engine.domain_groups(2))) == 4
    assert engine.exported().count() == 160


def test_sources_and_sinks(spark, engine, corpus, tmp_path):
    with pytest.raises(ValueError):
        P.corpus_from_lists(spark, ["a"], [[1.0], [2.0]])
    with pytest.raises(ValueError):
        P.corpus_from_lists(spark, ["a"], [[float("nan")]])
    assert P.validate(corpus) == 16
    with pytest.raises(ValueError):
        P.validate(corpus.limit(2))
    with pytest.raises(ValueError):
        P.validate(corpus.withColumn("embedding", F.when(F.col("ordinal") == 3, F.array(F.lit(0.0))).otherwise(F.col("embedding"))))
    (tmp_path / "c.json").write_text(json.dumps({"categories": ["a", "b"], "embeddings": [[1, 2], [3, 4]]}))
    got = P.corpus_from_json(spark, str(tmp_path / "c.json")).collect()
    assert [(r.item_id, r.category, r.embedding) for r in got] == [("s-0000", "a", [1.0, 2.0]), ("s-0001", "b", [3.0, 4.0])]
    P.write_csv(engine.points, str(tmp_path / "csv"))
    line = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert line[0].startswith("item_id,category,r") and line[1].startswith('"s-')
    P.write_json(engine.points, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 160
    P.write_html(engine.points, str(tmp_path / "v.html"))
    assert (tmp_path / "v.html").read_text().startswith("<!doctype html>")
    with pytest.raises(ValueError):
        P.write_html(engine.points, str(tmp_path / "v.html"), limit=10)
    P.write_points(engine.points, str(tmp_path / "pts"), [0.5, 1.0])
    stored = spark.read.parquet(str(tmp_path / "pts"))
    plan = N.in_region(stored, G.Band(0.1, 0.5), 12, 6)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "sector_id" in plan.split("PartitionFilters: [")[1][:200]


def test_vector_table(spark, tmp_path):
    t = VS.VectorTable(spark, "t", 2, str(tmp_path))
    row = lambda i, v, **m: (i, v, m)
    schema = "id string, vector array<double>, metadata map<string,string>"
    t.upsert(spark.createDataFrame([row("a", [1.0, 0.0], category="x"), row("b", [0.0, 1.0]), row("c", [1.0, 1.0], category="y")], schema))
    t.upsert(spark.createDataFrame([row("b", [2.0, 0.1], category="z")], schema))
    assert t.count() == 3
    assert [r.id for r in t.page(0, 2).collect()] == ["a", "b"]
    assert [r.id for r in t.search([1.0, 0.0], 2).collect()] == ["a", "b"]
    t.set_payload(spark.createDataFrame([("a", {"n": "1", "category": "w"})], "id string, metadata map<string,string>"))
    assert t.get(["a", "zz"]).collect()[0].metadata == {"n": "1", "category": "w"}
    assert {r.item_id: r.category for r in t.corpus().collect()} == {"a": "w", "b": "z", "c": "y"}
    t.delete(["c", "zz"])
    assert t.fetch_all().count() == 2 and t.fetch_all(1).count() == 1
    pts = P.from_cartesian(spark.createDataFrame([("a", 1.0, 0.0, 0.0)], "item_id string, x double, y double, z double"))
    t.sync_projections(pts)
    assert t.get(["a"]).first().metadata[VS.R_KEY].startswith("1.0")
    with pytest.raises(VS.StoreError):
        t.upsert(spark.createDataFrame([row("d", [1.0])], schema))
    with pytest.raises(VS.StoreError):
        t.search([1.0], 1)


def test_features_metrics_and_tuner(engine, corpus, data, spark):
    f = T.corpus_features(corpus).first()
    cats = np.arange(160) % 4
    s = data @ data.T
    i, j = np.triu_indices(160, 1)
    same = cats[i] == cats[j]
    assert f.intra_cosine == pytest.approx(s[i, j][same].mean())
    assert f.inter_cosine == pytest.approx(s[i, j][~same].mean())
    assert f.category_entropy == pytest.approx(1.0)
    x = np.array([r.embedding for r in corpus.orderBy("ordinal").collect()])
    quiet = np.abs(x) <= 0.05
    assert f.sparsity == pytest.approx(1 - quiet.mean())
    medians = [np.sort(np.abs(r[q]))[q.sum() // 2] for r, q in zip(x, quiet, strict=True) if q.any()]
    assert f.noise == pytest.approx(np.mean(medians))
    used = (~quiet).sum(axis=0) / (~quiet).sum()
    assert f.axis_entropy == pytest.approx(-(used * np.log(used)).sum() / np.log(16))
    assert len(T.feature_vector(T.corpus_features(corpus))) == len(T.FEATURES) == 10
    assert 0 <= T.modularity(engine.points, 5).first()[0] <= 1
    assert 0 <= T.category_silhouette(engine.points).first()[0] <= 1
    metric = T.Composite((("a", 2.0, lambda b: b["x"]), ("b", 0.0, lambda b: 1 / 0), ("c", 1.0, lambda b: 1.0)))
    space = {"x": [0.1, 0.5, 0.9], "y": ["p", "q"]}
    report = T.auto_tune(lambda c: c, metric, space)
    assert report.best.config["x"] == 0.9 and len(report.trials) == 6
    assert [t.number for t in report.ranked()][:2] == [4, 5] and report.best.number == 5
    for strategy in ("random", "tpe"):
        one, two = (T.auto_tune(lambda c: c, metric, space, strategy, 12, 7) for _ in range(2))
        assert one == two and one.best.config["x"] == 0.9
    assert report.table(spark).count() == 6

    def build(c):
        if c["x"] < 0.5:
            raise RuntimeError("no")
        return c

    assert len(T.auto_tune(build, metric, space).failures) == 2
    with pytest.raises(T.AllTrialsFailed):
        T.auto_tune(lambda c: 1 / 0, metric, space)


def test_meta_models_and_records(tmp_path):
    records = [T.MetaRecord("a", [0.0, 1.0], {"k": 1}, 0.2), T.MetaRecord("b", [10.0, 1.0], {"k": 2}, 0.9)]
    assert T.MetaModel().fit(records).predict([1.0, 5.0]) == {"k": 1}
    assert T.WeightedMetaModel().fit(records).predict([5.0, 1.0]) == {"k": 2}
    assert records[0].adjusted(1.0, 0.25).score == pytest.approx(0.4)
    path = str(tmp_path / "r.json")
    assert T.load_raw(path) == []
    T.save_records(records[:1], path)
    T.append_records(records[1:], path)
    assert [r["corpus_id"] for r in T.load_raw(path)] == ["a", "b"]
    with pytest.raises(ValueError):
        T.MetaModel().fit([])


def cloud(spark, n, seed=1, repeats=0):
    """Points in a few dense spots, some strays and some at one place."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(n // 4, 3)), *(c + 0.02 * rng.normal(size=(n // 4, 3)) for c in np.eye(3))])
    x = np.concatenate([x, np.repeat(x[:1], repeats, axis=0)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    order = rng.permutation(len(x))
    rows = [(int(i), *map(float, p)) for i, p in zip(order, x, strict=True)]
    u = np.empty_like(x)
    u[order] = x
    return spark.createDataFrame(rows, "ordinal long, ux double, uy double, uz double").repartition(5), u


@pytest.mark.parametrize("target, repeats", [(1024, 0), (16, 0), (16, 40)])
def test_blocked_neighbours_equal_brute_force(monkeypatch, spark, target, repeats):
    monkeypatch.setattr(B, "TARGET", target)
    points, u = cloud(spark, 240, repeats=repeats)
    proxy = 1 - np.clip(u @ u.T, -1, 1)
    np.fill_diagonal(proxy, np.inf)
    want = {(i, j) for i in range(len(u)) for j in np.lexsort((np.arange(len(u)), np.round(proxy[i], 13)))[:5].tolist()}
    got = {(r.i, r.j) for r in B.neighbours(points, 5).collect()}
    assert len(got) == 5 * len(u)
    assert repeats or got == want
    apart = [[sorted(proxy[i, j] for a, j in pairs if a == i) for i in range(0, len(u), 7)] for pairs in (got, want)]
    np.testing.assert_allclose(*apart, atol=1e-9)
    d = np.arccos(np.clip(u @ u.T, -1, 1))
    assert B.close_pairs(points, 0.03).first()[0] == (d[np.triu_indices(len(u), 1)] < 0.03).sum()


def test_few_points_and_none(spark):
    points, _ = cloud(spark, 4)
    assert {(r.i, r.j) for r in B.neighbours(points, 9).collect()} == {(i, j) for i in range(4) for j in range(4) if i != j}
    assert N.neighbour_edges(points.limit(0), 3).count() == 0 == B.close_pairs(points.limit(0), 1.0).first()[0]


def test_batches_of_queries_in_blocks(monkeypatch, spark):
    points, _ = cloud(spark, 100)
    points = points.withColumn("item_id", F.concat(F.lit("p"), "ordinal"))
    asked = points.filter("ordinal % 9 = 0")
    whole = {tuple(r) for r in N.batch_nearest(asked, points, 4).collect()}
    monkeypatch.setattr(N, "QUERY_BLOCK", 5)
    assert {tuple(r) for r in N.batch_nearest(asked, points, 4).collect()} == whole and len(whole) == 48


def test_paths_on_the_executors_equal_those_on_the_driver(monkeypatch, spark):
    points, _ = cloud(spark, 120, 3)
    edge = N.neighbour_edges(points, 4).persist()
    for goal in (7, 55, 119):
        here = C.graph_path(edge, 0, goal)
        with monkeypatch.context() as m:
            m.setattr(C, "PATH_EDGES", 0)
            there = C.graph_path(edge, 0, goal)
        assert [v for v, _, _ in here] == [v for v, _, _ in there]
        assert not here or here[-1][2] == pytest.approx(there[-1][2])


def test_places_need_no_global_sort(monkeypatch, spark):
    for ranges in (1 << 14, 7):
        monkeypatch.setattr(L, "RANGES", ranges)
        values = [int(x) for x in np.random.default_rng(1).permutation(300) ** 2]
        df = spark.createDataFrame([(v, "ab"[v % 2]) for v in values], "v long, g string")
        rank = {v: i for i, v in enumerate(sorted(values))}
        assert {r.v: r.place for r in L.placed(df, [], "v").collect()} == rank
        for g in "ab":
            mine = sorted(v for v in values if "ab"[v % 2] == g)
            assert {r.v: (r.place, r.n) for r in L.placed(df, ["g"], "v").filter(F.col("g") == g).collect()} == {v: (i, len(mine)) for i, v in enumerate(mine)}
        assert L.at_places(df, "v", [0, 7, 299]) == {i: sorted(values)[i] for i in (0, 7, 299)}
    assert L.at_places(df.limit(0), "v", [0]) == {}


def test_forces_in_blocks_equal_those_in_one_place(monkeypatch, spark):
    points, u = cloud(spark, 60)
    whole = {r.ordinal: (r.ux, r.uy, r.uz) for r in K.force_layout(points, rounds=3).collect()}
    monkeypatch.setattr(K, "FORCE_ROWS", 10)
    parts = {r.ordinal: (r.ux, r.uy, r.uz) for r in K.force_layout(points, rounds=3).collect()}
    np.testing.assert_allclose([whole[i] for i in sorted(whole)], [parts[i] for i in sorted(whole)], atol=1e-9)
    p, heat = u.copy(), 1.0
    for _ in range(3):
        d = p[:, None] - p[None]
        p = p + heat * ((d / (np.square(d).sum(axis=2, keepdims=True) + 1e-6)).sum(axis=1) * 0.01 + (u - p) * 0.01)
        p /= np.linalg.norm(p, axis=1, keepdims=True)
        heat *= 0.95
    np.testing.assert_allclose([whole[i] for i in sorted(whole)], p, atol=1e-7)


def test_index_changes_and_cached_answers(spark, tmp_path):
    rows = P.lattice_points(spark.read.parquet("/root/testdata/sf0.001/orders.parquet")).limit(60).persist()
    index = PointIndex(spark, str(tmp_path / "ix"), [1.0, 2.0], 4, 2, capacity=2)
    assert index.is_empty() and index.count() == 0
    index.insert(rows)
    with pytest.raises(ValueError):
        index.insert(rows.limit(1))
    some = [r.item_id for r in rows.limit(3).collect()]
    shell = G.Shell(0.0, 1.5)
    before = index.query(shell).count()
    assert index.query(shell).count() == before and (index.hits, index.misses) == (1, 1)
    index.remove(spark.createDataFrame([(some[0],), ("none",)], "item_id string"))
    assert not index.has(some[0]) and index.count() == 59
    index.update(rows.filter(F.col("item_id") == some[1]).withColumn("r", F.lit(9.0)))
    assert index.get([some[1]]).first().r == 9.0 and index.count() == 59
    index.insert(rows.filter(F.col("item_id") == some[0]))
    assert index.count() == 60
    assert index.query(shell).count() == rows.filter((F.col("item_id") != some[1]) & (F.col("r") <= 1.5)).count()
    assert index.nearest((0, 0, 1), 5).count() == 5 and index.within((0, 0, 1), 0.5).count() == N.within(rows, (0, 0, 1), 0.5).count()
    assert len(index._cache) == 2
    with pytest.raises(ValueError):
        PointIndex(spark, str(tmp_path), theta_parts=0)


def test_shells_prune_and_lose_nothing():
    bounds = [0.5, 1.0, 2.0]
    of = lambda r: min(sum(r >= b for b in bounds), 2)
    for region in (G.Shell(0.7, 1.2), G.Intersection((G.Shell(0.1, 5.0), G.Shell(0.9, 1.1), G.Band(0.1, 0.2))), G.Union((G.Shell(0.1, 0.2), G.Shell(1.5, 1.6)))):
        numbers, (lo, hi) = region.shells(bounds), region.radii()
        assert all(of(r) in numbers for r in np.linspace(lo, hi, 50))
    assert G.Band(0.1, 0.2).shells(bounds) is None and G.Union((G.Shell(1, 2), G.Band(0.1, 0.2))).radii() is None
    assert G.Intersection((G.Shell(0.1, 0.2), G.Shell(1.5, 1.6))).shells(bounds) == []


def test_inner_projections_and_drill_down(spark):
    rng = np.random.default_rng(6)
    names, rows = [], []
    for c in range(3):  # each category lives in three axes of its own
        for _ in range(30):
            v = np.zeros(12)
            v[c * 4 : c * 4 + 3] = rng.normal(size=3)
            names.append(f"c{c}")
            rows.append((v + 0.01 * rng.normal(size=12)).tolist())
    corpus = P.corpus_from_lists(spark, names + ["small"] * 5, rows + [rng.normal(size=12).tolist() for _ in range(5)])
    e = Engine.build(corpus)
    stats = {r.category: r for r in e.inner_spheres().collect()}
    assert set(stats) == {"c0", "c1", "c2"} and all(r.projection == "pca" and r.improvement >= 0.1 for r in stats.values())
    x = np.array(rows[:30])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
    assert stats["c0"].inner_explained == pytest.approx(s[:3].sum() / s.sum())
    near = e.drill_down("c0", rows[4], 3).collect()
    assert near[0].ordinal == 4 and near[0].used_inner and near[0].distance < 1e-6
    outer = e.drill_down("small", rows[4], 3).collect()
    assert len(outer) == 3 and not outer[0].used_inner
    assert J.inner_points(corpus, e.inner["c1"]).filter("abs(r - 1) > 1e-12").count() == 0
    assert Engine.build(corpus, Config(inner_kernel_rows=30, inner_kernel_gain=-1.0)).inner["c0"].model.kind == "kernel_pca"
    assert e.hierarchical_nearest(rows[4], 4).count() == 4


def test_other_projections_and_radii(corpus, data):
    m = J.fit(corpus, "random")
    np.testing.assert_allclose(coordinates(m.transform(corpus)), data @ P.matrix(16).T, atol=1e-9)
    flat = Engine.build(corpus, Config(fit={"volumetric": False}, radial=2.0))
    assert flat.points.filter("abs(r - 2) > 1e-12").count() == 0
    grown = Engine.build(corpus, Config(projection="random", radial=lambda r: f"ln(1 + {r})"))
    assert grown.points.filter("abs(r - ln(1 + intensity)) > 1e-12").count() == 0
    volume = Engine.build(corpus)
    assert volume.points.filter("abs(r - proj_mag) > 1e-9").count() == 0
    with pytest.warns(UserWarning, match="20 of 160"):
        J.KernelPca.fit(corpus, cap=20)


def test_more_of_the_engine(engine, data, spark):
    e = data[5].tolist()
    assert engine.has_id("s-0003") and not engine.has_id("zz") and engine.has_category("c1") and not engine.has_category("zz")
    assert engine.num_items() == 160 and engine.unique_categories() == ["c0", "c1", "c2", "c3"]
    assert engine.nearest(json.dumps(e), 3).first().ordinal == 5
    plain, weighted = engine.categories_near(e, 4.0).collect(), engine.categories_near(e, 4.0, weighted=True).collect()
    assert [r.cat_id for r in plain] == [r.cat_id for r in weighted] and all(w.effective >= p.distance for p, w in zip(plain, weighted, strict=True))
    assert engine.quality().count() == 160
    assert engine.distance_between("s-0001", "s-0001") == pytest.approx(0, abs=1e-9)
    assert engine.distance_between("s-0001", "s-0002", "great_circle", 2.0) == pytest.approx(2 * engine.distance_between("s-0001", "s-0002"))
    assert engine.query({"distance_between": {"a": "s-0001", "b": "s-0002", "metric": "chord"}}) > 0
    assert engine.query({"within_cap": {"theta": 0.3, "phi": 1.0, "half_angle": 3.0, "limit": 4}}).count() == 4
    stats = engine.stats().collect()
    assert sum(r.area for r in stats) == pytest.approx(4 * math.pi) and all(r.efficiency == pytest.approx(r.members / r.area) for r in stats if r.area)
    path = engine.category_path("c0", "c2").orderBy("step").collect()
    rows = {(r.src, r.dst): r for r in engine.graph.collect()}
    whole = 1.0
    for a, b in zip(path, path[1:], strict=False):
        edge = rows[a.cat_id, b.cat_id]
        sure = min(1.0, edge.max_strength * edge.territorial * (1.2 if b.cat_id in engine.cells[a.cat_id] else 1.0))
        assert a.hop_confidence == pytest.approx(sure) and len(a.bridges_to_next) <= 3
        whole *= max(sure, 0.01)
    assert path[-1].hop_confidence == 0 and path[0].path_confidence == pytest.approx(whole)
    assert engine.path_deviation("c0", "c2") >= 0
    assert engine.bridge_items("c0", "c1", 2).count() <= 2
    engine.register_views("t_")
    assert spark.sql("SELECT count(*) FROM t_points WHERE orrery_angular_distance(ux, uy, uz, 0, 0, 1) <= 4").first()[0] == 160
    embedder = TextEmbedder(lambda t: [float(len(t)), 1.0])
    df = spark.createDataFrame([("abc",), (None,)], "t string")
    assert [r[0] for r in df.select(embedder.column("t")).collect()] == [[3.0, 1.0], None]
    with pytest.raises(ValueError):
        TextEmbedder().embed("x")
    for bad in ('["a"]', "[]", '{"a": 1}'):
        with pytest.raises(ValueError):
            P.vector_from_json(bad)


def test_tuning_and_meta_models_build_engines(spark, tmp_path):
    corpus = P.stress_corpus(spark, 3, 12, 24).cache()
    space = {"projection": ["pca", "random"], "groups": [2], "sigma": [0.5, 1.0]}
    assert T.cardinality(space) == 2 == len(list(T.grid(space)))
    assert T.cardinality({"projection": ["pca", "laplacian"], "k": [5, 10, 15], "groups": [1, 2]}) == 8
    engine, report = Engine.tuned(corpus, space, lambda e: e.explained, budget=4)
    assert engine.config.projection == report.best.config["projection"] == "random"
    record = T.MetaRecord.from_report("c", T.feature_vector(T.corpus_features(corpus)), report, "explained", "grid").at("7")
    T.save_records([record], str(tmp_path / "m.json"))
    (back,) = T.load_records(str(tmp_path / "m.json"))
    assert back == record and back.timestamp == "7"
    model = T.MetaModel().fit([back])
    again, features = Engine.from_meta(corpus, model)
    assert again.config.projection == "random" and features == record.features
    assert Engine.tuned(corpus, {"groups": [3]}, lambda e: 1.0, model=model)[0].config.projection == "random"
    small = Engine.build(corpus, Config(samples=500))
    for composite in (T.default_composite(), T.connectivity_composite()):
        assert 0 <= composite(small) <= 1 and len(composite.components(small)) == 3
    log = T.FeedbackLog(str(tmp_path / "f.jsonl"), most=2)
    for score in (0.0, 0.4, 3.0):
        log.record(T.FeedbackEvent.now("c", "q", score))
    assert tuple(log.summary(spark).first()) == ("c", 2, 0.7, 0.4, 1.0)
    with pytest.raises(ValueError):
        P.corpus_from_lists(spark, ["a"], [[float("inf")]])
    table = spark.createDataFrame([("x", None, [1.0, 2.0]), ("y", "k", [0.0, 1.0])], "key string, kind string, v array<float>")
    got = {r.item_id: r.category for r in P.corpus_from_rows(table, "key", "kind", "v").collect()}
    assert got == {"x": "unknown", "y": "k"}


def test_late_events_are_judged_in_their_place(spark, tmp_path):
    schema = "event_id long, item_id string, ts timestamp, r double, theta double, phi double, ux double, uy double, uz double"
    at = lambda minute: datetime(2024, 1, 1, 0, minute)
    row = lambda i, item, minute, r: (i, item, at(minute), float(r), 0.0, 1.0, 1.0, 0.0, 0.0)
    files = [[row(1, "a", 0, 1), row(2, "a", 20, 5), row(3, "b", 21, 1)], [row(4, "a", 10, 5), row(5, "a", 30, 1)], [row(6, "z", 59, 9)], [row(7, "z", 59, 9)]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
        time.sleep(1.1)
    stream = ST.read_events(spark, str(tmp_path / "in*"), spark.read.parquet(str(tmp_path / "in0")).schema, 1)
    got = ST.finished(ST.transitions(stream, G.Shell(0.0, 2.0), "15 minutes"), "late")
    changes = sorted((r.item_id, r.ts.minute, r.change) for r in got.collect())
    assert changes == [("a", 0, "entered"), ("a", 10, "left"), ("a", 30, "entered"), ("b", 21, "entered")]


def test_streams_agree_with_batches(spark, tmp_path):
    events = ST.spatial_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    region = G.Intersection((G.Band(0.5, 2.3), G.Shell(0.2, 6.0)))
    events.write.parquet(str(tmp_path / "in"))
    stream = ST.read_events(spark, str(tmp_path / "in"), events.schema, 1)
    for name, f in (("entered", ST.entered), ("left", ST.left)):
        q = f(stream, region).writeStream.format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        assert {r.event_id for r in spark.table(name).collect()} == {r.event_id for r in f(events, region).collect()} != set()


def test_catalog_pairs_every_query(spark, sf):
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
    assert catalog.QUERIES["knn_point"](spark, sf).count() == 10
