"""The engine: a corpus, its projection, its points and its categories, and queries.

``Engine.build`` fits what has to be fitted and plans the rest; tables are computed
when they are read.  Typed queries can also be given as dictionaries (``query``), in
the shape of an API request.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import regions as G
from orrery.functions import sphere as S
from orrery.operators import analytics as A
from orrery.operators import categories as C
from orrery.operators import clusters as K
from orrery.operators import knn as N
from orrery.operators import projections as J
from orrery.operators import tuning as T
from orrery.sources import points as P
from orrery.sources import store as VS
from orrery.sources.tables import once


@dataclass(frozen=True)
class Config:
    projection: str = "pca"
    bridge_base: float = 0.5
    bridge_penalty: float = 0.4
    overlap_below: float = 0.3
    low_evr: float = 0.35
    groups: int = 5
    samples: int = 20_000
    min_certainty: float = 0.0
    min_combined: float = 0.0
    inner_min_rows: int = 20
    inner_min_gain: float = 0.10
    inner_kernel_rows: int = 80
    inner_kernel_gain: float = 0.05
    sharpness: float = 4.0
    radial: object = "magnitude"
    fit: dict = field(default_factory=dict)

    @classmethod
    def from_dict(cls, given: dict) -> Config:
        """Missing entries keep their defaults; unknown ones are refused."""
        return cls(**given)


class TextEmbedder:
    """Turns texts into vectors; without a function every use is an error."""

    def __init__(self, f=None) -> None:
        self.f = f

    def embed(self, text: str) -> list[float]:
        if self.f is None:
            raise ValueError("no embedder is configured")
        return [float(x) for x in self.f(text)]

    def column(self, text: str) -> Column:
        """The vectors of a column of texts, on the executors, a batch at a time."""
        f = self.f

        @F.pandas_udf("array<double>")
        def run(texts: pd.Series) -> pd.Series:
            if f is None:
                raise ValueError("no embedder is configured")
            return texts.map(lambda t: None if t is None else [float(x) for x in f(t)])

        return run(text)


class Engine:
    def __init__(self, corpus: DataFrame, model, config: Config, embedder: TextEmbedder) -> None:
        self.corpus, self.model, self.config, self.embedder = corpus, model, config, embedder
        self.spark: SparkSession = corpus.sparkSession

    @classmethod
    def build(cls, corpus: DataFrame, config: Config | None = None, embedder: TextEmbedder | None = None) -> Engine:
        config = config or Config()
        P.validate(corpus)
        return cls(corpus, J.fit(corpus.select("ordinal", "embedding"), config.projection, **config.fit), config, embedder or TextEmbedder())

    # Tables

    @cached_property
    def points(self) -> DataFrame:
        """The projected table.  A volumetric PCA places a row at its projected length, others as ``radial`` says."""
        radius = "proj_mag" if getattr(self.model, "volumetric", False) else P.placed_radius(self.config.radial)
        return once(P.from_cartesian(self.model.transform(self.corpus), radius).drop("embedding"), "points")

    @cached_property
    def categories(self) -> DataFrame:
        """One row a category; its cap is around the projection of its mean vector."""
        mean = C.summaries(self.corpus.join(self.points.select("ordinal", "ux", "uy", "uz"), "ordinal"), dim=self.dimension)
        rows = mean.select("cat_id", "category", "members", "centroid", F.col("centroid").alias("embedding"))
        placed = P.from_cartesian(self.model.transform(rows)).select("cat_id", "category", "members", "centroid", "theta", "phi", F.col("ux").alias("cx"), F.col("uy").alias("cy"), F.col("uz").alias("cz"))
        angle = F.avg(F.expr(S.angular(S.vec("u"), S.vec("c")))).alias("s")
        spread = self.points.select("category", "ux", "uy", "uz").join(placed.select("category", "cx", "cy", "cz"), "category").groupBy("category").agg(angle)
        out = placed.join(spread, "category").withColumn("spread", F.when(F.col("members") > 1, F.col("s")).otherwise(0.0)).withColumn("cohesion", 1 / (1 + F.col("spread"))).drop("s")
        return once(out, "categories")

    @cached_property
    def exclusivity(self) -> dict[int, float]:
        return {r.cat_id: r.exclusivity for r in A.exclusivity(self.categories, self.config.samples).collect()}

    @cached_property
    def voronoi(self) -> DataFrame:
        return once(A.voronoi(self.categories, self.config.samples), "cells")

    @cached_property
    def cells(self) -> dict[int, list[int]]:
        return {r.cat_id: list(r.neighbours) for r in self.voronoi.collect()}

    @cached_property
    def bridges(self) -> DataFrame:
        threshold = self.config.bridge_base + (1 - self.explained) ** 2 * self.config.bridge_penalty
        return C.bridges(self.corpus, self.categories, threshold, self.exclusivity, self.config.overlap_below)

    @cached_property
    def graph(self) -> DataFrame:
        return once(C.edges(self.categories, self.bridges, {(i, j) for i, js in self.cells.items() for j in js}, self.exclusivity), "edges")

    @cached_property
    def inner(self) -> dict[str, J.Inner]:
        """The categories with a projection of their own."""
        c = self.config
        return J.inner_models(self.corpus, self.points.select("category", "certainty"), c.inner_min_rows, c.inner_min_gain, c.inner_kernel_rows, c.inner_kernel_gain)

    @cached_property
    def _edges_of(self) -> dict[int, DataFrame]:
        return {}

    def neighbour_graph(self, k: int) -> DataFrame:
        """The k-NN graph, made once for each ``k``."""
        if k not in self._edges_of:
            self._edges_of[k] = once(N.neighbour_edges(self.points, k), "graph")
        return self._edges_of[k]

    @cached_property
    def dimension(self) -> int:
        return self.corpus.select(F.size("embedding")).first()[0]

    @property
    def explained(self) -> float:
        return self.model.explained

    def warnings(self) -> list[tuple[str, str]]:
        """Severity and message, where the projection keeps little of the variance."""
        e = self.explained
        for bound, severity in ((0.15, "critical"), (0.25, "high"), (self.config.low_evr, "moderate")):
            if e < bound:
                return [(severity, f"the projection explains {e:.1%} of the variance")]
        return []

    def exported(self) -> DataFrame:
        return P.exported(self.points)

    def stats(self) -> DataFrame:
        """The categories with their territory and the quality of their bridges; ``inner_spheres`` is the second table."""
        own = self.spark.createDataFrame(list(self.exclusivity.items()), "cat_id int, exclusivity double")
        out = self.categories.join(C.bridge_quality(self.graph), "cat_id", "left").join(own, "cat_id").join(self.voronoi.select("cat_id", "area"), "cat_id")
        efficiency = F.when(F.col("area") > 1e-15, F.col("members") / F.col("area")).otherwise(0.0)
        return out.select("cat_id", "category", "members", "spread", "cohesion", F.coalesce("quality", F.lit(0.0)).alias("bridge_quality"), "exclusivity", "area", efficiency.alias("efficiency"))

    def has_id(self, item_id: str) -> bool:
        return bool(self.corpus.filter(F.col("item_id") == item_id).take(1))

    def has_category(self, category: str) -> bool:
        return bool(self.corpus.filter(F.col("category") == category).take(1))

    def num_items(self) -> int:
        return self.corpus.count()

    def unique_categories(self) -> list[str]:
        return [r.category for r in self.categories.orderBy("cat_id").select("category").collect()]

    def register_views(self, prefix: str = "") -> None:
        """The tables and functions for SQL: ``points``, ``categories``, ``bridges``, ``category_edges``."""
        for name, table in (("points", self.points), ("categories", self.categories), ("bridges", self.bridges), ("category_edges", self.graph)):
            table.createOrReplaceTempView(prefix + name)
        S.register(self.spark)

    # Queries

    def vector(self, query) -> list[float]:
        """A query as a vector: numbers, a JSON array of them, or a text through the embedder."""
        if isinstance(query, str):
            v = P.vector_from_json(query) if query.lstrip().startswith("[") else self.embedder.embed(query)
        else:
            v = [float(x) for x in query]
        if len(v) != self.dimension or not np.isfinite(v).all():
            raise ValueError(f"a query needs {self.dimension} finite numbers")
        return v

    def _placed(self, query, model=None):
        row = self.spark.createDataFrame([(0, self.vector(query))], "ordinal long, embedding array<double>")
        return P.from_cartesian((model or self.model).transform(row)).first()

    def direction(self, query, model=None) -> tuple[float, float, float]:
        """The direction of a query under the projection, or under another."""
        row = self._placed(query, model)
        return row.ux, row.uy, row.uz

    def _kept(self, rows: DataFrame) -> DataFrame:
        """Quality columns, and the floors applied after the limit."""
        combined = F.expr(S.quality(S.num(self.explained), "certainty"))
        out = rows.withColumn("combined", combined).withColumn("level", F.expr(S.quality_level("combined")))
        return out.filter((F.col("certainty") >= self.config.min_certainty) & (F.col("combined") >= self.config.min_combined))

    def nearest(self, query, k: int = 5, max_distance: float | None = None) -> DataFrame:
        return self._kept(N.nearest(self.points, self.direction(query), k, max_distance))

    def similar_above(self, query, similarity: float) -> DataFrame:
        return self._kept(N.within(self.points, self.direction(query), float(np.arccos(np.clip(similarity, -1, 1)))))

    def in_region(self, region: G.Region) -> DataFrame:
        return N.in_region(self.points, region)

    def drill_down(self, category: str, query, k: int = 5) -> DataFrame:
        """The nearest rows of one category, by its own projection where it has one (``used_inner``)."""
        model = self.inner.get(category)
        if model is None:
            return C.drill_down(self.points, category, self.direction(query), k).withColumn("used_inner", F.lit(False))
        near = C.drill_down(J.inner_points(self.corpus, model), category, self.direction(query, model.model), k)
        return near.drop("embedding").withColumn("used_inner", F.lit(True))

    def categories_near(self, query, max_angle: float, weighted: bool = False) -> DataFrame:
        """The categories within an angle of a query; ``weighted`` puts those of uncertain queries farther away."""
        row = self._placed(query)
        t = (row.ux, row.uy, row.uz)
        return C.near_weighted(self.categories, t, row.certainty, max_angle) if weighted else C.near_direction(self.categories, t, max_angle)

    def quality(self) -> DataFrame:
        """Each row's quality signal with its distance to the nearest cap."""
        rows = self.points.select("ordinal", "item_id", "certainty").join(A.void_distance(self.points, self.categories), "ordinal")
        signal = F.expr(S.void_quality(S.num(self.explained), "certainty", "void_distance", S.num(self.config.sharpness)))
        return rows.withColumn("combined", signal).withColumn("level", F.expr(S.quality_level("combined")))

    def distance_between(self, a: str, b: str, metric: str = "angular", radius: float = 1.0) -> float:
        """The distance of two rows: angular, great_circle, chord or euclidean."""
        found = {r.item_id: r for r in self.points.filter(F.col("item_id").isin(a, b)).collect()}
        for i in (a, b):
            if i not in found:
                raise KeyError(i)
        p, q = ((r.ux, r.uy, r.uz) if metric in ("angular", "great_circle") else (r.x, r.y, r.z) for r in (found[a], found[b]))
        how = {"angular": lambda: S.angular(S.literal(p), S.literal(q)), "great_circle": lambda: S.great_circle(S.literal(p), S.literal(q), S.num(radius)), "chord": lambda: S.chord(S.literal(p), S.literal(q)), "euclidean": lambda: S.euclidean(S.literal(p), S.literal(q))}
        if metric not in how:
            raise ValueError(f"no metric {metric!r}")
        return self.spark.range(1).select(F.expr(how[metric]())).first()[0]

    def hybrid(self, query, final_k: int = 5, recall_k: int = 20) -> DataFrame:
        v = self.vector(query)
        return VS.hybrid_search(self.points, self.corpus, self.direction(query), v, final_k, recall_k)

    def domain_groups(self, target: int | None = None) -> list[list[int]]:
        over = A.overlaps(self.categories).collect()
        area = {r.cat_id: r.area for r in A.cap_areas(self.categories).collect()}
        sim = {(i, j): 0.5 for i, js in self.cells.items() for j in js if i < j}
        for r in over:
            if min(area[r.a], area[r.b]) > 1e-15:
                sim[r.a, r.b] = sim.get((r.a, r.b), 0.0) + 0.5 * min(1.0, r.area / min(area[r.a], area[r.b]))
        return C.domain_groups(sim, len(area), target or self.config.groups)

    def hierarchical_nearest(self, query, k: int = 5) -> DataFrame:
        """Where little variance is explained: only within the nearest group of categories."""
        if self.explained >= self.config.low_evr:
            return self.nearest(query, k)
        t = self.direction(query)
        cats = {r.cat_id: r for r in self.categories.select("cat_id", "category", "members", "cx", "cy", "cz").collect()}

        def apart(group: list[int]) -> float:
            c = sum(np.array([cats[i].cx, cats[i].cy, cats[i].cz]) * cats[i].members for i in group)
            return -float(c @ np.array(t)) / max(float(np.linalg.norm(c)), 1e-15)

        names = [cats[i].category for i in min(self.domain_groups(), key=apart)]
        found = None
        for name in names:
            near = self.drill_down(name, query, k).select("item_id", "ordinal", "category", "distance", "used_inner")
            found = near if found is None else found.union(near)
        rows = found.join(self.points.drop("item_id", "category"), "ordinal")
        best = self._kept(rows).orderBy("distance", "ordinal").limit(k)
        return best if best.take(1) else self.nearest(query, k)

    def concept_path(self, source: str, target: str, k: int = 10, bridged: bool = False) -> DataFrame:
        """Steps of the shortest path between two rows over the k-NN graph; empty without one.

        ``bridged`` weighs hops between categories by their bridges.
        """
        ids = {r.item_id: (r.ordinal, r.category) for r in self.points.filter(F.col("item_id").isin(source, target)).select("item_id", "ordinal", "category").collect()}
        for i in (source, target):
            if i not in ids:
                raise KeyError(i)
        edge = self.neighbour_graph(k)
        path = C.graph_path(self._bridged(edge) if bridged else edge, ids[source][0], ids[target][0])
        steps = self.spark.createDataFrame([(n, int(v), float(h), float(t)) for n, (v, h, t) in enumerate(path)], "step int, ordinal long, hop double, cumulative double")
        return steps.join(self.points.select("ordinal", "item_id", "category"), "ordinal").orderBy("step")

    def _bridged(self, edge: DataFrame) -> DataFrame:
        label = self.points.select("ordinal", "category").join(self.categories.select("category", "cat_id"), "category").select("ordinal", "cat_id")
        # Both directions count; of equally strong bridges, that of the first category.
        order = F.max(F.struct("strength", -F.col("source"), "kind"))
        best = self.bridges.groupBy(F.least("source", "target").alias("ca"), F.greatest("source", "target").alias("cb")).agg(order.alias("b"))
        e = edge.join(label.select(F.col("ordinal").alias("src"), F.col("cat_id").alias("cs")), "src").join(label.select(F.col("ordinal").alias("dst"), F.col("cat_id").alias("cd")), "dst")
        e = e.withColumns({"ca": F.least("cs", "cd"), "cb": F.greatest("cs", "cd")}).join(best, ["ca", "cb"], "left")
        hop = F.expr(S.hop_weight("distance", "coalesce(b.strength, 0.0)", "coalesce(b.kind, 'weak')"))
        return e.select("src", "dst", F.when(F.col("cs") == F.col("cd"), F.col("distance")).otherwise(F.greatest(hop, F.lit(0.0))).alias("distance"))

    def _cat(self, name: str) -> int:
        row = self.categories.filter(F.col("category") == name).select("cat_id").first()
        if row is None:
            raise KeyError(name)
        return row.cat_id

    def category_path(self, source: str, target: str) -> DataFrame:
        return C.category_path(self.graph, self._cat(source), self._cat(target), self.bridges)

    def path_deviation(self, source: str, target: str) -> float:
        """How far the centres on the way lie from the direct arc."""
        way = [r.cat_id for r in self.category_path(source, target).orderBy("step").collect()]
        at = {r.cat_id: (r.cx, r.cy, r.cz) for r in self.categories.select("cat_id", "cx", "cy", "cz").collect()}
        return A.deviation([at[i] for i in way], self.spark)

    def bridge_items(self, source: str, target: str, most: int = 10) -> DataFrame:
        return C.bridge_items(self.bridges, self._cat(source), self._cat(target), most)

    def category_neighbors(self, name: str, k: int = 5) -> DataFrame:
        return C.neighbours_of(self.graph, self._cat(name), k)

    def globs(self, k: int | None = None, max_k: int = 10) -> DataFrame:
        return K.globs(self.points, k, max_k)

    def local_manifold(self, query, k: int = 10) -> dict:
        return K.local_plane(self.points, self.direction(query), k)

    def inner_spheres(self) -> DataFrame:
        return J.inner_stats(self.corpus, self.inner)

    def has_inner_sphere(self, category: str) -> bool:
        return category in self.inner

    def navigator(self, radius: float = 0.5, samples: int | None = None) -> dict[str, DataFrame]:
        return A.full_report(self.points, self.categories, self.bridges, self.graph, radius, samples or self.config.samples)

    # From experience

    @classmethod
    def from_meta(cls, corpus: DataFrame, model: T.MetaModel, base: Config | None = None) -> tuple[Engine, list[float]]:
        """An engine with the configuration that a meta-model predicts, and the corpus features it went by."""
        features = T.feature_vector(T.corpus_features(corpus))
        return cls.build(corpus, replace(base or Config(), **model.predict(features))), features

    @classmethod
    def tuned(cls, corpus: DataFrame, space: dict, metric, strategy: str = "grid", budget: int = 24, base: Config | None = None, model: T.MetaModel | None = None) -> tuple[Engine, T.TuneReport]:
        """The best engine of a search; it starts from the prediction of a meta-model where there is one.

        Configurations that differ only after the projection share the fitted one.
        """
        base = base or Config()
        if model is not None:
            base = replace(base, **model.predict(T.feature_vector(T.corpus_features(corpus))))
        fitted: dict = {}

        def build(config: dict) -> Engine:
            own = {k: v for k, v in config.items() if k in Config.__dataclass_fields__}
            fit = {k: v for k, v in config.items() if k not in own}
            c = replace(base, **own, fit=base.fit | fit)
            key = (c.projection, tuple(sorted(c.fit.items())))
            if key not in fitted:
                fitted[key] = cls.build(corpus, c)
            engine = cls(corpus, fitted[key].model, c, fitted[key].embedder)
            engine.__dict__["points"] = fitted[key].points
            return engine

        report = T.auto_tune(build, metric, space, strategy, budget)
        return build(report.best.config), report

    def query(self, request: dict):
        """One request of the form ``{"nearest": {"query": ..., "k": 5}}``."""
        if len(request) != 1:
            raise ValueError("exactly one query must be given")
        ((kind, how),) = ((k, dict(v)) for k, v in request.items())
        known = {"nearest", "similar_above", "concept_path", "globs", "local_manifold", "category_path", "category_neighbors", "drill_down", "hierarchical_nearest", "hybrid", "stats", "distance_between", "categories_near", "domain_groups"}
        if kind in ("in_region", "within_cone", "within_cap", "within_shell", "within_band", "within_wedge"):
            limit = how.pop("limit", None) if isinstance(how, dict) and kind != "in_region" else None
            found = self.in_region(G.from_dict(how if kind == "in_region" else {kind.removeprefix("within_"): how}))
            return found if limit is None else found.orderBy("ordinal").limit(limit)
        if kind not in known:
            raise ValueError(f"no query {kind!r}")
        return getattr(self, kind)(**how)
