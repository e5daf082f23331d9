"""Spherical analytics over points and category caps.

Caps are rows ``cat_id, category, cx, cy, cz, spread``.  Monte Carlo estimates use
the lattice of the golden angle, so they are the same in every run.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import sphere as S
from orrery.sources.points import GOLDEN
from orrery.sources.tables import evaluated


def cap_areas(caps: DataFrame) -> DataFrame:
    return caps.select("cat_id", "category", "spread", F.expr(S.cap_area("spread")).alias("area"))


def overlaps(caps: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of caps that share area, the largest first."""
    a = caps.select(F.col("cat_id").alias("a"), F.col("spread").alias("sa"), *(F.col(f"c{c}").alias(f"p{c}") for c in "xyz"))
    b = caps.select(F.col("cat_id").alias("b"), F.col("spread").alias("sb"), *(F.col(f"c{c}").alias(f"q{c}") for c in "xyz"))
    pairs = a.join(b, F.col("a") < F.col("b")).withColumn("d", F.expr(S.angular(S.vec("p"), S.vec("q"))))
    return pairs.select("a", "b", F.col("d").alias("distance"), F.expr(S.cap_overlap("d", "sa", "sb")).alias("area")).filter("area > 1e-15").orderBy(F.desc("area"), "a", "b")


def overlap_bridges(caps: DataFrame, found: DataFrame) -> DataFrame:
    """Overlapping pairs with their bridges of both directions; area a bridge, infinite without."""
    n = found.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.count("*").alias("bridges"))
    out = overlaps(caps).join(n, ["a", "b"], "left").fillna(0, ["bridges"])
    return out.withColumn("ratio", F.when(F.col("bridges") > 0, F.col("area") / F.col("bridges")).otherwise(F.lit(float("inf"))))


def triples(caps: DataFrame) -> DataFrame:
    """``a < b < c`` with the spherical excess of each triangle of centres."""
    side = [caps.select(F.col("cat_id").alias(n), *(F.col(f"c{c}").alias(f"{n}{c}") for c in "xyz")) for n in "abc"]
    t = side[0].join(side[1], F.col("a") < F.col("b")).join(side[2], F.col("b") < F.col("c"))
    t = t.withColumns({"ab": F.expr(S.angular(S.vec("a"), S.vec("b"))), "bc": F.expr(S.angular(S.vec("b"), S.vec("c"))), "ca": F.expr(S.angular(S.vec("c"), S.vec("a")))})
    return t.select("a", "b", "c", F.expr(S.excess("ab", "bc", "ca")).alias("excess"))


def top_triples(caps: DataFrame, n: int) -> DataFrame:
    """The ``n`` triangles with the largest excess."""
    return triples(caps).orderBy(F.desc("excess"), "a", "b", "c").limit(n)


def curvature(caps: DataFrame) -> DataFrame:
    """The excesses of the triangles at each category, in rising order; their mean, least and largest."""
    t = triples(caps)
    per = t.select(F.explode(F.array("a", "b", "c")).alias("cat_id"), "excess").groupBy("cat_id")
    return per.agg(F.count("*").alias("triangles"), F.avg("excess").alias("mean"), F.min("excess").alias("least"), F.max("excess").alias("largest"), F.sort_array(F.collect_list("excess")).alias("excesses"))


def coherence(points: DataFrame, centre, radius: float) -> DataFrame:
    """One row ``coherence``: the density within ``radius`` of a direction against that of the whole sphere."""
    inside = F.expr(S.angular(S.vec("u"), S.literal(centre))) <= radius
    return points.agg((F.avg(F.when(inside, 1.0).otherwise(0.0)) / ((1 - math.cos(radius)) / 2)).alias("coherence"))


def antipodal(points: DataFrame, caps: DataFrame, radius: float) -> DataFrame:
    """What lies opposite each category: rows, coherence and the commonest category.

    Coherence is the density there against that of the whole sphere; of equally
    common categories the first by name counts.
    """
    n = points.count()
    far = caps.select("cat_id", *((-F.col(f"c{c}")).alias(f"q{c}") for c in "xyz"))
    near = points.select("category", "ux", "uy", "uz").crossJoin(far).filter(F.expr(S.angular(S.vec("u"), S.vec("q"))) <= radius)
    per = near.groupBy("cat_id", "category").agg(F.count("*").alias("c"))
    top = W.partitionBy("cat_id").orderBy(F.desc("c"), "category")
    per = per.withColumn("k", F.row_number().over(top))
    out = per.groupBy("cat_id").agg(F.sum("c").alias("items"), F.max(F.when(F.col("k") == 1, F.col("category"))).alias("dominant"))
    expected = (1 - math.cos(radius)) / 2
    return far.select("cat_id").join(out, "cat_id", "left").select("cat_id", F.coalesce("items", F.lit(0)).alias("items"), "dominant", (F.coalesce("items", F.lit(0)) / (n * expected)).alias("coherence"))


def sweep(points: DataFrame, start, end, epsilon: float) -> DataFrame:
    """Points within ``epsilon`` of the arc, nearest first.

    Products with the arc's normal and ends, computed once, tell most points apart.
    """
    n = [start[i] * end[j] - start[j] * end[i] for i, j in ((1, 2), (2, 0), (0, 1))]
    size = math.sqrt(sum(x * x for x in n))
    if size > 1e-15:
        dots = {f"_{k}": F.expr(S.dot(S.vec("u"), S.literal(v))) for k, v in (("n", [x / size for x in n]), ("a", start), ("b", end))}
        near = (F.abs(F.col("_n")) <= math.sin(min(epsilon, math.pi / 2)) + 1e-9) | (F.greatest("_a", "_b") >= math.cos(min(epsilon, math.pi)) - 1e-9)
        points = evaluated(points, dots).filter(near).drop(*dots)
    return evaluated(points, {"distance": F.expr(S.arc_distance(S.vec("u"), start, end))}).filter(F.col("distance") <= epsilon).orderBy("distance", "ordinal")


def sweep_report(points: DataFrame, cats: DataFrame, a: int, b: int, epsilon: float, places: int = 10) -> DataFrame:
    """One row for the arc between two categories: its length, the rows near it, how many are near each of its places, and the part of the places without any."""
    ends = {r.cat_id: (r.cx, r.cy, r.cz) for r in cats.filter(F.col("cat_id").isin(a, b)).select("cat_id", "cx", "cy", "cz").collect()}
    profile = density_profile(points, ends[a], ends[b], places, epsilon).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "points"))), lambda s: s.points).alias("profile"))
    near = sweep(points, ends[a], ends[b], epsilon).agg(F.count("*").alias("items"))
    length = F.expr(S.angular(S.literal(ends[a]), S.literal(ends[b])))
    gap = F.size(F.filter("profile", lambda c: c == 0)) / F.size("profile")
    return profile.crossJoin(near).select(F.lit(a).alias("a"), F.lit(b).alias("b"), length.alias("arc_length"), "items", "profile", gap.alias("gap_fraction"))


def arc_samples(start, end, n: int) -> list[tuple[float, float, float]]:
    w = math.acos(max(-1.0, min(1.0, sum(a * b for a, b in zip(start, end, strict=True)))))
    out = []
    for i in range(n):
        t = i / (n - 1) if n > 1 else 0.0
        if w < 1e-10:
            out.append(tuple(start))
        else:
            out.append(tuple((math.sin((1 - t) * w) * a + math.sin(t * w) * b) / math.sin(w) for a, b in zip(start, end, strict=True)))
    return out


def density_profile(points: DataFrame, start, end, n: int, radius: float) -> DataFrame:
    """How many points are near each of ``n`` places along the arc; one aggregate."""
    counts = [F.sum(F.when(F.expr(S.angular(S.vec("u"), S.literal(v))) <= radius, 1).otherwise(0)).alias(f"c{i}") for i, v in enumerate(arc_samples(start, end, n))]
    one = points.agg(*counts)
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.coalesce(f"c{i}", F.lit(0)).alias("points")) for i in range(n)])).alias("s")).select("s.*")


def void_distance(points: DataFrame, caps: DataFrame) -> DataFrame:
    """Distance of each point to the edge of the nearest cap; negative inside."""
    c = caps.select("cx", "cy", "cz", "spread")
    return points.select("ordinal", "ux", "uy", "uz").crossJoin(c).groupBy("ordinal").agg(F.min(F.expr(f"{S.angular(S.vec('u'), S.vec('c'))} - spread")).alias("void_distance"))


def lunes(found: DataFrame, rows: DataFrame, caps: DataFrame) -> DataFrame:
    """Bridges of each pair by the side of the bisector that they are on."""
    c = lambda n: caps.select(F.col("cat_id").alias(n), *(F.col(f"c{x}").alias(f"{n}{x}") for x in "xyz"))
    on = found.select("ordinal", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).join(rows.select("ordinal", "ux", "uy", "uz"), "ordinal").join(c("a"), "a").join(c("b"), "b")
    on = on.withColumn("side", F.expr(S.lune_side(S.vec("u"), S.vec("a"), S.vec("b"))))
    n = lambda s: F.sum(F.when(F.col("side") == s, 1).otherwise(0))
    out = on.groupBy("a", "b").agg(n("closer_to_a").alias("closer_to_a"), n("closer_to_b").alias("closer_to_b"), n("on_bisector").alias("on_bisector"))
    total = F.col("closer_to_a") + F.col("closer_to_b") + F.col("on_bisector")
    return out.withColumn("asymmetry", F.abs(F.col("closer_to_a") - F.col("closer_to_b")) / total)


def divergence(caps: DataFrame) -> DataFrame:
    """``a, b, divergence``: how much nearer than its ends a third centre is to the middle of each pair, or 0."""
    c = lambda n: caps.select(F.col("cat_id").alias(n), *(F.col(f"c{x}").alias(f"{n}{x}") for x in "xyz"))
    pairs = c("a").join(c("b"), F.col("a") < F.col("b"))
    pairs = evaluated(pairs, dict(zip(("mx", "my", "mz"), map(F.expr, S.slerp(S.vec("a"), S.vec("b"), "0.5")), strict=True)))
    own = F.least(F.expr(S.angular(S.vec("m"), S.vec("a"))), F.expr(S.angular(S.vec("m"), S.vec("b"))))
    third = pairs.join(c("k"), (F.col("k") != F.col("a")) & (F.col("k") != F.col("b")), "left").groupBy("a", "b").agg(F.min(F.expr(S.angular(S.vec("m"), S.vec("k")))).alias("other"), F.first(own).alias("own"))
    return third.select("a", "b", F.greatest(F.coalesce(F.col("own") - F.col("other"), F.lit(0.0)), F.lit(0.0)).alias("divergence"))


def samples(spark: SparkSession, n: int) -> DataFrame:
    """``n`` directions spread evenly over the sphere."""
    z = F.lit(1.0) - (F.col("id") * 2 + 1) / F.lit(float(n))
    s = F.sqrt(F.greatest(F.lit(0.0), 1 - z * z))
    t = F.col("id") * F.lit(GOLDEN)
    return spark.range(n).select(F.col("id").alias("sample"), (s * F.cos(t)).alias("ux"), (s * F.sin(t)).alias("uy"), z.alias("uz"))


def _hits(spark: SparkSession, caps: DataFrame, n: int) -> DataFrame:
    c = caps.select("cat_id", "cx", "cy", "cz", "spread")
    return samples(spark, n).crossJoin(c).withColumn("dot", F.expr(S.dot(S.vec("u"), S.vec("c")))).withColumn("inside", F.col("dot") >= F.cos("spread"))


def coverage(caps: DataFrame, n: int = 100_000) -> DataFrame:
    per = _hits(caps.sparkSession, caps, n).groupBy("sample").agg(F.sum(F.col("inside").cast("int")).alias("h"))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return per.agg(share(F.col("h") > 0).alias("coverage"), share(F.col("h") > 1).alias("overlap"), F.sum(F.when(F.col("h") == 0, 1).otherwise(0)).alias("void_samples"), F.count("*").alias("samples"))


def exclusivity(caps: DataFrame, n: int = 100_000) -> DataFrame:
    """The part of each cap that no other covers; 1 where a cap has no sample."""
    h = _hits(caps.sparkSession, caps, n).filter("inside").withColumn("h", F.count("*").over(W.partitionBy("sample")))
    per = h.groupBy("cat_id").agg(F.avg(F.when(F.col("h") == 1, 1.0).otherwise(0.0)).alias("e"))
    return caps.select("cat_id").join(per, "cat_id", "left").select("cat_id", F.coalesce("e", F.lit(1.0)).alias("exclusivity"))


def voronoi(caps: DataFrame, n: int = 100_000, margin: float = 0.05) -> DataFrame:
    """``cat_id, area, neighbours``: cells by the nearest centre, ties to the lowest.

    Two cells are neighbours where their centres come first and second for a sample
    with a margin of less than ``margin``.
    """
    h = _hits(caps.sparkSession, caps, n)
    two = h.withColumn("k", F.row_number().over(W.partitionBy("sample").orderBy(F.desc("dot"), "cat_id"))).filter("k <= 2")
    best = two.groupBy("sample").agg(F.max(F.when(F.col("k") == 1, F.col("cat_id"))).alias("i"), F.max(F.when(F.col("k") == 2, F.col("cat_id"))).alias("j"), (F.max("dot") - F.min("dot")).alias("gap"))
    area = best.groupBy(F.col("i").alias("cat_id")).agg((F.count("*") * (4 * math.pi / n)).alias("area"))
    near = best.filter((F.col("gap") < margin) & F.col("j").isNotNull())
    both = near.select("i", "j").union(near.select("j", "i")).groupBy(F.col("i").alias("cat_id")).agg(F.sort_array(F.collect_set("j")).alias("neighbours"))
    return caps.select("cat_id").join(area, "cat_id", "left").join(both, "cat_id", "left").select("cat_id", F.coalesce("area", F.lit(0.0)).alias("area"), F.coalesce("neighbours", F.array().cast("array<int>")).alias("neighbours"))


def voronoi_report(caps: DataFrame, graph: DataFrame, n: int = 100_000, margin: float = 0.05) -> DataFrame:
    """``voronoi`` with the members per area and the overlap of a cell's neighbours with those in the category graph."""
    linked = graph.groupBy(F.col("src").alias("cat_id")).agg(F.collect_set("dst").alias("linked"))
    out = voronoi(caps, n, margin).join(caps.select("cat_id", "members"), "cat_id").join(linked, "cat_id", "left")
    both, either = F.size(F.array_intersect("neighbours", "linked")), F.size(F.array_union("neighbours", "linked"))
    overlap = F.when(either > 0, both / either).otherwise(1.0)
    return out.withColumn("linked", F.coalesce("linked", F.array().cast("array<int>"))).select("cat_id", "area", "neighbours", F.when(F.col("area") > 1e-15, F.col("members") / F.col("area")).otherwise(0.0).alias("efficiency"), overlap.alias("graph_overlap"))


def deviation(path: list[tuple[float, float, float]], spark: SparkSession) -> float:
    """The largest distance of a path's inner places from the arc of its ends."""
    if len(path) < 3:
        return 0.0
    inner = spark.createDataFrame([tuple(map(float, p)) for p in path[1:-1]], "ux double, uy double, uz double")
    return inner.agg(F.max(F.expr(S.arc_distance(S.vec("u"), path[0], path[-1])))).first()[0]


def full_report(points: DataFrame, caps: DataFrame, found: DataFrame, graph: DataFrame, radius: float = 0.5, n: int = 100_000, top: int = 10) -> dict[str, DataFrame]:
    """All analyses of the navigator, one table each, computed when read."""
    return {
        "antipodal": antipodal(points, caps, radius),
        "coverage": coverage(caps, n),
        "caps": cap_areas(caps),
        "voronoi": voronoi_report(caps, graph, n),
        "overlaps": overlap_bridges(caps, found),
        "curvature": curvature(caps),
        "triples": top_triples(caps, top),
        "lunes": lunes(found, points, caps).join(divergence(caps), ["a", "b"]),
        "void": void_distance(points, caps),
    }
