"""The category layer: summaries, bridges, the category graph, routes.

Rows have ``ordinal, category, embedding`` and a direction.  The number of
categories is small against the rows, yet nothing here assumes that it is tiny:
tables of categories are joined, not collected, but for the routes over them.
"""

from __future__ import annotations

import heapq

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import sphere as S
from orrery.functions import vectors as V
from orrery.operators import places
from orrery.sources import points as P
from orrery.sources.tables import evaluated, once


def summaries(rows: DataFrame, seed: int = 42, dim: int = 64) -> DataFrame:
    """``cat_id, category, members, centroid``, its direction, ``spread, cohesion``.

    Categories count from 0 in the order of their first rows.  The centroid is the
    mean vector, placed by the same projection as the rows.
    """
    m = P.matrix(dim, seed)
    mean = rows.groupBy("category").agg(F.min("ordinal").alias("first"), F.count("*").alias("members"), vector_to_array(Summarizer.mean(array_to_vector("embedding"))).alias("centroid"))
    mean = mean.withColumn("cat_id", F.row_number().over(W.orderBy("first")) - 1).withColumn("_unit", V.normalized("centroid"))
    mean = evaluated(mean, {c: V.dot(V.constant(m[i]), "_unit") for i, c in enumerate("xyz")}).drop("_unit")
    placed = once(P.from_cartesian(mean).select("cat_id", "category", "members", "centroid", "theta", "phi", F.col("ux").alias("cx"), F.col("uy").alias("cy"), F.col("uz").alias("cz")), "centres")
    angle = F.expr(S.angular(S.vec("u"), S.vec("c")))
    spread = rows.join(placed.select("category", "cx", "cy", "cz"), "category").groupBy("category").agg(F.avg(angle).alias("_s"))
    out = placed.join(spread, "category").withColumn("spread", F.when(F.col("members") > 1, F.col("_s")).otherwise(0.0)).drop("_s")
    return once(out.withColumn("cohesion", 1 / (1 + F.col("spread"))), "categories")


def territorial(exclusivity: dict[int, float] | None, a: str, b: str) -> Column:
    """The factor that discounts pairs which share territory; 1 where nothing is known."""
    if not exclusivity:
        return F.lit(1.0)
    e = F.create_map(*[F.lit(v) for kv in exclusivity.items() for v in kv])
    return F.greatest(F.sqrt(e[F.col(a)] * e[F.col(b)]), F.lit(0.05))


def bridges(rows: DataFrame, cats: DataFrame, threshold: float, exclusivity: dict[int, float] | None = None, overlap_below: float = 0.3) -> DataFrame:
    """Rows that are near to another category: strength and class of each.

    ``exclusivity`` of each category discounts pairs that share territory; without
    it nothing is discounted.
    """
    c = cats.select("cat_id", "category", "centroid", V.norm("centroid").alias("n"))
    own = c.select("category", F.col("cat_id").alias("source"), F.col("centroid").alias("_own"), F.col("n").alias("_no"))
    other = c.select(F.col("cat_id").alias("target"), F.col("centroid").alias("_other"), F.col("n").alias("_nt"))
    base = rows.select("ordinal", "category", "embedding", V.norm("embedding").alias("_n")).join(own, "category")
    base = base.withColumn("affinity_source", V.cosine("embedding", "_own", F.col("_n"), F.col("_no"))).drop("_own", "_no", "category")
    pairs = base.crossJoin(other).filter("source <> target").withColumn("affinity_target", V.cosine("embedding", "_other", F.col("_n"), F.col("_nt")))
    found = pairs.filter((F.col("affinity_target") > 0) & (F.col("affinity_target") > F.col("affinity_source") * threshold)).drop("embedding", "_other", "_n", "_nt")
    total = F.col("affinity_source") + F.col("affinity_target")
    raw = F.when(total > 2.220446049250313e-16, 2 * F.col("affinity_source") * F.col("affinity_target") / total).otherwise(0.0)
    found = found.withColumn("territorial", territorial(exclusivity, "source", "target")).withColumn("strength", raw * F.col("territorial"))
    found = once(found, "bridges")
    median = upper_median(found, "strength").first()
    kind = F.when(F.col("territorial") < overlap_below, "overlap").when(F.col("strength") >= F.lit(median.median if median else None), "genuine").otherwise("weak")
    return found.withColumn("kind", kind)


def upper_median(df: DataFrame, column: str) -> DataFrame:
    """One row ``median``, the value at place ``n // 2`` from 0 in rising order; none of an empty table."""
    n = df.filter(F.col(column).isNotNull()).count()
    value = places.at_places(df, column, [n // 2]) if n else {}
    return df.sparkSession.createDataFrame([(float(v),) for v in value.values()], "median double")


def edges(cats: DataFrame, found: DataFrame, neighbours: set[tuple[int, int]] | None = None, exclusivity: dict[int, float] | None = None) -> DataFrame:
    """All ordered pairs of categories: distance, bridges, territorial factor, whether their cells touch, and weight."""
    a = cats.select(F.col("cat_id").alias("src"), *(F.col(f"c{c}").alias(f"a{c}") for c in "xyz"))
    b = cats.select(F.col("cat_id").alias("dst"), *(F.col(f"c{c}").alias(f"b{c}") for c in "xyz"))
    pairs = a.join(b, F.col("src") != F.col("dst")).select("src", "dst", F.expr(S.angular(S.vec("a"), S.vec("b"))).alias("centroid_distance"))
    per = found.groupBy(F.col("source").alias("src"), F.col("target").alias("dst")).agg(F.count("*").alias("bridge_count"), F.max("strength").alias("max_strength"), F.avg("strength").alias("mean_strength"))
    out = pairs.join(per, ["src", "dst"], "left").fillna(0, ["bridge_count", "max_strength", "mean_strength"])
    near = F.concat_ws("-", "src", "dst").isin([f"{i}-{j}" for i, j in neighbours]) if neighbours else F.lit(False)
    out = out.withColumns({"territorial": territorial(exclusivity, "src", "dst"), "adjacent": near})
    return out.withColumn("weight", F.col("centroid_distance") * F.when(F.col("adjacent"), 0.8).otherwise(1.0) / (1 + F.col("bridge_count") * F.col("mean_strength")))


def bridge_quality(graph: DataFrame) -> DataFrame:
    """``cat_id, quality``: the mean over all other categories of the mean strength times the territorial factor."""
    return graph.groupBy(F.col("src").alias("cat_id")).agg(F.avg(F.col("mean_strength") * F.col("territorial")).alias("quality"))


def quality_matrix(graph: DataFrame) -> DataFrame:
    """``i, j, quality``: the strongest bridge times the territorial factor, all pairs and the empty diagonal."""
    pairs = graph.select(F.col("src").alias("i"), F.col("dst").alias("j"), (F.col("max_strength") * F.col("territorial")).alias("quality"))
    return pairs.union(graph.select("src").distinct().select("src", "src", F.lit(0.0)))


def bridge_items(found: DataFrame, source: int, target: int, most: int) -> DataFrame:
    """The strongest bridges from one category to another."""
    return found.filter((F.col("source") == source) & (F.col("target") == target)).orderBy(F.desc("strength"), "ordinal").limit(most)


def neighbours_of(graph: DataFrame, cat_id: int, k: int) -> DataFrame:
    return graph.filter(F.col("src") == cat_id).orderBy("weight", "dst").limit(k)


def drill_down(points: DataFrame, category: str, target, k: int) -> DataFrame:
    """The ``k`` rows of one category nearest to a direction."""
    d = F.expr(S.angular(S.vec("u"), S.literal(target)))
    return points.filter(F.col("category") == category).withColumn("distance", d).orderBy("distance", "ordinal").limit(k)


def near_direction(cats: DataFrame, target, max_angle: float) -> DataFrame:
    d = F.expr(S.angular(S.vec("c"), S.literal(target)))
    return cats.withColumn("distance", d).filter(F.col("distance") <= max_angle).orderBy("distance", "cat_id")


def near_weighted(cats: DataFrame, target, certainty: float, max_angle: float) -> DataFrame:
    """``near_direction`` with ``effective``, the distance that an uncertain projection makes longer, which orders."""
    c = max(certainty, 0.001)
    return near_direction(cats, target, max_angle).withColumns({"effective": F.col("distance") / F.lit(c**0.5), "certainty": F.lit(c)}).orderBy("effective", "cat_id")


def shortest_path(edge_rows: list[tuple], start, goal) -> list[tuple] | None:
    """Dijkstra over ``(src, dst, weight)``: ``(node, hop, cumulative)`` or ``None``.

    A node is settled once, so weights below 0 end no worse than out of order.
    """
    near: dict = {}
    for a, b, w in edge_rows:
        near.setdefault(a, []).append((b, w))
    best, heap, before, closed = {start: 0.0}, [(0.0, start)], {}, set()
    while heap:
        d, v = heapq.heappop(heap)
        if v in closed:
            continue
        closed.add(v)
        if v == goal:
            break
        for u, w in near.get(v, ()):
            if u not in closed and d + w < best.get(u, float("inf")):
                best[u], before[u] = d + w, v
                heapq.heappush(heap, (d + w, u))
    if goal not in best:
        return None
    path, v = [goal], goal
    while v != start:
        v = before[v]
        path.append(v)
    path.reverse()
    return [(v, best[v] - best[path[i - 1]] if i else 0.0, best[v]) for i, v in enumerate(path)]


#: Edges that the driver takes for a path; more are relaxed on the executors.
PATH_EDGES = 500_000


def graph_path(edge: DataFrame, source: int, target: int) -> list[tuple]:
    """``(node, hop, cumulative)`` of the shortest path over undirected ``src, dst, distance``; empty without one.

    Small graphs are walked on the driver.  Larger ones stay where they are: a table
    of distances is relaxed along the edges, one hop of all nodes a round, until
    nothing gets shorter, and the path is read back from the target.
    """
    if source == target:
        return [(source, 0.0, 0.0)]
    edge = once(edge, "graph")
    both = edge.select("src", "dst", "distance").union(edge.select("dst", "src", "distance")).toDF("a", "b", "w")
    if edge.count() <= PATH_EDGES:
        return shortest_path([(r.a, r.b, r.w) for r in both.collect()], source, target) or []
    both = once(both.repartition("a"), "edges")
    known = front = edge.sparkSession.createDataFrame([(source, 0.0, None)], "node long, d double, prev long")
    while True:
        reached = front.join(both, front.node == both.a).select(F.col("b").alias("node"), (F.col("d") + F.col("w")).alias("nd"), F.col("node").alias("np"))
        best = reached.groupBy("node").agg(F.min(F.struct("nd", "np")).alias("m")).select("node", "m.*")
        goal = known.filter(F.col("node") == target).agg(F.min("d").alias("goal"))
        new = best.join(known, "node", "left").crossJoin(F.broadcast(goal)).filter((F.col("d").isNull() | (F.col("nd") < F.col("d"))) & (F.col("goal").isNull() | (F.col("nd") < F.col("goal"))))
        front = once(new.select("node", F.col("nd").alias("d"), F.col("np").alias("prev")), "front")
        if not front.take(1):
            break
        known = once(known.join(front.select("node"), "node", "left_anti").union(front), "known")
    path, node = [], target
    while node is not None:
        row = known.filter(F.col("node") == node).first()
        if row is None:
            return []
        path.append((node, row.d))
        node = row.prev
    path.reverse()
    return [(v, d - path[i - 1][1] if i else 0.0, d) for i, (v, d) in enumerate(path)]


def category_path(graph: DataFrame, source: int, target: int, found: DataFrame | None = None) -> DataFrame:
    """``step, cat_id, hop, cumulative, hop_confidence, path_confidence, bridges_to_next`` along the cheapest route.

    A hop's confidence, at the step that it leaves, is its strongest bridge times the
    territorial factor, and times 1.2 between cells that touch, at most 1; the path's
    is the product, each factor at least 0.01.  ``bridges_to_next`` has the ordinals
    of up to three bridges, the strongest first.  Weights below 0, which bridges of
    opposed affinities can make, count as 0.
    """
    spark = graph.sparkSession
    schema = "step int, cat_id int, hop double, cumulative double, hop_confidence double, path_confidence double, bridges_to_next array<long>"
    rows = graph.select("src", "dst", "weight", "max_strength", "territorial", "adjacent").collect()  # categories squared
    path = shortest_path([(r.src, r.dst, max(r.weight, 0.0)) for r in rows], source, target) if source != target else [(source, 0.0, 0.0)]
    if path is None:
        return spark.createDataFrame([], schema)
    sure = {(r.src, r.dst): min(1.0, r.max_strength * r.territorial * (1.2 if r.adjacent else 1.0)) for r in rows}
    hops = [(v, u) for (v, _, _), (u, _, _) in zip(path, path[1:], strict=False)]
    whole = 1.0
    for h in hops:
        whole *= max(sure[h], 0.01)
    through = {h: [r.ordinal for r in bridge_items(found, *h, 3).collect()] if found is not None else [] for h in hops}
    out = []
    for i, (v, hop, total) in enumerate(path):
        h = hops[i] if i < len(hops) else None
        out.append((i, int(v), float(hop), float(total), float(sure[h]) if h else 0.0, float(whole), through[h] if h else []))
    return spark.createDataFrame(out, schema)


def domain_groups(similarity: dict[tuple[int, int], float], n: int, target: int) -> list[list[int]]:
    """Average-linkage merging until ``target`` groups are left."""
    groups = [[i] for i in range(n)]
    at = lambda a, b: similarity.get((a, b), similarity.get((b, a), 0.0))
    while len(groups) > max(1, min(target, n)):
        score = {(i, j): sum(at(a, b) for a in groups[i] for b in groups[j]) / (len(groups[i]) * len(groups[j])) for i in range(len(groups)) for j in range(i + 1, len(groups))}
        i, j = max(score, key=lambda x: (score[x], -x[0], -x[1]))
        groups[i] += groups.pop(j)
    return groups
