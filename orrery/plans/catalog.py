"""The registered queries and, beside each, its SQL.

Each runs over its whole table.  The points come from two sources that both sides
can express: a fixed random projection of the embeddings (``random``) and the orders
on a lattice (``lattice``).  The SQL is written apart from the library's formulas
(see ``oracle``).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import regions as G
from orrery.functions import sphere as S
from orrery.functions import vectors as V
from orrery.operators import analytics as A
from orrery.operators import blocks as B
from orrery.operators import categories as C
from orrery.operators import clusters as K
from orrery.operators import knn as N
from orrery.operators import projections as J
from orrery.operators import tuning as T
from orrery.plans import oracle as O
from orrery.sources import points as P
from orrery.sources import store as VS
from orrery.sources.index import PointIndex
from orrery.sources.tables import once, shared_dir
from orrery.streaming import regions as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TARGET, OTHER = O.T1, O.T2
_M = P.matrix(64)
BASES = {"random": O.random_source(_M.tolist()), "lattice": O.lattice_source()}


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return P.lattice_points(table("orders")) if name == "lattice" else P.random_points(table("embeddings"), keep_embedding=True)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six decimals, without negative zeros; counts as 64-bit numbers."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        out.append((F.round(c, digits) + F.lit(0.0)).alias(f.name) if kind == "double" else c.cast("long").alias(f.name) if kind in ("int", "smallint") else c)
    return df.select(*out)


def register(name: str, spark_side: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(spark_side(spark, sf_dir))
    if sql is not None:
        ORACLE[name] = sql


def scalar(name: str, base: str, ours: dict[str, str], sql: dict[str, str]) -> None:
    """Expressions of each point, in the library's words and in the oracle's."""
    run = lambda s, d: source(s, d, base).select("ordinal", *(F.expr(e).alias(c) for c, e in ours.items()))
    register(name, run, O.select(base=BASES[base], body="SELECT ordinal, " + ", ".join(f"{e} AS {c}" for c, e in sql.items()) + " FROM p", doubles=list(sql), others=["ordinal"]))


def abc(names: str, values) -> dict[str, str]:
    return dict(zip(names, values, strict=True))


U, XYZ, L1, L2 = S.vec("u"), S.vec(""), S.literal(TARGET), S.literal(OTHER)
u, xyz, l1, l2 = O.vec("u"), O.vec(""), O.lit(O.T1), O.lit(O.T2)

# Scalar functions ------------------------------------------------------------------

_LAT, _LON = "90 - phi * 180 / pi()", "CASE WHEN theta > pi() THEN theta * 180 / pi() - 360 ELSE theta * 180 / pi() END"
scalar("sph_to_cart", "lattice", abc("abc", S.to_cartesian("r", "theta", "phi")), abc("abc", ("r * sqrt(1 - uz * uz) * cos(theta)", "r * sqrt(1 - uz * uz) * sin(theta)", "r * uz")))
scalar("cart_to_sph", "lattice", abc("abc", S.to_spherical(XYZ)), abc("abc", ("r", "theta", "phi")))
scalar("sph_to_geo", "lattice", abc("abc", S.to_geo("r", "theta", "phi")), abc("abc", (_LAT, _LON, "CASE WHEN r > 1 THEN r - 1 ELSE 0.0 END")))
scalar("geo_to_sph", "lattice", abc("abc", S.from_geo("(90.0 - degrees(phi))", "degrees(theta)", "r")), abc("abc", ("r + 1", "theta", "phi")))
scalar("cart_to_geo", "lattice", abc("abc", S.geo_from_cartesian(XYZ)), abc("abc", (_LAT, _LON, "CASE WHEN r > 1 THEN r - 1 ELSE 0.0 END")))
scalar("geo_to_cart", "lattice", abc("abc", S.cartesian_from_geo("(90.0 - degrees(phi))", "degrees(theta)", "r")), abc("abc", ("x + ux", "y + uy", "z + uz")))
scalar("unit_cartesian", "lattice", abc("abc", S.direction("theta", "phi")), abc("abc", ("x / r", "y / r", "z / r")))
scalar("normalize_3d", "lattice", abc("abc", S.normalize(XYZ)) | {"size": S.norm(XYZ)}, abc("abc", ("ux", "uy", "uz")) | {"size": "r"})
scalar("normalize_theta", "lattice", {"t": S.wrap("theta * 3.0D - 9.5D")}, {"t": f"theta * 3 - 9.5 + CASE WHEN theta * 3 < 9.5 - 2 * {O.PI} THEN 4 WHEN theta * 3 < 9.5 THEN 2 WHEN theta * 3 < 9.5 + 2 * {O.PI} THEN 0 ELSE -2 END * {O.PI}"})
scalar("dist_angular", "lattice", {"d": S.angular(U, L1)}, {"d": O.ang(u, l1)})
scalar("dist_great_circle", "lattice", {"d": S.great_circle(U, L1, "6371.0")}, {"d": f"6371 * {O.ang(u, l1)}"})
scalar("dist_chord", "lattice", {"d": S.chord(XYZ, L1)}, {"d": f"sqrt(r * r + 1 - 2 * {O.dot(xyz, l1)})"})
scalar("dist_euclidean", "lattice", {"d": S.euclidean(XYZ, S.literal((2.0, -1.0, 0.5)))}, {"d": f"sqrt({O.chord2(xyz, O.lit((2.0, -1.0, 0.5)))})"})
scalar("dist_cosine_proxy", "lattice", {"d": S.cosine_proxy(U, L1)}, {"d": f"{O.chord2(u, l1)} / 2"})
scalar("interp_slerp", "lattice", abc("abc", S.slerp(U, L1, "0.3")), abc("abc", O.rotated(u, l1, 0.3)))
scalar("interp_nlerp", "lattice", abc("abc", S.nlerp(U, L1, "0.3")), abc("abc", [f"(0.7 * {a} + 0.3 * {b}) / sqrt(0.58 + 0.42 * {O.dot(u, l1)})" for a, b in zip(u, l1, strict=True)]))
scalar("interp_full_slerp", "lattice", abc("abc", S.full_slerp(U, "r", L1, "2.0", "0.3")), abc("abc", [f"(0.7 * r + 0.6) * {c}" for c in O.rotated(u, l1, 0.3)]))
scalar("antipode", "lattice", abc("ab", S.antipode("theta", "phi")), abc("ab", (f"CASE WHEN theta < {O.PI} THEN theta + {O.PI} ELSE theta - {O.PI} END", "acos(-uz)")))
scalar("bisector_normal", "lattice", abc("abc", S.bisector_normal(U, L1)), abc("abc", [f"({a} - {b}) / sqrt(2 - 2 * {O.dot(u, l1)})" for a, b in zip(u, l1, strict=True)]))
scalar("arc_distance", "lattice", {"d": S.arc_distance(U, TARGET, OTHER)}, {"d": O.arc(u, O.T1, O.T2)})
scalar("spherical_excess", "lattice", {"e": S.excess(S.angular(U, L1), S.angular(L1, L2), S.angular(L2, U))}, {"e": O.excess(u, l1, l2)})
scalar("cap_solid_angle", "lattice", {"area": S.cap_area("phi")}, {"area": f"4 * {O.PI} * pow(sin(phi / 2), 2)"})
scalar("cap_intersection_area", "lattice", {"area": S.cap_overlap(S.angular(U, L1), "0.7", "0.4")}, {"area": O.lens(O.ang(u, l1), "0.7", "0.4")})
scalar("gap_confidence", "lattice", {"g": S.gap_confidence(f"({S.angular(U, L1)} - 0.5)", "4.0")}, {"g": f"1 - 1 / (1 + exp(2 - 4 * {O.ang(u, l1)}))"})
scalar("quality_signal", "lattice", {"combined": S.quality("0.6", "(phi / 3.2)")}, {"combined": "CASE WHEN phi / 3.2 > 0.0001 THEN 0.6 * pow(phi / 3.2, 1.5) ELSE 0.006 * phi / 3.2 END"})
scalar("void_quality", "lattice", {"combined": S.void_quality("0.6", "(phi / 3.2)", f"({S.angular(U, L1)} - 0.5)", "4.0")}, {"combined": f"0.6 * phi / 3.2 / (1 + exp(4 * {O.ang(u, l1)} - 2))"})
scalar("bridge_threshold", "lattice", {"t": S.bridge_threshold("(phi / 3.2)", "0.5", "0.4")}, {"t": "0.5 + pow(1 - phi / 3.2, 2) * 0.4"})
scalar("territorial_factor", "lattice", {"t": S.territorial("(phi / 3.2)", "(theta / 6.3)")}, {"t": "CASE WHEN phi * theta / 20.16 < 0.0025 THEN 0.05 ELSE pow(phi * theta / 20.16, 0.5) END"})
_KIND = "CASE WHEN theta < 2 THEN 'genuine' WHEN theta < 4 THEN 'overlap' ELSE 'weak' END"
scalar("hop_weight", "lattice", {"w": S.hop_weight("phi", "(r / 4.0)", _KIND)}, {"w": "CASE WHEN theta < 2 THEN phi / (r / 4 + 0.1) WHEN theta < 4 THEN phi * 2 ELSE phi / (r / 4 + 0.01) END"})
_PLANE = ((0.1, 0.2, 0.3), (1.0, 0.0, 0.0), (0.0, 0.6, 0.8), (0.0, -0.8, 0.6))
scalar("plane_coordinates", "lattice", abc("abc", S.plane_coordinates(XYZ, *_PLANE)), abc("abc", ("x - 0.1", "0.6 * y + 0.8 * z - 0.36", "0.6 * z - 0.8 * y - 0.02")))
scalar("export_points", "random", {c: c for c in ("r", "theta", "phi", "x", "y", "z")}, {c: c for c in ("r", "theta", "phi", "x", "y", "z")})
scalar("project_random", "random", {c: c for c in ("ux", "uy", "uz", "magnitude")}, {c: c for c in ("ux", "uy", "uz", "magnitude")})
register("projected_points", lambda s, d: P.projected(source(s, d, "random")), O.select(BASES["random"], "SELECT * FROM p", ["x", "y", "z"], ["item_id", "category"]))

_labels = lambda e: lambda s, d: source(s, d, "lattice").groupBy(F.expr(e).alias("label")).count().withColumnRenamed("count", "n")
register("lune_classify", _labels(S.lune_side(U, L1, L2)), f"WITH p AS ({BASES['lattice']}) SELECT CASE WHEN k > 2e-12 THEN 'closer_to_a' WHEN k < -2e-12 THEN 'closer_to_b' ELSE 'on_bisector' END AS label, count(*) AS n FROM (SELECT {O.chord2(u, l2)} - {O.chord2(u, l1)} AS k FROM p) GROUP BY 1")
register("quality_level", _labels(S.quality_level(S.quality("0.3", "(phi / 3.2)"))), f"WITH p AS ({BASES['lattice']}) SELECT ['unreliable', 'low', 'moderate', 'high'][1 + (q > 0.005)::INT + (q > 0.03)::INT + (q > 0.1)::INT] AS label, count(*) AS n FROM (SELECT 0.3 * phi / 3.2 * greatest(0.01, sqrt(phi / 3.2)) AS q FROM p) GROUP BY 1")
_BOUNDS = [(0.11, "high"), (0.1, "moderate"), (0.031, "moderate"), (0.03, "low"), (0.0051, "low"), (0.005, "unreliable"), (0.0, "unreliable"), (-1.0, "unreliable")]
register("quality_bounds", lambda s, d: s.createDataFrame([(v,) for v, _ in _BOUNDS], "value double").select("value", F.expr(S.quality_level("value")).alias("label")), "SELECT round(value::DOUBLE, 6) AS value, label FROM (VALUES " + ", ".join(f"({v!r}, '{x}')" for v, x in _BOUNDS) + ") t(value, label)")

_QUERY = [math.sin(i + 1.0) for i in range(64)]
_QSQL = "[" + ", ".join(f"{x!r}::DOUBLE" for x in _QUERY) + "]"
_HALF = [1.0] * 32 + [-0.5] * 32
_embeddings = lambda s, d: s.read.parquet(f"{d}/embeddings.parquet")
register("cosine_similarity", lambda s, d: _embeddings(s, d).select("vec_id", V.cosine("embedding", V.constant(_HALF)).alias("similarity")), "SELECT vec_id, round((list_sum(list_transform(embedding::DOUBLE[], lambda v, i: v * CASE WHEN i <= 32 THEN 1.0 ELSE -0.5 END)) / sqrt(40)) / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda v: v * v))), 6) + 0.0 AS similarity FROM embeddings")
register("vector_functions", lambda s, d: _embeddings(s, d).select("vec_id", F.size("embedding").alias("dimension"), V.norm("embedding").alias("magnitude"), V.euclidean("embedding", V.constant(_QUERY)).alias("distance"), V.gaussian("embedding", V.constant(_QUERY), 3.0).alias("kernel"), V.jaccard(V.active_axes("embedding", 0.15), F.array(*map(F.lit, range(0, 64, 3)))).alias("overlap")),
    f"SELECT vec_id, len(embedding)::BIGINT AS dimension, round(sqrt(list_dot_product(e, e)), 6) + 0.0 AS magnitude, round(list_distance(e, {_QSQL}), 6) + 0.0 AS distance, round(exp(0 - pow(list_distance(e, {_QSQL}), 2) / 18), 6) + 0.0 AS kernel, round(common / (len(a) + 22 - common), 6) + 0.0 AS overlap FROM (SELECT *, len(list_filter(a, lambda k: k % 3 = 0)) AS common FROM (SELECT *, embedding::DOUBLE[] AS e, list_filter(range(64), lambda k: abs(embedding[k + 1]::DOUBLE) > 0.15) AS a FROM embeddings))")

# Regions and cells -----------------------------------------------------------------

_SHELLS, _PARTS = [1.0, 2.0, 3.0], (12, 6)
REGIONS = {
    "region_cone": (G.Cone(0.7, 1.1, 0.73), f"{O.haversine(0.7, 1.1)} <= 0.73"),
    "region_cap": (G.Cap(5.9, 2.0, 0.41), f"{O.haversine(5.9, 2.0)} <= 0.41"),
    "region_shell": (G.Shell(0.73, 2.11), "NOT (r < 0.73 OR r > 2.11)"),
    "region_band": (G.Band(0.61, 1.37), "uz BETWEEN cos(1.37) AND cos(0.61)"),
    "region_wedge": (G.Wedge(0.51, 2.03), "theta BETWEEN 0.51 AND 2.03"),
    "region_wedge_wrap": (G.Wedge(5.51, 0.43), "NOT (theta > 0.43 AND theta < 5.51)"),
    "region_intersection": (G.Intersection((G.Shell(0.5, 3.0), G.Band(0.4, 2.0), G.Wedge(4.9, 1.0))), "r BETWEEN 0.5 AND 3 AND uz BETWEEN cos(2.0) AND cos(0.4) AND NOT (theta > 1 AND theta < 4.9)"),
    "region_union": (G.Union((G.Cap(0.3, 0.4, 0.3), G.Shell(3.3, 4.0), G.Intersection((G.Band(2.0, 3.0), G.Wedge(1.0, 2.0))))), O.either(f"{O.haversine(0.3, 0.4)} <= 0.3", "r BETWEEN 3.3 AND 4", "(uz BETWEEN cos(3.0) AND cos(2.0) AND theta BETWEEN 1 AND 2)")),
    "region_everything": (G.Intersection(()), "true"),
    "region_nothing": (G.Union(()), "false"),
    "region_semantic": (G.semantic(1.2, 1.4, similarity=0.8, shell=(0.5, 2.5)), f"cos({O.haversine(1.2, 1.4)}) >= 0.8 AND r BETWEEN 0.5 AND 2.5"),
    "region_from_request": (G.from_dict({"intersection": [{"cap": {"theta": 2.0, "phi": 1.0, "half_angle": 0.9}}, {"band": {"phi_min": 0.3, "phi_max": 1.2}}]}), f"{O.haversine(2.0, 1.0)} <= 0.9 AND uz BETWEEN cos(1.2) AND cos(0.3)"),
}
for _name, (_region, _where) in REGIONS.items():
    register(_name, lambda s, d, g=_region: N.in_region(P.with_cells(source(s, d, "lattice"), _SHELLS, *_PARTS), g, *_PARTS, _SHELLS).select("ordinal"), f"WITH p AS ({BASES['lattice']}) SELECT ordinal FROM p WHERE {_where}")

register("cells_shell", lambda s, d: P.with_cells(source(s, d, "lattice"), [0.5, 1.0, 2.0, 3.0]).groupBy("shell_id").agg(F.count("*").alias("n")), f"WITH p AS ({BASES['lattice']}) SELECT (CASE WHEN r < 0.5 THEN 0 WHEN r < 1 THEN 1 WHEN r < 2 THEN 2 ELSE 3 END)::BIGINT AS shell_id, count(*) AS n FROM p GROUP BY 1")
register("cells_sector", lambda s, d: P.with_cells(source(s, d, "lattice"), [1.0]).groupBy("sector_id").agg(F.count("*").alias("n")), f"WITH p AS ({BASES['lattice']}) SELECT (least(floor(theta * 6 / {O.PI}), 11) * 6 + least(floor(phi * 6 / {O.PI}), 5))::BIGINT AS sector_id, count(*) AS n FROM p GROUP BY 1")
register("sector_centres", lambda s, d: s.createDataFrame(G.sector_centres(12, 6), "sector_id int, theta double, phi double, diagonal double"), f"SELECT (t * 6 + f)::BIGINT AS sector_id, round((t + 0.5) * {O.PI} / 6, 6) AS theta, round((f + 0.5) * {O.PI} / 6, 6) AS phi, round({O.PI} / 6 * sqrt(2), 6) AS diagonal FROM range(12) a(t), range(6) b(f)")


def _changed_index(s: SparkSession, d: str) -> PointIndex:
    """Two thirds of the orders on the lattice in an index, after a removal, an update and an insert at another radius."""
    import uuid

    rows = source(s, d, "lattice")
    index = PointIndex(s, f"{shared_dir(s)}/index-{uuid.uuid4().hex}", _SHELLS, 4, 2)
    index.insert(rows.filter("ordinal % 3 = 0"))
    index.remove(rows.filter("ordinal % 9 = 0"))
    index.update(rows.filter("ordinal % 15 = 0 and ordinal % 9 <> 0").withColumn("r", F.col("r") + 1))
    index.insert(rows.filter("ordinal % 3 = 1"), radius="0.5D")
    return index


_IX = f"WITH p AS ({BASES['lattice']}), i AS (SELECT ordinal, theta, phi, ux, uy, uz, CASE WHEN ordinal % 3 = 1 THEN 0.5 WHEN ordinal % 15 = 0 THEN r + 1 ELSE r END AS r FROM p WHERE ordinal % 3 < 2 AND ordinal % 9 <> 0)"
register("index_rows", lambda s, d: _changed_index(s, d).rows.select("ordinal", "r"), f"{_IX} SELECT ordinal, round(r, 6) + 0.0 AS r FROM i")
register("index_region", lambda s, d: _changed_index(s, d).query(G.Intersection((G.Shell(1.1, 2.4), G.Wedge(1.0, 4.0)))).select("ordinal"), f"{_IX} SELECT ordinal FROM i WHERE r BETWEEN 1.1 AND 2.4 AND theta BETWEEN 1 AND 4")
register("index_within", lambda s, d: _changed_index(s, d).within(TARGET, 0.4).select("ordinal", "distance"), f"{_IX} SELECT ordinal, round({O.ang(u, l1)}, 6) + 0.0 AS distance FROM i WHERE {O.ang(u, l1)} <= 0.4")

# Neighbours ------------------------------------------------------------------------

_near = lambda t, k: f"SELECT ordinal, category, {O.ang(u, t)} AS distance FROM p ORDER BY {O.dot(u, t)} DESC, ordinal LIMIT {k}"
register("knn_point", lambda s, d: N.nearest(source(s, d, "random"), TARGET, 10).select("ordinal", "category", "distance"), O.select(BASES["random"], _near(l1, 10), ["distance"], ["ordinal", "category"]))
register("knn_lattice", lambda s, d: N.nearest(source(s, d, "lattice"), OTHER, 25, 0.2).select("ordinal", "distance"), O.select(BASES["lattice"], f"SELECT * FROM ({_near(l2, 25)}) WHERE distance <= 0.2", ["distance"], ["ordinal"]))
register("within_distance", lambda s, d: N.within(source(s, d, "lattice"), TARGET, 0.31).select("ordinal", "distance"), O.select(BASES["lattice"], f"SELECT ordinal, {O.ang(u, l1)} AS distance FROM p WHERE {O.dot(u, l1)} >= cos(0.31)", ["distance"], ["ordinal"]))
register("similar_above", lambda s, d: N.within(source(s, d, "random"), OTHER, math.acos(0.83)).select("ordinal", "distance"), O.select(BASES["random"], f"SELECT ordinal, {O.ang(u, l2)} AS distance FROM p WHERE {O.dot(u, l2)} >= 0.83", ["distance"], ["ordinal"]))
register("quality_filter", lambda s, d: (lambda p: p.withColumn("combined", F.expr(S.quality("0.6", "certainty"))).filter("certainty >= 0.3 and combined >= 0.1").select("ordinal", "combined"))(N.nearest(source(s, d, "lattice").withColumn("certainty", F.expr("phi / 3.2")), OTHER, 50)), O.select(BASES["lattice"], f"SELECT ordinal, 0.6 * pow(phi / 3.2, 1.5) AS combined FROM (SELECT * FROM p ORDER BY {O.dot(u, l2)} DESC, ordinal LIMIT 50) WHERE phi >= 0.96 AND 0.6 * pow(phi / 3.2, 1.5) >= 0.1", ["combined"], ["ordinal"]))
_PAIR = "p a JOIN p b ON a.ordinal <> b.ordinal"
_RANK = f"row_number() OVER (PARTITION BY a.ordinal ORDER BY {O.dot(O.vec('a.u'), O.vec('b.u'))} DESC, b.ordinal)"
_D = O.ang(O.vec("a.u"), O.vec("b.u"))
register("knn_batch", lambda s, d: (lambda p: N.batch_nearest(p.filter("ordinal % 20 = 0"), p, 5).select("query_id", "item_id", "distance", "rank"))(source(s, d, "random")), O.select(BASES["random"], f"SELECT * FROM (SELECT a.item_id AS query_id, b.item_id, {_D} AS distance, {_RANK} AS rank FROM (SELECT * FROM p WHERE ordinal % 20 = 0) a CROSS JOIN p b) WHERE rank <= 5", ["distance"], ["query_id", "item_id", "rank"]))
_EDGES = f"SELECT least(i, j) AS src, greatest(i, j) AS dst, min(distance) AS distance FROM (SELECT a.ordinal AS i, b.ordinal AS j, {_D} AS distance, {_RANK} AS rank FROM {_PAIR}) WHERE rank <= {{k}} GROUP BY 1, 2"
register("knn_graph", lambda s, d: N.neighbour_edges(source(s, d, "random"), 6), O.select(BASES["random"], _EDGES.format(k=6), ["distance"], ["src", "dst"]))
register("close_pairs", lambda s, d: B.close_pairs(source(s, d, "random"), 0.08), f"WITH p AS MATERIALIZED ({BASES['random']}) SELECT count(*) AS close_pairs FROM p a JOIN p b ON a.ordinal < b.ordinal WHERE {_D} < 0.08")
_PATH = "SELECT src AS a, dst AS b, distance AS w FROM g UNION ALL SELECT dst, src, distance FROM g"


def _concept_path(s, d):
    path = C.graph_path(N.neighbour_edges(source(s, d, "random"), 8), 0, 100)
    return s.createDataFrame([(i, int(v), float(h), float(t)) for i, (v, h, t) in enumerate(path)], "step int, ordinal long, hop double, cumulative double")


register("concept_path", _concept_path, f"""WITH RECURSIVE p AS MATERIALIZED ({BASES['random']}), g AS MATERIALIZED ({_EDGES.format(k=8)}), w AS MATERIALIZED ({_PATH}),
best(node, d) USING KEY (node) AS (SELECT 0::BIGINT, 0.0::DOUBLE UNION SELECT * FROM (SELECT w.b, min(best.d + w.w) AS d FROM best JOIN w ON w.a = best.node GROUP BY 1) n WHERE n.d < coalesce((SELECT r.d FROM recurring.best r WHERE r.node = n.b), 1e300)),
path(node, d, back) AS (SELECT node, d, 0 FROM best WHERE node = 100 UNION ALL SELECT * FROM (SELECT q.node, q.d, path.back + 1 FROM path JOIN w ON w.b = path.node JOIN best q ON q.node = w.a WHERE path.node <> 0 AND abs(q.d + w.w - path.d) < 1e-12 ORDER BY q.d, q.node LIMIT 1))
SELECT (max(back) OVER () - back)::BIGINT AS step, node AS ordinal, round(d - coalesce(lag(d) OVER (ORDER BY back DESC), d), 6) + 0.0 AS hop, round(d, 6) + 0.0 AS cumulative FROM path""")

# Vector tables ---------------------------------------------------------------------

register("store_search", lambda s, d: N.cosine_top(_embeddings(s, d).select(F.col("vec_id").alias("id"), "embedding"), _QUERY, 20, "embedding").select("id", "score"), f"SELECT id, round(score, 6) + 0.0 AS score FROM (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], {_QSQL}) AS score FROM embeddings ORDER BY score DESC, id LIMIT 20)")
register("hybrid_search", lambda s, d: (lambda p: VS.hybrid_search(p, p, TARGET, _QUERY, 5, 40).select("item_id", "score"))(source(s, d, "random")), O.select(BASES["random"], f"SELECT item_id, list_cosine_similarity(embedding, {_QSQL}) AS score FROM (SELECT * FROM p ORDER BY {O.dot(u, l1)} DESC, ordinal LIMIT 40) ORDER BY score DESC, ordinal LIMIT 5", ["score"], ["item_id"]))
register("store_page", lambda s, d: _embeddings(s, d).orderBy("vec_id").offset(40).limit(25).select("vec_id", "label"), "SELECT vec_id, label::BIGINT AS label FROM embeddings ORDER BY vec_id LIMIT 25 OFFSET 40")


def _changed_store(s: SparkSession, d: str) -> VS.VectorTable:
    """All vectors in a table; then some replaced, some deleted, some told more about."""
    e = _embeddings(s, d)
    put = lambda rows, note: rows.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.create_map(F.lit("category"), F.concat(F.lit("c"), "label"), F.lit("note"), F.lit(note)).alias("metadata"))
    store = VS.VectorTable(s, "vectors", 64, f"{shared_dir(s)}/store")
    store.upsert(put(e, "first"))
    store.upsert(put(e.filter("vec_id % 10 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x)), "second"))
    store.delete([str(i) for i in range(0, 100, 7)])
    store.set_payload(e.filter("vec_id % 4 = 0").select(F.col("vec_id").cast("string").alias("id"), F.create_map(F.lit("note"), F.lit("told"), F.lit("more"), F.lit("x")).alias("metadata")))
    return store


_STORE = "WITH t AS (SELECT vec_id::VARCHAR AS id, CASE WHEN vec_id % 10 = 0 THEN -1 ELSE 1 END AS sign, embedding::DOUBLE[] AS e, 'c' || label AS category, CASE WHEN vec_id % 4 = 0 THEN 'told' WHEN vec_id % 10 = 0 THEN 'second' ELSE 'first' END AS note, CASE WHEN vec_id % 4 = 0 THEN 'x' END AS more FROM embeddings WHERE NOT (vec_id < 100 AND vec_id % 7 = 0))"
register("store_rows", lambda s, d: _changed_store(s, d).fetch_all().select("id", F.element_at("vector", 1).alias("head"), F.col("metadata")["category"].alias("category"), F.col("metadata")["note"].alias("note"), F.col("metadata")["more"].alias("more")), f"{_STORE} SELECT id, round(sign * e[1], 6) + 0.0 AS head, category, note, more FROM t")
register("store_changed_search", lambda s, d: _changed_store(s, d).search(_QUERY, 15).select("id", "score"), f"{_STORE} SELECT id, round(score, 6) + 0.0 AS score FROM (SELECT id, sign * list_cosine_similarity(e, {_QSQL}) AS score FROM t ORDER BY score DESC, id LIMIT 15)")
register("store_get", lambda s, d: _changed_store(s, d).get(["0", "1", "7", "8", "none"]).select("id", F.col("metadata")["note"].alias("note")), f"{_STORE} SELECT id, note FROM t WHERE id IN ('0', '1', '7', '8', 'none')")
register("store_corpus", lambda s, d: _changed_store(s, d).corpus().groupBy("category").agg(F.count("*").alias("n")), f"{_STORE} SELECT category, count(*) AS n FROM t GROUP BY 1")


def _synced(s, d):
    store = VS.VectorTable(s, "synced", 64, f"{shared_dir(s)}/store")
    store.upsert(_embeddings(s, d).select(F.concat(F.lit("v"), "vec_id").alias("id"), F.col("embedding").alias("vector"), F.create_map(F.lit("k"), F.lit("v")).alias("metadata")))
    store.sync_projections(source(s, d, "random"))
    return store.fetch_all().select("id", F.col("metadata")["k"].alias("k"), *(F.col("metadata")[key].cast("double").alias(c) for key, c in ((VS.R_KEY, "r"), (VS.THETA_KEY, "theta"), (VS.PHI_KEY, "phi"))))


register("store_sync", _synced, O.select(BASES["random"], "SELECT item_id AS id, 'v' AS k, round(r, 9) AS r, round(theta, 9) AS theta, round(phi, 9) AS phi FROM p", ["r", "theta", "phi"], ["id", "k"]))


def _exports(kind: str):
    def run(s, d):
        import uuid

        path = f"{shared_dir(s)}/export-{uuid.uuid4().hex}"
        (P.write_json if kind == "json" else P.write_csv)(source(s, d, "random"), path)
        back = s.read.schema("item_id string, category string, r double, theta double, phi double, x double, y double, z double").json(path) if kind == "json" else s.read.option("header", True).option("escape", '"').csv(path)
        return back.select("item_id", "category", *(F.col(c).cast("double").alias(c) for c in ("r", "x", "z")))

    return run


for _kind in ("json", "csv"):
    register(f"export_{_kind}", _exports(_kind), O.select(BASES["random"], "SELECT item_id, category, round(r, 6) AS r, round(x, 6) AS x, round(z, 6) AS z FROM p", ["r", "x", "z"], ["item_id", "category"]))

# The category layer ----------------------------------------------------------------

_LAYER = O.layer(BASES["random"], _M.tolist())


def _layer(body: str, doubles: list[str], others: list[str], more: str = "") -> str:
    columns = [f"{c} AS {c}" for c in others] + [f"round({c}, 6) + 0.0 AS {c}" for c in doubles]
    return f"WITH RECURSIVE {_LAYER}{', ' + more if more else ''} SELECT {', '.join(columns)} FROM ({body}) AS q"


def _cats(s, d):
    rows = once(source(s, d, "random"), "points")
    return rows, C.summaries(rows)


def _found(s, d):
    """Rows, categories, what each has for itself, which cells touch, and bridges."""
    rows, cats = _cats(s, d)
    own = {r.cat_id: r.exclusivity for r in A.exclusivity(cats, O.SAMPLES).collect()}
    touch = {(r.cat_id, j) for r in A.voronoi(cats, O.SAMPLES).collect() for j in r.neighbours}
    return rows, cats, own, touch, C.bridges(rows, cats, 0.83, own)


def _graph(s, d):
    _, cats, own, touch, found = _found(s, d)
    return C.edges(cats, found, touch, own), found


register("category_summary", lambda s, d: _cats(s, d)[1].select("cat_id", "category", "members", "cx", "cy", "cz", "spread", "cohesion"), _layer("SELECT *, 1 / (1 + spread) AS cohesion FROM cats", ["cx", "cy", "cz", "spread", "cohesion"], ["cat_id", "category", "members"]))
register("bridges", lambda s, d: _found(s, d)[4].select("ordinal", "source", "target", "affinity_source", "affinity_target", "territorial", "strength", "kind"), _layer("SELECT * FROM bridges", ["affinity_source", "affinity_target", "territorial", "strength"], ["ordinal", "source", "target", "kind"]))
register("bridge_kinds", lambda s, d: (lambda x: C.bridges(x[0], x[1], 0.83, {i: 0.02 + 0.11 * i for i in range(10)}).groupBy("kind").count().withColumnRenamed("count", "n"))(_cats(s, d)), f"WITH {O.layer(BASES['random'], _M.tolist()).replace('coalesce(x, 1.0) AS x FROM cats', '0.02 + 0.11 * cat_id AS x FROM cats')} SELECT kind, count(*) AS n FROM bridges GROUP BY 1")
register("bridge_median", lambda s, d: C.upper_median(_found(s, d)[4], "strength"), _layer("SELECT median FROM md", ["median"], []))
register("bridge_items", lambda s, d: C.bridge_items(_found(s, d)[4], 0, 1, 10).select("ordinal", "strength"), _layer("SELECT ordinal, strength FROM bridges WHERE source = 0 AND target = 1 ORDER BY strength DESC, ordinal LIMIT 10", ["strength"], ["ordinal"]))
register("category_edges", lambda s, d: _graph(s, d)[0], _layer("SELECT * FROM edges", ["centroid_distance", "max_strength", "mean_strength", "territorial", "weight"], ["src", "dst", "bridge_count", "adjacent"]))
register("bridge_quality", lambda s, d: C.bridge_quality(_graph(s, d)[0]), _layer("SELECT src AS cat_id, sum(mean_strength * territorial) / 9 AS quality FROM edges GROUP BY 1", ["quality"], ["cat_id"]))
register("bridge_quality_matrix", lambda s, d: C.quality_matrix(_graph(s, d)[0]), _layer("SELECT a.cat_id AS i, b.cat_id AS j, coalesce(max_strength * territorial, 0.0) AS quality FROM cats a CROSS JOIN cats b LEFT JOIN edges ON src = a.cat_id AND dst = b.cat_id", ["quality"], ["i", "j"]))
register("category_neighbors", lambda s, d: C.neighbours_of(_graph(s, d)[0], 0, 4).select("dst", "weight"), _layer("SELECT dst, weight FROM edges WHERE src = 0 ORDER BY weight, dst LIMIT 4", ["weight"], ["dst"]))
register("category_path", lambda s, d: (lambda g: C.category_path(g[0], 0, 7, g[1]).withColumn("bridges_to_next", F.concat_ws(",", "bridges_to_next")))(_graph(s, d)), _layer(
    """SELECT s.step::BIGINT AS step, s.node AS cat_id, s.d - coalesce(lag(s.d) OVER (ORDER BY s.step), s.d) AS hop, s.d AS cumulative, coalesce(sure, 0.0) AS hop_confidence,
    (SELECT product(greatest(sure, 0.01)) FROM hops) AS path_confidence, coalesce(through, '') AS bridges_to_next FROM steps s LEFT JOIN hops USING (step)""",
    ["hop", "cumulative", "hop_confidence", "path_confidence"], ["step", "cat_id", "bridges_to_next"],
    O.route(0, 7) + """, hops AS MATERIALIZED (SELECT a.step, least(1.0, max_strength * territorial * CASE WHEN adjacent THEN 1.2 ELSE 1.0 END) AS sure,
    (SELECT string_agg(ordinal, ',' ORDER BY strength DESC, ordinal) FROM (SELECT ordinal, strength, row_number() OVER (ORDER BY strength DESC, ordinal) AS k FROM bridges WHERE source = a.node AND target = b.node) WHERE k <= 3) AS through
    FROM steps a JOIN steps b ON b.step = a.step + 1 JOIN edges ON src = a.node AND dst = b.node)"""))  # fmt: skip
register("drill_down", lambda s, d: C.drill_down(source(s, d, "random"), "c3", TARGET, 8).select("ordinal", "distance"), O.select(BASES["random"], f"SELECT ordinal, {O.ang(u, l1)} AS distance FROM p WHERE category = 'c3' ORDER BY {O.dot(u, l1)} DESC, ordinal LIMIT 8", ["distance"], ["ordinal"]))
c = O.vec("c")
register("categories_near", lambda s, d: C.near_direction(_cats(s, d)[1], TARGET, 1.6).select("cat_id", "distance"), _layer(f"SELECT cat_id, {O.ang(c, l1)} AS distance FROM cats WHERE {O.ang(c, l1)} <= 1.6", ["distance"], ["cat_id"]))
register("categories_near_weighted", lambda s, d: C.near_weighted(_cats(s, d)[1], TARGET, 0.25, 1.6).select("cat_id", "distance", "effective", "certainty"), _layer(f"SELECT cat_id, {O.ang(c, l1)} AS distance, 2 * {O.ang(c, l1)} AS effective, 0.25 AS certainty FROM cats WHERE {O.ang(c, l1)} <= 1.6", ["distance", "effective", "certainty"], ["cat_id"]))
register("route_to_category", lambda s, d: C.near_direction(_cats(s, d)[1], TARGET, 4.0).limit(1).select("cat_id"), _layer(f"SELECT cat_id FROM cats ORDER BY {O.dot(c, l1)} DESC, cat_id LIMIT 1", [], ["cat_id"]))

# Analytics over the category caps ---------------------------------------------------

ac, bc = O.vec("a.c"), O.vec("b.c")
_OVER = f"SELECT * FROM (SELECT a.cat_id AS a, b.cat_id AS b, {O.ang(ac, bc)} AS distance, {O.lens(O.ang(ac, bc), 'a.spread', 'b.spread')} AS area FROM cats a JOIN cats b ON a.cat_id < b.cat_id) WHERE area > 1e-15"
_TRI = f"SELECT x.cat_id AS a, y.cat_id AS b, z.cat_id AS c, {O.excess(O.vec('x.c'), O.vec('y.c'), O.vec('z.c'))} AS excess FROM cats x JOIN cats y ON x.cat_id < y.cat_id JOIN cats z ON y.cat_id < z.cat_id"
register("cap_areas", lambda s, d: A.cap_areas(_cats(s, d)[1]).select("cat_id", "area"), _layer(f"SELECT cat_id, 4 * {O.PI} * pow(sin(spread / 2), 2) AS area FROM cats", ["area"], ["cat_id"]))
register("cap_overlaps", lambda s, d: A.overlaps(_cats(s, d)[1]), _layer(_OVER, ["distance", "area"], ["a", "b"]))
register("overlap_bridges", lambda s, d: (lambda x: A.overlap_bridges(x[1], x[4]))(_found(s, d)), _layer(f"SELECT o.*, coalesce(n, 0) AS bridges, CASE WHEN n > 0 THEN area / n ELSE 'Infinity'::DOUBLE END AS ratio FROM ({_OVER}) o LEFT JOIN (SELECT least(source, target) AS a, greatest(source, target) AS b, count(*) AS n FROM bridges GROUP BY 1, 2) USING (a, b)", ["distance", "area", "ratio"], ["a", "b", "bridges"]))
register("curvature_triples", lambda s, d: A.triples(_cats(s, d)[1]), _layer(_TRI, ["excess"], ["a", "b", "c"]))
register("curvature_top", lambda s, d: A.top_triples(_cats(s, d)[1], 12), _layer(f"SELECT * FROM ({_TRI}) ORDER BY excess DESC LIMIT 12", ["excess"], ["a", "b", "c"]))
register("curvature_signature", lambda s, d: A.curvature(_cats(s, d)[1]).withColumn("median", F.element_at("excesses", 18)).drop("excesses"), _layer(f"SELECT cat_id, count(*) AS triangles, avg(excess) AS mean, min(excess) AS least, max(excess) AS largest, list_sort(list(excess))[18] AS median FROM (SELECT unnest([a, b, c]) AS cat_id, excess FROM ({_TRI})) GROUP BY 1", ["mean", "least", "largest", "median"], ["cat_id", "triangles"]))
_FAR = O.ang(u, ("(-c.cx)", "(-c.cy)", "(-c.cz)"))
register("antipodal", lambda s, d: (lambda x: A.antipodal(x[0], x[1], 0.6))(_cats(s, d)), _layer(
    f"SELECT cat_id, coalesce(items, 0)::BIGINT AS items, dominant, coalesce(items, 0) / ((SELECT count(*) FROM p) * pow(sin(0.3), 2)) AS coherence FROM cats LEFT JOIN (SELECT cat_id, sum(n) AS items, arg_min(category, (-n, category)) AS dominant FROM (SELECT c.cat_id, p.category, count(*) AS n FROM p JOIN cats c ON {_FAR} <= 0.6 GROUP BY 1, 2) GROUP BY 1) USING (cat_id)",
    ["coherence"], ["cat_id", "items", "dominant"]))
register("region_coherence", lambda s, d: A.coherence(source(s, d, "lattice"), TARGET, 0.5), O.select(BASES["lattice"], f"SELECT count(*) FILTER ({O.dot(u, l1)} >= cos(0.5)) / count(*) / pow(sin(0.25), 2) AS coherence FROM p", ["coherence"], []))
register("geodesic_sweep", lambda s, d: A.sweep(source(s, d, "lattice"), TARGET, OTHER, 0.05).select("ordinal", "distance"), O.select(BASES["lattice"], f"SELECT * FROM (SELECT ordinal, {O.arc(u, O.T1, O.T2)} AS distance FROM p) WHERE distance <= 0.05", ["distance"], ["ordinal"]))
_STOPS = [tuple(a * math.cos(w) + e * math.sin(w) for a, e in zip(O.T1, ((b - a * sum(x * y for x, y in zip(O.T1, O.T2, strict=True))) / math.sqrt(1 - sum(x * y for x, y in zip(O.T1, O.T2, strict=True)) ** 2) for a, b in zip(O.T1, O.T2, strict=True)), strict=True)) for w in (i / 7 * math.acos(sum(x * y for x, y in zip(O.T1, O.T2, strict=True))) for i in range(8))]
_PROFILE = " UNION ALL ".join(f"SELECT {i}::BIGINT AS place, count(*) FILTER ({O.ang(u, O.lit(v))} <= 0.2) AS points FROM p" for i, v in enumerate(_STOPS))
register("geodesic_profile", lambda s, d: A.density_profile(source(s, d, "lattice"), TARGET, OTHER, 8, 0.2), O.select(BASES["lattice"], _PROFILE, [], ["place", "points"]))
register("sweep_report", lambda s, d: (lambda x: A.sweep_report(x[0], x[1], 0, 7, 0.15, 12).withColumn("profile", F.concat_ws(",", "profile")))(_cats(s, d)), _layer(
    """SELECT 0::BIGINT AS a, 7::BIGINT AS b, w AS arc_length, (SELECT count(*) FROM off WHERE d <= 0.15) AS items, (SELECT string_agg(n, ',' ORDER BY k) FROM prof) AS profile, (SELECT avg((n = 0)::INT) FROM prof) AS gap_fraction FROM ends""",
    ["arc_length", "gap_fraction"], ["a", "b", "items", "profile"],
    f"""ends AS (SELECT a.cx AS ax, a.cy AS ay, a.cz AS az, b.cx AS bx, b.cy AS b_y, b.cz AS bz, {O.ang(O.vec("a.c"), O.vec("b.c"))} AS w FROM cats a, cats b WHERE a.cat_id = 0 AND b.cat_id = 7),
    stops AS (SELECT k, w, ax * cos(k / 11 * w) + (bx - ax * cos(w)) / sin(w) * sin(k / 11 * w) AS mx, ay * cos(k / 11 * w) + (b_y - ay * cos(w)) / sin(w) * sin(k / 11 * w) AS my, az * cos(k / 11 * w) + (bz - az * cos(w)) / sin(w) * sin(k / 11 * w) AS mz FROM ends, range(12) t(k)),
    prof AS MATERIALIZED (SELECT k, count(*) FILTER ({O.ang(u, O.vec("m"))} <= 0.15) AS n FROM stops CROSS JOIN p GROUP BY 1),
    tail AS (SELECT *, (bx - ax * cos(w)) / sin(w) AS ex, (b_y - ay * cos(w)) / sin(w) AS ey, (bz - az * cos(w)) / sin(w) AS ez FROM ends),
    turned AS (SELECT ux * ax + uy * ay + uz * az AS along, ux * ex + uy * ey + uz * ez AS across, w FROM p, tail),
    off AS (SELECT CASE WHEN atan2(across, along) BETWEEN 0 AND w THEN acos(least(1.0, sqrt(along * along + across * across))) ELSE least(acos(along), acos(along * cos(w) + across * sin(w))) END AS d FROM turned)"""))  # fmt: skip
register("void_distance", lambda s, d: (lambda x: A.void_distance(x[0], x[1]))(_cats(s, d)), _layer(f"SELECT ordinal, min({O.ang(u, c)} - spread) AS void_distance FROM p CROSS JOIN (SELECT cx, cy, cz, spread FROM cats) GROUP BY 1", ["void_distance"], ["ordinal"]))
_SIDE = f"{O.chord2(O.vec('p.u'), O.vec('y.c'))} - {O.chord2(O.vec('p.u'), O.vec('x.c'))}"
register("lune_sides", lambda s, d: (lambda x: A.lunes(x[4], x[0], x[1]))(_found(s, d)), _layer(
    f"SELECT *, abs(closer_to_a - closer_to_b) / (closer_to_a + closer_to_b + on_bisector) AS asymmetry FROM (SELECT a, b, count(*) FILTER (k > 2e-12) AS closer_to_a, count(*) FILTER (k < -2e-12) AS closer_to_b, count(*) FILTER (abs(k) <= 2e-12) AS on_bisector FROM (SELECT least(source, target) AS a, greatest(source, target) AS b, {_SIDE} AS k FROM bridges JOIN p USING (ordinal) JOIN cats x ON x.cat_id = least(source, target) JOIN cats y ON y.cat_id = greatest(source, target)) GROUP BY 1, 2)",
    ["asymmetry"], ["a", "b", "closer_to_a", "closer_to_b", "on_bisector"]))
_MID = tuple(f"(({x} + {y}) / sqrt(2 + 2 * {O.dot(ac, bc)}))" for x, y in zip(ac, bc, strict=True))
register("lune_divergence", lambda s, d: A.divergence(_cats(s, d)[1]), _layer(f"SELECT a, b, greatest(0.0, min(own - other)) AS divergence FROM (SELECT a, b, own, min({O.ang(O.vec('m'), O.vec('k.c'))}) AS other FROM (SELECT a.cat_id AS a, b.cat_id AS b, {O.ang(ac, bc)} / 2 AS own, {_MID[0]} AS mx, {_MID[1]} AS my, {_MID[2]} AS mz FROM cats a JOIN cats b ON a.cat_id < b.cat_id) q JOIN cats k ON k.cat_id NOT IN (a, b) GROUP BY 1, 2, 3) GROUP BY 1, 2", ["divergence"], ["a", "b"]))
register("mc_coverage", lambda s, d: A.coverage(_cats(s, d)[1], O.SAMPLES), _layer("SELECT avg((h > 0)::INT) AS coverage, avg((h > 1)::INT) AS overlap, count(*) FILTER (h = 0) AS void_samples, count(*) AS samples FROM (SELECT sample, sum(inside::INT) AS h FROM hits GROUP BY 1)", ["coverage", "overlap"], ["void_samples", "samples"]))
register("mc_exclusivity", lambda s, d: A.exclusivity(_cats(s, d)[1], O.SAMPLES), _layer("SELECT cat_id, x AS exclusivity FROM excl", ["exclusivity"], ["cat_id"]))
register("mc_voronoi", lambda s, d: A.voronoi(_cats(s, d)[1], O.SAMPLES).withColumn("neighbours", F.concat_ws(",", "neighbours")), _layer(f"SELECT cat_id, coalesce(n, 0) * 4 * {O.PI} / {O.SAMPLES} AS area, coalesce(js, '') AS neighbours FROM cats LEFT JOIN (SELECT c[1] AS cat_id, count(*) AS n FROM top2 GROUP BY 1) USING (cat_id) LEFT JOIN (SELECT i AS cat_id, string_agg(j, ',' ORDER BY j) AS js FROM touch GROUP BY 1) USING (cat_id)", ["area"], ["cat_id", "neighbours"]))
register("voronoi_report", lambda s, d: (lambda x: A.voronoi_report(x[1], C.edges(x[1], x[4], x[3], x[2]), O.SAMPLES).select("cat_id", "efficiency", "graph_overlap"))(_found(s, d)), _layer(f"SELECT cat_id, CASE WHEN n > 0 THEN members / (n * 4 * {O.PI} / {O.SAMPLES}) ELSE 0.0 END AS efficiency, coalesce(t, 0) / 9 AS graph_overlap FROM cats LEFT JOIN (SELECT c[1] AS cat_id, count(*) AS n FROM top2 GROUP BY 1) USING (cat_id) LEFT JOIN (SELECT i AS cat_id, count(*) AS t FROM touch GROUP BY 1) USING (cat_id)", ["efficiency", "graph_overlap"], ["cat_id"]))

# Layouts, quality, features, feedback ----------------------------------------------

register("layout_uniform", lambda s, d: K.lay_out_uniform(s.read.parquet(f"{d}/customer.parquet").select("c_custkey"), "c_custkey").select("c_custkey", "place", "theta", "phi"), f"SELECT c_custkey, place, round(t - floor(t / ({O.PI} * 2)) * {O.PI} * 2, 6) + 0.0 AS theta, round(acos((n - 1 - 2.0::DOUBLE * place) / n), 6) + 0.0 AS phi FROM (SELECT c_custkey, place, n, place * {O.GOLDEN!r}::DOUBLE AS t FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS place, count(*) OVER () AS n FROM customer))")
register("layout_quality", lambda s, d: K.layout_quality(source(s, d, "random"), 0.05), O.select(BASES["random"], f"SELECT least(1.0, min(d) / sqrt(4 * {O.PI} / (SELECT count(*) FROM p))) AS dispersion, avg((d < 0.05)::INT) AS overlap, count(*) FILTER (d < 0.05) AS close_pairs FROM (SELECT {_D} AS d FROM p a JOIN p b ON a.ordinal < b.ordinal)", ["dispersion", "overlap"], ["close_pairs"]))
_LABELLED = f"(SELECT x.category AS ca, y.category AS cb FROM ({_EDGES.format(k=15)}) JOIN p x ON x.ordinal = src JOIN p y ON y.ordinal = dst)"
register("modularity", lambda s, d: T.modularity(source(s, d, "random")), O.select(BASES["random"], f"SELECT greatest(0.0, least(1.0, (SELECT avg((ca = cb)::INT) FROM {_LABELLED}) - (SELECT sum(pow(k / t, 2)) FROM (SELECT count(*) AS k, sum(count(*)) OVER () AS t FROM (SELECT unnest([ca, cb]) AS c FROM {_LABELLED}) GROUP BY c)))) AS modularity", ["modularity"], []))
register("silhouette", lambda s, d: T.category_silhouette(source(s, d, "random")), O.select(BASES["random"], f"SELECT (avg((b - a) / greatest(a, b)) + 1) / 2 AS silhouette FROM (SELECT i, max(d) FILTER (own) AS a, min(d) FILTER (NOT own) AS b FROM (SELECT a.ordinal AS i, b.category, a.category = b.category AS own, avg({_D}) AS d FROM {_PAIR} GROUP BY 1, 2, 3) GROUP BY 1)", ["silhouette"], []))
register("territorial_health", lambda s, d: T.territorial_health(A.exclusivity(_cats(s, d)[1], O.SAMPLES)), _layer("SELECT sum(x) / 10 AS territorial_health FROM excl", ["territorial_health"], []))
register("bridge_coherence", lambda s, d: T.bridge_coherence(_found(s, d)[4]), _layer("SELECT count(*) FILTER (kind = 'genuine') / count(*) AS bridge_coherence FROM bridges", ["bridge_coherence"], []))
register("jaccard_graph", lambda s, d: N.jaccard_edges(_embeddings(s, d).select(F.col("vec_id").alias("ordinal"), V.doubles("embedding").alias("embedding")), 0.15, 5), "WITH a AS (SELECT vec_id AS i, list_filter(range(1, 65), lambda k: abs(embedding[k]::DOUBLE) > 0.15) AS s FROM embeddings), q AS (SELECT u.i, v.i AS j, len(list_intersect(u.s, v.s)) / (len(u.s) + len(v.s) - len(list_intersect(u.s, v.s))) AS similarity FROM a u JOIN a v ON u.i <> v.i) SELECT i, j, round(similarity, 6) + 0.0 AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY similarity DESC, j DESC) AS k FROM q WHERE similarity > 0) WHERE k <= 5")
_F = ["mean_members", "category_entropy", "sparsity", "axis_entropy", "noise", "intra_cosine", "inter_cosine"]
register("corpus_features", lambda s, d: T.corpus_features(source(s, d, "random")).select("n_items", "n_categories", "dim", "largest", "smallest", *_F), O.select(BASES["random"], """SELECT *, n_items / n_categories AS mean_members FROM (SELECT sum(n)::BIGINT AS n_items, count(*) AS n_categories, max(n) AS largest, min(n) AS smallest, sum(-(n / t) * log10(n / t)) / log10(count(*)) AS category_entropy FROM (SELECT category, count(*) AS n, sum(count(*)) OVER () AS t FROM p GROUP BY 1)),
  (SELECT 64::BIGINT AS dim, avg((abs(v) > 0.05)::INT) AS sparsity FROM (SELECT unnest(embedding) AS v FROM p)),
  (SELECT sum(-(k / t) * log10(k / t)) / log10(64) AS axis_entropy FROM (SELECT count(*) AS k, sum(count(*)) OVER () AS t FROM (SELECT i, embedding[i] AS v FROM p, range(1, 65) x(i)) WHERE abs(v) > 0.05 GROUP BY i)),
  (SELECT avg(v) AS noise FROM (SELECT v, row_number() OVER (PARTITION BY ordinal ORDER BY v) AS k, count(*) OVER (PARTITION BY ordinal) AS m FROM (SELECT ordinal, abs(unnest(embedding)) AS v FROM p) WHERE v <= 0.05) WHERE k = m // 2 + 1),
  (SELECT avg(list_cosine_similarity(a.embedding, b.embedding)) FILTER (a.category = b.category) AS intra_cosine, avg(list_cosine_similarity(a.embedding, b.embedding)) FILTER (a.category <> b.category) AS inter_cosine FROM p a JOIN p b ON a.ordinal < b.ordinal)""", _F, ["n_items", "n_categories", "dim", "largest", "smallest"]))
_scores = lambda s, d: s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("corpus_id"), (F.col("value") / 100).alias("score"), F.col("event_id").alias("seq"))
_CLAMP = "CASE WHEN value > 100 THEN 1.0 WHEN value < 0 THEN 0.0 ELSE value / 100 END"
register("feedback_summary", lambda s, d: T.feedback_summary(_scores(s, d)), f"SELECT user_id AS corpus_id, count(*) AS events, round(sum(s) / count(*), 6) + 0.0 AS mean, round(min(s), 6) + 0.0 AS least, round(max(s), 6) + 0.0 AS largest FROM (SELECT user_id, {_CLAMP} AS s FROM events) GROUP BY 1")
register("feedback_window", lambda s, d: T.feedback_summary(_scores(s, d), 10).select("corpus_id", "events", "mean"), f"SELECT corpus_id, count(*) AS events, round(avg(s), 6) + 0.0 AS mean FROM (SELECT user_id AS corpus_id, {_CLAMP} AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 10 GROUP BY 1")
register("feedback_corpora", lambda s, d: T.corpus_ids(_scores(s, d)), "SELECT user_id AS corpus_id FROM events GROUP BY 1")


def _meta(s, d):
    """A model of 30 made-up corpora, asked for a configuration for each of ten others."""
    known = [T.MetaRecord(f"k{i}", [float(i % 7), float(i * i % 11), 3.0], {"k": i}, 0.2 + (i * 37 % 50) / 100) for i in range(30)]
    out = []
    for name, model in (("nearest", T.MetaModel()), ("weighted", T.WeightedMetaModel())):
        model.fit(known)
        out += [(name, q, model.ranked([q * 0.7, q * 1.1, 1.0])[0][0].corpus_id) for q in range(10)]
    return s.createDataFrame(out, "model string, query long, corpus_id string")


_Z = "SELECT *, (i % 7 - m1) / s1 AS z1, (i * i % 11 - m2) / s2 AS z2 FROM k, (SELECT avg(i % 7) AS m1, stddev_pop(i % 7) AS s1, avg(i * i % 11) AS m2, stddev_pop(i * i % 11) AS s2 FROM k)"
register("meta_models", _meta, f"""WITH k AS (SELECT i, 0.2 + (i * 37 % 50) / 100 AS score FROM range(30) t(i)), z AS ({_Z}), d AS (SELECT q, i, score, sqrt(pow(z1 - (q * 0.7 - m1) / s1, 2) + pow(z2 - (q * 1.1 - m2) / s2, 2)) AS d FROM z, range(10) r(q))
SELECT 'nearest' AS model, q AS query, 'k' || arg_min(i, (d, i)) AS corpus_id FROM d GROUP BY q UNION ALL SELECT 'weighted', q, 'k' || arg_min(i, (-score / (d + 0.1), i)) FROM d GROUP BY q""")

# Streams ---------------------------------------------------------------------------

_WATCHED = G.Intersection((G.Band(0.5, 2.3), G.Shell(0.2, 6.0)))
_INSIDE = "phi >= 0.5 AND phi <= 2.3 AND r >= 0.2 AND r <= 6"
_EV = "SELECT event_id, ts, user_id, CASE event_type WHEN 'click' THEN 'entered' WHEN 'error' THEN 'left' ELSE 'moved' END AS event_type, value / 10 AS r, acos(1.0::DOUBLE - 2.0 * (user_id::DOUBLE * 0.6180339887498949::DOUBLE - floor(user_id::DOUBLE * 0.6180339887498949::DOUBLE))) AS phi FROM events"


def _stream(s: SparkSession, d: str) -> DataFrame:
    """The events as a stream of files, in batches."""
    return ST.spatial_events(ST.read_events(s, f"{d}/events.parquet*", s.read.parquet(f"{d}/events.parquet").schema))


register("stream_events", lambda s, d: ST.finished(_stream(s, d), "events").select("event_id", "event_type"), f"SELECT event_id, event_type FROM ({_EV})")
for _name, _kind, _f in (("stream_entered", "entered", ST.entered), ("stream_left", "left", ST.left)):
    register(_name, lambda s, d, f=_f, n=_name: ST.finished(f(_stream(s, d), _WATCHED), n).select("event_id"), f"SELECT event_id FROM ({_EV}) WHERE event_type = '{_kind}' AND {_INSIDE}")
register("stream_transitions", lambda s, d: ST.finished(ST.transitions(_stream(s, d), _WATCHED, "0 seconds"), "transitions").groupBy("item_id", "change").count().withColumnRenamed("count", "n"), f"SELECT 'u' || user_id AS item_id, CASE WHEN inside THEN 'entered' ELSE 'left' END AS change, count(*) AS n FROM (SELECT *, lag(inside, 1, false) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM (SELECT *, {_INSIDE} AS inside FROM ({_EV}))) WHERE inside <> was GROUP BY 1, 2")
register("stream_windows", lambda s, d: ST.finished(ST.windowed_counts(_stream(s, d), _WATCHED, "1 day"), "windows", complete=True).select(F.col("window.start").cast("string").alias("start"), "event_type", "events"), f"SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS events FROM ({_EV}) WHERE {_INSIDE} GROUP BY 1, 2")

# Those that SQL cannot express; the tests hold them against numpy --------------------

_corpus = lambda s, d: source(s, d, "random").select("item_id", "ordinal", "category", "embedding")
_xyz = ("ordinal", "x", "y", "z", "certainty", "proj_mag")
register("project_pca", lambda s, d: (lambda c: J.Pca.fit(c).transform(c).select(*_xyz))(_corpus(s, d)), None)
register("project_kernel_pca", lambda s, d: (lambda c: J.KernelPca.fit(c).transform(c).select(*_xyz))(_corpus(s, d)), None)
register("project_laplacian", lambda s, d: (lambda c: J.Laplacian.fit(c, threshold=0.15).transform(c).select(*_xyz))(_corpus(s, d)), None)


def _inner(s, d):
    corpus = once(_corpus(s, d), "corpus")
    outer = J.Pca.fit(corpus).transform(corpus).select("category", "certainty")
    return corpus, J.inner_models(corpus, outer)


register("inner_spheres", lambda s, d: J.inner_stats(*_inner(s, d)), None)


def _inner_points(s, d):
    corpus, inner = _inner(s, d)
    parts = [J.inner_points(corpus, m).select("ordinal", "category", "theta", "phi") for m in inner.values()]
    out = s.createDataFrame([], "ordinal long, category string, theta double, phi double")
    for part in parts:
        out = out.union(part)
    return out


register("inner_points", _inner_points, None)
register("detect_globs", lambda s, d: K.globs(source(s, d, "random"), max_k=10), None)
register("layout_clustered", lambda s, d: K.clustered_layout(source(s, d, "random"), 5).select("ordinal", "glob", "theta", "phi"), None)
register("layout_clustered_quality", lambda s, d: K.clustered_quality(K.clustered_layout(source(s, d, "random"), 5)), None)
register("layout_force", lambda s, d: K.force_layout(source(s, d, "random")), None)


def _local_plane(s, d):
    p = K.local_plane(source(s, d, "lattice"), TARGET, 12)
    return s.createDataFrame([(*p["centroid"], p["variance_ratio"])], "cx double, cy double, cz double, variance_ratio double")


def _domain_groups(s, d):
    caps = _cats(s, d)[1]
    over, area = A.overlaps(caps).collect(), {r.cat_id: r.area for r in A.cap_areas(caps).collect()}
    near = {(r.cat_id, j) for r in A.voronoi(caps, O.SAMPLES).collect() for j in r.neighbours}
    sim = {(i, j): 0.5 for i, j in near if i < j}
    for r in over:
        if min(area[r.a], area[r.b]) > 1e-15:
            sim[r.a, r.b] = sim.get((r.a, r.b), 0.0) + 0.5 * min(1.0, r.area / min(area[r.a], area[r.b]))
    return s.createDataFrame([(g, int(c)) for g, cs in enumerate(C.domain_groups(sim, len(area), 4)) for c in cs], "group_id int, cat_id int")


register("local_manifold", _local_plane, None)
register("domain_groups", _domain_groups, None)
