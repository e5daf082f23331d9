"""The registered queries as DuckDB SQL, written apart from the library's own formulas.

Wherever there is a second way to say a thing, it is taken here: angles from chords,
triangle excesses from triple products, lens areas from three dihedral angles,
inverse functions from the values they were made of, sums over pairs in place of
sums over groups.  Nothing of ``orrery.functions`` is used.
"""

from __future__ import annotations

import math
from functools import reduce

PI = repr(math.pi)
GOLDEN, ROOT = 2.399963229728653, 0.41421356237309515
T1, T2 = (0.36, 0.48, 0.8), (-0.6, 0.64, 0.48)
SAMPLES = 20_000


def lit(v) -> tuple[str, ...]:
    return tuple(f"({float(x)!r}::DOUBLE)" for x in v)


def vec(p: str) -> tuple[str, ...]:
    return f"{p}x", f"{p}y", f"{p}z"


def dot(a, b) -> str:
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"


def chord2(a, b) -> str:
    return "(" + " + ".join(f"({x} - {y}) * ({x} - {y})" for x, y in zip(a, b, strict=True)) + ")"


def ang(a, b) -> str:
    """The angle of two unit vectors, from their chord."""
    return f"(2 * asin(least(1.0, sqrt({chord2(a, b)}) / 2)))"


def haversine(theta: float, phi: float) -> str:
    return f"(2 * asin(least(1.0, sqrt(pow(sin((phi - {phi!r}) / 2), 2) + sin(phi) * sin({phi!r}) * pow(sin((theta - {theta!r}) / 2), 2)))))"


def excess(a, b, c) -> str:
    triple = f"{a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) + {a[1]} * ({b[2]} * {c[0]} - {b[0]} * {c[2]}) + {a[2]} * ({b[0]} * {c[1]} - {b[1]} * {c[0]})"
    return f"(2 * atan2(abs({triple}), 1 + {dot(a, b)} + {dot(b, c)} + {dot(c, a)}))"


def lens(d: str, a: str, b: str) -> str:
    safe = lambda x: f"acos(greatest(-1.0, least(1.0, {x})))"
    area = (
        f"2 * {PI} - 2 * {safe(f'(cos({d}) - cos({a}) * cos({b})) / (sin({a}) * sin({b}))')}"
        f" - 2 * cos({a}) * {safe(f'(cos({b}) - cos({d}) * cos({a})) / (sin({d}) * sin({a}))')}"
        f" - 2 * cos({b}) * {safe(f'(cos({a}) - cos({d}) * cos({b})) / (sin({d}) * sin({b}))')}"
    )
    cap = lambda x: f"4 * {PI} * pow(sin({x} / 2), 2)"
    return f"(CASE WHEN {d} >= {a} + {b} THEN 0.0 WHEN {d} <= abs({a} - {b}) THEN {cap(f'least({a}, {b})')} ELSE {area} END)"


def arc(p, a, b) -> str:
    """Distance from the arc of two fixed directions: over its inside by the normal, else from an end."""
    n = [a[i] * b[j] - a[j] * b[i] for i, j in ((1, 2), (2, 0), (0, 1))]
    size = math.sqrt(sum(x * x for x in n))
    n = [x / size for x in n]
    side = lambda u, v: [u[i] * v[j] - u[j] * v[i] for i, j in ((1, 2), (2, 0), (0, 1))]
    inside = f"{dot(p, lit(side(n, a)))} >= 0 AND {dot(p, lit(side(b, n)))} >= 0"
    return f"(CASE WHEN {inside} THEN asin(least(1.0, abs({dot(p, lit(n))}))) ELSE least({ang(p, lit(a))}, {ang(p, lit(b))}) END)"


def rotated(a, b, t: float) -> tuple[str, ...]:
    """``a`` turned towards ``b`` by the part ``t`` of their angle."""
    w = ang(a, b)
    return tuple(f"({x} * cos({t!r} * {w}) + ({y} - {x} * cos({w})) / sin({w}) * sin({t!r} * {w}))" for x, y in zip(a, b, strict=True))


# Sources ---------------------------------------------------------------------------

_TURN = f"2 * {PI}"


def _points(rows: str) -> str:
    return f"SELECT *, r * ux AS x, r * uy AS y, r * uz AS z FROM ({rows})"


def random_source(matrix) -> str:
    axes = ", ".join(f"list_dot_product([{', '.join(f'{v!r}::DOUBLE' for v in m)}], e) AS p{c}" for c, m in zip("xyz", matrix, strict=True))
    base = "SELECT 'v' || vec_id AS item_id, vec_id AS ordinal, 'c' || label AS category, embedding::DOUBLE[] AS embedding FROM embeddings"
    long = f"SELECT *, sqrt(list_sum(list_transform(embedding, lambda v: v * v))) AS magnitude FROM ({base})"
    flat = f"SELECT * EXCLUDE (e), {axes} FROM (SELECT *, list_transform(embedding, lambda v: v / magnitude) AS e FROM ({long}))"
    unit = f"SELECT * EXCLUDE (px, py, pz), magnitude AS r, px / sqrt(px * px + py * py + pz * pz) AS ux, py / sqrt(px * px + py * py + pz * pz) AS uy, pz / sqrt(px * px + py * py + pz * pz) AS uz FROM ({flat})"
    return _points(f"SELECT *, CASE WHEN atan2(uy, ux) < 0 THEN atan2(uy, ux) + {_TURN} ELSE atan2(uy, ux) END AS theta, atan2(sqrt(ux * ux + uy * uy), uz) AS phi FROM ({unit})")


def lattice_source() -> str:
    k = "o_orderkey::DOUBLE"
    share = f"({k} * {ROOT!r}::DOUBLE - floor({k} * {ROOT!r}::DOUBLE))"
    angle = f"SELECT 'o' || o_orderkey AS item_id, o_orderkey AS ordinal, o_orderpriority AS category, o_totalprice / 99991.0::DOUBLE AS r, {k} * {GOLDEN!r}::DOUBLE AS t, 1.0::DOUBLE - 2.0::DOUBLE * {share} AS uz FROM orders"
    both = f"SELECT * EXCLUDE (t), t - floor(t / ({_TURN})) * ({_TURN}) AS theta, acos(uz) AS phi, sqrt(1 - uz * uz) AS rho FROM ({angle})"
    return _points(f"SELECT * EXCLUDE (rho), rho * cos(theta) AS ux, rho * sin(theta) AS uy FROM ({both})")


def select(base: str, body: str, doubles: list[str], others: list[str], recursive: bool = False) -> str:
    """``body`` over the source ``p`` with doubles to six decimals."""
    columns = [f"{c} AS {c}" for c in others] + [f"round({c}, 6) + 0.0 AS {c}" for c in doubles]
    return f"WITH {'RECURSIVE ' if recursive else ''}p AS MATERIALIZED ({base}) SELECT {', '.join(columns)} FROM ({body}) AS q"


# The category layer ----------------------------------------------------------------


def layer(base: str, matrix, threshold: float = 0.83) -> str:
    """CTEs after ``p``: ``cats``, ``hits``, ``excl``, ``touch``, ``bridges``, ``edges``."""
    axes = ", ".join(f"list_dot_product([{', '.join(f'{v!r}::DOUBLE' for v in m)}], centroid) AS q{c}" for c, m in zip("xyz", matrix, strict=True))
    s = f"(SELECT i AS sample, sqrt(1 - zz * zz) * cos(i * {GOLDEN!r}) AS ux, sqrt(1 - zz * zz) * sin(i * {GOLDEN!r}) AS uy, zz AS uz FROM (SELECT i, 1.0::DOUBLE - (2 * i + 1) / {SAMPLES}.0::DOUBLE AS zz FROM range({SAMPLES}) t(i)))"
    return f"""
p AS MATERIALIZED ({base}),
e AS (SELECT category, i, avg(embedding[i]) AS v FROM p, range(1, 65) t(i) GROUP BY 1, 2),
m AS (SELECT category, min(ordinal) AS lead, count(*) AS members FROM p GROUP BY 1),
c0 AS (SELECT category, lead, members, list(v ORDER BY i) AS centroid FROM e JOIN m USING (category) GROUP BY 1, 2, 3),
c1 AS (SELECT *, {axes} FROM c0),
c2 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY lead) - 1 AS cat_id, category, members, centroid, qx / sqrt(qx * qx + qy * qy + qz * qz) AS cx, qy / sqrt(qx * qx + qy * qy + qz * qz) AS cy, qz / sqrt(qx * qx + qy * qy + qz * qz) AS cz FROM c1),
cats AS MATERIALIZED (SELECT c2.*, CASE WHEN members > 1 THEN s ELSE 0.0 END AS spread FROM c2 JOIN (SELECT c2.category, avg({ang(vec("u"), vec("c"))}) AS s FROM p JOIN c2 USING (category) GROUP BY 1) USING (category)),
hits AS MATERIALIZED (SELECT sample, cat_id, {dot(vec("u"), vec("c"))} AS d, {dot(vec("u"), vec("c"))} >= cos(spread) AS inside FROM {s} CROSS JOIN (SELECT cat_id, cx, cy, cz, spread FROM cats)),
excl AS MATERIALIZED (SELECT cat_id, coalesce(x, 1.0) AS x FROM cats LEFT JOIN (SELECT cat_id, avg((h = 1)::INT) AS x FROM (SELECT cat_id, count(*) OVER (PARTITION BY sample) AS h FROM hits WHERE inside) GROUP BY 1) USING (cat_id)),
top2 AS MATERIALIZED (SELECT sample, list(cat_id ORDER BY d DESC, cat_id) AS c, list(d ORDER BY d DESC, cat_id) AS d FROM hits GROUP BY 1),
touch AS MATERIALIZED (SELECT DISTINCT unnest([c[1], c[2]]) AS i, unnest([c[2], c[1]]) AS j FROM top2 WHERE d[1] - d[2] < 0.05),
b0 AS (SELECT p.ordinal, o.cat_id AS source, t.cat_id AS target, list_cosine_similarity(p.embedding, o.centroid) AS affinity_source, list_cosine_similarity(p.embedding, t.centroid) AS affinity_target
  FROM p JOIN cats o USING (category) JOIN cats t ON t.cat_id <> o.cat_id),
b1 AS MATERIALIZED (SELECT b0.*, greatest(0.05, pow(x.x * y.x, 0.5)) AS territorial,
  greatest(0.05, pow(x.x * y.x, 0.5)) * CASE WHEN affinity_source + affinity_target > 2.220446049250313e-16 THEN 2 / (1 / affinity_source + 1 / affinity_target) ELSE 0.0 END AS strength
  FROM b0 JOIN excl x ON x.cat_id = source JOIN excl y ON y.cat_id = target WHERE affinity_target > 0 AND affinity_target > affinity_source * {threshold!r}),
md AS (SELECT list_sort(list(strength))[count(*) // 2 + 1] AS median FROM b1),
bridges AS MATERIALIZED (SELECT b1.*, CASE WHEN territorial < 0.3 THEN 'overlap' WHEN strength >= median THEN 'genuine' ELSE 'weak' END AS kind FROM b1, md),
edges AS MATERIALIZED (SELECT a.cat_id AS src, b.cat_id AS dst, {ang(vec("a.c"), vec("b.c"))} AS centroid_distance, coalesce(n, 0) AS bridge_count, coalesce(hi, 0.0) AS max_strength, coalesce(total / n, 0.0) AS mean_strength,
  greatest(0.05, pow(x.x * y.x, 0.5)) AS territorial, EXISTS (SELECT 1 FROM touch WHERE i = a.cat_id AND j = b.cat_id) AS adjacent,
  {ang(vec("a.c"), vec("b.c"))} * CASE WHEN EXISTS (SELECT 1 FROM touch WHERE i = a.cat_id AND j = b.cat_id) THEN 0.8 ELSE 1.0 END / (1 + coalesce(total, 0.0)) AS weight
  FROM cats a JOIN cats b ON a.cat_id <> b.cat_id JOIN excl x ON x.cat_id = a.cat_id JOIN excl y ON y.cat_id = b.cat_id
  LEFT JOIN (SELECT source, target, count(*) AS n, max(strength) AS hi, sum(strength) AS total FROM bridges GROUP BY 1, 2) z ON z.source = a.cat_id AND z.target = b.cat_id)"""


def route(start: int, goal: int) -> str:
    """CTEs after ``edges``: ``best``, the cheapest weights from ``start``, and ``path``, the way back from ``goal``."""
    return f"""
w AS MATERIALIZED (SELECT src, dst, greatest(weight, 0.0) AS w FROM edges),
best(node, d) USING KEY (node) AS (SELECT {start}::BIGINT, 0.0::DOUBLE UNION SELECT * FROM (SELECT w.dst, min(best.d + w.w) AS d FROM best JOIN w ON w.src = best.node GROUP BY 1) n WHERE n.d < coalesce((SELECT r.d FROM recurring.best r WHERE r.node = n.dst), 1e300)),
path(node, d, back) AS (SELECT node, d, 0 FROM best WHERE node = {goal} UNION ALL SELECT * FROM (SELECT b.node, b.d, path.back + 1 FROM path JOIN w ON w.dst = path.node JOIN best b ON b.node = w.src WHERE path.node <> {start} AND abs(b.d + w.w - path.d) < 1e-12 ORDER BY b.d, b.node LIMIT 1)),
steps AS (SELECT node, d, max(back) OVER () - back AS step FROM path)"""


def either(*parts: str) -> str:
    return reduce(lambda a, b: f"({a} OR {b})", parts)
