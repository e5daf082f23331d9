"""Point tables: where they come from, what is derived from them, where they go.

A point table has ``item_id, ordinal, category, r, theta, phi``, the direction
``ux, uy, uz`` and the Cartesian ``x, y, z``.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import sphere as S
from orrery.functions import vectors as V
from orrery.operators.places import placed
from orrery.sources.tables import evaluated

GOLDEN, ROOT = 2.399963229728653, 0.41421356237309515


def matrix(dim: int, seed: int = 42) -> np.ndarray:
    """A fixed 3 x ``dim`` matrix of normal numbers: SplitMix64, then Box-Muller."""
    state, out = seed, []
    mask = (1 << 64) - 1

    def uniform() -> float:
        nonlocal state
        state = (state + 0x9E3779B97F4A7C15) & mask
        z = state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        return ((z ^ (z >> 31)) >> 11) / float(1 << 53)

    while len(out) < 3 * dim:
        u, v = max(uniform(), 1e-300), uniform()
        rho = math.sqrt(-2 * math.log(u))
        out += [rho * math.cos(2 * math.pi * v), rho * math.sin(2 * math.pi * v)]
    return np.array(out[: 3 * dim]).reshape(3, dim)


def from_cartesian(df: DataFrame, radius: str | None = None) -> DataFrame:
    """Adds spherical coordinates and the direction to ``x, y, z``.

    With ``radius``, an expression, the point is moved out to that radius.
    """
    r, theta, phi = S.to_spherical(S.vec(""))
    return from_spherical(evaluated(df, {"r": F.expr(radius or r), "theta": F.expr(theta), "phi": F.expr(phi)}))


def from_spherical(df: DataFrame) -> DataFrame:
    """Adds the direction and ``x, y, z`` to ``r, theta, phi``."""
    out = evaluated(df, dict(zip(("ux", "uy", "uz"), map(F.expr, S.direction("theta", "phi")), strict=True)))
    return out.withColumns({c: F.col("r") * F.col(f"u{c}") for c in "xyz"})


def random_points(embeddings: DataFrame, seed: int = 42, dim: int = 64, keep_embedding: bool = False) -> DataFrame:
    """Each vector under a fixed random projection; the radius is the vector's length."""
    m = matrix(dim, seed)
    unit = V.normalized("embedding")
    rows = embeddings.select(F.concat(F.lit("v"), "vec_id").alias("item_id"), F.col("vec_id").alias("ordinal"), F.concat(F.lit("c"), "label").alias("category"), V.doubles("embedding").alias("embedding"))
    rows = rows.withColumn("magnitude", V.norm("embedding")).withColumn("_unit", unit)
    rows = evaluated(rows, {c: V.dot(V.constant(m[i]), "_unit") for i, c in enumerate("xyz")}).drop("_unit")
    return from_cartesian(rows if keep_embedding else rows.drop("embedding"), "magnitude")


def lattice_points(orders: DataFrame) -> DataFrame:
    """Orders spread over the sphere by the golden angle, their price as radius."""
    k = "CAST(o_orderkey AS DOUBLE)"
    part = f"({k} * {ROOT!r} - floor({k} * {ROOT!r}))"
    rows = orders.select(
        F.concat(F.lit("o"), "o_orderkey").alias("item_id"),
        F.col("o_orderkey").alias("ordinal"),
        F.col("o_orderpriority").alias("category"),
        F.expr("o_totalprice / 99991.0D").alias("r"),
        "o_orderkey",
    )
    return from_spherical(evaluated(rows, {"theta": F.expr(S.wrap(f"{k} * {GOLDEN!r}D")), "phi": F.expr(f"acos(1.0D - 2.0D * {part})")}).drop("o_orderkey"))


def with_cells(points: DataFrame, shells: list[float], theta_parts: int = 12, phi_parts: int = 6) -> DataFrame:
    """Adds ``shell_id`` and ``sector_id``, the clustering columns of a stored table."""
    if theta_parts < 1 or phi_parts < 1:
        raise ValueError("divisions must be at least 1")
    bounds = sorted(set(shells))
    inside = sum((F.when(F.col("r") >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    shell = F.least(inside, F.lit(max(len(bounds) - 1, 0)))
    t = F.least(F.floor(F.col("theta") / (2 * math.pi) * theta_parts), F.lit(theta_parts - 1))
    p = F.least(F.floor(F.col("phi") / math.pi * phi_parts), F.lit(phi_parts - 1))
    return points.withColumns({"shell_id": shell.cast("int"), "sector_id": (t * phi_parts + p).cast("int")})


def write_points(points: DataFrame, path: str, shells: list[float], theta_parts: int = 12, phi_parts: int = 6) -> None:
    """Partitioned by cell, so that region queries read only the cells they meet."""
    cells = with_cells(points, shells, theta_parts, phi_parts)
    cells.repartition("sector_id").write.mode("overwrite").partitionBy("sector_id", "shell_id").parquet(path)


def corpus_from_json(spark: SparkSession, path: str) -> DataFrame:
    """``{"categories": [...], "embeddings": [[...]]}`` as rows."""
    raw = spark.read.schema("categories array<string>, embeddings array<array<double>>").json(path, multiLine=True)
    rows = raw.select(F.posexplode(F.arrays_zip("categories", "embeddings")).alias("ordinal", "z"))
    return rows.select(F.concat(F.lit("s-"), F.lpad(F.col("ordinal").cast("string"), 4, "0")).alias("item_id"), "ordinal", F.col("z.categories").alias("category"), F.col("z.embeddings").alias("embedding"))


def corpus_from_lists(spark: SparkSession, categories: list, embeddings) -> DataFrame:
    """Lists or arrays of any float type; refuses what is not finite or not even."""
    rows = [[float(x) for x in e] for e in embeddings]
    if len(categories) != len(rows):
        raise ValueError(f"{len(categories)} categories for {len(rows)} embeddings")
    if not all(math.isfinite(x) for e in rows for x in e):
        raise ValueError("embeddings must be finite")
    data = [(f"s-{i:04}", i, c, e) for i, (c, e) in enumerate(zip(categories, rows, strict=True))]
    return spark.createDataFrame(data, "item_id string, ordinal long, category string, embedding array<double>")


def corpus_from_rows(rows: DataFrame, item_id: str, category: str, embedding: str) -> DataFrame:
    """Any table as a corpus, by the names of its columns; ordinals follow a hash of the ids."""
    named = rows.select(F.col(item_id).cast("string").alias("item_id"), F.coalesce(F.col(category).cast("string"), F.lit("unknown")).alias("category"), V.doubles(embedding).alias("embedding"))
    return placed(named.withColumn("_h", F.xxhash64("item_id")), [], "_h").select("item_id", F.col("place").cast("long").alias("ordinal"), "category", "embedding")


def vector_from_json(text: str) -> list[float]:
    """A query vector from a JSON array of finite numbers."""
    found = json.loads(text)
    if not isinstance(found, list) or not found or not all(isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) for x in found):
        raise ValueError("a query vector is an array of finite numbers")
    return [float(x) for x in found]


def stress_corpus(spark: SparkSession, categories: int = 10, members: int = 30, dim: int = 128, seed: int = 42) -> DataFrame:
    """A corpus to try things on: sparse categories that share some of their axes, and noise."""
    rng = np.random.default_rng(seed)
    names, rows = [], []
    for c in range(categories):
        axes = rng.choice(dim, 8, replace=False)
        for _ in range(members):
            v = rng.uniform(-0.04, 0.04, dim)
            v[axes] += rng.uniform(0.5, 1.0, 8)
            v[rng.choice(dim, 2)] += 0.4
            names.append(f"category-{c}")
            rows.append(v.tolist())
    return corpus_from_lists(spark, names, rows)


def placed_radius(radial, magnitude: str = "intensity") -> str:
    """The radius of a point as an expression: ``"magnitude"``, a number, or a function of the magnitude's expression."""
    return magnitude if radial == "magnitude" else radial(magnitude) if callable(radial) else f"CAST({float(radial)!r} AS DOUBLE)"


def projected(points: DataFrame) -> DataFrame:
    return points.select("item_id", "category", "x", "y", "z")


def validate(corpus: DataFrame, min_rows: int = 3, min_norm: float = 1e-9) -> int:
    """The common dimension; one pass; ``ValueError`` for what cannot be projected."""
    n, lo, hi, shortest = corpus.agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding")), F.min(V.norm("embedding"))).first()
    if n < min_rows:
        raise ValueError(f"{n} rows, at least {min_rows} are needed")
    if lo != hi:
        raise ValueError(f"dimensions from {lo} to {hi}")
    if shortest < min_norm:
        raise ValueError("a vector has no length")
    return lo


EXPORTED = ["item_id", "category", "r", "theta", "phi", "x", "y", "z"]


def exported(points: DataFrame) -> DataFrame:
    return points.select(*EXPORTED, *[c for c in ("certainty", "intensity") if c in points.columns])


def write_json(points: DataFrame, path: str) -> None:
    exported(points).write.mode("overwrite").json(path)


def write_csv(points: DataFrame, path: str) -> None:
    """A header, quoted strings and six decimals."""
    out = exported(points)
    numbers = {c: F.format_string("%.6f", F.col(c)) for c, t in out.dtypes if t == "double"}
    text = {c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) for c, t in out.dtypes if t == "string"}
    names = out.columns
    lines = out.select(F.concat_ws(",", *[(numbers | text).get(c, F.col(c).cast("string")) for c in names]).alias(",".join(names)))
    lines.write.mode("overwrite").option("header", True).option("quote", "").option("sep", "\x01").csv(path)


def write_html(points: DataFrame, path: str, limit: int = 20000) -> None:
    """A stand-alone page that draws the points; refuses tables larger than ``limit``."""
    rows = [r.asDict() for r in exported(points).limit(limit + 1).collect()]
    if len(rows) > limit:
        raise ValueError(f"more than {limit} points; aggregate or filter first")
    page = (
        "<!doctype html><meta charset=utf-8><canvas id=c width=900 height=900></canvas><script>const P="
        + json.dumps(rows)
        + ";let a=0;const g=c.getContext('2d'),m=Math.max(1e-9,...P.map(p=>p.r));const hue=s=>{let h=0;for(const k of s||'')h=(h*31+k.charCodeAt(0))%360;return h};"
        "setInterval(()=>{a+=.01;g.clearRect(0,0,900,900);for(const p of P){const x=p.x*Math.cos(a)-p.y*Math.sin(a);g.fillStyle=`hsl(${hue(p.category)},70%,50%)`;g.fillRect(450+x/m*400,450-p.z/m*400,3,3)}},40)</script>"
    )
    with open(path, "w", encoding="utf-8") as f:
        f.write(page)
