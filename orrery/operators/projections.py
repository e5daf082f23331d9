"""Projections to three dimensions.

PCA is one distributed Gram aggregate and a small eigenproblem on the driver.  The
kernel and Laplacian projections are fitted on all rows (or, if asked, on ``cap`` of
them, with a warning).  Their matrices of all pairs are never held: tasks take them a
block at a time, multiplied by a few vectors, and the driver holds those vectors and
the rows, in proportion to the number of rows.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import vectors as V
from orrery.operators.knn import jaccard_edges
from orrery.sources.points import from_cartesian, matrix
from orrery.sources.tables import evaluated

#: Rows up to which a matrix of all pairs is made in one place.
DENSE = 2000
#: Rows and columns of a block of all pairs, in tasks.
ROWS, COLUMNS = 512, 2048
#: Ranges into which the squared distances are cut at a time.
BINS = 1 << 16


def _rows(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit rows; a zero row becomes the first axis."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    out = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    out[n[:, 0] == 0, 0] = 1.0
    return out


def _oriented(v: np.ndarray) -> np.ndarray:
    """Columns with their largest entry positive."""
    return v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)


def grams(corpus: DataFrame, key: str | None = None) -> dict:
    """Number, sum and Gram matrix of the unit rows of each key, summed on the executors."""

    def run(batches):
        sums: dict = {}
        for batch in batches:
            if batch.num_rows:
                x, keys = _unit(_rows(batch.column(1))), np.array(batch.column(0).to_pylist(), dtype=object).astype(str)
                for k in np.unique(keys):
                    part = x[keys == k]
                    n, s, g = sums.get(k, (0, 0.0, 0.0))
                    sums[k] = n + len(part), s + part.sum(axis=0), g + part.T @ part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), *(pa.array([v if isinstance(v, int) else v.ravel().tolist() for v in c]) for c in zip(*sums.values(), strict=True))], names=["key", "n", "s", "g"])

    def add(t: pa.Table) -> pa.Table:
        s, g = (np.sum([x.as_py() for x in t[c]], axis=0).tolist() for c in ("s", "g"))
        return pa.table({"key": t["key"].slice(0, 1), "n": pa.array([int(sum(t["n"].to_pylist()))]), "s": pa.array([s]), "g": pa.array([g])})

    schema = "key string, n long, s array<double>, g array<double>"
    name = F.col(key).cast("string") if key else F.lit("all")
    parts = corpus.select(F.coalesce(name, F.lit("")).alias("key"), "embedding").mapInArrow(run, schema)
    # A tree of sums: no task adds more than a few dozen matrices of a key.
    parts = parts.groupBy("key", F.pmod(F.xxhash64("n", "s"), F.lit(32)).alias("k")).applyInArrow(add, schema).groupBy("key").applyInArrow(add, schema)
    out = {r.key: (r.n, np.array(r.s), np.array(r.g).reshape(len(r.s), len(r.s))) for r in parts.collect()}
    if not out:
        raise ValueError("nothing to fit on")
    return out


@dataclass(frozen=True)
class Pca:
    mean: np.ndarray
    axes: np.ndarray  # 3 x d
    values: np.ndarray
    total: float
    volumetric: bool = True

    kind = "pca"

    @classmethod
    def fit(cls, corpus: DataFrame, volumetric: bool = True) -> Pca:
        return cls.of(*grams(corpus)["all"], volumetric)

    @classmethod
    def of(cls, n: int, s: np.ndarray, g: np.ndarray, volumetric: bool = True) -> Pca:
        if n < 3:
            raise ValueError("at least 3 rows are needed")
        mean = s / n
        values, vectors = np.linalg.eigh(g / n - np.outer(mean, mean))
        return cls(mean, _oriented(vectors[:, ::-1][:, :3]).T, np.maximum(values[::-1][:3], 0), float(np.trace(g) / n - mean @ mean), volumetric)

    @property
    def explained(self) -> float:
        return float(self.values.sum() / self.total) if self.total > 2.2e-16 else 1.0

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds ``x, y, z, proj_mag, certainty, intensity``, as Catalyst expressions.

        A zero vector projects from the origin; certainty is the part of the centred
        length that the three axes keep.
        """
        n = V.norm("embedding")
        unit = F.transform("embedding", lambda v: F.when(F.col("_n") > 0, v.cast("double") / F.col("_n")).otherwise(0.0))
        out = rows.withColumn("_n", n).withColumn("_c", F.zip_with(unit, V.constant(self.mean), lambda a, b: a - b))
        out = evaluated(out, {c: V.dot("_c", V.constant(a)) for c, a in zip("xyz", self.axes, strict=True)} | {"_t": V.dot("_c", "_c")})
        kept = F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")
        out = out.withColumns({"proj_mag": F.sqrt(kept), "certainty": F.when(F.col("_t") > 1e-15, F.greatest(F.lit(0.0), F.least(F.lit(1.0), kept / F.col("_t")))).otherwise(1.0), "intensity": F.col("_n")})
        return out.drop("_n", "_c", "_t")


def _training(corpus: DataFrame, cap: int | None) -> np.ndarray:
    """All rows, or ``cap`` of them by the hash of the ordinal where there are more."""
    rows = corpus.select("embedding", F.xxhash64("ordinal").alias("h"), "ordinal")
    some = (rows if cap is None else rows.orderBy("h").limit(cap)).select("embedding", "ordinal").toArrow().sort_by("ordinal")
    if some.num_rows < 3:
        raise ValueError("at least 3 rows are needed")
    if some.num_rows == cap and (n := corpus.count()) > cap:
        warnings.warn(f"fitted on {cap} of {n} rows", stacklevel=3)
    return _unit(_rows(some["embedding"].combine_chunks()))


def _spread(rows: DataFrame, n: int) -> DataFrame:
    """Rows over enough tasks where each is held against ``n`` others."""
    return rows if n <= DENSE else rows.repartition(4 * max(8, rows.sparkSession.sparkContext.defaultParallelism))


def _each(spark, n: int, work, schema: str) -> pa.Table:
    """``work`` on ranges of rows ``[(a, b), ...]``, dealt out to tasks; its tables together."""
    cuts = list(range(0, n, ROWS))
    tasks = min(len(cuts), 4 * max(8, spark.sparkContext.defaultParallelism))

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield from work([(a, min(n, a + ROWS)) for a in cuts[i::tasks]])

    return spark.range(0, tasks, 1, tasks).mapInArrow(run, schema).toArrow()


def _median_distance(spark, shared, n: int) -> float:
    """The upper median of the distances of all pairs, by counts of ever narrower ranges."""
    place, lo, width = n * (n - 1) // 2 // 2, 0.0, 4.5
    for _ in range(3):
        step = width / BINS

        def count(parts, lo=lo, step=step):
            x, total = shared.value, np.zeros(BINS, np.int64)
            for a, b in parts:
                for c in range(a // COLUMNS * COLUMNS, n, COLUMNS):
                    d2 = np.maximum(0, 2 - 2 * x[a:b] @ x[c : c + COLUMNS].T)
                    d2 = d2[np.arange(a, b)[:, None] < np.arange(c, c + d2.shape[1])[None]] if c < b else d2.ravel()
                    k = np.floor((d2 - lo) / step)
                    total += np.bincount(k[(k >= 0) & (k < BINS)].astype(np.int64), minlength=BINS)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

        counts = sum(np.frombuffer(c, np.int64) for c in _each(spark, n, count, "counts binary")["counts"].to_pylist())
        before = np.cumsum(counts)
        k = min(int(np.searchsorted(before, place, side="right")), BINS - 1)
        place, lo, width = max(0, place - int(before[k] - counts[k])), lo + k * step, step
    return float(np.sqrt(lo))


def _leading(apply, start: np.ndarray, count: int, size=np.abs, depth: int = 3, tolerance: float = 1e-10, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, the largest by ``size`` first, and vectors of a symmetric operator, of which ``count`` are exact to ``tolerance``.

    Rayleigh-Ritz over the blocks that repeated application makes of ``start``,
    orthogonal to each other, begun again with the best vectors until they stand.
    """
    block, v = start.shape[1], np.linalg.qr(start)[0]
    for _ in range(rounds):
        basis, images = [v], []
        for at in range(depth):
            images.append(apply(basis[-1]))
            if at + 1 < depth:
                w = images[-1]
                for _ in range(2):
                    for q in basis:
                        w = w - q @ (q.T @ w)
                    w = np.linalg.qr(w)[0]
                basis.append(w)
        h = np.block([[p.T @ q for q in images] for p in basis])
        values, u = np.linalg.eigh((h + h.T) / 2)
        top = np.argsort(-size(values), kind="stable")[:block]
        values, parts = values[top], np.split(u[:, top], depth)
        v = sum(p @ q for p, q in zip(basis, parts, strict=True))
        off = np.linalg.norm(sum(p @ q for p, q in zip(images, parts, strict=True)) - v * values, axis=0)
        if off[:count].max() <= tolerance * np.abs(values).max():
            return values, v
        v = np.linalg.qr(v)[0]
    warnings.warn(f"eigenvectors stand only to {off[:count].max() / np.abs(values).max():.1e}", stacklevel=3)
    return values, v


def _by_arrow(rows: DataFrame, project) -> DataFrame:
    @F.pandas_udf("x double, y double, z double, proj_mag double, certainty double, intensity double")
    def run(e: pd.Series) -> pd.DataFrame:
        x = np.array(e.tolist(), dtype=float).reshape(len(e), -1)
        f, certainty = project(_unit(x))
        return pd.DataFrame({"x": f[:, 0], "y": f[:, 1], "z": f[:, 2], "proj_mag": np.linalg.norm(f, axis=1), "certainty": certainty, "intensity": np.linalg.norm(x, axis=1)})

    return rows.withColumn("_p", run("embedding")).select("*", "_p.*").drop("_p")


@dataclass(frozen=True)
class KernelPca:
    train: np.ndarray
    sigma: float
    alphas: np.ndarray  # n x 3
    values: np.ndarray
    total: float
    row_mean: np.ndarray
    grand: float

    kind = "kernel_pca"

    @classmethod
    def fit(cls, corpus: DataFrame, sigma: float | None = None, cap: int | None = None) -> KernelPca:
        x = _training(corpus, cap)
        if sigma is not None and sigma <= 0:
            raise ValueError("sigma must be positive")
        if len(x) > DENSE:
            return cls._in_blocks(corpus.sparkSession, x, sigma)
        d2 = np.maximum(0, 2 - 2 * x @ x.T)
        if sigma is None:
            d = np.sqrt(d2[np.triu_indices(len(x), 1)])
            sigma = max(float(np.sort(d)[len(d) // 2] / np.sqrt(2)), 1e-8)
        k = np.exp(-d2 * (0.5 / sigma**2))
        row, grand = k.mean(axis=1), k.mean()
        c = k - row[:, None] - row[None] + grand
        values, vectors = np.linalg.eigh(c)
        values = np.maximum(values[::-1][:3], 1e-12)
        return cls(x, sigma, _oriented(vectors[:, ::-1][:, :3]) / np.sqrt(values), values, float(np.trace(c)), row, float(grand))

    @classmethod
    def _in_blocks(cls, spark, x: np.ndarray, sigma: float | None) -> KernelPca:
        """The same for any number of rows: the kernel matrix is made a block at a time, once for each few vectors it is multiplied by."""
        n, shared = len(x), spark.sparkContext.broadcast(x)
        if sigma is None:
            sigma = max(_median_distance(spark, shared, n) / 2**0.5, 1e-8)

        def product(v: np.ndarray) -> np.ndarray:
            vectors = spark.sparkContext.broadcast(v)

            def work(parts):
                x, v = shared.value, vectors.value
                for a, b in parts:
                    out = np.zeros((b - a, v.shape[1]))
                    for c in range(0, n, COLUMNS):
                        out += np.exp(np.minimum(0, 2 * x[a:b] @ x[c : c + COLUMNS].T - 2) * (0.5 / sigma**2)) @ v[c : c + COLUMNS]
                    yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([out.tobytes()], pa.binary())], names=["a", "rows"])

            found, out = _each(spark, n, work, "a long, rows binary"), np.empty_like(v)
            for a, rows in zip(found["a"].to_pylist(), found["rows"].to_pylist(), strict=True):
                part = np.frombuffer(rows).reshape(-1, v.shape[1])
                out[a : a + len(part)] = part
            vectors.destroy()
            return out

        row = product(np.ones((n, 1)))[:, 0] / n
        grand = float(row.mean())

        def centred(v: np.ndarray) -> np.ndarray:
            w = product(v - v.mean(axis=0))
            return w - w.mean(axis=0)

        # The kernel bends the rows' own axes but little, so they are where to begin.
        start = x - x.mean(axis=0)
        start = np.concatenate([start @ np.linalg.eigh(start.T @ start)[1][:, ::-1][:, :16], np.random.default_rng(0).normal(size=(n, 4))], axis=1)
        values, vectors = _leading(centred, start, 3, size=lambda v: v)
        shared.destroy()
        values = np.maximum(values[:3], 1e-12)
        return cls(x, sigma, _oriented(vectors[:, :3]) / np.sqrt(values), values, n - n * grand, row, grand)

    @property
    def explained(self) -> float:
        return float(self.values.sum() / self.total) if self.total > 2.2e-16 else 1.0

    @property
    def num_training_points(self) -> int:
        return len(self.train)

    def transform(self, rows: DataFrame) -> DataFrame:
        m = rows.sparkSession.sparkContext.broadcast(self)

        def project(x):
            s = m.value
            total, f = np.zeros(len(x)), np.zeros((len(x), 3))
            for a in range(0, len(x), ROWS):
                for c in range(0, len(s.train), COLUMNS):
                    k = np.exp(np.minimum(0, 2 * x[a : a + ROWS] @ s.train[c : c + COLUMNS].T - 2) * (0.5 / s.sigma**2))
                    total[a : a + ROWS] += k.sum(axis=1)
                    f[a : a + ROWS] += k @ s.alphas[c : c + COLUMNS]
            mean = total / len(s.train)
            f += (s.grand - mean)[:, None] * s.alphas.sum(axis=0) - s.row_mean @ s.alphas
            potential = 1 - 2 * mean + s.grand
            return f, np.clip(np.divide((f * f).sum(axis=1), potential, out=np.ones(len(f)), where=potential > 1e-12), 0, 1)

        return _by_arrow(_spread(rows, len(self.train)), project)


@dataclass(frozen=True)
class Laplacian:
    active: np.ndarray  # n x d, 0 or 1
    threshold: float
    degree: np.ndarray
    vectors: np.ndarray  # n x 3
    values: np.ndarray

    kind = "laplacian"

    @classmethod
    def fit(cls, corpus: DataFrame, k: int = 15, threshold: float = 0.05, cap: int | None = None) -> Laplacian:
        x = _training(corpus, cap)
        a = (np.abs(x) > threshold).astype(np.float64)
        if len(x) > DENSE:
            return cls._in_parts(corpus.sparkSession, x, a.astype(np.uint8), k, threshold)
        sim = _jaccard(a, a)
        np.fill_diagonal(sim, 0)
        n = len(x)
        w = np.zeros_like(sim)
        order = np.lexsort((-np.arange(n)[None].repeat(n, 0), -sim), axis=1)[:, : min(k, n - 1)]
        rows = np.arange(n)[:, None]
        w[rows, order] = sim[rows, order]
        w = np.maximum(w, w.T)
        degree = np.maximum(w.sum(axis=1), 1e-6)
        s = 1 / np.sqrt(degree)
        values, vectors = np.linalg.eigh(w * s[:, None] * s[None])
        root = np.sqrt(degree) / np.linalg.norm(np.sqrt(degree))
        keep = [i for i in np.argsort(-np.abs(values)) if abs(vectors[:, i] @ root) < 0.99][:3]
        keep.sort(key=lambda i: -values[i])
        return cls(a, threshold, degree, _oriented(vectors[:, keep]), values[keep])

    @classmethod
    def _in_parts(cls, spark, x: np.ndarray, active: np.ndarray, k: int, threshold: float) -> Laplacian:
        """The same for any number of rows: the tasks find each row's neighbours, the driver has those edges."""
        n, shared, step = len(x), spark.sparkContext.broadcast(active), 4096

        def rows(batches):
            for batch in batches:
                for a in batch.column(0).to_pylist():
                    part = shared.value[a : a + step]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(part))), pa.array(part.astype(float).tolist())], names=["ordinal", "embedding"])

        table = spark.range(0, n, step, -(-n // step)).mapInArrow(rows, "ordinal long, embedding array<double>")
        edges = jaccard_edges(table, 0.5, k).toArrow()
        i, j, w = (edges[c].to_numpy() for c in ("i", "j", "similarity"))
        one, at = np.unique(np.append(np.minimum(i, j) * n + np.maximum(i, j), []).astype(np.int64), return_index=True)
        i, j, w = one // n, one % n, w[at]
        i, j, w = np.append(i, j), np.append(j, i), np.append(w, w)
        order = np.argsort(i, kind="stable")
        i, j, w = i[order].astype(np.int32), j[order].astype(np.int32), w[order]
        degree = np.maximum(np.bincount(i, w, minlength=n), 1e-6)
        w = w / np.sqrt(degree[i] * degree[j])
        root = np.sqrt(degree) / np.linalg.norm(np.sqrt(degree))
        apply = lambda v: np.stack([np.bincount(i, w * c[j], minlength=n) for c in v.T], axis=1)
        start = np.concatenate([root[:, None], np.random.default_rng(0).normal(size=(n, 7))], axis=1)
        values, vectors = _leading(apply, start, 5, depth=int(np.clip((1 << 28) // (16 * n * 8), 4, 12)))
        shared.destroy()
        keep = [c for c in range(len(values)) if abs(vectors[:, c] @ root) < 0.99][:3]
        keep.sort(key=lambda c: -values[c])
        return cls(active, threshold, degree, _oriented(vectors[:, keep]), values[keep])

    @property
    def explained(self) -> float:
        """The connectivity ratio: the mean size of the eigenvalues kept."""
        return float(np.abs(self.values).mean())

    def transform(self, rows: DataFrame) -> DataFrame:
        m = rows.sparkSession.sparkContext.broadcast(self)

        def project(x):
            s = m.value
            mine, weights = (np.abs(x) > s.threshold).astype(np.float64), s.vectors / np.sqrt(s.degree)[:, None]
            d, f = np.zeros(len(x)), np.zeros((len(x), s.vectors.shape[1]))
            for a in range(0, len(x), ROWS):
                for c in range(0, len(s.active), COLUMNS):
                    sim = _jaccard(mine[a : a + ROWS], s.active[c : c + COLUMNS].astype(np.float64))
                    d[a : a + ROWS] += sim.sum(axis=1)
                    f[a : a + ROWS] += sim @ weights[c : c + COLUMNS]
            f /= np.sqrt(np.maximum(d, 1e-6))[:, None]
            f = np.where(np.abs(s.values) < 1e-10, 0.0, f / np.where(np.abs(s.values) < 1e-10, 1.0, s.values))
            return f, np.tanh(np.linalg.norm(f, axis=1))

        return _by_arrow(_spread(rows, len(self.active)), project)


def _jaccard(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = a @ b.T
    union = a.sum(axis=1)[:, None] + b.sum(axis=1)[None] - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


@dataclass(frozen=True)
class Random:
    """A fixed random projection: nothing is fitted, and nothing is known of what it keeps."""

    axes: np.ndarray  # 3 x d

    kind = "random"
    explained = 1.0

    @classmethod
    def fit(cls, corpus: DataFrame, seed: int = 42) -> Random:
        dim = corpus.select(F.size("embedding")).first()[0]
        return cls(matrix(dim, seed))

    def transform(self, rows: DataFrame) -> DataFrame:
        out = rows.withColumn("_u", V.normalized("embedding"))
        out = evaluated(out, {c: V.dot("_u", V.constant(a)) for c, a in zip("xyz", self.axes, strict=True)}).drop("_u")
        return out.withColumns({"proj_mag": F.lit(1.0), "certainty": F.lit(1.0), "intensity": V.norm("embedding")})


def fit(corpus: DataFrame, kind: str = "pca", **how):
    """A fitted projection by its name; all have ``kind``, ``explained`` and ``transform``."""
    kinds = {"pca": Pca, "kernel_pca": KernelPca, "laplacian": Laplacian, "random": Random}
    if kind not in kinds:
        raise ValueError(f"no projection {kind!r}")
    return kinds[kind].fit(corpus, **how)


@dataclass(frozen=True)
class Inner:
    """A projection of one category's rows that keeps more of them than the outer one."""

    category: str
    members: int
    model: object
    inner_explained: float
    outer_explained: float

    @property
    def improvement(self) -> float:
        return self.inner_explained - self.outer_explained


def inner_models(corpus: DataFrame, certainty: DataFrame, min_rows: int = 20, min_gain: float = 0.10, kernel_rows: int = 80, kernel_gain: float = 0.05) -> dict[str, Inner]:
    """The categories with at least ``min_rows`` whose own PCA explains ``min_gain`` more than the outer projection.

    ``certainty`` has ``category, certainty`` of the outer one, whose mean it is held
    against.  From ``kernel_rows`` on, a kernel PCA takes its place where it explains
    ``kernel_gain`` more than that.  The Gram matrices of all categories come from one pass.
    """
    outer = {r.category: r.c for r in certainty.groupBy("category").agg(F.avg("certainty").alias("c")).collect()}
    out = {}
    for name, (n, s, g) in sorted(grams(corpus, "category").items()):
        if n < max(min_rows, 3):
            continue
        model = Pca.of(n, s, g, volumetric=False)
        explained = model.explained
        if explained - outer.get(name, 0.0) < min_gain:
            continue
        if n >= kernel_rows:
            kernel = KernelPca.fit(corpus.filter(F.col("category") == name))
            if kernel.explained > explained + kernel_gain:
                model, explained = kernel, kernel.explained
        out[name] = Inner(name, n, model, explained, outer.get(name, 0.0))
    return out


def inner_stats(corpus: DataFrame, inner: dict[str, Inner]) -> DataFrame:
    rows = [(m.category, m.members, m.model.kind, m.inner_explained, m.outer_explained, m.improvement) for m in inner.values()]
    return corpus.sparkSession.createDataFrame(rows, "category string, members long, projection string, inner_explained double, outer_explained double, improvement double")


def inner_points(corpus: DataFrame, inner: Inner) -> DataFrame:
    """The rows of the category at unit distance in the directions of its own projection."""
    return from_cartesian(inner.model.transform(corpus.filter(F.col("category") == inner.category)), "1.0D")
