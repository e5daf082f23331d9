"""Sums over all points of a function of the distance, without all pairs.

Directions are cut into the leaves of six quadtrees, one on each face of a cube, of at
most ``TARGET`` points.  For a leaf, what is near is summed point by point.  A cell
that lies apart stands for its points by ``NODES`` squared Chebyshev nodes: every
point's charge is spread over them by interpolation, so no point is left out.  A cell
counts as apart where that changes a sum by some 1e-9 of it at most; for the angle,
which also bends at the antipode, the antipodal cell must lie apart too.

The directions (three doubles a point) and their charges go to the driver and to each
task; the work of a point grows with the logarithm of the number of points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEPTH, TARGET, NODES, APART = 14, 512, 10, 2.0
#: Pairs that are taken at once.
STEP = 1 << 16
#: Charges that are summed in one pass.
WIDTH = 64


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The angle of each of ``x`` to each of ``y``, from the chord: 0 for equal ones, and as good for small ones."""
    d = np.subtract.outer(x[:, 0], y[:, 0])
    d *= d
    for c in (1, 2):
        e = np.subtract.outer(x[:, c], y[:, c])
        e *= e
        d += e
    np.sqrt(d, out=d)
    d *= 0.5
    np.minimum(d, 1.0, out=d)
    np.arcsin(d, out=d)
    d *= 2
    return d


def pushes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``1 / (|x - y|^2 + 1e-6)`` of unit vectors."""
    d = x @ y.T
    d *= -2
    d += 2.0
    np.maximum(d, 0.0, out=d)
    d += 1e-6
    return np.reciprocal(d, out=d)


def _nodes(m: int) -> np.ndarray:
    return np.cos((np.arange(m) + 0.5) * np.pi / m)


def _basis(s: np.ndarray, m: int) -> np.ndarray:
    """The Lagrange polynomials of the Chebyshev nodes at ``s`` in [-1, 1], a row for each."""
    k = np.arange(m)
    t = np.cos(k[:, None] * np.arccos(np.clip(s, -1, 1)))
    c = np.cos(k[:, None] * ((k + 0.5) * np.pi / m)) * (2.0 / m)
    c[0] /= 2
    return t.T @ c


def _face(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The face of each direction and its place there, as angles scaled to [-1, 1]."""
    axis = np.abs(x).argmax(axis=1)
    rows = np.arange(len(x))
    main = x[rows, axis]
    face = 2 * axis + (main < 0)
    place = [np.clip(np.arctan2(x[rows, (axis + k) % 3], np.abs(main)) * (4 / np.pi), -1, 1) for k in (1, 2)]
    return face, place[0], place[1]


def _direction(face: int, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    axis = face // 2
    x = np.empty((len(s), 3))
    x[:, axis] = -1.0 if face % 2 else 1.0
    x[:, (axis + 1) % 3], x[:, (axis + 2) % 3] = np.tan(s * np.pi / 4), np.tan(t * np.pi / 4)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _interleaved(i: np.ndarray) -> np.ndarray:
    i = i.astype(np.int64)
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        i = (i | (i << shift)) & mask
    return i


def _apart(i: int) -> int:
    return int("".join(reversed(bin(i)[:1:-1][::2])) or "0", 2)


class Cells:
    """The points in the order of their cells, ``order``, and the tree of cells above them."""

    def __init__(self, x: np.ndarray, charges: np.ndarray | None = None, labels: list[tuple[np.ndarray, int]] = (), target: int | None = None) -> None:
        """``charges``: a row for each point; or ``labels``, codes from 0 (below: none) with how many there are, as charges of 1."""
        target = target or TARGET
        face, s, t = _face(x)
        side = 1 << DEPTH
        grid = [np.minimum(((v + 1) / 2 * side).astype(np.int64), side - 1) for v in (s, t)]
        code = (face.astype(np.int64) << 2 * DEPTH) | _interleaved(grid[0]) | _interleaved(grid[1]) << 1
        self.order = np.argsort(code, kind="stable")
        code, self.x = code[self.order], np.ascontiguousarray(x[self.order])
        s, t = s[self.order], t[self.order]
        self.labels = [(codes[self.order], n) for codes, n in labels]
        self.charges = None if charges is None else np.ascontiguousarray(charges[self.order])
        self.width = sum(n for _, n in labels) if charges is None else charges.shape[1]
        low, high, level, face_of, first, leaf = [], [], [], [], [], []
        self.children: list[list[int]] = []

        def add(a: int, b: int, depth: int, start: int) -> int:
            at = len(low)
            for column, v in zip((low, high, level, face_of, first), (a, b, depth, start >> 2 * DEPTH, start), strict=True):
                column.append(v)
            leaf.append(b - a <= target or depth == DEPTH)
            self.children.append([])
            if not leaf[at]:
                step = 1 << 2 * (DEPTH - depth - 1)
                cuts = a + np.searchsorted(code[a:b], start + step * np.arange(1, 4))
                for k, (p, q) in enumerate(zip([a, *cuts], [*cuts, b], strict=True)):
                    if q > p:
                        self.children[at].append(add(int(p), int(q), depth + 1, start + k * step))
            return at

        cuts = np.searchsorted(code, np.arange(7) << 2 * DEPTH)
        self.roots = [add(int(cuts[f]), int(cuts[f + 1]), 0, f << 2 * DEPTH) for f in range(6) if cuts[f + 1] > cuts[f]]
        self.low, self.high, self.leaf = np.array(low, int), np.array(high, int), np.array(leaf, bool)
        half = 1.0 / (1 << np.array(level, int))
        corner = np.array([[_apart((c & ((1 << 2 * DEPTH) - 1)) >> k) for k in (0, 1)] for c in first]).reshape(-1, 2) / side * 2 - 1
        self.middle = corner + half[:, None]
        self.half, self.face = half, np.array(face_of, int)
        self.edge = half * np.pi / 4
        self.centre = np.stack([_direction(f, m[:1], m[1:])[0] for f, m in zip(self.face, self.middle, strict=True)]) if low else np.zeros((0, 3))
        self.radius = np.array([np.arccos(np.clip(_direction(f, m[0] + h * np.array([-1, -1, 1, 1]), m[1] + h * np.array([-1, 1, -1, 1])) @ c, -1, 1)).max() for f, m, h, c in zip(self.face, self.middle, half, self.centre, strict=True)])
        self.nodes = np.stack([self._nodes(c) for c in range(len(low))]) if low else np.zeros((0, NODES * NODES, 3))
        self._spread(s, t)

    def charge(self, a: int, b: int) -> np.ndarray:
        if self.charges is not None:
            return self.charges[a:b]
        return np.concatenate([np.equal.outer(codes[a:b], np.arange(n)).astype(float) for codes, n in self.labels], axis=1)

    def _nodes(self, cell: int) -> np.ndarray:
        u = _nodes(NODES) * self.half[cell]
        s, t = (g.ravel() for g in np.meshgrid(self.middle[cell, 0] + u, self.middle[cell, 1] + u, indexing="ij"))
        return _direction(self.face[cell], s, t)

    def _inside(self, cell: int, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        """What each node of the cell stands for at places in it."""
        a, b = (_basis((v - m) / self.half[cell], NODES) for v, m in zip((s, t), self.middle[cell], strict=True))
        return (a[:, :, None] * b[:, None, :]).reshape(len(s), -1)

    def _spread(self, s: np.ndarray, t: np.ndarray) -> None:
        m = NODES * NODES
        self.proxies = np.zeros((len(self.low), m, self.width))
        down = [_basis((_nodes(NODES) + k) / 2, NODES) for k in (-1, 1)]
        self.places = (s, t)
        for at in range(len(self.low) - 1, -1, -1):  # children come after their parents
            if self.leaf[at]:
                a, b = self.low[at], self.high[at]
                for p in range(a, b, 4096):
                    q = min(b, p + 4096)
                    self.proxies[at] += self._inside(at, s[p:q], t[p:q]).T @ self.charge(p, q)
            for child in self.children[at]:
                k = (self.middle[child] > self.middle[at]).astype(int)
                w = self.proxies[child].reshape(NODES, NODES, self.width)
                self.proxies[at] += np.einsum("ij,kl,ikc->jlc", down[k[0]], down[k[1]], w, optimize=True).reshape(m, self.width)

    def near_and_far(self, leaf: int, both: bool) -> tuple[list[int], list[int]]:
        """The leaves that are near a leaf, and the largest cells that are apart from it and hold the rest."""
        near, far, todo = [], [], np.array(self.roots, int)
        while len(todo):
            d = np.arccos(np.clip(self.centre[todo] @ self.centre[leaf], -1, 1))
            if both:
                d = np.minimum(d, np.pi - d)
            away = d - self.radius[todo] - self.radius[leaf] >= APART * np.maximum(self.edge[todo], self.edge[leaf])
            small = self.high[todo] - self.low[todo] <= NODES * NODES
            away &= ~(self.leaf[todo] & small)
            far += todo[away].tolist()
            rest = todo[~away]
            near += rest[self.leaf[rest]].tolist()
            todo = np.array([c for r in rest[~self.leaf[rest]] for c in self.children[r]], int)
        return near, far

    def sums(self, leaf: int, kernel) -> np.ndarray:
        """The sums of a leaf's points over all points, a column for each charge."""
        near, far = self.near_and_far(leaf, kernel is angles)
        a, b = self.low[leaf], self.high[leaf]
        x = self.x[a:b]
        out = np.zeros((b - a, self.width))
        if far:
            some = b - a > NODES * NODES  # then the sums are smooth enough to be taken at the leaf's own nodes
            at = self.nodes[leaf] if some else x
            total = np.zeros((len(at), self.width))
            step = max(1, STEP // (len(at) * NODES * NODES))
            for k in range(0, len(far), step):
                part = far[k : k + step]
                total += kernel(at, self.nodes[part].reshape(-1, 3)) @ self.proxies[part].reshape(-1, self.width)
            s, t = self.places
            if some:
                for p in range(a, b, 4096):
                    q = min(b, p + 4096)
                    out[p - a : q - a] = self._inside(leaf, s[p:q], t[p:q]) @ total
            else:
                out = total
        for lo, hi in _runs(self.low, self.high, sorted(near)):
            for p in range(lo, hi, 2048):
                y, c = self.x[p : min(hi, p + 2048)], self.charge(p, min(hi, p + 2048))
                step = max(1, STEP // len(y))
                for i in range(0, b - a, step):
                    out[i : i + step] += kernel(x[i : i + step], y) @ c
        return out

    def shares(self, tasks: int) -> list[list[int]]:
        """The leaves in ``tasks`` lists of about as many points."""
        leaves = np.flatnonzero(self.leaf)
        if not len(leaves):
            return []
        return [p.tolist() for p in np.split(leaves, np.searchsorted(self.low[leaves], np.arange(1, tasks) * len(self.x) // tasks)) if len(p)]


def _runs(low: np.ndarray, high: np.ndarray, cells: list[int]) -> Iterator[tuple[int, int]]:
    """The ranges of points of cells, those that touch as one."""
    last = None
    for c in cells:
        if last is not None and last[1] == low[c]:
            last = (last[0], high[c])
            continue
        if last is not None:
            yield last
        last = (low[c], high[c])
    if last is not None:
        yield last


def directions(points: DataFrame, *columns) -> tuple[pa.Table, np.ndarray]:
    """The rows in the order of their ordinals, and their directions."""
    t = points.select("ordinal", "ux", "uy", "uz", *columns).toArrow().sort_by("ordinal")
    return t, np.stack([t[c].to_numpy() for c in ("ux", "uy", "uz")], axis=1)


def by_leaf(spark: SparkSession, cells: Cells, work: Callable[[Cells, int], pa.RecordBatch], schema: str) -> tuple[DataFrame, object]:
    """``work`` on each leaf, spread over tasks of about as many points; and the broadcast that they read."""
    shares = cells.shares(4 * max(8, spark.sparkContext.defaultParallelism))
    shared = spark.sparkContext.broadcast(cells)

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                for leaf in shares[i]:
                    yield work(shared.value, leaf)

    return spark.range(0, len(shares), 1, max(1, len(shares))).mapInArrow(run, schema), shared


def own_and_next(points: DataFrame, *labels: str) -> DataFrame:
    """``label, ordinal, a, b``: each point's mean angle to the others of its own value of a label, and to those of the nearest other value.

    ``label`` counts the columns ``labels`` from 0.  ``a`` is null for the only point of
    a value, ``b`` where there is one value.
    """
    spark = points.sparkSession
    t, x = directions(points, *(F.col(c).cast("string").alias(f"l{i}") for i, c in enumerate(labels)))
    ordinal, groups = t["ordinal"].to_numpy(), [[]]
    for i in range(len(labels)):
        coded = t[f"l{i}"].combine_chunks().dictionary_encode()
        codes = np.asarray(coded.indices.fill_null(-1).to_numpy(zero_copy_only=False), dtype=np.int32)
        names = len(coded.dictionary)
        size = np.bincount(codes[codes >= 0], minlength=names)
        for lo in range(0, names, WIDTH):
            hi = min(names, lo + WIDTH)
            if sum(len(n) for *_, n in groups[-1]) + hi - lo > WIDTH:
                groups.append([])
            groups[-1].append((i, names, np.where((codes >= lo) & (codes < hi), codes - lo, -1).astype(np.int32), size[lo:hi]))
    out, schema = None, "label int, ordinal long, a double, b double"
    for group in filter(None, groups):
        heads = [(i, names, size) for i, names, _, size in group]
        cells = Cells(x, labels=[(codes, len(size)) for *_, codes, size in group])
        cells.ids = ordinal[cells.order]

        def means(cells: Cells, leaf: int, heads=heads) -> pa.RecordBatch:
            sums, at, low, high = cells.sums(leaf, angles), 0, cells.low[leaf], cells.high[leaf]
            columns = [[], [], [], []]
            for (i, names, size), (codes, _) in zip(heads, cells.labels, strict=True):
                mean, own = sums[:, at : at + len(size)] / size, codes[low:high]
                at, rows, mine = at + len(size), np.arange(high - low), np.maximum(own, 0)
                lone = (own < 0) | (size[mine] < 2)
                a = mean[rows, mine] * size[mine] / np.maximum(size[mine] - 1, 1)
                mean[rows[own >= 0], own[own >= 0]] = np.inf
                b = mean.min(axis=1)
                for column, v in zip(columns, (np.full(len(rows), i, np.int32), cells.ids[low:high], pa.array(a, mask=lone), pa.array(b, mask=~np.isfinite(b) | (names < 2))), strict=True):
                    column.append(pa.array(v))
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=["label", "ordinal", "a", "b"])

        found, _ = by_leaf(spark, cells, means, schema)
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], schema)
    return out if len(groups) == 1 else out.groupBy("label", "ordinal").agg(F.max("a").alias("a"), F.min("b").alias("b"))
