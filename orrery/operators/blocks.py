"""Exact neighbours on the sphere without all pairs: an octree of bounded blocks.

Directions are points of the unit sphere in space, where the straight distance is
monotone in the angle, so a cube of an octree that a ball does not meet holds no
neighbour.  The leaves of the tree are the largest cubes with at most ``TARGET``
points (or the smallest cubes there are).  Each point is compared with its own leaf,
which bounds the distance of its ``k``-th neighbour, and then with the other leaves
that the ball of that radius meets.  Every task holds one leaf and its visitors.

The table of leaves has at most about 10 x 4^``DEPTH`` rows (those cubes that the
sphere meets) whatever the number of points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.sources.tables import once

DEPTH, TARGET = 8, 1024
_XYZ = ("ux", "uy", "uz")
_SLACK = 1e-12


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of ``x`` three apart."""
    x = x.astype(np.int64)
    for shift, mask in ((16, 0x30000FF), (8, 0x300F00F), (4, 0x30C30C3), (2, 0x9249249)):
        x = (x | (x << shift)) & mask
    return x


def _gathered(x: np.ndarray) -> np.ndarray:
    x = x & 0x9249249
    for shift, mask in ((2, 0x30C30C3), (4, 0x300F00F), (8, 0x30000FF), (16, 0x3FF)):
        x = (x | (x >> shift)) & mask
    return x


def codes(x: np.ndarray) -> np.ndarray:
    """Cubes of the finest level, numbered along the tree."""
    i = np.clip(np.floor((x + 1) / 2 * (1 << DEPTH)), 0, (1 << DEPTH) - 1).astype(np.int64)
    return _spread(i[:, 0]) | _spread(i[:, 1]) << 1 | _spread(i[:, 2]) << 2


class Tree:
    """The leaves: ``start``, their first cube of the finest level, and ``level``."""

    def __init__(self, code: np.ndarray, count: np.ndarray) -> None:
        order = np.argsort(code)
        code, count = code[order], count[order]
        level = np.full(len(code), DEPTH)
        for at in range(DEPTH - 1, -1, -1):
            first = np.flatnonzero(np.concatenate([code[:1] >= 0, (code[1:] ^ code[:-1]) >> 3 * (DEPTH - at) != 0]))
            total = np.add.reduceat(count, first) if len(first) else first
            level[np.repeat(total <= TARGET, np.diff(np.append(first, len(code))))] = at
        start = code >> 3 * (DEPTH - level) << 3 * (DEPTH - level)
        self.start, at = np.unique(start, return_index=True)
        self.level = level[at]
        self.size = 2.0 / (1 << self.level)
        self.low = np.stack([_gathered(self.start >> k) for k in range(3)], axis=1) * (2.0 / (1 << DEPTH)) - 1

    def leaf(self, code: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, code, side="right") - 1

    def reach(self, leaf: np.ndarray) -> np.ndarray:
        """No point of a leaf is farther than this from ``TARGET`` others: its parent holds more."""
        return np.where(self.level[leaf] > 0, 2 * self.size[leaf] * 3**0.5, 2.0)

    def met(self, x: np.ndarray, radius: float, own: int) -> np.ndarray:
        """Leaves other than ``own`` that the ball meets."""
        level = int(self.level[own])
        edge = 2.0 / (1 << level)
        lo = np.maximum(np.floor((x - radius + 1) / edge).astype(np.int64), 0)
        hi = np.minimum(np.floor((x + radius + 1) / edge).astype(np.int64), (1 << level) - 1)
        i, j, k = (g.ravel() for g in np.meshgrid(*(np.arange(a, b + 1) for a, b in zip(lo, hi, strict=True)), indexing="ij"))
        cube = (_spread(i) | _spread(j) << 1 | _spread(k) << 2) << 3 * (DEPTH - level)
        a = np.searchsorted(self.start, cube, side="right") - 1
        b = np.searchsorted(self.start, cube + (1 << 3 * (DEPTH - level)))
        a = np.maximum(a, 0)
        n = b - a
        found = np.unique(np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n))
        gap = np.maximum(self.low[found] - x, 0) + np.maximum(x - self.low[found] - self.size[found, None], 0)
        return found[((gap * gap).sum(axis=1) <= radius * radius + _SLACK) & (found != own)]


def _coded(points: DataFrame) -> tuple[DataFrame, Tree]:
    @F.pandas_udf("long")
    def code(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series(codes(np.stack([x, y, z], axis=1)))

    rows = once(points.select("ordinal", *_XYZ).withColumn("code", code(*_XYZ)), "coded")
    counts = rows.groupBy("code").count().toPandas()
    tree = Tree(counts["code"].to_numpy(np.int64), counts["count"].to_numpy(np.int64))
    shared = points.sparkSession.sparkContext.broadcast(tree)

    @F.pandas_udf("int")
    def leaf(c: pd.Series) -> pd.Series:
        return pd.Series(shared.value.leaf(c.to_numpy()).astype(np.int32))

    return rows.select("ordinal", *_XYZ, leaf("code").alias("leaf")), tree


def _arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return t["ordinal"].to_numpy(), np.stack([t[c].to_numpy() for c in _XYZ], axis=1)


def _nearest(x: np.ndarray, own: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Slices ``row, id, proxy`` of the ``k`` nearest of ``y`` to each of ``x``, ties to the lower id, never the same id."""
    order = np.argsort(ids, kind="stable")
    y, ids = y[order], ids[order]
    step = max(1, (1 << 22) // max(1, len(y)))
    for a in range(0, len(x), step):
        proxy = 1 - np.clip(x[a : a + step] @ y.T, -1, 1)
        proxy[own[a : a + step, None] == ids[None]] = np.inf
        if k < len(y):
            bar = np.partition(proxy, k - 1, axis=1)[:, k - 1]
            row, at = np.nonzero(proxy <= bar[:, None])
        else:
            row, at = np.nonzero(np.ones_like(proxy, dtype=bool))
        value = proxy[row, at]
        sort = np.lexsort((at, value, row))
        row, at, value = row[sort], at[sort], value[sort]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        take = (place < k) & np.isfinite(value)
        yield a + row[take], ids[at[take]], value[take]


def _visits(rows: DataFrame, tree: Tree, radius: str) -> DataFrame:
    """``leaf, ordinal, ux, uy, uz, visitor``: every point in its leaf and, as a visitor, in those its ball meets."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    @F.pandas_udf("array<int>")
    def met(x: pd.Series, y: pd.Series, z: pd.Series, leaf: pd.Series, r: pd.Series) -> pd.Series:
        t = shared.value
        return pd.Series([t.met(np.array(p), q, own).astype(np.int32) for *p, own, q in zip(x, y, z, leaf, r, strict=True)])

    visitors = rows.select(F.explode(met(*_XYZ, "leaf", radius)).alias("leaf"), "ordinal", *_XYZ, F.lit(True).alias("visitor"))
    return visitors.union(rows.select("leaf", "ordinal", *_XYZ, F.lit(False)))


def neighbours(points: DataFrame, k: int) -> DataFrame:
    """``i, j, proxy, rank``: the ``k`` nearest other points of each, by the cosine proxy and then the ordinal."""
    rows, tree = _coded(points)
    shared = points.sparkSession.sparkContext.broadcast(tree)

    def inside(t: pa.Table) -> pa.Table:
        ids, x = _arrays(t)
        leaf = t["leaf"].to_numpy()
        radius = shared.value.reach(leaf)
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        for row, j, proxy in _nearest(x, ids, x, ids, k):
            for column, value in zip(found, (row, j, proxy), strict=True):
                column.append(value)
            last = np.flatnonzero(np.bincount(row, minlength=len(x)) == k)
            at = np.searchsorted(row, last, side="right") - 1
            radius[last] = np.minimum(radius[last], np.sqrt(2 * np.maximum(proxy[at], 0)) + _SLACK)
        row, j, proxy = (np.concatenate(c) for c in found)
        first = np.arange(len(row)) == np.searchsorted(row, row)
        # One row a neighbour; the first of a point, or a row without one, has its ball.
        alone = np.setdiff1d(np.arange(len(x)), row)
        at = np.concatenate([row, alone])
        none = np.zeros(len(alone), dtype=bool)
        ball = np.concatenate([first, ~none])
        return pa.table(
            {"i": ids[at], "j": pa.array(np.append(j, ids[alone]), mask=np.append(np.zeros(len(row), bool), ~none)), "proxy": np.append(proxy, np.zeros(len(alone))), "leaf": pa.array(leaf[at], pa.int32())}
            | {c: x[at, n] for n, c in enumerate(_XYZ)}
            | {"radius": pa.array(radius[at], mask=~ball)}
        )

    local = once(rows.groupBy("leaf").applyInArrow(inside, "i long, j long, proxy double, leaf int, ux double, uy double, uz double, radius double"), "local")
    near = local.filter("j is not null").select("i", "j", "proxy")
    if len(tree.start) > 1:
        balls = local.filter("radius is not null").select("leaf", F.col("i").alias("ordinal"), *_XYZ, "radius")

        def visited(t: pa.Table) -> pa.Table:
            guest = t["visitor"].to_numpy(zero_copy_only=False)
            ids, x = _arrays(t)
            out = [(ids[guest][row], j, proxy) for row, j, proxy in _nearest(x[guest], ids[guest], x[~guest], ids[~guest], k)]
            i, j, proxy = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            return pa.table({"i": i, "j": j, "proxy": proxy})

        near = near.union(_visits(balls, tree, "radius").groupBy("leaf").applyInArrow(visited, "i long, j long, proxy double"))
    rank = F.row_number().over(W.partitionBy("i").orderBy("proxy", "j"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)


def close_pairs(points: DataFrame, angle: float) -> DataFrame:
    """One row ``close_pairs``: how many pairs of points are less than ``angle`` apart."""
    rows, tree = _coded(points)
    radius = 2 * np.sin(min(max(angle, 0.0), np.pi) / 2) + _SLACK

    def count(t: pa.Table) -> pa.Table:
        guest = t["visitor"].to_numpy(zero_copy_only=False)
        ids, x = _arrays(t)
        host, hosts = x[~guest], ids[~guest]
        n, step = 0, max(1, (1 << 21) // max(1, len(host)))
        for a in range(0, len(x), step):
            p, i = x[a : a + step], ids[a : a + step]
            d = np.arctan2(np.sqrt(sum(np.square(np.outer(p[:, u], host[:, v]) - np.outer(p[:, v], host[:, u])) for u, v in ((1, 2), (2, 0), (0, 1)))), p @ host.T)
            n += int(((d < angle) & (i[:, None] < hosts[None])).sum())
        return pa.table({"n": [n]})

    visits = _visits(rows.withColumn("radius", F.lit(float(radius))), tree, "radius")
    return visits.groupBy("leaf").applyInArrow(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("close_pairs"))
