"""N-gram Jaccard self-join by rare-first prefix filtering.

A document is the set of its word n-grams.  All pairs with a Jaccard similarity
of at least ``threshold`` are found exactly:

1. one pass writes a signature of each document's set and counts all grams into a
   table of fixed size, which gives the rare-first order (any total order is right,
   a good one only makes fewer candidates);
2. one pass gives the *prefix* of each set in that order, long enough that two
   similar sets must share ``SHARED`` grams of their prefixes; a task sends the
   prefix of a set once, however many copies of it it reads;
3. the prefixes are joined on the gram, in two steps: the sets of a gram's run are
   sent on to the block of the lowest among them, where the grams that a group of
   copies shares meet again, so that a pair becomes one row there and not one for
   each gram; a run of more than ``TILE`` sets is cut into tiles, and each two tiles
   are a block; the length filter ends a run, and the number of grams shared so far
   with those that can still follow (the positional filter) drops most pairs;
4. each remaining pair is verified once: the suffix filter bounds the overlap from
   counts in fixed ranges of gram hashes, and the sorted sets decide.

The result has one row a document: its class, which is the connected group of
similar documents, named by the lowest id in it, and its number of links, the other
documents similar to it.  Documents with the same grams, equally often, are one
entity on the way and no pairs are made of them; they count as links of one another
and each of them as a link of every document similar to them.  Blocks hand on one
row a member, with its links there and the lowest id that it hangs together with,
and not their pairs.

Nulls, empties and ties: a null text, an empty one and one without words have no
grams; such a document is a class of its own without links.  A row without
``doc_id`` cannot be named and is left out.  Rows that repeat id and text count as
one; with other texts, they are one document, in one class, whose links are the sum
of those of its texts.  A text with fewer than ``n`` words is one gram of all of
them.  Ids are of any type with an order.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import textops
from orrery.llm.common import cut, id_bit, ids_bitmap, kind_of, sized, small_batches, tidy, without

N, THRESHOLD = 3, 0.6
#: Shared grams that two prefixes must have, unless the sets themselves are smaller.
SHARED = 3
#: Counters of the frequency table, a byte each, whatever the size of the corpus.
BUCKETS = 1 << 24
_CHUNK = 1 << 14
#: Sets of a gram's run that are compared in one block; longer runs are cut into tiles.
TILE = 1024
#: Members, and grams of their sets, beyond which the pairs of a leader are verified in several blocks.
BLOCK, BLOCK_GRAMS = 2048, 1 << 20
#: Copies of a set beyond which its rows are joined by broadcast, as one task should not have them all.
HOT = 50_000
#: Signatures that a task remembers, so as to send the prefix of a set once.
_SEEN = 1 << 17
#: Grams of other sets that one is compared with at a time.
_COMPARED = 1 << 18
_EPS = 1e-9


def _bucket(g: np.ndarray) -> np.ndarray:
    return (g >> np.uint64(40)).astype(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of the rows with an id, nulls as empty texts."""
    small_batches(docs.sparkSession)
    return docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))


def _once(g: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = np.ones(len(g), dtype=bool)
    keep[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    return g[keep], d[keep]


def _signature(g: np.ndarray, d: np.ndarray, rows: int) -> np.ndarray:
    total = np.zeros(len(g) + 1, dtype=np.uint64)
    np.cumsum(textops.mix(g ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    at = np.searchsorted(d, np.arange(rows + 1))
    return (total[at[1:]] - total[at[:-1]]).view(np.int64)


def _steps(total: np.ndarray) -> np.ndarray:
    """Counts in one byte: exact up to 128, then in eighths of doublings."""
    high = 128 + 8 * np.log2(np.maximum(total, 128) / 128)
    return np.where(total < 128, total, np.minimum(high, 255)).astype(np.uint8)


def survey(docs: DataFrame, n: int = N) -> DataFrame:
    """One pass over all texts for two kinds of rows.

    ``doc_id, sig`` of each document, ``sig`` null without words, and ``k, counts``,
    a part of a task's table of gram frequencies.
    """
    rows = _texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    arrow = kind_of(rows, "doc_id")

    def run(batches):
        names = ["doc_id", "sig", "k", "counts"]
        total = np.zeros(BUCKETS, dtype=np.uint32)
        for batch in batches:
            ids = batch.column(0)
            for i, j, first, h, _, _ in textops.words(batch.column(1)):
                g, d = textops.grams(h, first, n)
                np.add.at(total, _bucket(g), 1)
                none = pa.nulls(j - i)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(_signature(g, d, j - i), mask=np.diff(first) == 0), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        parts = [(k, squeeze(total[k * _CHUNK : (k + 1) * _CHUNK].tobytes())) for k in range(BUCKETS // _CHUNK) if total[k * _CHUNK : (k + 1) * _CHUNK].any()]
        none = pa.nulls(len(parts))
        yield pa.RecordBatch.from_arrays([none.cast(arrow), none.cast(pa.int64()), pa.array([k for k, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=names)
        del total, parts
        tidy()

    return rows.mapInArrow(run, f"doc_id {kind}, sig long, k int, counts binary")


def frequencies(surveyed: DataFrame) -> np.ndarray:
    """How often each bucket's grams occur, in the steps of ``_steps``."""

    def merge(pieces: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor().decompress
        total = np.zeros(_CHUNK, dtype=np.int64)
        for x in pieces["counts"]:
            total += np.frombuffer(expand(x.as_py()), dtype=np.uint32)
        return pa.table({"k": pieces["k"].slice(0, 1), "counts": pa.array([_steps(total).tobytes()])})

    out = np.zeros(BUCKETS, dtype=np.uint8)
    for k, counts in surveyed.filter("k is not null").select("k", "counts").groupBy("k").applyInArrow(merge, "k int, counts binary").collect():
        out[k * _CHUNK : (k + 1) * _CHUNK] = np.frombuffer(counts, dtype=np.uint8)
    return out


def prefixes(docs: DataFrame, counts: np.ndarray, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``gram, sig, size, rest``: the prefix of each document's set, rarest first.

    ``rest`` counts the grams after this one.  Prefixes are ``SHARED - 1`` longer
    than one shared gram needs, so similar sets share ``SHARED`` of them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        freq, seen = shared.value, set()
        for batch in batches:
            for i, j, first, h, _, _ in textops.words(batch.column(0)):
                g, d = textops.grams(h, first, n)
                sig = _signature(g, d, j - i)
                if len(seen) > _SEEN:
                    seen.clear()
                fresh = np.ones(j - i, dtype=bool)
                for r, x in enumerate(sig.tolist()):
                    fresh[r] = x not in seen
                    seen.add(x)
                g, d = g[fresh[d]], d[fresh[d]]
                order = np.lexsort((g, d * 256 + freq[_bucket(g)]))
                g, d = _once(g[order], d[order])
                size = np.bincount(d, minlength=j - i)
                at = np.concatenate([[0], np.cumsum(size)])
                length = size - np.ceil(threshold * size - _EPS).astype(np.int64) + SHARED
                place = np.arange(len(g)) - at[d]
                inside = np.flatnonzero(place < length[d])
                text = d[inside]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[inside].view(np.int64)), pa.array(sig[text]), pa.array(size[text].astype(np.int32)), pa.array((size[text] - 1 - place[inside]).astype(np.int32))],
                    names=["gram", "sig", "size", "rest"],
                )

    return _texts(docs).select("text").mapInArrow(run, "gram long, sig long, size int, rest int")


def _rows(gram, sig, size, rest, block=None, total=None) -> pa.RecordBatch:
    """Rows of the runs: with a block, or of a tiled run, or the end of one with its total."""
    none = pa.nulls(len(gram))
    return pa.RecordBatch.from_arrays(
        [none.cast(pa.int64()) if block is None else pa.array(block), pa.array(gram), pa.array(sig), pa.array(size), pa.array(rest), none.cast(pa.int64()) if total is None else pa.array(total)],
        names=["block", "gram", "sig", "size", "rest", "total"],
    )


def _led(gram, sig, size, rest) -> Iterator[pa.RecordBatch]:
    """Whole runs: those of at least two sets get a block, by the run's lowest
    signature and, for long runs, a part of the grams; those beyond ``TILE`` an end."""
    if not len(gram):
        return
    start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    length = np.diff(np.append(start, len(gram)))
    leader = np.minimum.reduceat(sig, start)
    part = gram[start].view(np.uint64) % (1 + length // 256).astype(np.uint64)
    block = np.repeat(textops.mix(leader.view(np.uint64) + part).view(np.int64), length)
    some = np.repeat((length > 1) & (length <= TILE), length)
    if some.any():
        yield _rows(gram[some], sig[some], size[some], rest[some], block[some])
    hot = length > TILE
    if hot.any():
        many = np.repeat(hot, length)
        yield _rows(gram[many], sig[many], size[many], rest[many])
        zero = np.zeros(int(hot.sum()), np.int32)
        yield _rows(gram[start[hot]], leader[hot], zero, zero, total=length[hot].astype(np.int64))


def _lead(batches) -> Iterator[pa.RecordBatch]:
    """``_led`` over rows sorted by gram, size and signature; a run is never held beyond ``TILE`` sets."""
    kept, total, leader, before = [], 0, 0, None

    def closed():
        if total > TILE:
            if kept:
                yield _rows(*(np.concatenate(x) for x in zip(*kept, strict=True)))
            zero = np.zeros(1, np.int32)
            yield _rows(np.array([before[0]]), np.array([leader]), zero, zero, total=np.array([total]))
        elif kept:
            yield from _led(*(np.concatenate(x) for x in zip(*kept, strict=True)))

    for batch in batches:
        x = [batch.column(k).to_numpy() for k in range(4)]
        if not len(x[0]):
            continue
        once = np.ones(len(x[0]), dtype=bool)
        once[1:] = (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1])
        once[0] = before is None or before != (x[0][0], x[1][0])
        last = (x[0][-1], x[1][-1])
        x = [c[once] for c in x]
        if len(x[0]):
            edge = np.flatnonzero(x[0][1:] != x[0][:-1]) + 1
            at = 0
            if before is not None and x[0][0] == before[0]:
                at = int(edge[0]) if len(edge) else len(x[0])
                kept.append([c[:at] for c in x])
                total, leader = total + at, min(leader, int(x[1][:at].min()))
            if at < len(x[0]):
                yield from closed()
                tail = int(edge[-1]) if len(edge) else 0
                yield from _led(*(c[at:tail] for c in x))
                kept, total, leader = [[c[tail:] for c in x]], len(x[0]) - tail, int(x[1][tail:].min())
        before = last
        if total > TILE and kept:
            yield _rows(*(np.concatenate(c) for c in zip(*kept, strict=True)))
            kept = []
    yield from closed()


def _runs(table: pa.Table, threshold: float):
    """Pairs of the whole runs of a gram in a table sorted by block, gram, size and sig."""
    gram, sig, size, rest, side = (table.column(k).to_numpy() for k in range(1, 6))
    if not len(gram):
        return
    size, rest = size.astype(np.int64), rest.astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    stop = np.append(start[1:], len(gram))
    end = np.repeat(stop, stop - start)
    # Within its run, each row meets those after it, so far as their length allows.
    step, alive = 1, np.flatnonzero(np.arange(len(gram)) + 1 < end)
    while len(alive):
        alive = alive[size[alive] >= threshold * size[alive + step] - _EPS]
        # In a block of two tiles, only rows of different tiles are a pair.
        a = alive[(side[alive] == 0) | (side[alive] != side[alive + step])]
        b = a + step
        if len(a):
            low = sig[a] < sig[b]
            sa, sb = np.where(low, size[a], size[b]), np.where(low, size[b], size[a])
            yield np.minimum(sig[a], sig[b]), np.maximum(sig[a], sig[b]), np.ones(len(a), np.int32), np.minimum(rest[a], rest[b]).astype(np.int32), sa.astype(np.int32), sb.astype(np.int32)
        step += 1
        alive = alive[alive + step < end[alive]]


def _gathered(parts: list) -> tuple[np.ndarray, ...]:
    """The rows of ``_runs`` with one row for each pair."""
    a, b, count, rest, sa, sb = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((b, a))
    a, b, count, rest, sa, sb = a[order], b[order], count[order], rest[order], sa[order], sb[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[first], b[first], np.add.reduceat(count, first).astype(np.int32), np.minimum.reduceat(rest, first), sa[first], sb[first]


def _whole_runs(batches, column: int):
    """The batches again, cut only where the numbers of a column change."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        run = table.column(column).to_numpy()
        other = np.flatnonzero(run != run[-1]) if len(run) else run
        at = int(other[-1]) + 1 if len(other) else 0
        rest = table.slice(at)
        yield table.slice(0, at)
    if rest is not None:
        yield rest


def _blocks(spark: SparkSession, index: DataFrame) -> DataFrame:
    """``block, gram, sig, size, rest, side``: every run of two sets or more, in blocks of bounded size."""
    runs = index.repartition("gram").sortWithinPartitions("gram", "size", "sig")
    runs = cut(spark, runs.mapInArrow(_lead, "block long, gram long, sig long, size int, rest int, total long"), "runs")
    columns = ["block", "gram", "sig", "size", "rest"]
    whole = runs.filter("block is not null").select(*columns, F.lit(0).alias("side"))
    ends = sized(spark, runs.filter("total is not null").select(F.col("gram").alias("g"), F.col("sig").alias("leader"), F.expr("shiftleft(1, int(ceil(log2(double(total) / %d))))" % TILE).alias("tiles")), "ends")
    rows = runs.filter("block is null and total is null").join(ends, F.col("gram") == F.col("g")).withColumn("t", F.pmod(F.xxhash64("sig"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    side = F.when(F.col("i") == F.col("t"), 0).when(F.col("t") < F.col("i"), 1).otherwise(2)
    block = F.xxhash64("leader", "tiles", F.least("t", "i"), F.greatest("t", "i"))
    return whole.union(rows.select(block.alias("block"), *columns[1:], side.alias("side")))


def candidates(index: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``a, b, sa, sb``: pairs of signatures ``a < b`` that pass the length, count and positional filters, with the sizes of their sets."""
    names = ["a", "b", "c", "rest", "sa", "sb"]

    def emit(parts):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _gathered(parts)], names=names)

    def run(batches):
        parts, held = [], 0
        for table in _whole_runs(batches, 1):
            for part in _runs(table, threshold):
                parts.append(part)
                held += len(part[0])
                if held > 1 << 19:
                    parts = [_gathered(parts)]
                    held = len(parts[0][0])
                    if held > 1 << 18:
                        yield emit(parts)
                        parts, held = [], 0
        if parts:
            yield emit(parts)
        tidy()

    blocks = _blocks(index.sparkSession, index).repartition("block").sortWithinPartitions("block", "gram", "size", "sig")
    pairs = blocks.mapInArrow(run, "a long, b long, c int, rest int, sa int, sb int").groupBy("a", "b")
    pairs = pairs.agg(F.sum("c").alias("c"), F.min("rest").alias("rest"), F.max("sa").alias("sa"), F.max("sb").alias("sb"))
    need = F.ceil(threshold / (1 + threshold) * (F.col("sa") + F.col("sb")) - F.lit(_EPS))
    return pairs.filter((F.col("c") >= F.least(F.lit(SHARED), need)) & (F.col("c") + F.col("rest") >= need)).select("a", "b", "sa", "sb")


class _Block:
    """The members of a block with their sets, and what its pairs say about them."""

    def __init__(self) -> None:
        self.members, self.sig = [], None

    def ready(self) -> None:
        """Sorts the members by signature and ranks them by id."""
        self.members.sort(key=lambda m: m[0])
        once = [m for k, m in enumerate(self.members) if not k or m[0] != self.members[k - 1][0]]
        self.sig = np.array([m[0] for m in once], dtype=np.int64)
        self.ids = [m[1] for m in once]
        self.copies = np.array([m[2] for m in once], dtype=np.int64)
        self.sets, self.members = [m[3] for m in once], []
        self.size = np.array([len(g) for g in self.sets], dtype=np.int64)
        self.ranges = np.stack([np.bincount(g >> 42, minlength=64) for g in self.sets]).astype(np.int32)
        self.by_id = sorted(range(len(once)), key=lambda k: self.ids[k])
        self.label = np.empty(len(once), dtype=np.int64)
        self.label[self.by_id] = np.arange(len(once))
        self.links = np.zeros(len(once), dtype=np.int64)

    def similar(self, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
        """Places of the similar ones among pairs in order of ``a``, and their Jaccard."""
        x, y = np.searchsorted(self.sig, a), np.searchsorted(self.sig, b)
        if (self.sig[np.minimum(x, len(self.sig) - 1)] != a).any() or (self.sig[np.minimum(y, len(self.sig) - 1)] != b).any():
            raise RuntimeError("a pair came without its sets: the documents changed between two passes")
        need = np.ceil(threshold / (1 + threshold) * (self.size[x] + self.size[y]) - _EPS)
        keep = np.concatenate([np.minimum(self.ranges[x[k : k + 4096]], self.ranges[y[k : k + 4096]]).sum(axis=1) for k in range(0, len(x), 4096)]) >= need  # the suffix filter
        x, y = x[keep], y[keep]
        shared = np.zeros(len(x), dtype=np.int64)
        edge = np.flatnonzero(np.concatenate([x[:1] >= 0, x[1:] != x[:-1]]))
        for s, e in zip(edge, np.append(edge[1:], len(x)), strict=False):
            mine, k = self.sets[x[s]], int(s)
            upto = np.cumsum(self.size[y[s:e]])
            while k < e:
                done = upto[k - s - 1] if k > s else 0
                stop = max(k + 1, int(s + np.searchsorted(upto, done + _COMPARED, side="right")))
                other = y[k:stop]
                n = self.size[other]
                begin = np.cumsum(n) - n
                theirs = np.concatenate([self.sets[i] for i in other])
                place = np.searchsorted(mine, theirs)
                place[place == len(mine)] = 0
                shared[k:stop] = np.add.reduceat((mine[place] == theirs).astype(np.int64), begin)
                k = stop
        jaccard = shared / (self.size[x] + self.size[y] - shared)
        good = jaccard >= threshold
        return x[good], y[good], jaccard[good]

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        np.add.at(self.links, x, self.copies[y])
        np.add.at(self.links, y, self.copies[x])
        edge = np.flatnonzero(np.concatenate([x[:1] >= 0, x[1:] != x[:-1]]))
        for s, e in zip(edge, np.append(edge[1:], len(x)), strict=False):
            found = np.unique(np.append(self.label[y[s:e]], self.label[x[s]]))
            if len(found) > 1:
                self.label[np.isin(self.label, found)] = found[0]


def _verified(threshold: float, arrow: pa.DataType, as_pairs: bool):
    """Streams blocks of members, each with its set, followed by their pairs in order of the first.

    Gives ``sig, id, low, links`` of the members with links, ``low`` the lowest id
    that a member hangs together with in the block; or the pairs.
    """

    def done(block):
        if as_pairs or block is None or block.sig is None:
            return
        k = np.flatnonzero(block.links)
        if len(k):
            low = [block.ids[block.by_id[i]] for i in block.label[k]]
            yield pa.RecordBatch.from_arrays([pa.array(block.sig[k]), pa.array([block.ids[i] for i in k], arrow), pa.array(low, arrow), pa.array(block.links[k])], names=["sig", "id", "low", "links"])

    def run(batches):
        key, block = None, None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            is_pair = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
            if not len(keys):
                continue
            change = (keys[1:] != keys[:-1]).any(axis=1)
            edge = np.flatnonzero(np.concatenate([[True], change | (is_pair[1:] != is_pair[:-1])]))
            for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(keys)], strict=True):
                if key is None or (keys[s] != key).any():
                    yield from done(block)
                    key, block = keys[s], _Block()
                part = batch.slice(s, e - s)
                if is_pair[s]:
                    if block.sig is None:
                        block.ready()
                    x, y, jaccard = block.similar(part.column(3).to_numpy(), part.column(4).to_numpy(), threshold)
                    if as_pairs and len(x):
                        yield pa.RecordBatch.from_arrays([pa.array([block.ids[i] for i in x], arrow), pa.array([block.ids[i] for i in y], arrow), pa.array(jaccard)], names=["x", "y", "jaccard"])
                    elif len(x):
                        block.link(x, y)
                    continue
                for sig, id_, copies, grams in zip(part.column(3).to_pylist(), part.column(5).to_pylist(), part.column(6).to_pylist(), part.column(7), strict=True):
                    six = np.frombuffer(grams.as_buffer(), dtype=np.uint8).reshape(-1, 6)
                    wide = np.zeros((len(six), 8), dtype=np.uint8)
                    wide[:, :6] = six
                    block.members.append((sig, id_, copies, wide.view(np.int64).ravel()))
        yield from done(block)
        tidy()

    return run


def gram_sets(docs: DataFrame, bitmap: np.ndarray, n: int = N) -> DataFrame:
    """``sig, grams`` of the documents that the bitmap names, and of a few others.

    ``grams`` has the sorted hashes, cut to 48 bits, six bytes each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        bits = shared.value
        for batch in batches:
            at = batch.column(1).to_numpy()
            some = batch.column(0).filter(pa.array((bits[at >> 6] >> (at & 63)) & 1 == 1))
            for i, j, first, h, _, _ in textops.words(some):
                g, d = textops.grams(h, first, n)
                sig = _signature(g, d, j - i)
                order = np.lexsort((g, d))
                g, d = _once(g[order], d[order])
                at = np.searchsorted(d, np.arange(j - i + 1))
                six = np.ascontiguousarray((g >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6])
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array([six[at[k] : at[k + 1]].tobytes() for k in range(j - i)], pa.binary())], names=["sig", "grams"])

    return _texts(docs).select("text", id_bit("doc_id").alias("bit")).mapInArrow(run, "sig long, grams binary")


def verify(docs: DataFrame, reps: DataFrame, pairs: DataFrame, n: int = N, threshold: float = THRESHOLD, as_pairs: bool = False) -> DataFrame:
    """What the similar ones among the candidate pairs say of their members; see ``_verified``.

    A pair is verified in a block of its first member's leader, the lowest signature
    among that member and its partners; the members of a group share a leader, so a
    set travels about once, however many pairs it is in.  The members of a large
    group are cut into parts, and each two parts are a block.
    """
    spark = docs.sparkSession
    ends = pairs.select(F.col("a").alias("x"), F.col("a").alias("y")).union(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
    leaders = ends.groupBy("x").agg(F.min("y").alias("leader"))
    led = cut(spark, pairs.join(leaders, pairs.a == leaders.x).select("leader", "a", "b", "sa", "sb"), "led")
    members = cut(spark, led.select("leader", F.col("a").alias("sig"), F.col("sa").alias("size")).union(led.select("leader", "b", "sb")).distinct(), "members")
    part = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_GRAMS)).cast("int")
    heads = sized(spark, members.groupBy("leader").agg(part.alias("parts")).filter("parts > 1").withColumnRenamed("leader", "h"), "heads")
    parted = lambda df: df.join(heads, df.leader == heads.h, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    of = lambda c: F.pmod(F.xxhash64(c), F.col("parts")).cast("int")
    rows = parted(led).select("leader", F.least(of("a"), of("b")).alias("p"), F.greatest(of("a"), of("b")).alias("q"), "a", "b")
    info = members.select("sig").distinct().join(reps, "sig")
    sets = gram_sets(docs, ids_bitmap(info.select(F.col("rep").alias("doc_id"))), n)
    placed = parted(members).withColumns({"p": of("sig"), "i": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))})
    placed = placed.select("leader", F.least("p", "i").alias("p"), F.greatest("p", "i").alias("q"), "sig").join(info, "sig").join(sets, "sig")
    none = lambda t: F.lit(None).cast(t)
    kind = reps.schema["rep"].dataType.simpleString()
    placed = placed.select("leader", "p", "q", F.col("sig").alias("a"), none("long").alias("b"), F.col("rep").alias("id"), "copies", "grams")
    rows = placed.union(rows.select("*", none(kind).alias("id"), none("long").alias("copies"), none("binary").alias("grams")))
    rows = rows.repartition("leader", "p", "q").sortWithinPartitions("leader", "p", "q", F.col("b").isNotNull(), "a")
    found = _verified(threshold, kind_of(reps, "rep"), as_pairs)
    return rows.mapInArrow(found, f"x {kind}, y {kind}, jaccard double" if as_pairs else f"sig long, id {kind}, low {kind}, links long")


def _similar(docs: DataFrame, n: int, threshold: float, as_pairs: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents with their signatures, the sets with the lowest id and the copies of each, and what ``verify`` says."""
    if not 0 < threshold <= 1 or n < 1:
        raise ValueError("threshold must lie in (0, 1] and n be at least 1")
    spark: SparkSession = docs.sparkSession
    surveyed = cut(spark, survey(docs, n), "survey")
    pairs = cut(spark, candidates(prefixes(docs, frequencies(surveyed), n, threshold), threshold), "candidates")
    every = cut(spark, surveyed.filter("k is null").select("doc_id", "sig").distinct(), "signatures")
    reps = every.filter("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    return every, reps, verify(docs, reps, pairs, n, threshold, as_pairs)


def ngram_jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id, n_links``, one row a document; see the module's text."""
    spark = docs.sparkSession
    every, reps, found = _similar(docs, n, threshold, False)
    found = cut(spark, found, "found")
    # An id that comes with several texts ties their classes together.
    several = every.filter("sig is not null").groupBy("doc_id").agg(F.min("sig").alias("s"), F.max("sig").alias("t")).filter("s <> t").select(F.col("doc_id").alias("d"), "s")
    several = sized(spark, several, "several")
    low = reps.select(F.col("sig").alias("s"), F.col("rep").alias("low"))
    ties = every.join(several, every.doc_id == several.d).filter("sig is not null and sig <> s").join(reps.select("sig", F.col("rep").alias("id")), "sig").join(low, "s")
    edges = found.select(F.col("id").alias("doc_a"), F.col("low").alias("doc_b")).union(ties.select("id", "low")).filter("doc_a <> doc_b")
    label = groups(edges)
    links = found.groupBy("sig").agg(F.sum("links").alias("links"))
    per = reps.join(links, "sig", "left").join(label.select(F.col("doc_id").alias("rep"), "keeper"), "rep", "left")
    per = cut(spark, per.select(F.col("sig").alias("s"), F.coalesce("keeper", "rep").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), "copies"), "sets")
    # The rows of a set with many copies stay where they are.
    hot = sized(spark, per.filter(F.col("copies") > HOT), "hot")
    cold = per.filter(F.col("copies") <= HOT)
    named = every.join(hot, every.sig == hot.s, "left").select("doc_id", "sig", "c", "n")
    rest = named.filter("c is null").select("doc_id", "sig").join(cold, F.col("sig") == cold.s, "left").select("doc_id", "sig", "c", "n")
    rows = named.filter("c is not null").union(rest)
    return rows.groupBy("doc_id").agg(F.min(F.coalesce("c", "doc_id")).alias("class_id"), F.sum(F.coalesce("n", F.lit(0))).alias("n_links"))


def similar_sets(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_a, doc_b, jaccard``: the similar pairs of distinct sets, each named by its lowest id."""
    _, _, found = _similar(docs, n, threshold, True)
    return found.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), F.round("jaccard", 6).alias("jaccard")).filter("doc_a <> doc_b")


def groups(pairs: DataFrame) -> DataFrame:
    """``doc_id, keeper``: connected groups of the pairs, each led by its lowest id.

    Each id points to the lowest among itself and its partners; pointers are
    followed until they end, and pairs whose ends now agree are done.  What is left,
    with ends replaced, goes through the same again.  A group of copies of one
    another is done in the first round, however many pairs it has.
    """
    spark = pairs.sparkSession
    edges = cut(spark, pairs.select(F.col("doc_a").alias("u"), F.col("doc_b").alias("v")), "edges")
    label = None
    while True:
        low = edges.select("u", "v").union(edges.select("v", "u")).toDF("u", "v").groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l"))
        low = _followed(spark, cut(spark, low, "pointers"))
        if label is None:
            label = low
        else:
            label = cut(spark, label.join(low.toDF("l", "r"), "l", "left").select("u", F.coalesce("r", "l").alias("l")), "labels")
        ends = edges.join(low.toDF("u", "a"), "u").join(low.toDF("v", "b"), "v").filter("a <> b")
        edges = cut(spark, ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
        if not edges.take(1):
            return label.select(F.col("u").alias("doc_id"), F.col("l").alias("keeper"))


def _followed(spark: SparkSession, pointers: DataFrame) -> DataFrame:
    """Pointers ``u, l`` followed to their ends, twice as far in each round."""
    while True:
        step = cut(spark, pointers.join(pointers.toDF("l", "m"), "l").select("u", F.col("m").alias("l"), (F.col("m") < F.col("l")).alias("moved")), "pointers")
        pointers = step.select("u", "l")
        if not step.filter("moved").take(1):
            return pointers


def drop_near_copies(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class: that with the lowest id.

    Documents without a similar one, without words and without an id stay as they are.
    """
    gone = ngram_jaccard_join(docs, n, threshold).filter("doc_id <> class_id").select("doc_id")
    return without(docs, cut(docs.sparkSession, gone, "gone"))
