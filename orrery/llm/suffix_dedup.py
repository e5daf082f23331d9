"""Repeated passages by a sparse suffix array over content-selected positions.

Words are numbered by hash.  In every window of ``length`` words one k-gram is
selected by content (the lowest hash, the leftmost of equals), so two equal
windows select the same place in both.  Only the suffixes that start at selected
places are kept, about one in ``(length - k) / 2`` words.  Then

1. a suffix whose first ``k`` words start no other kept suffix is dropped;
2. the others are sorted as suffixes, with the words before them as the second
   key, across the cluster by their first ``k`` words;
3. neighbours are compared: the common words to the right and to the left give the
   windows that the two share;  where three or more suffixes start alike, a
   neighbour on the right need not be the best one on the left, so their windows
   are then compared by class, which is exact;
4. shared windows that touch are joined, which extends a match to its full length
   on both sides, through as many selected places as it covers.

First words that start more than ``HOT`` kept suffixes, boilerplate as a rule, would
be one task's whole work; the windows around those places are compared by a grouped
count instead, which gives the same and is spread over all tasks.

The result is exact: a word belongs to a repeat if, and only if, some window of
``length`` words around it occurs twice in the corpus, in one document or in two.
Of equal windows, the first by ``(doc_id, position)`` is kept, the others go.

Nulls, empties and ties: texts that are null or have fewer than ``length`` words
have no window.  Ids are of any type with an order.  A row without ``doc_id`` cannot be named and is left out.  Rows
that repeat an id with the same text count as one, with other texts they are read
as texts of the same document, whose spans are then joined; equal windows at the
same place of both are one place.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.llm import textops
from orrery.llm.common import cut, parted, sized, small_batches, tidy

LENGTH, K = 50, 10
#: Suffixes with the same first words that one task sorts; beyond, windows are counted.
HOT = 1 << 13
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _texts(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.lower("text").alias("text"))


def _selected(h: np.ndarray, first: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Selected word places, their k-gram, and the first and last window that chose them."""
    none = np.zeros(0, np.int64)
    if len(h) < length:
        return none, np.zeros(0, np.uint64), none, none
    key = np.zeros(len(h), dtype=np.uint64)
    for i in range(k):
        key[: len(h) - k + 1] = (key[: len(h) - k + 1] + h[i : len(h) - k + 1 + i]) * np.uint64(0xD6E8FEB86659FD93)
    key = textops.mix(key)
    key[len(h) - k + 1 :] = _TOP
    span, width = length - k + 1, 1
    low, at = key, np.arange(len(h))
    while width < span:
        step = min(width, span - width)
        here, there = low[: len(low) - step], low[step:]
        right = there < here
        at = np.where(right, at[step:], at[: len(at) - step])
        low = np.where(right, there, here)
        width += step
    count = np.diff(first)
    ok = np.zeros(len(h) + 1, dtype=np.int32)
    full = count >= length
    np.add.at(ok, first[:-1][full], 1)
    np.add.at(ok, first[1:][full] - length + 1, -1)
    q = np.flatnonzero(np.cumsum(ok)[: len(at)] > 0)
    p = at[q]
    turn = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else none
    last = np.append(turn[1:], len(p)) - 1 if len(p) else none
    return p[turn], key[p[turn]], q[turn], q[last]


def places(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """``key, doc_id, at``: every selected place of every document."""
    rows = _texts(docs)

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, _, first, h, _, _ in textops.words(batch.column(1)):
                p, key, _, _ = _selected(h, first, length, k)
                row = np.searchsorted(first, p, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), ids.take(pa.array(i + row)), pa.array((p - first[row]).astype(np.int32))], names=["key", "doc_id", "at"])

    return rows.mapInArrow(run, f"key long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, at int")


def _wanted(batch: pa.RecordBatch, i: int, j: int, place: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which of the places, words from each text's start, are in the texts' lists."""
    listed, size = batch.column(2), 1 << 32
    values, offsets = listed.values.to_numpy().astype(np.int64), listed.offsets.to_numpy()
    want = np.concatenate([r * size + values[offsets[i + r] : offsets[i + r + 1]] for r in range(j - i)] or [np.zeros(0, np.int64)])
    return np.isin(row * size + place, want)


def windows(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """``h, doc_id, lo``: the windows that chose the listed places, with a hash of their words."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, j, first, h, _, _ in textops.words(batch.column(1)):
                p, _, q1, q2 = _selected(h, first, length, k)
                row = np.searchsorted(first, p, side="right") - 1
                take = _wanted(batch, i, j, p - first[row], row)
                q1, q2, row = q1[take], q2[take], row[take]
                n = q2 - q1 + 1
                q = np.arange(n.sum()) + np.repeat(q1 - (np.cumsum(n) - n), n)
                own = np.repeat(row, n)
                for a in range(0, len(q), 1 << 16):
                    part, mine = q[a : a + (1 << 16)], own[a : a + (1 << 16)]
                    g = np.zeros(len(part), dtype=np.uint64)
                    for w in range(length):
                        g = (g + h[part + w]) * np.uint64(0xD6E8FEB86659FD93)
                    yield pa.RecordBatch.from_arrays([pa.array(textops.mix(g).view(np.int64)), ids.take(pa.array(i + mine)), pa.array((part - first[mine]).astype(np.int32))], names=["h", "doc_id", "lo"])

    return docs.mapInArrow(run, f"h long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, lo int")


def suffixes(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """``key, doc_id, at, near, far, context`` of the listed places of each document.

    ``context`` has the words to the right and then those to the left, nearest
    first, as four bytes each; ``near`` and ``far`` bound the windows that chose
    the place, as words before it.
    """
    reach = length - k

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, j, first, h, _, _ in textops.words(batch.column(1)):
                p, key, q1, q2 = _selected(h, first, length, k)
                row = np.searchsorted(first, p, side="right") - 1
                take = _wanted(batch, i, j, p - first[row], row)
                p, key, q1, q2, row = p[take], key[take], q1[take], q2[take], row[take]
                small = (h >> np.uint64(32)).astype(np.uint32)
                for a in range(0, len(p), 1 << 12):
                    b = min(a + (1 << 12), len(p))
                    mid = p[a:b, None]
                    right, left = mid + np.arange(length), mid - 1 - np.arange(reach)
                    r_ok, l_ok = right < first[row[a:b] + 1][:, None], left >= first[row[a:b]][:, None]
                    context = np.concatenate([np.where(r_ok, small[np.minimum(right, len(h) - 1)], 0), np.where(l_ok, small[np.maximum(left, 0)], 0)], axis=1).astype(np.uint32)
                    blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(context.shape[1] * 4), b - a, [None, pa.py_buffer(np.ascontiguousarray(context))]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[a:b].view(np.int64)), ids.take(pa.array(i + row[a:b])), pa.array((p[a:b] - first[row[a:b]]).astype(np.int32)), pa.array((p[a:b] - q2[a:b]).astype(np.int32)), pa.array((p[a:b] - q1[a:b]).astype(np.int32)), blob],
                        names=["key", "doc_id", "at", "near", "far", "context"],
                    )

    return docs.mapInArrow(run, f"key long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, at int, near int, far int, context binary")


def _spans(mask: np.ndarray, doc: np.ndarray, ids: pa.Array, at: np.ndarray, later: bool, length: int):
    """Runs of marked windows (columns: words before the place) as spans of words."""
    if not mask.any():
        return None
    wide = np.zeros((mask.shape[0], mask.shape[1] + 2), dtype=np.int8)
    wide[:, 1:-1] = mask
    edge = np.diff(wide, axis=1)
    row, lo = np.nonzero(edge == 1)
    hi = np.nonzero(edge == -1)[1] - 1
    return pa.RecordBatch.from_arrays([ids.take(pa.array(doc[row])), pa.array((at[row] - hi).astype(np.int32)), pa.array((at[row] - lo + length).astype(np.int32)), pa.array(np.full(len(row), later))], names=["doc_id", "lo", "hi", "later"])


def _compare(table: pa.Table, length: int, k: int):
    """Spans of the whole runs of one key in a table sorted as a suffix array."""
    reach = length - k
    n = table.num_rows
    if n < 2:
        return
    key, at, near, far = (table.column(c).to_numpy() for c in (0, 2, 3, 4))
    ids = pc.unique(table.column(1)).sort()
    doc = pc.index_in(table.column(1), ids).to_numpy()  # numbers in the order of the ids
    context = np.frombuffer(b"".join(table.column(5).to_pylist()), dtype=np.uint32).reshape(n, length + reach)
    same = context[1:] == context[:-1]
    # Rows that repeat an id and its text give the same suffixes: one stays.
    twin = same.all(axis=1) & (key[1:] == key[:-1]) & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])
    if twin.any():
        stay = np.concatenate([[True], ~twin])
        key, doc, at, near, far, context = (x[stay] for x in (key, doc, at, near, far, context))
        n, same = len(key), context[1:] == context[:-1]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, n))
    before = np.arange(reach + 1)
    own = (before >= near[:, None]) & (before <= far[:, None])
    shared, later = np.zeros((n, reach + 1), dtype=bool), np.zeros((n, reach + 1), dtype=bool)
    # Neighbours: how far do they agree to the right and to the left?
    right = np.minimum.accumulate(same[:, :length], axis=1).sum(axis=1)
    left = np.minimum.accumulate(same[:, length:], axis=1).sum(axis=1)
    match = (before <= left[:, None]) & (length - before <= right[:, None]) & (key[1:] == key[:-1])[:, None]
    pair = start[size == 2]
    if len(pair):
        apart = (doc[pair] != doc[pair + 1]) | (at[pair] != at[pair + 1])
        both = match[pair] & own[pair] & own[pair + 1] & apart[:, None]
        shared[pair], shared[pair + 1] = both, both
        first_later = (doc[pair] > doc[pair + 1]) | ((doc[pair] == doc[pair + 1]) & (at[pair] > at[pair + 1]))
        later[np.where(first_later, pair, pair + 1)] = both
    many = np.flatnonzero(np.repeat(size > 2, size))
    if len(many):
        # Hashes of the words on either side give those of the windows in them.
        word = context[many].astype(np.uint64) + np.uint64(1)
        r = np.cumsum(textops.mix(word[:, :length] + np.arange(length, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), axis=1)
        m = np.cumsum(textops.mix(word[:, length:] - np.arange(1, reach + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), axis=1)
        group = np.repeat(np.arange(len(size)), size)[many]
        for b in range(reach + 1):
            mine = np.flatnonzero(own[many, b])
            if len(mine) < 2:
                continue
            h = r[mine, length - b - 1] + (m[mine, b - 1] if b else np.uint64(0))
            order = np.lexsort((at[many[mine]], doc[many[mine]], h, group[mine]))
            o = mine[order]
            g, hh, dd, aa = group[o], h[order], doc[many[o]], at[many[o]]
            equal = (g[1:] == g[:-1]) & (hh[1:] == hh[:-1])
            lead = np.concatenate([[True], ~equal])
            run = np.cumsum(lead) - 1
            head = np.flatnonzero(lead)[run]
            # Rows at the first place of a window are that place, no later one.
            other = (dd != dd[head]) | (aa != aa[head])
            several = np.zeros(run[-1] + 1, dtype=bool)
            several[run[other]] = True
            shared[many[o[several[run]]], b] = True
            later[many[o[other]], b] = True
    yield _spans(shared, doc, ids, at, False, length)
    yield _spans(later, doc, ids, at, True, length)


def _pieces(key: np.ndarray, most: int = 4096):
    """Slices of whole runs of equal keys, of about ``most`` rows where runs are shorter."""
    edge = np.append(np.flatnonzero(np.concatenate([key[:1] == key[:1], key[1:] != key[:-1]])), len(key))
    a = 0
    while a < len(key):
        b = int(edge[max(np.searchsorted(edge, a + most, side="right") - 1, np.searchsorted(edge, a, side="right"))])
        yield a, b
        a = b


def _neighbours(length: int, k: int):
    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            key = table.column(0).to_numpy()
            at = int(np.searchsorted(key, key[-1])) if len(key) else 0
            rest = table.slice(at)
            for a, b in _pieces(key[:at]):
                yield from (x for x in _compare(table.slice(a, b - a), length, k) if x is not None)
        if rest is not None:
            yield from (x for x in _compare(rest, length, k) if x is not None)
        tidy()

    return run


def _joined(spans: DataFrame) -> DataFrame:
    """Spans of one document that overlap or touch become one."""
    w = W.partitionBy("doc_id").orderBy("lo", "hi")
    edge = F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1))
    run = spans.withColumn("new", F.when(edge >= F.col("lo"), 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return run.groupBy("doc_id", "run").agg(F.min("lo").alias("word_start"), F.max("hi").alias("word_end")).drop("run")


def _repeats(docs: DataFrame, length: int, k: int) -> DataFrame:
    """``doc_id, lo, hi, later``: unmerged spans of all repeats and of those that go."""
    if not 0 < k <= length:
        raise ValueError("k must lie in 1..length")
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    kept = cut(spark, places(docs, length, k), "places")
    keys = cut(spark, kept.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "keys")
    hot = sized(spark, keys.filter(F.col("c") > HOT).select(F.col("key").alias("hot_key")), "hot")
    marked = kept.join(hot, F.col("key") == F.col("hot_key"), "left")
    per = lambda rows: rows.groupBy("doc_id").agg(F.collect_set("at").alias("listed"))

    def with_lists(lists: DataFrame) -> DataFrame:
        return parted(_texts(docs), lists)[1].join(lists, "doc_id").select("doc_id", "text", "listed")

    cold = cut(spark, per(marked.filter("hot_key is null").join(keys, "key", "left_semi")), "listed")
    order = suffixes(with_lists(cold), length, k).repartition("key").sortWithinPartitions("key", "context", "doc_id", "at")
    spans = order.mapInArrow(_neighbours(length, k), f"doc_id {kind}, lo int, hi int, later boolean")
    dense = cut(spark, per(marked.filter("hot_key is not null")), "dense")
    if dense.take(1):
        seen = cut(spark, windows(with_lists(dense), length, k), "windows")
        place = F.struct("doc_id", "lo")
        shared = sized(spark, seen.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select(F.col("h").alias("g"), "first"), "shared")
        both = seen.join(shared, F.col("h") == F.col("g")).select("doc_id", "lo", (F.col("lo") + length).alias("hi"), (place != F.col("first")).alias("later"))
        # Every repeat, and once more those that go; windows of a text that overlap become one.
        spans = spans.union(both.select("doc_id", "lo", "hi", F.lit(False))).union(both.filter("later"))
    return cut(spark, spans, "repeats")


def repeated_passages(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """``doc_id, word_start, word_end, later_words``: all maximal repeats.

    ``later_words`` counts the span's words that ``drop_repeats`` deletes, those
    of which an earlier copy exists.
    """
    spans = _repeats(docs, length, k)
    every = _joined(spans.filter("not later").select("doc_id", "lo", "hi"))
    gone = _joined(spans.filter("later").select("doc_id", "lo", "hi")).select(F.col("doc_id").alias("d"), F.col("word_start").alias("s"), F.col("word_end").alias("e"))
    joined = every.join(gone, (F.col("doc_id") == F.col("d")) & (F.col("s") >= F.col("word_start")) & (F.col("e") <= F.col("word_end")), "left")
    return joined.groupBy("doc_id", "word_start", "word_end").agg(F.coalesce(F.sum(F.col("e") - F.col("s")), F.lit(0)).cast("long").alias("later_words"))


def drop_repeats(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """``docs`` without the later copies of its repeats; ``n_chars`` follows the text.

    A span goes from its first word's first byte to the next word that stays.  A
    document of which nothing but white space (of any kind) stays is dropped; all
    others, also those that were empty or blank before, remain.
    """
    spark = docs.sparkSession
    gone = _joined(_repeats(docs, length, k).filter("later").select("doc_id", "lo", "hi"))
    names = docs.columns
    id_, lo_, hi_ = (next(f"{n}{i}" for i in range(len(names) + 1) if f"{n}{i}".lower() not in {c.lower() for c in names}) for n in ("id", "lo", "hi"))
    listed = cut(spark, gone.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("word_start", "word_end"))).alias("s")), "later")
    clear, unsure = parted(docs, listed)
    listed = listed.select(F.col("doc_id").alias(id_), F.transform("s", lambda s: s.word_start).alias(lo_), F.transform("s", lambda s: s.word_end).alias(hi_))
    marked = unsure.join(listed, unsure["doc_id"] == listed[id_], "left").drop(id_)
    touched = marked.filter(F.col(lo_).isNotNull() & F.col("text").isNotNull())

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            text = table.column("text").combine_chunks()
            lo, hi = table.column(lo_).to_pylist(), table.column(hi_).to_pylist()
            raw, bounds = textops.buffers(text)
            out = [None] * len(text)
            for i, j, first, _, start, _ in textops.words(text):
                for r in range(j - i):
                    body = raw[bounds[i + r] : bounds[i + r + 1]].tobytes()
                    s = start[first[r] : first[r + 1]]
                    parts, done = [], 0
                    for a, b in zip(lo[i + r], hi[i + r], strict=True):
                        if a >= len(s):
                            continue  # a span of another row with this id
                        parts.append(body[done : int(s[a])])
                        done = int(s[b]) if b < len(s) else len(body)
                    out[i + r] = b"".join([*parts, body[done:]]).decode()
            at = table.schema.get_field_index("text")
            table = table.set_column(at, table.schema.field(at).with_type(pa.string()), pa.array(out, pa.string())).select(names)
            stay = [bool(x.strip()) or not before.as_py().strip() for x, before in zip(out, text, strict=True)]
            yield from table.filter(pa.array(stay)).to_batches()

    done = touched.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(names)
    return clear.union(marked.filter(F.col(lo_).isNull() | F.col("text").isNull()).select(names)).union(done)
