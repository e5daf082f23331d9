"""Media columns: what ISO media containers say about their tracks.

The boxes are walked from the top, payloads (``mdat``) are stepped over by their
sizes.  For each track the sample tables give codec, time scale, duration, number
of samples, and where its keyframes lie: chunk offsets, samples a chunk and sample
sizes make byte ranges, of which the sync sample table keeps the keyframes (all
samples, where the table is absent).

Nulls, empties and errors: a null or empty container, one without ``moov`` and one
without tracks give one row with null track columns and the reason in ``error``.
A track whose tables are cut off or contradict each other has the fields read
so far and the reason; so has one with times or places beyond 63 bits, and one
that makes keyframes of more equal samples than the file has bytes for.  No table
takes more memory than its bytes in the file do, times a small number.  A duration
that says it is unknown (all bits set) is null.  Keyframe ranges past the end of the
data stay as declared.  Repeated rows give repeated rows; a null id passes through.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class MediaError(ValueError):
    """A container that breaks its own rules."""


def boxes(data: memoryview, at: int, end: int) -> Iterator[tuple[str, int, int]]:
    """Kind, begin and end of the content of each box in ``data[at:end]``."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise MediaError("a box header is cut off")
            (size,) = struct.unpack_from(">Q", data, at + 8)
            head = 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise MediaError(f"box {kind.decode('latin1')} leaves its parent")
        yield kind.decode("latin1"), at + head, at + size
        at += size


def _find(data, at, end, *path) -> tuple[int, int] | None:
    for kind, a, b in boxes(data, at, end):
        if kind == path[0]:
            return (a, b) if len(path) == 1 else _find(data, a, b, *path[1:])
    return None


def _numbers(data, a: int, b: int, width: int, count: int, what: str) -> np.ndarray:
    if count < 0 or a + width * count > b:
        raise MediaError(f"{what} is cut off")
    return np.frombuffer(data[a : a + width * count], dtype=f">u{width}").astype(np.int64)


def _table(data, a, b, columns: int, what: str) -> np.ndarray:
    if a + 8 > b:
        raise MediaError(f"{what} is cut off")
    (n,) = struct.unpack_from(">I", data, a + 4)
    return _numbers(data, a + 8, b, 4, n * columns, what).reshape(n, columns)


#: Places and times beyond are errors: the largest number of the columns.
_MOST = (1 << 63) - 1
_BLANK = dict.fromkeys(("track_id", "handler", "codec", "timescale", "duration_ms", "n_samples", "keyframes", "error"))


def _track(data, a: int, b: int) -> dict:
    """The fields of ``TYPE``; ``keyframes`` as an array of offsets and one of sizes."""
    out = dict(_BLANK)
    try:
        if (x := _find(data, a, b, "tkhd")) and x[0] + 24 <= x[1]:
            (out["track_id"],) = struct.unpack_from(">I", data, x[0] + (20 if data[x[0]] == 1 else 12))
        if (x := _find(data, a, b, "mdia", "hdlr")) and x[0] + 12 <= x[1]:
            out["handler"] = bytes(data[x[0] + 8 : x[0] + 12]).decode("latin1")
        x = _find(data, a, b, "mdia", "mdhd")
        if not x or x[0] + 20 > x[1] or (data[x[0]] == 1 and x[0] + 32 > x[1]):
            raise MediaError("no media header")
        wide = data[x[0]] == 1
        scale, ticks = struct.unpack_from(">IQ", data, x[0] + 20) if wide else struct.unpack_from(">II", data, x[0] + 12)
        out["timescale"] = scale
        if ticks == (1 << (64 if wide else 32)) - 1:
            ticks = None
        stbl = _find(data, a, b, "mdia", "minf", "stbl")
        if not stbl:
            raise MediaError("no sample table")
        at = {kind: (p, q) for kind, p, q in boxes(data, *stbl)}
        if "stsd" in at and at["stsd"][0] + 16 <= at["stsd"][1]:
            out["codec"] = bytes(data[at["stsd"][0] + 12 : at["stsd"][0] + 16]).decode("latin1")
        if "stts" in at:
            times = _table(data, *at["stts"], 2, "stts").astype(np.uint64)
            each = times[:, 0] * times[:, 1]  # below 2^64
            ticks = (int((each >> np.uint64(32)).sum()) << 32) + int((each & np.uint64(0xFFFFFFFF)).sum())
        if scale and ticks is not None:
            if ticks * 1000 // scale > _MOST:
                raise MediaError("the duration is out of range")
            out["duration_ms"] = ticks * 1000 // scale
        same, sizes, n = _sizes(data, at)
        out["n_samples"] = n
        if "stss" in at:
            keys = _table(data, *at["stss"], 1, "stss")[:, 0] - 1
            if len(keys) and (keys.min() < 0 or keys.max() >= n):
                raise MediaError("stss names a sample that is not there")
        elif same * n > len(data):
            raise MediaError("more samples than the file has bytes for")
        else:
            keys = np.arange(n)
        out["keyframes"] = _offsets(data, at, same, sizes, n, keys), (np.full(len(keys), same, dtype=np.int64) if same else sizes[keys])
    except MediaError as e:
        out["error"] = str(e)
    return out


def _sizes(data, at) -> tuple[int, np.ndarray | None, int]:
    """The size of all samples or 0, the sizes of each if they differ, and the number of samples."""
    if "stsz" in at:
        a, b = at["stsz"]
        if a + 12 > b:
            raise MediaError("stsz is cut off")
        same, n = struct.unpack_from(">II", data, a + 4)
        return (same, None, n) if same else (0, _numbers(data, a + 12, b, 4, n, "stsz"), n)
    if "stz2" in at:
        a, b = at["stz2"]
        if a + 12 > b:
            raise MediaError("stz2 is cut off")
        bits, n = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
        if bits == 4:
            pairs = _numbers(data, a + 12, b, 1, (n + 1) // 2, "stz2")
            return 0, np.stack([pairs >> 4, pairs & 15], axis=1).ravel()[:n], n
        if bits in (8, 16):
            return 0, _numbers(data, a + 12, b, bits // 8, n, "stz2"), n
    raise MediaError("no sample sizes")


def _offsets(data, at, same: int, sizes: np.ndarray | None, n: int, keys: np.ndarray) -> np.ndarray:
    """Where the samples ``keys`` begin: their chunk, and what lies before them in it."""
    if "co64" in at:
        a, b = at["co64"]
        chunks = _numbers(data, a + 8, b, 8, struct.unpack_from(">I", data, a + 4)[0] if a + 8 <= b else -1, "co64")
    elif "stco" in at:
        chunks = _table(data, *at["stco"], 1, "stco")[:, 0]
    else:
        raise MediaError("no chunk offsets")
    if "stsc" not in at:
        raise MediaError("no samples a chunk")
    runs = _table(data, *at["stsc"], 3, "stsc")
    if not n:
        return np.zeros(0, np.int64)
    first = runs[:, 0] - 1
    if not len(runs) or first[0] != 0 or (np.diff(first) <= 0).any() or first[-1] >= len(chunks):
        raise MediaError("stsc does not fit the chunks")
    each = np.repeat(np.minimum(runs[:, 1], n), np.diff(np.append(first, len(chunks))))
    upto = np.cumsum(each)
    if int(upto[-1]) < n:
        raise MediaError("stsc has fewer samples than stsz")
    chunk = np.searchsorted(upto, keys, side="right")
    head = upto[chunk] - each[chunk]
    if same:
        if len(keys) and int((keys - head).max()) > _MOST // same:
            raise MediaError("a chunk offset is out of range")
        before = (keys - head) * same
    else:
        total = np.concatenate([[0], np.cumsum(sizes)])
        before = total[keys] - total[head]
    # Offsets of 64 bits come as negative numbers beyond 63.
    if len(keys) and ((chunks[chunk] < 0).any() or (chunks[chunk] > _MOST - before).any()):
        raise MediaError("a chunk offset is out of range")
    return chunks[chunk] + before


def _tracks(blob: bytes | None) -> list[dict]:
    if not blob:
        return [_BLANK | {"error": "no data"}]
    data = memoryview(blob)
    try:
        moov = _find(data, 0, len(data), "moov")
        if not moov:
            return [_BLANK | {"error": "no moov"}]
        tracks = [_track(data, a, b) for kind, a, b in boxes(data, *moov) if kind == "trak"]
    except MediaError as e:
        return [_BLANK | {"error": str(e)}]
    return tracks or [_BLANK | {"error": "no tracks"}]


def read_container(blob: bytes | None) -> list[dict]:
    """One dictionary for each track; a single one with an error, where there is none."""
    as_list = lambda k: None if k is None else [{"offset": int(o), "size": int(s)} for o, s in zip(*k, strict=True)]
    return [t | {"keyframes": as_list(t["keyframes"])} for t in _tracks(blob)]


TYPE = "track_id long, handler string, codec string, timescale long, duration_ms long, n_samples long, keyframes array<struct<offset:long,size:long>>, error string"
_ARROW = pa.struct([("track_id", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration_ms", pa.int64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))), ("error", pa.string())])


def _keyframes(found: list) -> pa.Array:
    """A list column from arrays of offsets and sizes, without an object for each keyframe."""
    size = [0 if k is None else len(k[0]) for k in found]
    at = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32(), mask=np.array([*(k is None for k in found), False]))
    parts = [np.concatenate([np.zeros(0, np.int64), *(k[c] for k in found if k is not None)]) for c in (0, 1)]
    return pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.array(p) for p in parts], ["offset", "size"]))


def media_columns(files: DataFrame, id_col: str, blob_col: str) -> DataFrame:
    """A row for each track of each container: the id and the fields of ``TYPE``."""
    kind = files.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, out = [], []
            for r, blob in enumerate(batch.column(1)):
                tracks = _tracks(blob.as_py())
                rows += [r] * len(tracks)
                out += tracks
            fields = [_keyframes([t["keyframes"] for t in out]) if f.name == "keyframes" else pa.array([t[f.name] for t in out], f.type) for f in _ARROW]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *fields], names=[id_col, *(f.name for f in _ARROW)])

    return files.select(F.col(id_col), F.col(blob_col)).mapInArrow(run, f"`{id_col}` {kind}, {TYPE}")
