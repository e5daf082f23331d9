"""ISO media containers made of table rows, as input where no media files exist."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, EVERY, AUDIO = 512, 12, 16
CODECS = (b"avc1", b"hvc1", b"av01")


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes) -> bytes:
    return box(kind, b"\0\0\0\0", *parts)


def _list(kind: bytes, values, columns: int = 1) -> bytes:
    v = np.asarray(values, dtype=">u4").ravel()
    return _full(kind, struct.pack(">I", len(v) // columns), v.tobytes())


def track(number: int, handler: bytes, codec: bytes, timescale: int, delta: int, sizes: list[int], chunks: list[int], per_chunk: int, sync: list[int] | None) -> bytes:
    n = len(sizes)
    stbl = [
        _full(b"stsd", struct.pack(">I", 1), box(codec, bytes(8))),
        _list(b"stts", [[n, delta]] if n else [], 2),
        *([_list(b"stss", sync)] if sync is not None else []),
        _full(b"stsz", struct.pack(">II", 0, n), np.asarray(sizes, dtype=">u4").tobytes()),
        _list(b"stsc", [[1, per_chunk, 1]] if n else [], 3),
        _list(b"stco", chunks),
    ]
    mdhd = _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, timescale, n * delta, 0, 0))
    hdlr = _full(b"hdlr", bytes(4), handler, bytes(13))
    return box(b"trak", _full(b"tkhd", struct.pack(">IIIII", 0, 0, number, 0, n * delta), bytes(60)), box(b"mdia", mdhd, hdlr, box(b"minf", box(b"stbl", *stbl))))


def container(number: int, picture: bytes, sound: bytes) -> bytes:
    """A video track over ``picture`` and an audio track over ``sound``."""
    head = box(b"ftyp", b"isom", bytes(4), b"isommp42")
    at = len(head) + 8
    sizes = [min(SAMPLE, len(picture) - i) for i in range(0, len(picture), SAMPLE)]
    chunks = [at + i for i in range(0, len(picture), 5 * SAMPLE)]
    video = track(1, b"vide", CODECS[number % 3], 12800 + number % 5, 512, sizes, chunks, 5, list(range(1, len(sizes) + 1, EVERY)))
    notes = [min(AUDIO, len(sound) - i) for i in range(0, len(sound), AUDIO)]
    audio = track(2, b"soun", b"mp4a", 48000, 1024, notes, [at + len(picture) + i for i in range(0, len(sound), AUDIO)], 1, None)
    return head + box(b"mdat", picture, sound) + box(b"moov", _full(b"mvhd", bytes(96)), video, audio)


def from_pages(pages: DataFrame) -> DataFrame:
    """``page_id, media``: each page's HTML as pictures, its address as sound."""

    def run(batches):
        for batch in batches:
            ids, urls, texts = (batch.column(k).to_pylist() for k in range(3))
            made = [container(i or 0, (t or "").encode(), (u or "").encode()) for i, u, t in zip(ids, urls, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["page_id", "media"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, media binary")


SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS h, strlen(coalesce(url, '')) AS u FROM pages
), v AS (
  SELECT page_id, 1::BIGINT AS track_id, 'vide' AS handler, ['avc1', 'hvc1', 'av01'][page_id % 3 + 1] AS codec, (12800 + page_id % 5)::BIGINT AS timescale,
         ((h + {SAMPLE - 1}) // {SAMPLE})::BIGINT AS n_samples, 512 AS delta,
         array_to_string(list_transform(range(0, h::BIGINT, {SAMPLE * EVERY}), lambda i: (32 + i) || ':' || least({SAMPLE}, h - i)), ',') AS keyframes FROM p
), a AS (
  SELECT page_id, 2::BIGINT, 'soun', 'mp4a', 48000::BIGINT, ((u + {AUDIO - 1}) // {AUDIO})::BIGINT, 1024,
         array_to_string(list_transform(range(0, u::BIGINT, {AUDIO}), lambda i: (32 + h + i) || ':' || least({AUDIO}, u - i)), ',') FROM p
)
SELECT page_id, track_id, handler, codec, timescale, (n_samples * delta * 1000 // timescale)::BIGINT AS duration_ms, n_samples, keyframes, NULL::VARCHAR AS error
FROM (SELECT * FROM v UNION ALL SELECT * FROM a)
"""
