"""Document fingerprints by a homomorphic multiset hash.

A paragraph (a line, without spaces, tabs and carriage returns around it, unless
nothing is left) is hashed to ``LANES`` numbers of 16 bits; a document's
fingerprint is their sum, lane by lane, modulo 2**16.  So documents with the same
paragraphs in any order have the same fingerprint, a repeated paragraph counts each
time, and paragraphs can be added and taken out without the rest of the text.

The lanes are SHA-256 in counter mode over the paragraph's own SHA-256.  Where texts
may be made to collide on purpose, take 1,024 lanes.

Nulls and empties: a null or empty text has no paragraphs and the zero vector; a
null id passes through; repeated rows give repeated rows.  Other columns are
ignored.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import small_batches

LANES = 128


def paragraphs(text: str | None) -> list[bytes]:
    return [q.encode() for p in (text or "").split("\n") if (q := p.strip(" \t\r"))]


def lanes_of(parts: list[bytes], lanes: int = LANES) -> np.ndarray:
    """One row of ``lanes`` numbers for each paragraph."""
    out = bytearray()
    for p in parts:
        seed = sha256(p).hexdigest().encode()
        for i in range(lanes // 16):
            out += sha256(b"%b:%d" % (seed, i)).digest()
    return np.frombuffer(bytes(out), dtype=">u2").astype(np.uint16).reshape(len(parts), lanes)


def fingerprint(text: str | None, lanes: int = LANES) -> np.ndarray:
    return lanes_of(paragraphs(text), lanes).sum(axis=0, dtype=np.uint16)


def to_hex(v: np.ndarray) -> str:
    return v.astype(">u2").tobytes().hex()


def from_hex(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), dtype=">u2").astype(np.uint16)


def document_fingerprints(docs: DataFrame, lanes: int = LANES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_paragraphs, fingerprint`` (hexadecimal), one row a document."""
    if lanes < 16 or lanes % 16:
        raise ValueError("lanes must be a multiple of 16")
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            prints, counts = [], []
            for text in batch.column(1):
                parts = paragraphs(text.as_py())
                counts.append(len(parts))
                prints.append(to_hex(lanes_of(parts, lanes).sum(axis=0, dtype=np.uint16)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32()), pa.array(prints, pa.string())], names=["doc_id", "n_paragraphs", "fingerprint"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_paragraphs int, fingerprint string")


def revise(prints: DataFrame, changes: DataFrame, lanes: int = LANES) -> DataFrame:
    """Fingerprints after ``changes`` (``doc_id, paragraph, sign``) without the texts.

    ``sign`` 1 inserts the paragraph, -1 deletes it.  Ids that only ``changes`` has
    start from nothing.  A null paragraph or sign changes nothing.
    """
    kind = prints.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for old, added in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                v = from_hex(old) if old else np.zeros(lanes, np.uint16)
                for c in added or ():
                    parts = paragraphs((c["paragraph"] or "").replace("\n", " "))
                    if parts and c["sign"]:
                        v = v + lanes_of(parts, lanes)[0] * np.uint16(c["sign"] & 0xFFFF)
                out.append(to_hex(v))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    by = changes.groupBy("doc_id").agg(F.collect_list(F.struct("paragraph", F.col("sign").cast("int").alias("sign"))).alias("added"))
    return prints.select("doc_id", "fingerprint").join(by, "doc_id", "full").select("doc_id", "fingerprint", "added").mapInArrow(run, f"doc_id {kind}, fingerprint string")


SQL = f"""
WITH p AS (
  SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS p FROM documents
), u AS (
  SELECT doc_id, sha256(q) AS seed FROM (SELECT doc_id, unnest(p) AS q FROM p)
), b AS (
  SELECT doc_id, i, sha256(seed || ':' || i) AS hash FROM u, range({LANES // 16}) r(i)
), l AS (
  SELECT doc_id, i * 16 + j AS lane, sum(('0x' || substr(hash, j * 4 + 1, 4))::BIGINT) % 65536 AS v FROM b, range(16) s(j) GROUP BY 1, 2
), f AS (
  SELECT doc_id, string_agg(format('{{:04x}}', v::BIGINT), '' ORDER BY lane) AS f FROM l GROUP BY 1
)
SELECT p.doc_id, len(p.p)::INT AS n_paragraphs, coalesce(f.f, repeat('0', {LANES * 4})) AS fingerprint FROM p LEFT JOIN f USING (doc_id)
"""
