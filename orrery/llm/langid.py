"""Language ID by error-correcting output codes.

Each language has a codeword of bits; for each bit a linear classifier over hashed
byte n-grams says on which side a text is.  A text's language is the one whose
codeword has the least logistic loss against the classifiers' margins, so a few
wrong bits do no harm.  A text is *ambiguous* when the second best codeword is
nearly as good.

The languages are those of all labelled rows.  The classifiers are fitted on at most
``sample`` of the rows, read whole: of each language those of the lowest hashes, as
many as go with the square root of its rows and one at least (so one of each, should
there be more languages than ``sample``).  In the fit a language weighs as that root
at any size of the corpus.  Scoring reads every text whole.

Nulls, empties and ties: rows without label or text are not fitted on; a null,
empty or letterless text gets a null language and is rejected; equal losses go to
the language that comes first by name; a null id passes through; repeated rows
give repeated rows.  With a single labelled language all texts with letters get it.
Without any labelled row there is no model: languages stay null (in
``keep_identified``: as they are), all rows are ambiguous, and only texts without
letters are rejected.  Other columns are ignored, or kept by ``keep_identified``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.llm import textops
from orrery.llm.common import small_batches

#: Labelled rows that the classifiers are fitted on, at most (but one of each language).
SAMPLE = 3000
BINS = 4096
#: Ambiguous: the gap of the two best mean losses is below this.  Such texts, mixed of two
#: languages as a rule, are rejected.
GAP = 0.05
STEPS, RATE = 120, 8.0

_LETTER = np.zeros(256, dtype=np.uint64)
for _b in range(256):
    if _b >= 128 or chr(_b).isalpha():
        _LETTER[_b] = ord(chr(_b).lower()) if _b < 128 else _b


def features(column: pa.Array):
    """Slices ``(i, j, counts)``: hashed 1- to 3-grams of letters, words marked off."""
    raw, bounds = textops.buffers(column)
    for i, j in textops.slices(bounds):
        for a in range(i, j, 256):
            b = min(a + 256, j)
            counts = np.zeros((b - a) * BINS, dtype=np.int64)
            # A slice of one long text goes piece by piece; pieces overlap by a gram.
            for lo in range(int(bounds[a]), max(int(bounds[b]), int(bounds[a]) + 1), textops.SLICE_BYTES):
                hi = min(lo + textops.SLICE_BYTES, int(bounds[b]))
                back = min(2, lo - int(bounds[a])) if lo > bounds[a] else 0
                x = _LETTER[raw[lo - back : hi]]
                row = np.searchsorted(bounds[a : b + 1], np.arange(lo - back, hi), side="right") - 1
                code = x + np.uint64(1)
                for n in (1, 2, 3):
                    m = len(x) - n + 1
                    if m <= 0:
                        break
                    g = code[:m].copy()
                    ok = (x[:m] != 0) | (x[n - 1 : n - 1 + m] != 0)
                    for k in range(1, n):
                        g = g * np.uint64(257) + code[k : k + m]
                    if n == 3:
                        ok = x[1 : m + 1] != 0
                    ok = ok & (row[:m] == row[n - 1 : n - 1 + m])
                    ok[: max(0, back - n + 1)] = False  # counted in the piece before
                    bin_ = (textops.mix(g + np.uint64(n << 40)) >> np.uint64(52)).astype(np.int64)
                    counts += np.bincount(row[:m][ok] * BINS + bin_[ok], minlength=len(counts))
            yield a, b, counts.reshape(b - a, BINS)


def _scaled(counts: np.ndarray) -> np.ndarray:
    x = np.log1p(counts.astype(np.float32))
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def codewords(n: int) -> np.ndarray:
    """The exhaustive code for up to five languages, else a fixed random one of 4 bits a language."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 5:
        bits = [[1 if (c >> k) & 1 else -1 for c in range(2 ** (n - 1) - 1)] for k in range(n - 1)]
        return np.array([[1] * (2 ** (n - 1) - 1), *bits], dtype=float)
    rng = np.random.default_rng(7)
    while True:
        code = rng.choice([-1.0, 1.0], size=(n, 4 * n))
        if (np.abs(code.sum(axis=0)) < n).all() and len(np.unique(code, axis=0)) == n:
            return code


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def margins(self, counts: np.ndarray) -> np.ndarray:
        return _scaled(counts) @ self.weights + self.bias

    def losses(self, counts: np.ndarray) -> np.ndarray:
        """Mean logistic loss of each language's codeword."""
        m = self.margins(counts)
        return np.logaddexp(0, -m[:, None, :] * self.code[None]).mean(axis=2)


def quotas(counts: np.ndarray, sample: int) -> np.ndarray:
    """Rows of each language to fit on: all, or by the square root of their number."""
    if counts.sum() <= sample:
        return counts
    of = lambda t: np.minimum(counts, np.maximum(1, (t * np.sqrt(counts)).astype(np.int64)))
    low, high = 0.0, float(sample)
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if of(mid).sum() <= sample else (low, mid)
    return of(low)


def _training(docs: DataFrame, sample: int, label_col: str, id_col: str, text_col: str) -> tuple[pa.Table, dict[str, int]]:
    """``y, t, h`` of the rows to fit on, and the number of labelled rows of each language."""
    rows = docs.filter(F.col(label_col).isNotNull() & (F.length(text_col) > 0))
    rows = rows.select(F.col(label_col).cast("string").alias("y"), F.col(text_col).alias("t"), F.xxhash64(id_col, text_col).bitwiseAND(F.lit((1 << 62) - 1)).alias("h"))
    found = rows.groupBy("y").agg(F.count("*").alias("n"), F.min("h").alias("least")).orderBy("y").collect()
    counts = np.array([r.n for r in found], dtype=np.int64)
    quota = quotas(counts, sample)
    if counts.sum() > sample:
        # A share of the hashes that holds the quota by far and the lowest hash surely; few texts move.
        bars = [max(r.least, min(1 << 62, int((q + 6 * q**0.5 + 20) / r.n * (1 << 62)))) for r, q in zip(found, quota.tolist(), strict=True)]
        of = lambda values: F.element_at(F.create_map(*[F.lit(x) for r, v in zip(found, values, strict=True) for x in (r.y, v)]), F.col("y"))
        rows = rows.filter(F.col("h") <= of(bars))
        rows = rows.withColumn("k", F.row_number().over(W.partitionBy("y").orderBy("h"))).filter(F.col("k") <= of(quota.tolist())).drop("k")
    return rows.toArrow().sort_by([("y", "ascending"), ("h", "ascending")]), {r.y: r.n for r in found}


def fit(docs: DataFrame, sample: int = SAMPLE, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    part, counts = _training(docs, sample, label_col, id_col, text_col)
    if part.num_rows == 0:
        return None
    texts = part["t"].combine_chunks()
    labels = np.array(part["y"].to_pylist(), dtype=object).astype(str)
    x = np.concatenate([_scaled(c) for _, _, c in features(texts)])
    languages, place, rows = np.unique(labels, return_inverse=True, return_counts=True)
    languages = languages.tolist()
    weight = (np.sqrt([counts[x] for x in languages]) / rows)[place].astype(np.float32)[:, None]
    weight /= weight.mean()
    code = codewords(len(languages)).astype(np.float32)
    y = code[np.searchsorted(np.array(languages), labels)]
    w, b = np.zeros((BINS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    if len(languages) > 1:
        for _ in range(STEPS):
            pull = weight * y / (1 + np.exp(y * (x @ w + b)))
            w += RATE * (x.T @ pull) / len(x) * 8
            b += 0.5 * pull.mean(axis=0)
    else:
        b += 10
    return Model(languages, code, w, b)


def identify(docs: DataFrame, model: Model | None = None, gap: float = GAP, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``doc_id, language, gap, ambiguous, rejected``, one row a document.

    Rejected are texts without letters and, where there is a model, ambiguous ones.
    """
    model = model or fit(docs, id_col=id_col, text_col=text_col, **how)
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for i, j, counts in features(batch.column(1)):
                best, apart, blank = _decide(m, counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([None if z or m is None else m.languages[k] for k, z in zip(best, blank, strict=True)], pa.string()), pa.array(np.where(blank, 0.0, apart)), pa.array(blank | (apart < gap) | (m is None)), pa.array(blank | (apart < gap))],
                    names=["doc_id", "language", "gap", "ambiguous", "rejected"],
                )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, language string, gap double, ambiguous boolean, rejected boolean")


def _decide(m: Model | None, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if m is None:
        return np.zeros(len(counts), np.int64), np.ones(len(counts)), counts.sum(axis=1) == 0
    loss = m.losses(counts)
    best = np.argmin(loss, axis=1)
    order = np.sort(loss, axis=1)
    apart = (order[:, 1] - order[:, 0] if loss.shape[1] > 1 else np.ones(len(loss))).astype(np.float64)
    return best, apart, counts.sum(axis=1) == 0


def keep_identified(docs: DataFrame, model: Model | None = None, gap: float = GAP, **how) -> DataFrame:
    """``docs`` without rejected texts, ``lang`` set to the language found."""
    small_batches(docs.sparkSession)
    model = model or fit(docs, **how)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            at, lang = batch.schema.get_field_index("text"), batch.schema.get_field_index("lang")
            for i, j, counts in features(batch.column(at)):
                best, apart, blank = _decide(m, counts)
                part = batch.slice(i, j - i)
                columns = [pa.array([m.languages[k] for k in best], pa.string()) if c == lang and m else part.column(c) for c in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names).filter(pa.array(~(blank | (apart < gap))))

    return docs.mapInArrow(run, docs.schema)
