"""Corpus features, quality metrics, the tuner, meta-models and feedback."""

from __future__ import annotations

import itertools
import json
import math
import os
import time
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import vectors as V
from orrery.operators import knn, sums
from orrery.sources.tables import once

# Features --------------------------------------------------------------------------


def _pair_mean(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean cosine of all pairs within each group, from the groups' vector sums."""
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("_u"))).alias("s"), F.sum(F.when(F.col("_n") > 0, 1.0).otherwise(0.0)).alias("q"))
    pairs = (V.dot("s", "s") - F.col("q")) / 2
    return g.select(*by, pairs.alias("sum"), (F.col("n") * (F.col("n") - 1) / 2).alias("pairs"), "n")


#: The features that a corpus is compared by, in order.
FEATURES = ["n_items", "n_categories", "dim", "mean_members", "category_entropy", "sparsity", "axis_entropy", "noise", "intra_cosine", "inter_cosine"]


def corpus_features(corpus: DataFrame, threshold: float = 0.05) -> DataFrame:
    """One row that describes a corpus: sizes, balance, use of the axes, noise, cohesion.

    ``sparsity`` is the share of active entries, those beyond ``threshold``;
    ``axis_entropy`` how evenly the axes are active, ``noise`` the mean over the rows
    of the upper median of their inactive entries.
    """
    rows = corpus.select("category", "embedding", V.norm("embedding").alias("_n"))
    rows = rows.withColumn("_u", F.transform("embedding", lambda x: F.when(F.col("_n") > 0, x.cast("double") / F.col("_n")).otherwise(0.0)))
    inside = _pair_mean(rows, ["category"])
    share = F.col("n") / F.sum("n").over(W.partitionBy())
    balance = inside.withColumn("p", share).agg(F.count("*").alias("n_categories"), F.sum("n").alias("n_items"), F.max("n").alias("largest"), F.min("n").alias("smallest"), F.sum(-F.col("p") * F.log("p")).alias("h"), F.sum("sum").alias("si"), F.sum("pairs").alias("pi"))
    every = _pair_mean(rows.withColumn("_all", F.lit(0)), ["_all"]).select(F.col("sum").alias("sa"), F.col("pairs").alias("pa"))
    quiet = F.array_sort(F.filter(F.transform("embedding", lambda x: F.abs(x.cast("double"))), lambda x: x <= threshold))
    rows = corpus.select("embedding", quiet.alias("_q"))
    active = rows.agg(F.first(F.size("embedding")).alias("dim"), F.avg(1 - F.size("_q") / F.size("embedding")).alias("sparsity"), F.coalesce(F.avg(F.when(F.size("_q") > 0, F.element_at("_q", (F.floor(F.size("_q") / 2) + 1).cast("int")))), F.lit(0.0)).alias("noise"))
    used = rows.select(F.explode(V.active_axes("embedding", threshold)).alias("axis")).groupBy("axis").agg(F.count("*").alias("c"))
    used = used.withColumn("p", F.col("c") / F.sum("c").over(W.partitionBy())).agg(F.coalesce(F.sum(-F.col("p") * F.log("p")), F.lit(0.0)).alias("ha"))
    out = balance.crossJoin(every).crossJoin(active).crossJoin(used)
    intra = F.when(F.col("pi") > 0, F.col("si") / F.col("pi")).otherwise(0.0)
    inter = F.when(F.col("pa") > F.col("pi"), (F.col("sa") - F.col("si")) / (F.col("pa") - F.col("pi"))).otherwise(0.0)
    return out.select(
        "n_items", "n_categories", "dim", (F.col("n_items") / F.col("n_categories")).alias("mean_members"), "largest", "smallest",
        F.when(F.col("n_categories") > 1, F.col("h") / F.log("n_categories")).otherwise(0.0).alias("category_entropy"), "sparsity",
        F.when(F.col("dim") > 1, F.col("ha") / F.log("dim")).otherwise(0.0).alias("axis_entropy"), "noise", intra.alias("intra_cosine"), inter.alias("inter_cosine"),
        (intra / F.greatest(F.abs(inter), F.lit(1e-12))).alias("separation"),
    )


def feature_vector(features: DataFrame) -> list[float]:
    """The features of ``corpus_features`` by which corpora are compared; the ratio is not among them."""
    row = features.first()
    return [float(row[f]) for f in FEATURES]


# Quality ---------------------------------------------------------------------------


def modularity(points: DataFrame, k: int = 15) -> DataFrame:
    """Modularity of the categories on the k-NN graph, one row, clamped to [0, 1]."""
    label = points.select("ordinal", "category")
    e = once(knn.neighbour_edges(points, k).select("src", "dst"), "graph").join(label.select(F.col("ordinal").alias("src"), F.col("category").alias("ca")), "src").join(label.select(F.col("ordinal").alias("dst"), F.col("category").alias("cb")), "dst")
    m = e.agg(F.count("*").alias("m"))
    inner = e.filter("ca = cb").groupBy(F.col("ca").alias("category")).agg(F.count("*").alias("inside"))
    degree = e.select(F.explode(F.array("ca", "cb")).alias("category")).groupBy("category").agg(F.count("*").alias("degree"))
    per = degree.join(inner, "category", "left").fillna(0, ["inside"]).crossJoin(m)
    q = F.sum(F.col("inside") / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), 2))
    return per.agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(q, F.lit(0.0)))).alias("modularity"))


def category_silhouette(points: DataFrame) -> DataFrame:
    """(mean silhouette + 1) / 2 over categories of at least two, by angular distance; 1 where nothing can be scored."""
    per = sums.own_and_next(points, "category").filter("a is not null and b is not null")
    s = (F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(2.220446049250313e-16))
    return per.agg(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.avg(s) + 1) / 2)), F.lit(1.0)).alias("silhouette"))


def territorial_health(exclusivity: DataFrame) -> DataFrame:
    return exclusivity.agg(F.avg("exclusivity").alias("territorial_health"))


def bridge_coherence(found: DataFrame) -> DataFrame:
    """The part of the bridges that is genuine; 0 without bridges."""
    return found.agg(F.coalesce(F.avg(F.when(F.col("kind") == "genuine", 1.0).otherwise(0.0)), F.lit(0.0)).alias("bridge_coherence"))


@dataclass(frozen=True)
class Composite:
    """A weighted mean of metrics; weights of 0 and less drop out."""

    parts: tuple[tuple[str, float, Callable], ...]

    def components(self, built) -> list[tuple[str, float]]:
        return [(name, float(f(built))) for name, w, f in self.parts if w > 0]

    def __call__(self, built) -> float:
        total = sum(w for _, w, _ in self.parts if w > 0)
        return sum(w * float(f(built)) for _, w, f in self.parts if w > 0) / total if total else 0.0


def default_composite() -> Composite:
    """Of an engine: bridges that are genuine 0.40, territory of one's own 0.35, silhouette 0.25."""
    return Composite((("bridge_coherence", 0.40, lambda e: bridge_coherence(e.bridges).first()[0]), ("territorial_health", 0.35, _health), ("cluster_silhouette", 0.25, lambda e: category_silhouette(e.points).first()[0])))


def connectivity_composite() -> Composite:
    """Of an engine: modularity of the neighbour graph 0.50, genuine bridges 0.30, territory 0.20."""
    return Composite((("graph_modularity", 0.50, lambda e: modularity(e.points).first()[0]), ("bridge_coherence", 0.30, lambda e: bridge_coherence(e.bridges).first()[0]), ("territorial_health", 0.20, _health)))


def _health(engine) -> float:
    return sum(engine.exclusivity.values()) / max(1, len(engine.exclusivity))


# Tuning ----------------------------------------------------------------------------


class AllTrialsFailed(RuntimeError):
    """No configuration could be built."""


@dataclass
class Trial:
    number: int
    config: dict
    score: float | None
    error: str | None = None


@dataclass
class TuneReport:
    trials: list[Trial] = field(default_factory=list)

    @property
    def best(self) -> Trial:
        """The highest score, of equals the last."""
        return max((t for t in self.trials if t.score is not None), key=lambda t: (t.score, t.number))

    @property
    def failures(self) -> list[Trial]:
        return [t for t in self.trials if t.error]

    @property
    def mean_score(self) -> float:
        scores = [t.score for t in self.trials if t.score is not None]
        return sum(scores) / len(scores) if scores else 0.0

    def ranked(self) -> list[Trial]:
        return sorted((t for t in self.trials if t.score is not None), key=lambda t: (-t.score, t.number))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t.number, json.dumps(t.config, sort_keys=True), t.score, t.error) for t in self.trials], "number int, config string, score double, error string")


#: Knobs that only one projection uses; other projections are tried without them.
KIND_KNOBS = {"k": "laplacian", "threshold": "laplacian", "sigma": "kernel_pca"}


def _used(space: dict[str, list], kind: str | None) -> list[str]:
    return sorted(n for n in space if kind is None or KIND_KNOBS.get(n, kind) == kind)


def grid(space: dict[str, list]) -> Iterable[dict]:
    """All configurations; the knobs of one projection do not multiply those of the others."""
    for kind in space.get("projection", [None]):
        names = [n for n in _used(space, kind) if n != "projection"]
        for values in itertools.product(*(space[n] for n in names)):
            yield ({} if kind is None else {"projection": kind}) | dict(zip(names, values, strict=True))


def cardinality(space: dict[str, list]) -> int:
    """How many configurations ``grid`` has."""
    return sum(math.prod(len(space[n]) for n in _used(space, kind) if n != "projection") for kind in space.get("projection", [None]))


def _drawn(space: dict[str, list], rng: np.random.Generator) -> dict:
    pick = {k: space[k][int(rng.integers(len(space[k])))] for k in sorted(space)}
    return {k: v for k, v in pick.items() if k in _used(space, pick.get("projection"))}


def draw(space: dict[str, list], n: int, seed: int = 42) -> list[dict]:
    rng = np.random.default_rng(seed)
    return [_drawn(space, rng) for _ in range(n)]


def propose(space: dict[str, list], done: list[Trial], rng: np.random.Generator, gamma: float = 0.25, tries: int = 24) -> dict:
    """The candidate most likely among the good trials against the others."""
    scored = sorted((t for t in done if t.score is not None), key=lambda t: -t.score)
    if len(scored) < 4:
        return _drawn(space, rng)
    cut = max(1, int(gamma * len(scored)))
    good, rest = scored[:cut], scored[cut:]

    def weight(part, k, v):
        return (sum(t.config.get(k, none) == v for t in part) + 1) / (len(part) + len(space[k]))

    best, config, none = -math.inf, None, object()
    for _ in range(tries):
        c = {k: space[k][rng.choice(len(space[k]), p=np.array([weight(good, k, v) for v in space[k]]) / sum(weight(good, k, v) for v in space[k]))] for k in sorted(space)}
        c = {k: v for k, v in c.items() if k in _used(space, c.get("projection"))}
        ratio = sum(math.log(weight(good, k, v) / weight(rest, k, v)) for k, v in c.items())
        if ratio > best:
            best, config = ratio, c
    return config


def auto_tune(build: Callable[[dict], object], metric: Callable[[object], float], space: dict[str, list], strategy: str = "grid", budget: int = 24, seed: int = 42) -> TuneReport:
    """Builds and scores configurations; equal ones are built once, failures are noted."""
    report, seen, rng = TuneReport(), {}, np.random.default_rng(seed)
    todo = list(itertools.islice(grid(space), budget)) if strategy == "grid" else draw(space, budget, seed) if strategy == "random" else [None] * budget
    for i, config in enumerate(todo):
        config = config if config is not None else propose(space, report.trials, rng)
        key = json.dumps(config, sort_keys=True, default=str)
        if key not in seen:
            try:
                seen[key] = (float(metric(build(config))), None)
            except Exception as e:  # a trial may fail for any reason of its own
                seen[key] = (None, f"{type(e).__name__}: {e}")
        report.trials.append(Trial(i, config, *seen[key]))
    if all(t.score is None for t in report.trials):
        raise AllTrialsFailed("; ".join(sorted({t.error for t in report.trials})))
    return report


# Meta-models -----------------------------------------------------------------------


@dataclass
class MetaRecord:
    corpus_id: str
    features: list[float]
    config: dict
    score: float
    timestamp: str = ""
    metric: str = ""
    strategy: str = ""

    @classmethod
    def from_report(cls, corpus_id: str, features: list[float], report: TuneReport, metric: str = "", strategy: str = "") -> MetaRecord:
        """What a search found out, with the present time in seconds."""
        return cls(corpus_id, features, report.best.config, report.best.score, str(int(time.time())), metric, strategy)

    def at(self, timestamp: str) -> MetaRecord:
        return replace(self, timestamp=timestamp)

    def adjusted(self, feedback: float, alpha: float) -> MetaRecord:
        return replace(self, score=(1 - alpha) * self.score + alpha * feedback)


def save_records(records: list, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump([asdict(r) for r in records], f)


def append_records(records: list, path: str) -> None:
    """One JSON object a line; a file that holds an array is rewritten as lines first."""
    old = load_raw(path)
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(json.dumps(r) + "\n" for r in [*old, *(asdict(r) for r in records)])


def load_raw(path: str) -> list[dict]:
    """A JSON array or one object a line; a missing file has nothing."""
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read().strip()
    except FileNotFoundError:
        return []
    return json.loads(text) if text.startswith("[") else [json.loads(x) for x in text.splitlines() if x.strip()]


def load_records(path: str) -> list[MetaRecord]:
    return [MetaRecord(**r) for r in load_raw(path)]


def home(name: str) -> str:
    """The default path of a file of records."""
    return os.path.join(os.environ.get("ORRERY_HOME", os.path.expanduser("~/.orrery")), name)


class MetaModel:
    """Picks a configuration for a corpus by its features' z-scored distance to known ones."""

    def __init__(self, epsilon: float = 0.1) -> None:
        self.epsilon, self.records = epsilon, []

    def fit(self, records: list[MetaRecord]) -> MetaModel:
        if not records:
            raise ValueError("no records")
        x = np.array([r.features for r in records], dtype=float)
        self.records, self.mean, self.sd = records, x.mean(axis=0), x.std(axis=0)
        self.x = self._scaled(x)
        return self

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.where(self.sd > 2.2e-16, (x - self.mean) / np.where(self.sd > 2.2e-16, self.sd, 1), 0.0)

    def distances(self, features) -> np.ndarray:
        return np.linalg.norm(self.x - self._scaled(np.asarray(features, dtype=float)), axis=1)

    def ranked(self, features) -> list[tuple[MetaRecord, float]]:
        d = self.distances(features)
        return [(self.records[i], float(d[i])) for i in np.lexsort((np.arange(len(d)), d))]

    def predict(self, features) -> dict:
        return self.ranked(features)[0][0].config


class WeightedMetaModel(MetaModel):
    """Prefers high scores near by: score / (distance + epsilon)."""

    def ranked(self, features) -> list[tuple[MetaRecord, float]]:
        d = self.distances(features)
        s = np.array([r.score for r in self.records]) / (d + self.epsilon)
        return [(self.records[i], float(s[i])) for i in np.lexsort((np.arange(len(s)), -s))]


@dataclass
class FeedbackEvent:
    """What a user thought of one answer, from 0 to 1."""

    corpus_id: str
    query_id: str
    score: float
    timestamp: str = ""

    @classmethod
    def now(cls, corpus_id: str, query_id: str, score: float) -> FeedbackEvent:
        return cls(corpus_id, query_id, max(0.0, min(1.0, score)), str(int(time.time())))


class FeedbackLog:
    """Events of a file, the last ``most`` of them; kept, summed up and appended to."""

    def __init__(self, path: str, most: int | None = None) -> None:
        self.path, self.most = path, most

    def record(self, event: FeedbackEvent) -> None:
        append_records([event], self.path)

    def events(self, spark: SparkSession) -> DataFrame:
        """``corpus_id, query_id, score, timestamp, seq``, in order of arrival."""
        rows = [(r["corpus_id"], r["query_id"], float(r["score"]), r["timestamp"], i) for i, r in enumerate(load_raw(self.path))]
        return spark.createDataFrame(rows[-self.most :] if self.most else rows, "corpus_id string, query_id string, score double, timestamp string, seq long")

    def summary(self, spark: SparkSession) -> DataFrame:
        return feedback_summary(self.events(spark)).orderBy("corpus_id")


# Feedback --------------------------------------------------------------------------


def feedback_summary(events: DataFrame, window: int | None = None) -> DataFrame:
    """``corpus_id``'s scores, clamped to [0, 1]: count, mean, least, largest.

    ``events`` has ``corpus_id, score`` and, for a window of the last events of each
    corpus, ``seq``.
    """
    if window is not None:
        events = events.withColumn("_k", F.row_number().over(W.partitionBy("corpus_id").orderBy(F.desc("seq")))).filter(F.col("_k") <= window)
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return events.groupBy("corpus_id").agg(F.count("*").alias("events"), F.avg(s).alias("mean"), F.min(s).alias("least"), F.max(s).alias("largest"))


def corpus_ids(events: DataFrame) -> DataFrame:
    """The corpora with feedback, in order."""
    return events.select("corpus_id").distinct().orderBy("corpus_id")
