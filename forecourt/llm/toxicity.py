"""Severity of toxic language by cumulative-link ordinal regression on sparse text features.

Grades 0 to 3 share one weight per feature; ordered thresholds cut the common score, so
P(grade > k) = sigmoid(w.x - threshold_k), and the expected severity is the sum of these over k.
Features are the words and word beginnings and endings that tell labelled toxic documents from clean ones, valued by
their rate; beginnings and endings let forms of a word count that no label has shown.

Only the fit is bounded, by ``PER_CLASS`` labelled documents of either kind (those with the
smallest hash of their key) and ``FEATURES`` features. Every document is scored over its whole text.
Labels say toxic or not; the grade of a toxic training document follows from its share of marked words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.llm.common import as_text, written

#: Labelled documents of each kind that the fit sees at most.
PER_CLASS = 4000
#: Features kept at most; toxic documents that each must come from, and their share of all toxic ones seen.
FEATURES = 4096
MIN_DOCS = 3
MIN_SHARE = 0.01
#: Words with a feature from which a document has any: one alone may be chance.
MIN_MARKED = 2
#: Logarithm of the odds, toxic to clean, from which something is a feature.
MIN_ODDS = 3.0
#: Shares of marked words from which a toxic document has grade 2 and 3.
GRADE_EDGES = (0.02, 0.06)
#: Expected severity from which a document counts as toxic.
TOXIC = 0.5
#: Weight of the squared weights in the fit.
PENALTY = 1e-4
_CACHE = 500_000

_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    """The word, its beginnings of three to eight letters and its endings of three to five."""
    n = len(word)
    return [word, *(word[:k] + "*" for k in range(3, 9) if k < n), *("*" + word[-k:] for k in (3, 4, 5) if k < n)]


@dataclass
class OrdinalModel:
    features: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    known: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def vector(self, text: str) -> tuple[list[int], list[float], float]:
        """Columns and values of a text's features, and its share of marked words; nothing if only one word is marked."""
        words = _WORD.findall(text.lower())
        if len(self.known) > _CACHE:
            self.known.clear()
        hits = [self.known[w] if w in self.known else self._look_up(w) for w in words]
        marked = [x for x in hits if x]
        if len(marked) < MIN_MARKED:
            return [], [], 0.0
        counts = sorted(Counter([i for x in marked for i in x]).items())
        return [i for i, _ in counts], [float(np.log1p(1000.0 * n / len(words))) for _, n in counts], len(marked) / len(words)

    def _look_up(self, word: str) -> tuple[int, ...]:
        found = self.known[word] = tuple(self.features[f] for f in features_of(word) if f in self.features)
        return found

    def severity(self, text: str) -> float:
        """Expected grade; 0 without a fitted model."""
        if not len(self.thresholds):
            return 0.0
        columns, values, _ = self.vector(text)
        score = sum(self.weights[i] * v for i, v in zip(columns, values))
        return float((1 / (1 + np.exp(np.clip(self.thresholds - score, -500, 500)))).sum())


def fit_ordinal(rows: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, size: int, levels: int = 4,
                penalty: float = PENALTY, rounds: int = 600, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by full-batch Adam on the penalised likelihood; classes weigh the same."""
    lengths = np.array([len(x) for x in rows])
    row, col = np.repeat(np.arange(len(rows)), lengths), np.concatenate(rows).astype(np.int64)
    val = np.concatenate(values)
    share = np.bincount(grades, minlength=levels).astype(float)
    cost = (1 / np.maximum(share, 1))[grades]
    cost /= cost.sum()
    # the parameters: weights, the first threshold, logarithms of the steps to the next
    theta = np.concatenate((np.zeros(size), [1.0], np.zeros(levels - 2)))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for step in range(1, rounds + 1):
        w, gaps = theta[:size], np.exp(theta[size + 1:])
        cuts = theta[size] + np.concatenate(([0.0], np.cumsum(gaps)))
        score = np.bincount(row, val * w[col], minlength=len(rows))
        edges = np.concatenate(([-np.inf], cuts, [np.inf]))
        high, low = sigmoid(edges[grades + 1] - score), sigmoid(edges[grades] - score)
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = cost * high * (1 - high) / p, cost * low * (1 - low) / p
        by_cut = np.bincount(grades + 1, -d_high, minlength=levels + 1) + np.bincount(grades, d_low, minlength=levels + 1)
        by_cut = by_cut[1:levels]
        grad = np.concatenate((np.bincount(col, val * (d_high - d_low)[row], minlength=size) + penalty * w,
                               [by_cut.sum()], gaps * by_cut[::-1].cumsum()[::-1][1:]))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return theta[:size], theta[size] + np.concatenate(([0.0], np.cumsum(np.exp(theta[size + 1:]))))


def _labelled(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, per_class: int) -> DataFrame:
    """``key, body, toxic`` of at most ``per_class`` documents of either kind, one row per key."""
    kinds = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("toxic")).dropna()
    kinds = kinds.groupBy("key").agg(F.max("toxic").alias("toxic")).withColumn("lot", F.xxhash64("key"))
    there = docs.select(F.col(key).alias("key")).distinct().join(kinds, "key")
    some = [there.where(F.col("toxic") == t).orderBy("lot", "key").limit(per_class) for t in (0, 1)]
    chosen = some[0].unionByName(some[1]).select("key", "toxic")
    bodies = docs.select(F.col(key).alias("key"), as_text(F.col(text)).alias("body")).join(F.broadcast(chosen), "key")
    bodies = bodies.groupBy("key", "toxic").agg(F.min("body").alias("body"))

    @F.pandas_udf("long")
    def signature(texts: pd.Series) -> pd.Series:
        return pd.Series([family(t) for t in texts], dtype="int64")

    one = bodies.groupBy("toxic", signature("body").alias("family")).agg(F.min(F.struct("key", "body")).alias("x"))
    return written(one.select("x.key", "x.body", "toxic"), "labelled")


def family(text: str) -> int:
    """The smallest hash of three words in a row: near copies mostly share it, so that a text seen often counts once."""
    words = text.lower().split()
    shingles = (" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2)))
    return min(xxhash.xxh64_intdigest(x.encode("utf-8")) for x in shingles) >> 1


def _document_counts(rows: DataFrame, only: set[str] | None = None) -> DataFrame:
    """``feature, docs``: in how many of the rows each feature occurs; batches add up first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total = Counter()
            for body in batch["body"]:
                found = {f for w in set(_WORD.findall(body.lower())) for f in features_of(w)}
                total.update(found if only is None else found & only)
            yield pd.DataFrame({"feature": list(total), "n": list(total.values())}, columns=["feature", "n"])

    counted = rows.select("body").mapInPandas(count, "feature string, n long")
    return counted.groupBy("feature").agg(F.sum("n").alias("docs"))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic",
        per_class: int = PER_CLASS, features: int = FEATURES, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> OrdinalModel:
    """A model from the labelled documents of ``docs``; without toxic or clean ones, a model that rates all 0.

    Null keys and labels are left out; of several labels for one key the highest counts, of several texts the smallest.
    """
    sample = _labelled(docs, labels, text, key, label, per_class)
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return OrdinalModel()
    # features of the bounded sample; each stands for min_docs documents of it at least
    toxic = {r["feature"]: r["docs"] for r in _document_counts(sample.where("toxic = 1")).where(F.col("docs") >= max(min(min_docs, n_toxic), min_share * n_toxic)).collect()}
    clean = {r["feature"]: r["docs"] for r in _document_counts(sample.where("toxic = 0"), set(toxic)).collect()}
    odds = {f: np.log((n + 0.5) / (n_toxic + 1)) - np.log((clean.get(f, 0) + 0.5) / (n_clean + 1)) for f, n in toxic.items()}
    ranked = sorted((f for f in toxic if odds[f] >= MIN_ODDS), key=lambda f: (-toxic[f] * odds[f], f))[:features]
    if not ranked:
        return OrdinalModel()
    model = OrdinalModel({f: i for i, f in enumerate(ranked)})

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [model.vector(body) for body in batch["body"]]
            yield pd.DataFrame({"key": batch["key"].astype(str), "toxic": batch["toxic"], "columns": [c for c, _, _ in found],
                                "vals": [v for _, v, _ in found], "share": [s for _, _, s in found]})

    rows = sample.mapInPandas(vectors, "key string, toxic int, columns array<int>, vals array<double>, share double").toPandas()
    rows = rows.sort_values("key", kind="stable")
    grades = np.where(rows["toxic"] == 1, 1 + sum((rows["share"] >= e).astype(int) for e in GRADE_EDGES), 0)
    model.weights, model.thresholds = fit_ordinal(list(rows["columns"]), list(rows["vals"]), grades, len(ranked), 2 + len(GRADE_EDGES))
    return model


def score(docs: DataFrame, model: OrdinalModel, text: str = "text", toxic: float = TOXIC) -> DataFrame:
    """``row`` (all input columns) with ``severity`` (expected grade), ``grade`` (rounded) and ``toxic``.

    Null and empty texts have severity 0. Rows are independent, so ties, repeated rows, empty
    tables and clashing names need no care.
    """

    @F.pandas_udf("double")
    def severity(texts: pd.Series) -> pd.Series:
        return pd.Series([model.severity(t) for t in texts], dtype="float64")

    seen = docs.select(F.struct("*").alias("row"))
    seen = seen.withColumn("severity", severity(as_text(F.col("row").getField(text))))
    return seen.select("row", "severity", F.round("severity").cast("int").alias("grade"), (F.col("severity") >= toxic).alias("toxic"))
