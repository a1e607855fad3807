"""Severity of toxic documents by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector for all thresholds, thresholds ascending. x says which
words and word beginnings a text has (hashed, 0 or 1). The model is fitted on a bounded sample of labelled documents
(``sample``, drawn by the hash of doc_id); every document is scored over its whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, saved

_WORD = re.compile(r"\w+")
#: Number of hashed features, and the beginnings of words that count as features.
FEATURES, BEGINNINGS = 1 << 18, (3, 4, 5, 6, 8)
_MEMO = 300_000


class _WordFeatures(dict):
    """word -> its features, restricted to those in ``chosen`` (None: all)."""

    def __init__(self, chosen: dict[int, int] | None):
        super().__init__()
        self.chosen = chosen

    def __missing__(self, word: str) -> tuple[int, ...]:
        names = [word, *[word[:n] + "*" for n in BEGINNINGS if len(word) > n]]
        ids = (xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) % FEATURES for x in names)
        found = tuple(ids) if self.chosen is None else tuple(self.chosen[i] for i in ids if i in self.chosen)
        if len(self) >= _MEMO:
            self.clear()
        self[word] = found
        return found

    def of(self, text: str) -> list[int]:
        out: set[int] = set()
        for word in set(_WORD.findall(text.lower())):
            if found := self[word]:
                out.update(found)
        return sorted(out)


@dataclass(frozen=True)
class OrdinalModel:
    features: np.ndarray  # hashed features that have a weight
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_features: int, n_grades: int, steps: int = 300, ridge: float = 3e-5, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of greatest likelihood (Adam on the whole sample)."""
    n = len(rows)
    col = np.concatenate(rows).astype(np.int64) if n else np.empty(0, np.int64)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    k = n_grades - 1
    par = np.concatenate((np.zeros(n_features), [1.0], np.zeros(k - 1)))  # weights, first threshold, log gaps
    m, v = np.zeros_like(par), np.zeros_like(par)
    at = np.arange(n)
    for step in range(1, steps + 1):
        gaps = np.exp(par[n_features + 1 :])
        cut = par[n_features] + np.concatenate(([0.0], np.cumsum(gaps)))
        score = np.bincount(row, par[col], n)
        low = 1 / (1 + np.exp(-np.clip(cut[None, :] - score[:, None], -30, 30)))  # P(grade <= k)
        cum = np.hstack([np.zeros((n, 1)), low, np.ones((n, 1))])
        p = np.maximum(cum[at, grades + 1] - cum[at, grades], 1e-12)
        slope = low * (1 - low)
        by_cut = np.zeros((n, k))
        up = grades < k
        by_cut[at[up], grades[up]] += slope[at[up], grades[up]]
        down = grades > 0
        by_cut[at[down], grades[down] - 1] -= slope[at[down], grades[down] - 1]
        by_cut /= p[:, None]  # d log p / d cut
        g = np.empty_like(par)
        g[:n_features] = np.bincount(col, by_cut.sum(axis=1)[row], n_features) / n + ridge * par[:n_features]
        to_cut = -by_cut.mean(axis=0)
        g[n_features] = to_cut.sum()
        g[n_features + 1 :] = np.cumsum(to_cut[::-1])[::-1][1:] * gaps
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        par -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return par[:n_features], par[n_features] + np.concatenate(([0.0], np.cumsum(np.exp(par[n_features + 1 :]))))


def _featurer(chosen: dict[int, int] | None):
    def make():
        words = _WordFeatures(chosen)

        def f(batch):
            return {"grade": batch.column("grade"), "x": [words.of(t) for t in batch.column("text").to_pylist()]}

        return f

    return make


def grades_of(labels: DataFrame) -> DataFrame:
    """doc_id and grade (0, 1) of labelled documents: toxic if any of its labels says so; null labels and ids count for nothing."""
    return labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("grade"))


def fit_severity(docs: DataFrame, graded: DataFrame, sample: int = 20_000, least_z: float = 4.0, least_docs: int = 3) -> OrdinalModel | None:
    """Fit on at most ``sample`` rows of graded(doc_id, grade); None if they do not hold both grade 0 and others.

    Features are those whose share of graded documents departs from the base rate by ``least_z`` standard deviations. Where
    the grades only say yes or no, the yes half with more features that lean that way than the median becomes grade 2.
    """
    some = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "graded_id")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), F.col("doc_id") == F.col("graded_id")).select("grade", "text")
    drawn = saved(own, "graded")  # bounded by the sample
    totals = drawn.agg(F.count("*").alias("n"), F.count(F.when(F.col("grade") > 0, 1)).alias("bad")).first()
    if not totals["bad"] or totals["bad"] == totals["n"]:
        return None
    share = totals["bad"] / totals["n"]
    seen = arrow_pass(drawn, _featurer(None), "grade int, x array<int>", rows=50).select("grade", F.explode("x").alias("f")).groupBy("f").agg(F.count("*").alias("docs"), F.count(F.when(F.col("grade") > 0, 1)).alias("bad"))
    z = (F.col("bad") - F.col("docs") * share) / F.sqrt(F.col("docs") * (share * (1 - share)))
    strong = sorted((r["f"], r["z"] > 0) for r in seen.where(F.col("docs") >= least_docs).select("f", z.alias("z")).where(F.abs("z") >= least_z).collect())  # at most FEATURES
    chosen, leans = np.array([f for f, _ in strong], np.int64), np.array([up for _, up in strong], bool)
    rows = arrow_pass(drawn, _featurer({int(x): i for i, x in enumerate(chosen)}), "grade int, x array<int>", rows=50).collect()  # at most ``sample``
    rows.sort(key=lambda r: (r["grade"], r["x"]))
    x, grades = [np.array(r["x"], np.int64) for r in rows], np.array([r["grade"] for r in rows])
    if grades.max() == 1:
        signs = np.array([leans[i].sum() for i in x])
        grades = grades * (1 + (signs > np.median(signs[grades > 0])))
    return OrdinalModel(chosen, *fit_ordinal(x, grades, len(chosen), int(grades.max()) + 1))


def _scorer(model: OrdinalModel | None, reject: float, column: str):
    def make():
        words = _WordFeatures({int(x): i for i, x in enumerate(model.features)}) if model else None

        def f(batch):
            texts = [t or "" for t in batch.column(column).to_pylist()]
            if model is None:
                above = np.zeros((len(texts), 1))
            else:
                above = model.above(np.array([model.weights[words.of(t)].sum() for t in texts]))
            grade = (above > 0.5).sum(axis=1)
            own = {n: batch.column(n) for n in batch.schema.names}
            return own | {"severity": above.sum(axis=1), "grade": grade.astype(np.int32), "toxic": above[:, 0] >= reject}

        return f

    return make


def score_severity(docs: DataFrame, model: OrdinalModel | None, reject: float = 0.35) -> DataFrame:
    """docs with severity (expected grade), grade (median grade) and toxic (P(grade >= 1) is at least ``reject``).

    Columns of these names are replaced. Null and empty texts have no features and take the model's base rate; without a
    model (no labels of both kinds) nothing is toxic. Rows that repeat each get their row.
    """
    kept = docs.select([F.col(f"`{c}`") for c in docs.columns if c not in ("severity", "grade", "toxic")])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return arrow_pass(kept, _scorer(model, reject, "text"), f"{schema}, severity double, grade int, toxic boolean")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 20_000, reject: float = 0.35) -> DataFrame:
    """score_severity() of docs under a model fitted on their labelled rows."""
    return score_severity(docs, fit_severity(docs, grades_of(labels), sample), reject)
