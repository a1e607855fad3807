"""How good weights and a threshold share are: a whole population of candidates in a few passes over counted score vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import first_row
from .scoring import BELLS

# Shares of separation, detection rate, robustness and diversity in the whole.
PARTS = (0.45, 0.25, 0.20, 0.10)
#: Threshold shares that a search may try, in percent.
LEAST_SHARE, MOST_SHARE = 1.0, 10.0


@dataclass(frozen=True)
class Candidate:
    weights: tuple[float, ...]
    share: float

    @classmethod
    def of(cls, vector: np.ndarray) -> Candidate:
        """From weights, of any scale, and a share."""
        w = np.maximum(vector[:-1], 1e-6)
        return cls(tuple((w / w.sum()).tolist()), float(np.clip(vector[-1], LEAST_SHARE, MOST_SHARE)))


def counted_vectors(ll: DataFrame, scores: list[str]) -> DataFrame:
    """Different score vectors with their number, _rows: all that a search reads."""
    return ll.groupBy(*scores).agg(F.count("*").alias("_rows"))


def diversity(weights: tuple[float, ...]) -> float:
    """Entropy over its maximum, and a tenth more if 3 to 70 % of the weights count; 0 for one weight."""
    w = np.array(weights)
    if len(w) < 2:
        return 0.0
    share = float(-(w * np.log(w + 1e-8)).sum() / np.log(len(w)))
    return min(1.0, share + 0.1) if 3 <= (w > 0.05).sum() <= 0.7 * len(w) else share


def rate_quality(rate: float) -> float:
    return max(top * float(np.exp(-0.5 * ((rate - at) / width) ** 2)) for at, width, top in BELLS)


def separation_quality(d: float) -> float:
    return min(1.0, d / 2 + (0.1 if d > 1.5 else 0.0))


#: Bins of a histogram: each pass narrows a bracket by this factor at least.
_BINS = 1024
_CUTS = "spec int, bin int, n long, low double, high double"
_SUMS = ("n", "n_a", "n_b", "n_c", "hit1", "hit2", "rest1", "rest2")


def _scores(batch: pa.RecordBatch, weights: np.ndarray, places: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Scores (vectors x candidates) and numbers of rows. Terms are added one by one, so a vector's score is the same in every pass."""
    columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
    s = np.zeros((batch.num_rows, len(weights)))
    for k, x in enumerate(columns[:-1]):
        s += x[:, None] * weights[:, k]
    return -s if places is None else np.round(-s, places), columns[-1].astype(np.int64)


def _histograms(weights: np.ndarray, of: list[int], low: np.ndarray, high: np.ndarray, places: int | None):
    """Numbers of rows, least and greatest score in the bins of each bracket: of[i] is the candidate of bracket i."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(of), _BINS), np.int64)
        least, most = np.full(n.shape, np.inf), np.full(n.shape, -np.inf)
        for batch in batches:
            scores, rows = _scores(batch, weights, places)
            for i, (c, a, b) in enumerate(zip(of, low, high, strict=True)):
                inside = (scores[:, c] >= a) & (scores[:, c] <= b)
                x = scores[inside, c]
                at = np.clip((x - a) / (b - a) * _BINS, 0, _BINS - 1).astype(int) if b > a else np.zeros(len(x), int)
                np.add.at(n[i], at, rows[inside])
                np.minimum.at(least[i], at, x)
                np.maximum.at(most[i], at, x)
        i, j = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(n[i, j]), pa.array(least[i, j]), pa.array(most[i, j])], names=[c.split()[0] for c in _CUTS.split(", ")])

    return run


def _sums(weights: np.ndarray, cuts: np.ndarray, places: int | None):
    """For each candidate, what its three thresholds flag, and sums about the middle one, which lies among the scores: no digits are lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(weights), len(_SUMS)))
        for batch in batches:
            s, rows = _scores(batch, weights, places)
            n = rows.astype(float)[:, None]
            flags, off = s[:, :, None] > cuts, s - cuts[:, 1]
            hit = flags[:, :, 1]
            parts = [np.broadcast_to(n, s.shape), *(n * flags[:, :, k] for k in range(3)), *(n * off**k * w for w in (hit, ~hit) for k in (1, 2))]
            total += np.stack([x.sum(axis=0) for x in parts], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(weights)), pa.int32()), *(pa.array(c) for c in total.T)], names=["i", *_SUMS])

    return run


class Judge:
    """Judges populations over counted_vectors(), which should be a saved table: each task judges all candidates over its vectors.

    Thresholds are exact order statistics of every candidate's scores. All brackets are narrowed together: a pass counts each bracket's
    bins in tasks, the counts merge in Spark, and the bins that hold the two ranks asked for are the next bracket, until they hold one value each.
    The driver sees at most _BINS rows for each bracket, and a row for each candidate, however many vectors there are.
    places: decimals that scores are rounded to, so that equal patterns tie.
    """

    def __init__(self, vectors: DataFrame, scores: list[str], places: int | None = None):
        self.vectors, self.places = vectors.select(*scores, "_rows"), places
        row = first_row(self.vectors, F.sum("_rows"), *[f for c in scores for f in (F.min(c), F.max(c))])
        self.rows, self.low, self.high = row[0] or 0, np.array(row[1::2], float), np.array(row[2::2], float)

    def cuts(self, weights: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """The score at each share (percent from above) of each candidate: candidates x shares."""
        at = (1 - shares / 100) * (self.rows - 1)
        ranks = np.stack([np.floor(at), np.minimum(np.floor(at) + 1, self.rows - 1)], axis=2)
        slack = 1e-9 + 1e-9 * np.abs(np.concatenate((self.low, self.high))).sum()
        low, high = -weights @ self.high - slack, -weights @ self.low + slack
        # Brackets: (candidate, low, high) -> rows below it and the ranks that it serves.
        todo = {(c, low[c], high[c]): (0, [(c, k, r) for k in range(shares.shape[1]) for r in (0, 1)]) for c in range(len(weights))}
        found = np.empty(ranks.shape)
        while todo:
            specs = list(todo)
            run = _histograms(weights, [c for c, _, _ in specs], np.array([x for _, x, _ in specs]), np.array([x for _, _, x in specs]), self.places)
            bins = self.vectors.mapInArrow(run, _CUTS).groupBy("spec", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow().to_pandas().sort_values(["spec", "bin"])
            new: dict = {}
            for i, own in bins.groupby("spec"):
                below, served = todo[specs[i]]
                total, lows, highs = below + np.cumsum(own["n"].to_numpy()), own["low"].to_numpy(), own["high"].to_numpy()
                for rank in served:
                    a = int(np.searchsorted(total, ranks[rank], side="right"))
                    if lows[a] == highs[a]:
                        found[rank] = lows[a]
                    else:
                        new.setdefault((rank[0], lows[a], highs[a]), (int(total[a - 1]) if a else below, []))[1].append(rank)
            todo = new
        return found[:, :, 0] + (at - np.floor(at)) * (found[:, :, 1] - found[:, :, 0])

    def __call__(self, population: list[Candidate]) -> list[float]:
        """Fitness (0 to 100) of each candidate; 0 where nothing or half of the rows and more would be flagged.

        Standardising scores changes neither order nor Cohen's d, so it is left out.
        """
        if not self.rows or not population:
            return [0.0] * len(population)
        weights = np.array([p.weights for p in population])
        shares = np.array([(max(LEAST_SHARE, p.share - 0.5), p.share, min(MOST_SHARE, p.share + 0.5)) for p in population])
        run = _sums(weights, self.cuts(weights, shares), self.places)
        each = self.vectors.mapInArrow(run, "i int, " + ", ".join(f"{c} double" for c in _SUMS))
        rows = each.groupBy("i").agg(*[F.sum(c).alias(c) for c in _SUMS]).collect()  # a row for each candidate
        out = [0.0] * len(population)
        for r in rows:
            out[r["i"]] = _fitness(r, population[r["i"]])
        return out


def judge_of(vectors: DataFrame, scores: list[str], places: int | None = None) -> Judge:
    return Judge(vectors, scores, places)


def population_fitness(vectors: DataFrame, scores: list[str], population: list[Candidate], places: int | None = None) -> list[float]:
    """Judge of one population."""
    return Judge(vectors, scores, places)(population)


def _fitness(r, p: Candidate) -> float:
    n1, n0 = r["n_b"], r["n"] - r["n_b"]
    if not n1 or 2 * n1 >= r["n"]:
        return 0.0
    spread = max(0.0, r["hit2"] - r["hit1"] ** 2 / n1) + max(0.0, r["rest2"] - r["rest1"] ** 2 / n0)
    pooled = np.sqrt(spread / (r["n"] - 2)) if r["n"] > 2 else 0.0
    apart = abs(r["hit1"] / n1 - r["rest1"] / n0) / pooled if min(n1, n0) >= 2 and pooled >= 1e-10 else 0.0
    counts = np.array([r["n_a"], r["n_b"], r["n_c"]], float)
    steady = min(1.0, float(np.exp(-5 * counts.std() / counts.mean())))
    parts = separation_quality(float(apart)), rate_quality(100 * n1 / r["n"]), steady, diversity(p.weights)
    return float(np.clip(100 * np.dot(parts, PARTS), 0, 100))
