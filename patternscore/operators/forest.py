"""Threshold by an isolation forest over scores: trees of random cuts, each grown on a small sample as published; every score is judged."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import counted_quantiles, first_row

_EULER = 0.5772156649015329


def usual_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n values."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + _EULER) - 2 * (n - 1) / n


def path_lengths(x: np.ndarray, rng: np.random.Generator, deepest: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts (ascending) of a tree grown on x and the path length in each of the intervals between them."""
    cuts, paths, todo = [], [], [(np.sort(x), 0, np.inf)]
    while todo:
        own, depth, end = todo.pop()
        if len(own) < 2 or depth == deepest or own[0] == own[-1]:
            cuts.append(end)
            paths.append(depth + usual_path(len(own)))
            continue
        at = rng.uniform(own[0], own[-1])
        k = int(np.searchsorted(own, at, side="right"))
        todo += [(own[k:], depth + 1, end), (own[:k], depth + 1, at)]  # the left part is taken first, so cuts ascend
    return np.array(cuts[:-1]), np.array(paths)


def forest_threshold(counted: DataFrame, share: float, trees: int = 100, sample: int = 256, seed: int = 42) -> float | None:
    """The smallest score that the forest flags, of counted scores (value, n); the percentile threshold where it flags none.

    ``share`` percent of the rows, those of shortest path, are flagged. Trees are grown on ``sample`` rows each, drawn from at most
    trees * sample different scores (chosen by weight and hash). Low scores are isolated too, so the threshold can lie low.
    """
    u = (F.xxhash64("value", F.lit(seed)).cast("double") + 2.0**63 + 1) / 2.0**64
    drawn = counted.orderBy(-F.ln(u) / F.col("n"), "value").limit(trees * sample).toPandas()  # bounded by the parameters
    if drawn.empty:
        return None
    rng, values, weights = np.random.default_rng(seed), drawn["value"].to_numpy(), drawn["n"].to_numpy(float)
    order = np.argsort(values)
    values, weights = values[order], weights[order] / weights.sum()
    cuts, steps, base = [], [], 0.0
    for _ in range(trees):
        at, paths = path_lengths(rng.choice(values, sample, p=weights), rng, int(np.ceil(np.log2(sample))))
        cuts.append(at)
        steps.append(np.diff(paths))
        base += paths[0]
    cuts, steps = np.concatenate(cuts), np.concatenate(steps)
    order = np.argsort(cuts, kind="stable")
    edges, total = cuts[order], base + np.concatenate(([0.0], np.cumsum(steps[order])))

    @F.pandas_udf("double")
    def shortness(x: pd.Series) -> pd.Series:
        return pd.Series(-np.round(total[np.searchsorted(edges, x.to_numpy(), side="left")] / trees, 9))

    judged = counted.select("value", "n", shortness("value").alias("f"))
    cut = counted_quantiles(judged.groupBy("f").agg(F.sum("n").alias("n")), [1 - share / 100], "f")[0]
    least = first_row(judged.where(F.col("f") > F.lit(cut)), F.min("value"))[0]
    return counted_quantiles(counted, [1 - share / 100])[0] if least is None else least
