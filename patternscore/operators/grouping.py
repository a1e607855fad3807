"""Partitions of the columns into small groups. Row work is one aggregate; only the column-by-column matrix reaches the driver."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import first_row


_MOMENTS = "i int, j int, n double, a double, b double, aa double, bb double, ab double"


def _moments(columns: int, shift: list[float]):
    """Sums over a task's rows for each pair of columns, over rows where both have a value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((5, columns, columns))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1) - shift
            here = ~np.isnan(x)
            x, w = np.where(here, x, 0.0), here.astype(float)
            total += np.stack((w.T @ w, x.T @ w, (x * x).T @ w, x.T @ x, w.T @ (x * x)))
        i, j = np.triu_indices(columns, 1)
        n, a, aa, ab, bb = (t[i, j] for t in total)
        rows = dict(zip(("i", "j", "n", "a", "b", "aa", "bb", "ab"), (i.astype(np.int32), j.astype(np.int32), n, a, total[1][j, i], aa, bb, ab), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in rows.values()], names=list(rows))

    return run


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r (Pearson's; 0 where a column does not vary) of each pair of columns, over rows where both have a value.

    Each task sends its sums of products, a row for each pair of columns, so the plan has no expression per pair.
    """
    own = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    means = first_row(own, *[F.avg(f"x{i}") for i in range(len(columns))])  # sums are taken about the means, so no digits are lost
    sums = own.mapInArrow(_moments(len(columns), [m or 0.0 for m in means]), _MOMENTS)
    one = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "aa", "bb", "ab")])
    spread = lambda s, ss: F.col(ss) - F.col(s) * F.col(s) / F.col("n")
    va, vb = spread("a", "aa"), spread("b", "bb")
    varies = (F.col("n") > 0) & (va > 1e-12 * F.col("aa")) & (vb > 1e-12 * F.col("bb"))
    r = F.when(varies, (F.col("ab") - F.col("a") * F.col("b") / F.col("n")) / F.sqrt(va * vb)).otherwise(0.0)
    name = lambda i: F.element_at(F.array(*[F.lit(c) for c in columns]), F.col(i) + 1)
    return one.select(name("i").alias("a"), name("j").alias("b"), (F.round(r, 6) + F.lit(0.0)).alias("r"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    out, at = np.eye(len(columns)), {c: i for i, c in enumerate(columns)}
    for r in correlation_pairs(df, columns).collect():  # columns**2 rows
        out[at[r["a"]], at[r["b"]]] = out[at[r["b"]], at[r["a"]]] = abs(r["r"])
    return out


def chunks(columns: list[str], size: int) -> list[list[str]]:
    return [columns[i : i + size] for i in range(0, len(columns), size)]


def random_groups(columns: list[str], size: int, seed: int = 42) -> list[list[str]]:
    own = list(columns)
    random.Random(seed).shuffle(own)
    return chunks(own, size)


def average_linkage(apart: np.ndarray) -> list[tuple[int, int, float]]:
    """The merges (a < b, height) of average linkage by ascending height; a cluster is known by its least member.

    By the nearest-neighbour chain: it grows until two clusters are each other's nearest and then merges them, with distances updated by
    cluster sizes, so the work grows with the square of the number of points.
    """
    d, size, merges, chain = apart.astype(float), np.ones(len(apart)), [], []
    np.fill_diagonal(d, np.inf)
    left = np.ones(len(d), bool)
    while len(merges) < len(d) - 1:
        chain = chain or [int(left.argmax())]
        x = chain[-1]
        y = int(d[x].argmin())
        if len(chain) < 2 or d[x, y] < d[x, chain[-2]]:
            chain.append(y)
            continue
        a, b = sorted((x, chain[-2]))
        del chain[-2:]
        merges.append((a, b, float(d[a, b])))
        d[a] = d[:, a] = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[b] = d[:, b] = d[a, a] = np.inf
        size[a] += size[b]
        left[b] = False
    return sorted(merges, key=lambda m: m[2])


def linked_groups(corr: np.ndarray, columns: list[str], size: int) -> list[list[str]]:
    """Average linkage on 1 - |r|, cut at max(1, min(p // size, p // 2)) clusters; re-chunked if one passes 1.5 * size."""
    many = max(1, min(len(columns) // size, len(columns) // 2))
    clusters = {i: [i] for i in range(len(columns))}
    for a, b, _ in average_linkage(1 - corr)[: max(0, len(columns) - many)]:
        clusters[a] += clusters.pop(b)
    groups = [[columns[i] for i in sorted(clusters[a])] for a in sorted(clusters)]
    return chunks([c for g in groups for c in g], size) if any(len(g) > 1.5 * size for g in groups) else groups


def greedy_groups(corr: np.ndarray, columns: list[str], size: int, least: float = 0.1) -> list[list[str]]:
    left, out = list(range(len(columns))), []
    while left:
        group = [max(left, key=lambda i: (corr[i, left].mean(), -i))]
        left.remove(group[0])
        while left and len(group) < size:
            best = max(left, key=lambda i: (corr[i, group].mean(), -i))
            if corr[best, group].mean() <= least:
                break
            group.append(best)
            left.remove(best)
        out.append([columns[i] for i in group])
    return out


def variances(df: DataFrame, columns: list[str]) -> dict[str, float]:
    row = first_row(df, *[F.round(F.var_samp(c), 3) for c in columns])
    return dict(zip(columns, row, strict=True))


def by_variance(found: dict[str, float]) -> list[str]:
    return sorted(found, key=lambda c: (-(found[c] if found[c] is not None else -1.0), c))


def variance_groups(df: DataFrame, columns: list[str], size: int) -> DataFrame:
    """column_name, variance, group_id: columns by descending sample variance, dealt round the groups."""
    found, n = variances(df, columns), max(1, len(columns) // size)
    order = by_variance(found)
    return df.sparkSession.createDataFrame([(c, found[c], i % n) for i, c in enumerate(order)], "column_name string, variance double, group_id long")


# Name parts of each category, in the order in which they are tried.
DOMAINS = {
    "voltage": ("V_", "Gr_V_", "phase_Gr_V_"),
    "current": ("I_", "Gr_I_", "phase_Gr_I_"),
    "power": ("P_", "P_50", "P_H", "P_DC"),
    "phase": ("phi_", "phase_"),
    "harmonic": ("_H", "THD_"),
}


def domain_of(name: Column) -> Column:
    out = F.lit("other")
    for kind, parts in reversed(DOMAINS.items()):
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(name, F.lit(p))
        out = F.when(hit, kind).otherwise(out)
    return out


def domain_groups(columns: list[str], size: int) -> list[list[str]]:
    """Columns of one category in their order, in chunks; groups under 3 are merged."""
    kinds: dict[str, list[str]] = {k: [] for k in (*DOMAINS, "other")}
    for c in columns:
        kinds[next((k for k, parts in DOMAINS.items() if any(p in c for p in parts)), "other")].append(c)
    return merged_small([g for cs in kinds.values() for g in chunks(cs, size)])


def group_info(df: DataFrame, groups: list[list[str]]) -> DataFrame:
    """group_id, size, features, mean_variance (sample) and mean_correlation (absolute, a column with itself included) of each group."""
    columns = list(dict.fromkeys(c for g in groups for c in g))
    corr, var, at = correlation_matrix(df, columns), variances(df, columns), {c: i for i, c in enumerate(columns)}
    rows = []
    for i, g in enumerate(groups):
        own = [at[c] for c in g]
        rows.append((i, len(g), ",".join(g), float(np.mean([var[c] or 0.0 for c in g])), float(corr[np.ix_(own, own)].mean())))
    return df.sparkSession.createDataFrame(rows, "group_id long, size long, features string, mean_variance double, mean_correlation double")


def save_groups(spark, groups: list[list[str]], path: str) -> None:
    """A row (group_id, features) per group, as JSON lines in a folder that Spark can write."""
    spark.createDataFrame(list(enumerate(groups)), "group_id long, features array<string>").coalesce(1).write.mode("errorifexists").json(path)


def load_groups(spark, path: str) -> list[list[str]]:
    return [r["features"] for r in spark.read.schema("group_id long, features array<string>").json(path).orderBy("group_id").collect()]  # a row for each group


def linked_components(corr: np.ndarray, columns: list[str], size: int, least: float = 0.3) -> list[list[str]]:
    """Columns connected by |r| > least, in walks that stop at 1.5 * size columns; re-chunked if a group is larger or under 3."""
    left, groups = set(range(len(columns))), []
    while left:
        walk, todo = [], [min(left)]
        while todo and len(walk) < 1.5 * size:
            x = todo.pop()
            if x in left:
                left.discard(x)
                walk.append(x)
                todo += [y for y in sorted(left, reverse=True) if corr[x, y] > least]
        groups.append([columns[i] for i in sorted(walk)])
    odd = any(len(g) < 3 or len(g) > 1.5 * size for g in groups)
    return chunks([c for g in groups for c in g], size) if odd else groups


def kmeans_groups(corr: np.ndarray, columns: list[str], size: int, seed: int = 42, starts: int = 10, rounds: int = 100) -> list[list[str]]:
    """k-means over the rows of the correlation matrix (one point per column), k = columns // size, the best of several starts."""
    rng, k, best = np.random.default_rng(seed), max(1, len(columns) // size), None
    for _ in range(starts):
        centres = corr[rng.choice(len(columns), k, replace=False)]
        for _ in range(rounds):
            apart = ((corr[:, None] - centres[None]) ** 2).sum(axis=2)
            own = apart.argmin(axis=1)
            new = np.array([corr[own == i].mean(axis=0) if (own == i).any() else centres[i] for i in range(k)])
            if np.allclose(new, centres):
                break
            centres = new
        if best is None or apart.min(axis=1).sum() < best[0]:
            best = apart.min(axis=1).sum(), own
    groups = [[c for c, o in zip(columns, best[1], strict=True) if o == i] for i in range(k)]
    groups = [g for g in groups if g]
    return chunks([c for g in groups for c in g], size) if any(len(g) > 1.5 * size for g in groups) else groups


def merged_small(groups: list[list[str]], least: int = 3) -> list[list[str]]:
    """Columns of groups under ``least`` are dealt round the other groups; if there are no others, they are one group."""
    large, small = [list(g) for g in groups if len(g) >= least], [c for g in groups if len(g) < least for c in g]
    if not large:
        return [small] if small else []
    for i, c in enumerate(small):
        large[i % len(large)].append(c)
    return large


#: What create_groups() may use.
STRATEGIES = ("correlation", "greedy", "components", "kmeans", "random", "domain", "variance")


def create_groups(df: DataFrame, columns: list[str], size: int = 15, strategy: str = "correlation", seed: int = 42) -> list[list[str]]:
    """Groups of the columns by a strategy; one that is not in STRATEGIES is random."""
    if strategy == "domain":
        return domain_groups(columns, size)
    if strategy == "variance":
        n = max(1, len(columns) // size)
        order = by_variance(variances(df, columns))
        return [order[i::n] for i in range(n)]
    ways = {"correlation": linked_groups, "greedy": greedy_groups, "components": linked_components, "kmeans": kmeans_groups}
    if strategy in ways:
        return ways[strategy](correlation_matrix(df, columns), columns, size)
    return random_groups(columns, size, seed)
