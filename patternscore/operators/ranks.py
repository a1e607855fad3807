"""Running totals and exact order statistics without a task that sees all rows: sorts are by range, tasks add what stands before them."""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved

#: Accuracy of the sketches that bracket an order statistic: a bracket holds about 6 of so many parts of the rows.
_ACCURACY = 10_000


def first_row(df: DataFrame, *aggregates: Column):
    """One row of aggregates, on the driver."""
    return df.agg(*aggregates).first()


def running_total(df: DataFrame, by: list[str], weight: Column, name: str) -> DataFrame:
    """df with the sum of ``weight`` over all rows up to the own one in the order of ``by``, which must tell rows apart. An empty table stays empty."""
    order = saved(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_id", 33)
    sums = sorted((r["p"], r["w"]) for r in order.groupBy(part.alias("p")).agg(F.sum(weight).cast("long").alias("w")).collect())  # a row for each task of the sort
    before, at = [], 0
    for p, w in sums:
        before.append((p, at))
        at += w
    offsets = df.sparkSession.createDataFrame(pa.table({"_p": pa.array([p for p, _ in before], pa.int64()), "_before": pa.array([w for _, w in before], pa.int64())}))
    within = F.sum(weight).over(Window.partitionBy(part).orderBy("_id").rowsBetween(Window.unboundedPreceding, 0))
    return order.withColumn(name, within).join(F.broadcast(offsets), part == F.col("_p")).withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_id", "_p", "_before")


def _between(low: float | None, high: float | None, part: float) -> float | None:
    return None if low is None else low if high is None else low + part * (high - low)


def counted_quantiles(counted: DataFrame, shares: list[float], value: str = "value", n: str = "n") -> list[float | None]:
    """Interpolated quantiles of different values with their numbers; None of no rows. Null values must not be there."""
    totals = saved(running_total(counted, [value], F.col(n), "_total"), "totals")
    rows = first_row(totals, F.max("_total").alias("n"))["n"] or 0
    at = [s * (rows - 1) for s in shares]
    found = first_row(totals, *[F.min(F.when(F.col("_total") > floor(p) + d, F.col(value))) for p in at for d in (0, 1)])
    return [_between(found[2 * i], found[2 * i + 1], p - floor(p)) for i, p in enumerate(at)]


def grouped_quantiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """by, n and q<i> of each group: interpolated quantiles of its values (nulls left out). Different values are counted, and one range sort ranks those of all groups."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    totals = saved(running_total(counted, [*by, value], F.col("_n"), "_total"), "totals")
    groups = totals.groupBy(*by).agg(F.sum("_n").alias("n"), F.min(F.col("_total") - F.col("_n")).alias("_base"))
    ranked = totals.alias("t").join(groups.alias("g"), [F.col(f"t.{c}").eqNullSafe(F.col(f"g.{c}")) for c in by]).select(*[F.col(f"t.{c}") for c in by], F.col(f"t.{value}").alias("_v"), (F.col("_total") - F.col("_base")).alias("_rank"), "n")
    at = [F.lit(s) * (F.col("n") - 1) for s in shares]
    ends = [F.min(F.when(F.col("_rank") > F.floor(p) + d, F.col("_v"))).alias(f"_{i}_{d}") for i, p in enumerate(at) for d in (0, 1)]
    part = lambda i, p: F.col(f"_{i}_0") + (p - F.floor(p)) * (F.coalesce(f"_{i}_1", f"_{i}_0") - F.col(f"_{i}_0"))
    return ranked.groupBy(*by, "n").agg(*ends).select(*by, "n", *[part(i, p).alias(f"q{i}") for i, p in enumerate(at)])


def bottom_k(df: DataFrame, by: str, sizes: dict, order: str) -> DataFrame:
    """Of each value of ``by`` in sizes, the rows of the least ``order`` (a text or number that tells rows apart): sizes[value] of them.

    Each task keeps the least of its own rows, and the least of those are taken: the last step sees so many rows from each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for value, k in sizes.items():
                own = rows.filter(pc.equal(rows[by], pa.scalar(value, rows[by].type)))
                both = pa.concat_tables([kept[value], own]) if value in kept else own
                kept[value] = both.take(pc.sort_indices(both, sort_keys=[(order, "ascending")])[:k]).combine_chunks()
        for rows in kept.values():
            yield from rows.to_batches()

    least = df.where(F.col(by).isin(list(sizes))).mapInArrow(run, df.schema)
    most = F.coalesce(*[F.when(F.col(by) == v, F.lit(k)) for v, k in sizes.items()])
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return least.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def number(c: str) -> Column:
    """A column as double, NaN as null."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Interpolated quantiles of every column, nulls and NaN left out; None of a column without values.

    Sketches bracket each quantile in one pass, a second pass counts what lies below the brackets, and only values inside them are counted and ranked.
    """
    own = df.select(*[number(c).alias(f"x{j}") for j, c in enumerate(columns)])
    asked = [x for s in shares for x in (max(0.0, s - 3 / _ACCURACY), min(1.0, s + 3 / _ACCURACY))]
    seen = first_row(own, *[F.count(f"x{j}") for j in range(len(columns))], *[F.percentile_approx(f"x{j}", asked, _ACCURACY) for j in range(len(columns))])
    specs = []
    for j in range(len(columns)):
        n, edges = seen[j], seen[len(columns) + j]
        specs += [(j, n, s * (n - 1), edges[2 * i], edges[2 * i + 1]) for i, s in enumerate(shares) if n]
    if not specs:
        return {c: [None] * len(shares) for c in columns}
    x = [F.col(f"x{j}") for j, *_ in specs]
    checks = first_row(own, *[F.count(F.when(c < lo, 1)) for c, (_, _, _, lo, _) in zip(x, specs, strict=True)], *[F.count(F.when(c <= hi, 1)) for c, (_, _, _, _, hi) in zip(x, specs, strict=True)])
    inside, below = [], []
    for i, (_, n, at, lo, hi) in enumerate(specs):
        good = checks[i] <= floor(at) and checks[len(specs) + i] >= min(n, floor(at) + 2)
        below.append(checks[i] if good else 0)  # a bracket that missed its ranks is opened
        inside.append(F.when(x[i].between(lo, hi) if good else x[i].isNotNull(), x[i]))
    each = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), v.alias("value")) for i, v in enumerate(inside)]), lambda s: s["value"].isNotNull())
    counted = own.select(F.inline(each)).groupBy("i", "value").agg(F.count("*").alias("n"))
    totals = saved(running_total(counted, ["i", "value"], F.col("n"), "total"), "totals")
    sums = {r["i"]: r["n"] for r in totals.groupBy("i").agg(F.sum("n").alias("n")).collect()}  # a row for each quantile
    picks, base = [], 0
    for i, (_, _, at, _, _) in enumerate(specs):
        picks += [F.min(F.when((F.col("i") == i) & (F.col("total") > base + floor(at) - below[i] + d), F.col("value"))) for d in (0, 1)]
        base += sums.get(i, 0)
    found = first_row(totals, *picks)
    out = {c: [None] * len(shares) for c in columns}
    k = 0
    for j, c in enumerate(columns):
        if seen[j]:
            for i in range(len(shares)):
                at = specs[k][2]
                out[c][i] = _between(found[2 * k], found[2 * k + 1], at - floor(at))
                k += 1
    return out
