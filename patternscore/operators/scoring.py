"""Equal-width bins, pattern frequencies, group scores, thresholds and their explanation.

Edges, frequencies, mean, deviation and threshold are fitted once: a few numbers on the driver, and one saved table of pattern
frequencies (wide groups have nearly as many as rows). Applying them takes the same number of shuffles whatever the number of groups. Rows that repeat
count as often as they stand there; an empty table has no scores and no threshold.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructType

from ..sources.shared import saved
from .ranks import counted_quantiles, first_row, grouped_quantiles, running_total


@dataclass(frozen=True)
class Plan:
    """What to score: a row key, groups of numeric columns and the number of bins."""

    key: str
    groups: list[list[str]] = field(default_factory=list)
    bins: int = 5

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys(c for g in self.groups for c in g))

    @property
    def scores(self) -> list[str]:
        return [f"group_{i}" for i in range(len(self.groups))]


def fitted_edges(df: DataFrame, columns: list[str]) -> dict[str, tuple]:
    """Minimum and maximum of each column."""
    row = first_row(df, *[f for c in columns for f in (F.min(c), F.max(c))])
    return {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(columns)}


def bin_columns(df: DataFrame, columns: list[str], bins: int, edges: dict[str, tuple] | None = None) -> DataFrame:
    """Codes 0 to bins - 1 of equal widths between each column's minimum and maximum; a constant column is 0, null stays null.

    edges: fitted_edges() of other rows; values outside them fall in the first or last bin.
    """
    codes, edges = {}, edges or fitted_edges(df, columns)
    for c in columns:
        low, high = edges[c]
        none = F.when(F.col(c).isNotNull(), F.lit(0).cast("long"))
        if low is None or not high > low:
            codes[c] = none
            continue
        low, high = F.lit(low), F.lit(high)
        code = sum(((F.col(c) >= low + i * (high - low) / bins).cast("long") for i in range(1, bins)), F.lit(0).cast("long"))
        codes[c] = F.when(F.col(c).isNotNull(), code)
    return df.withColumns(codes)


def pattern(group: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in group])


def pattern_counts(binned: DataFrame, plan: Plan) -> DataFrame:
    """group_id, pattern, n: all groups in one shuffle of partial counts."""
    each = F.array(*[F.struct(F.lit(i).cast("long").alias("group_id"), pattern(g).alias("pattern")) for i, g in enumerate(plan.groups)])
    return binned.select(F.inline(each)).groupBy("group_id", "pattern").agg(F.count("*").alias("n"))


#: Pattern frequencies that are sent to all tasks at most; rows of rarer patterns travel to their frequencies.
MOST_SENT = 100_000
#: Columns whose codes fit one 64-bit number, for a number of bins.
_FIT = lambda bins: int(62 / log2(bins + 1))
#: Types whose values compare as doubles.
_PLAIN = (ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType)


def _cuts(low, high, bins: int) -> list[float]:
    """The values at which bins 1 to bins - 1 of a column begin, in the arithmetic of bin_columns(); none of a constant column."""
    if low is None or not high > low:
        return []
    return [low + float(i * (high - low)) / bins for i in range(1, bins)]


def _coder(plan: Plan, cuts: list[list[float] | None]):
    """From batches of the key and plan.columns (bins where cuts is None, else values), the key and each group's code.

    A code is exact: digits of base bins + 1 (null is a digit) in a bigint, or in several as text if some group is wider.
    """
    place = {c: j for j, c in enumerate(plan.columns)}
    parts = [[[place[c] for c in g[i : i + _FIT(plan.bins)]] for i in range(0, len(g), _FIT(plan.bins))] for g in plan.groups]
    as_text, bins = any(len(p) > 1 for p in parts), plan.bins

    def digits(values: pa.Array, at: list[float] | None) -> np.ndarray:
        if at is None:
            return values.fill_null(bins).to_numpy(zero_copy_only=False)
        there, v = values.is_valid().to_numpy(zero_copy_only=False), values.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
        out = np.zeros(len(v), np.int64)
        for x in at:
            out += v >= x
        out[np.isnan(v)] = len(at)  # Spark's NaN is above all numbers
        out[~there] = bins
        return out

    def number(columns: list[np.ndarray]) -> np.ndarray:
        out = columns[0]
        for d in columns[1:]:
            out = out * (bins + 1) + d
        return out

    def run(batches):
        for b in batches:
            found = [digits(b.column(j + 1), at) for j, at in enumerate(cuts)]
            numbers = [[pa.array(number([found[j] for j in own])) for own in group] for group in parts]
            codes = [pc.binary_join_element_wise(*[n.cast(pa.string()) for n in group], ",") if as_text else group[0] for group in numbers]
            yield pa.RecordBatch.from_arrays([b.column(0), *codes], names=[b.schema.names[0], *(f"code_{i}" for i in range(len(codes)))])

    return run, "string" if as_text else "long"


def coded(df: DataFrame, plan: Plan, edges: dict[str, tuple] | None = None) -> DataFrame:
    """key and code_<i>, the code of each group's pattern.

    Tasks code Arrow batches column by column: as one Spark expression for each group, wide groups make methods that the JVM doesn't compile.
    Columns that are not of a plain number type (decimals, dates) are binned by bin_columns().
    """
    edges = edges or fitted_edges(df, plan.columns)
    values = df.select(*[F.col(c).alias(f"_v{j}") for j, c in enumerate(plan.columns)]).schema
    other = [c for c, f in zip(plan.columns, values, strict=True) if not isinstance(f.dataType, _PLAIN) or not all(isinstance(x, (int, float, type(None))) for x in edges[c])]
    cuts = [None if c in other else _cuts(*edges[c], plan.bins) for c in plan.columns]
    rows = (bin_columns(df, other, plan.bins, edges) if other else df).select(plan.key, *[F.col(c).alias(f"_v{j}") for j, c in enumerate(plan.columns)])
    run, kind = _coder(plan, cuts)
    schema = StructType([rows.schema[0]])
    for i in range(len(plan.groups)):
        schema = schema.add(f"code_{i}", kind)
    return rows.mapInArrow(run, schema)


def code_counts(rows: DataFrame, plan: Plan) -> DataFrame:
    """group_id, code, n of coded() rows: all groups in one shuffle of partial counts."""
    each = F.array(*[F.struct(F.lit(i).cast("long").alias("group_id"), F.col(f"code_{i}").alias("code")) for i in range(len(plan.groups))])
    return rows.select(F.inline(each)).groupBy("group_id", "code").agg(F.count("*").alias("n"))


def log_frequencies(counts: DataFrame) -> DataFrame:
    """group_id, pattern (or code), n, ll = ln((n + 1) / (rows + patterns)) and unseen, the same of n = 0; a saved table of these scores new rows too."""
    sizes = counts.groupBy("group_id").agg(F.sum(F.col("n") + 1).alias("total"))
    key = "code" if "code" in counts.columns else "pattern"
    return counts.join(F.broadcast(sizes), "group_id").select("group_id", key, "n", F.ln((F.col("n") + 1) / F.col("total")).alias("ll"), F.ln(1 / F.col("total")).alias("unseen"))  # a row for each group


def frequency_table(df: DataFrame, plan: Plan, edges: dict[str, tuple] | None = None) -> DataFrame:
    """Saved log_frequencies() of the rows' codes."""
    return saved(log_frequencies(code_counts(coded(df, plan, edges), plan)), "frequencies")


def _sent_from(table: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` patterns of the table occur so often."""
    bands = {r["b"]: r["c"] for r in table.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).agg(F.count("*").alias("c")).collect()}  # 63 rows at most
    at = max(bands, default=0) + 1
    while at and (most := most - bands.get(at - 1, 0)) >= 0:
        at -= 1
    return 1 << at


def log_likelihoods(df: DataFrame, plan: Plan, table: DataFrame | None = None, edges: dict[str, tuple] | None = None, most: int = MOST_SENT) -> DataFrame:
    """key and a column group_<i> per group.

    table and edges: saved log_frequencies() and fitted_edges() of other rows; a pattern that the table lacks counts as seen 0 times.
    The most frequent patterns, ``most`` at most, go to all tasks. If that is not all of them, what a row still lacks travels as
    (row, group, code), for all groups in one shuffle, to the rest of the table and back in a second one: none of those keys is a hot one, as
    all frequent patterns were sent.
    """
    by_code = table is None or "code" in table.columns
    edges = edges or fitted_edges(df, plan.columns)
    if by_code:
        rows = coded(df, plan, edges)
    else:
        rows = bin_columns(df, plan.columns, plan.bins, edges).select(plan.key, *[pattern(g).alias(f"code_{i}") for i, g in enumerate(plan.groups)])
    if table is None:
        rows = _numbered(rows)
        table = saved(log_frequencies(code_counts(rows, plan)), "frequencies")
    table = table.withColumnRenamed("pattern", "code")
    unseen = {r["group_id"]: r["u"] for r in table.groupBy("group_id").agg(F.max("unseen").alias("u")).collect()}  # a row for each group
    least = _sent_from(table, most)
    if least > 1 and "_r" not in rows.columns:
        rows = _numbered(rows)
    for i in range(len(plan.groups)):
        own = table.where((F.col("group_id") == i) & (F.col("n") >= least)).select(F.col("code").alias(f"_q{i}"), F.col("ll").alias(f"_l{i}"))
        rows = rows.join(F.broadcast(own), F.col(f"code_{i}") == F.col(f"_q{i}"), "left").drop(f"_q{i}")
    found = [[F.col(f"_l{i}")] for i in range(len(plan.groups))]
    if least > 1:
        each = F.array(*[F.struct(F.lit(i).cast("long").alias("group_id"), F.col(f"code_{i}").alias("code"), F.col(f"_l{i}").isNull().alias("open")) for i in range(len(plan.groups))])
        left = rows.select("_r", F.inline(F.filter(each, lambda x: x["open"])))
        rare = left.join(table.where(F.col("n") < least).select("group_id", "code", "ll"), ["group_id", "code"])
        back = rare.groupBy("_r").agg(*[F.max(F.when(F.col("group_id") == i, F.col("ll"))).alias(f"_m{i}") for i in range(len(plan.groups))])
        rows = rows.join(back, "_r", "left")
        found = [[*f, F.col(f"_m{i}")] for i, f in enumerate(found)]
    return rows.select(plan.key, *[F.coalesce(*f, F.lit(unseen.get(i)).cast("double")).alias(name) for i, (f, name) in enumerate(zip(found, plan.scores, strict=True))])


def _numbered(rows: DataFrame) -> DataFrame:
    """Saved rows with a number of their own, _r: a narrow table of key and codes that later passes read instead of the rows."""
    return saved(rows.withColumn("_r", F.monotonically_increasing_id()), "codes")


def aggregated(scores: list[str], how: str = "mean", weights: list[float] | None = None) -> Column:
    """One value per row from its group scores: mean, min, max, median, sum or weighted."""
    cols, k = [F.col(c) for c in scores], len(scores)
    if how == "min":
        return F.array_min(F.array(*cols))
    if how == "max":
        return F.array_max(F.array(*cols))
    if how == "median":
        s = F.array_sort(F.array(*cols))
        return (F.get(s, F.lit((k - 1) // 2)) + F.get(s, F.lit(k // 2))) / 2
    if how == "weighted":
        w = weights if weights and len(weights) == k else [1.0] * k
        return sum((c * x for c, x in zip(cols[1:], w[1:], strict=True)), cols[0] * w[0]) / sum(w)
    total = sum(cols[1:], cols[0])
    return total if how == "sum" else total / k


def centre(ll: DataFrame, plan: Plan, how: str = "mean", weights: list[float] | None = None) -> tuple[float, float]:
    """Mean and population deviation of the raw scores (the negated aggregates)."""
    row = first_row(ll.select((-aggregated(plan.scores, how, weights)).alias("s")), F.avg("s"), F.stddev_pop("s"))
    return row[0] or 0.0, row[1] or 0.0


def anomaly_scores(ll: DataFrame, plan: Plan, how: str = "mean", weights: list[float] | None = None, zscore: bool = True, fitted: tuple[float, float] | None = None) -> DataFrame:
    """ll with anomaly_score: the negated aggregate, in population deviations from its mean (as it is where that is 0).

    fitted: centre() of other rows. Without it ll is read twice, so it should be a saved table.
    """
    raw = -aggregated(plan.scores, how, weights)
    mean, std = (0.0, 0.0) if not zscore else fitted or centre(ll, plan, how, weights)
    return ll.withColumn("anomaly_score", (raw - F.lit(mean)) / F.lit(std) if std > 0 else raw)


def average_ranks(scored: DataFrame) -> DataFrame:
    """scored with rank_share: average rank / rows. Ranks accumulate over distinct scores, by ranges of scores."""
    each = scored.groupBy("anomaly_score").agg(F.count("*").alias("_c"))
    totals = saved(running_total(each, ["anomaly_score"], F.col("_c"), "_t"), "totals")
    n = first_row(totals, F.max("_t"))[0]
    ranked = totals.select("anomaly_score", ((F.col("_t") - F.col("_c") + (F.col("_c") + 1) / 2) / F.lit(n)).alias("rank_share"))
    return scored.join(ranked, "anomaly_score")


def threshold_value(scored: DataFrame, method: str = "percentile", share: float = 5.0, deviations: float = 2.0) -> float | None:
    """The threshold by a method: percentile, iqr, std, adaptive or forest; None of no rows. Scores are counted first, so ties cost nothing."""
    counted = saved(scored.where("anomaly_score IS NOT NULL").groupBy(F.col("anomaly_score").alias("value")).agg(F.count("*").alias("n")), "scores")
    n, s = F.col("n"), F.col("value")
    mean = first_row(counted, F.sum(s * n) / F.sum(n))[0]
    if mean is None:
        return None
    moment = lambda k: F.sum(n * F.pow(s - F.lit(mean), F.lit(k))) / F.sum(n)
    if method == "percentile":
        return counted_quantiles(counted, [1 - share / 100])[0]
    if method == "iqr":
        low, high = counted_quantiles(counted, [0.25, 0.75])
        return high + 1.5 * (high - low)
    if method == "std":
        return first_row(counted, F.lit(mean) + deviations * F.sqrt(moment(2.0)))[0]
    if method == "forest":
        from .forest import forest_threshold

        return forest_threshold(counted, share)
    if method != "adaptive":
        raise ValueError(f"no threshold method {method}")
    one = counted.agg(F.sum(n).cast("double").alias("n"), F.sqrt(moment(2.0)).alias("std"), moment(3.0).alias("m3"), moment(4.0).alias("m4"))
    row = one.select("std", (normality_statistic() < NORMAL_K2).alias("normal")).first()
    return mean + deviations * row["std"] if row["normal"] else counted_quantiles(counted, [1 - share / 100])[0]


def threshold(scored: DataFrame, method: str = "percentile", share: float = 5.0, deviations: float = 2.0) -> DataFrame:
    """One row, threshold."""
    return scored.sparkSession.range(1).select(F.lit(threshold_value(scored, method, share, deviations)).cast("double").alias("threshold"))


#: The 5 % point of chi-square with 2 degrees of freedom.
NORMAL_K2 = 5.991464547107979


def normality_statistic() -> Column:
    """D'Agostino and Pearson's K2 of columns n, std, m3, m4."""
    return F.expr(NORMAL_SQL)


_Y = "(m3 / power(std, 3) * sqrt((n + 1) * (n + 3) / (6 * (n - 2))))"
_B2 = "(3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)))"
_W2 = f"(sqrt(2 * ({_B2} - 1)) - 1)"
_A = f"({_Y} / sqrt(2 / ({_W2} - 1)))"
_Z1 = f"(ln({_A} + sqrt({_A} * {_A} + 1)) / sqrt(0.5 * ln({_W2})))"
_X = "((m4 / power(std, 4) - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))))"
_G = "(6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))))"
_D = f"(6 + 8 / {_G} * (2 / {_G} + sqrt(1 + 4 / ({_G} * {_G}))))"
_Z2 = f"((1 - 2 / (9 * {_D}) - cbrt((1 - 2 / {_D}) / (1 + {_X} * sqrt(2 / ({_D} - 4))))) / sqrt(2 / (9 * {_D})))"
NORMAL_SQL = f"({_Z1} * {_Z1} + {_Z2} * {_Z2})"


def flagged(scored: DataFrame, method: str = "percentile", share: float = 5.0, deviations: float = 2.0) -> DataFrame:
    """scored with threshold and is_anomaly: scores strictly above the threshold. scored is read twice, so it should be a saved table."""
    at = F.lit(threshold_value(scored, method, share, deviations)).cast("double")
    return scored.withColumn("threshold", at).withColumn("is_anomaly", F.col("anomaly_score") > at)


def separation(flags: DataFrame) -> DataFrame:
    """n_anomalies, anomaly_rate, class means and Cohen's d (pooled sample variance; 0 where a class has under 2 rows)."""
    a, s = F.col("is_anomaly"), F.col("anomaly_score")
    one = flags.agg(
        F.count("*").alias("n"), F.count(F.when(a, 1)).alias("n1"), F.avg(F.when(a, s)).alias("m1"), F.avg(F.when(~a, s)).alias("m0"),
        F.var_samp(F.when(a, s)).alias("v1"), F.var_samp(F.when(~a, s)).alias("v0"),
    )
    n0 = F.col("n") - F.col("n1")
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (n0 - 1) * F.col("v0")) / (F.col("n") - 2))
    d = F.when((F.col("n1") >= 2) & (n0 >= 2) & (pooled > 1e-10), (F.col("m1") - F.col("m0")) / pooled).otherwise(0.0)
    return one.select("n", F.col("n1").alias("n_anomalies"), (100 * F.col("n1") / F.col("n")).alias("anomaly_rate"), F.col("m1").alias("mean_anomaly"), F.col("m0").alias("mean_normal"), d.alias("cohens_d"))


# Centre, width and height of the bells that say how likely a detection rate (percent) is.
BELLS = ((4.0, 1.0, 1.0), (1.5, 0.5, 0.8), (7.0, 1.5, 0.6))


def rate_score(rate: Column) -> Column:
    """How likely a detection rate (percent) is: the greatest of the bells."""
    return F.greatest(*[top * F.exp(-0.5 * F.pow((rate - at) / width, F.lit(2.0))) for at, width, top in BELLS])


def explanations(flags: DataFrame, plan: Plan, top: int = 2) -> DataFrame:
    """The ``top`` least likely groups of every anomaly: key, rank, group_name, ll. Sorting is within a row."""
    each = F.array_sort(F.array(*[F.struct(F.col(c).alias("ll"), F.lit(c).alias("group_name")) for c in plan.scores]))
    return flags.where("is_anomaly").select(plan.key, F.posexplode(F.slice(each, 1, top)).alias("p", "g")).select(plan.key, (F.col("p") + 1).cast("long").alias("rank"), "g.group_name", "g.ll")


def contributions(flags: DataFrame, plan: Plan) -> DataFrame:
    """group_name and its mean score of normal rows less that of anomalies."""
    a = F.col("is_anomaly")
    means = F.array(*[F.struct(F.lit(c).alias("group_name"), (F.avg(F.when(~a, F.col(c))) - F.avg(F.when(a, F.col(c)))).alias("contribution")) for c in plan.scores])
    return flags.agg(means.alias("m")).select(F.inline("m"))


def box_plot(flags: DataFrame) -> DataFrame:
    """For each class (is_anomaly): n, q25, median, q75, whiskers (farthest scores within 1.5 quartile distances of the box) and n_outside. One sort ranks both classes."""
    box = grouped_quantiles(flags, ["is_anomaly"], "anomaly_score", [0.25, 0.5, 0.75])
    each = flags.select("is_anomaly", "anomaly_score").join(F.broadcast(box), "is_anomaly")  # two rows
    reach = 1.5 * (F.col("q2") - F.col("q0"))
    inside = F.when(F.col("anomaly_score").between(F.col("q0") - reach, F.col("q2") + reach), F.col("anomaly_score"))
    out = each.groupBy("is_anomaly", "n", "q0", "q1", "q2").agg(F.min(inside).alias("low_whisker"), F.max(inside).alias("high_whisker"), (F.count("*") - F.count(inside)).alias("n_outside"))
    return out.withColumnsRenamed({"q0": "q25", "q1": "median", "q2": "q75"})


def histogram(scored: DataFrame, bins: int = 50) -> DataFrame:
    """bin and its number of rows."""
    own = bin_columns(scored.select("anomaly_score"), ["anomaly_score"], bins)
    return own.groupBy(F.col("anomaly_score").alias("bin")).agg(F.count("*").alias("n"))


def conditional_table(binned: DataFrame, node: str, parent: str) -> DataFrame:
    """parent, node, n, p = N(parent, node) / N(parent)."""
    n = binned.groupBy(F.col(parent).alias("parent"), F.col(node).alias("node")).agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("parent")))
