"""How well flags separate: metrics of a result, their bands, and the comparison of two results. Each is one row from a few aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import bottom_k, grouped_quantiles
from .scoring import separation

# The bands of Cohen's d, of the detection rate (percent) and of the distance between class means.
EFFECTS = ((1.2, "excellent"), (0.8, "good"), (0.5, "moderate"), (0.2, "weak"))
RATES = ((3.0, 5.0, "optimal"), (1.5, 3.0, "conservative"), (5.0, 7.0, "aggressive"))
EFFECT_POINTS = ((1.2, 4), (0.8, 3), (0.5, 2), (0.2, 1))
RATE_POINTS = ((3.0, 5.0, 4), (2.0, 6.0, 3), (1.0, 8.0, 2), (0.5, 10.0, 1))
DISTANCE_POINTS = ((2.0, 4), (1.5, 3), (1.0, 2), (0.5, 1))
STEP, LEAST_RATE, MOST_RATE = 0.1, 0.5, 10.0


def score_statistics(flags: DataFrame) -> DataFrame:
    """A row for all scores and one for those of anomalies (part: all, anomalies): n, mean, std, low, high, median, q25, q75."""
    part = F.explode(F.when(F.col("is_anomaly"), F.array(F.lit("all"), F.lit("anomalies"))).otherwise(F.array(F.lit("all"))))
    rows = flags.select(part.alias("part"), "anomaly_score")
    quartiles = grouped_quantiles(rows, ["part"], "anomaly_score", [0.5, 0.25, 0.75]).select("part", F.col("q0").alias("median"), F.col("q1").alias("q25"), F.col("q2").alias("q75"))
    one = rows.groupBy("part").agg(F.count("*").alias("n"), F.avg("anomaly_score").alias("mean"), F.stddev_pop("anomaly_score").alias("std"), F.min("anomaly_score").alias("low"), F.max("anomaly_score").alias("high"))
    both = flags.sparkSession.createDataFrame([("all",), ("anomalies",)], "part string")
    return both.join(one.join(quartiles, "part", "left"), "part", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def heatmap_sample(flags: DataFrame, key: str, most: int = 100, anomalies: int = 20, seed: int = 42) -> DataFrame:
    """``most`` rows for a picture: at most ``anomalies`` anomalies and normal rows for the rest, each class by the least md5 of (seed, key)."""
    few = min(anomalies, flags.where("is_anomaly").count())
    order = F.concat(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key).cast("string"))
    return bottom_k(flags.withColumn("_order", order), "is_anomaly", {True: few, False: max(0, most - few)}, "_order").drop("_order")


def _at_least(x: Column, bands, other) -> Column:
    out = F.lit(other)
    for least, name in reversed(bands):
        out = F.when(x >= least, name).otherwise(out)
    return out


def effect_level(d: Column) -> Column:
    return _at_least(d, EFFECTS, "poor")


def rate_level(rate: Column) -> Column:
    (a, b, best), (c, _, low), (_, d, high) = RATES
    return F.when(rate.between(a, b), best).when((rate >= c) & (rate < a), low).when((rate > b) & (rate <= d), high).otherwise("unusual")


def quality_points(x: Column, kind: str) -> Column:
    """0 to 4 for cohens_d, anomaly_rate (percent) or separation; 2 for anything else."""
    if kind == "anomaly_rate":
        out = F.lit(0)
        for a, b, points in reversed(RATE_POINTS):
            out = F.when(x.between(a, b), points).otherwise(out)
        return out
    bands = {"cohens_d": EFFECT_POINTS, "separation": DISTANCE_POINTS}.get(kind)
    return _at_least(x, bands, 0) if bands else F.lit(2)


def performance(flags: DataFrame) -> DataFrame:
    """separation() with the distance of the class means, levels and points."""
    one = separation(flags).withColumn("separation", F.coalesce(F.abs(F.col("mean_anomaly") - F.col("mean_normal")), F.lit(0.0)))
    points = [quality_points(F.col(c), c).alias(f"{c}_points") for c in ("cohens_d", "anomaly_rate", "separation")]
    return one.select("*", effect_level(F.col("cohens_d")).alias("effect"), rate_level(F.col("anomaly_rate")).alias("rate"), *points)


def comparison(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row of two performance() rows (one row each, so the join is of one pair): values before and after, changes, and an assessment."""
    names = ("n_anomalies", "anomaly_rate", "cohens_d", "separation")
    one = before.select(*[F.col(c).alias(f"before_{c}") for c in names]).crossJoin(after.select(*[F.col(c).alias(f"after_{c}") for c in names]))
    one = one.select("*", *[(F.col(f"after_{c}") - F.col(f"before_{c}")).alias(f"change_{c}") for c in names])
    good = lambda c: F.col(c).between(*RATES[0][:2])
    rate, change = F.col("after_anomaly_rate"), F.col("change_cohens_d")
    better = (change > STEP) | (good("after_anomaly_rate") & ~good("before_anomaly_rate")) | (F.col("change_separation") > 0)
    worse = (change < -STEP) | (rate > MOST_RATE) | (rate < LEAST_RATE)
    verdict = F.when(better & ~worse, "significant_improvement").when(better, "mixed_results").when(worse, "performance_degradation").otherwise("marginal_changes")
    return one.withColumn("assessment", verdict)
