"""One fitted model that cleans, bins and scores rows, old and new alike, and a call that does all of it from table to table."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import saved
from . import preprocess as P
from . import scoring as S
from . import networks as N
from .grouping import create_groups, merged_small


def _save_values(spark: SparkSession, values: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(values, default=float),)], "value string").coalesce(1).write.text(path)


def _load_values(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


@dataclass
class Cleaner:
    """What preprocessing fitted: columns that stay, fills, codes, limits and scales. Codes are saved tables, the rest a few numbers a column."""

    key: str
    columns: list[str]
    dropped: list[str] = field(default_factory=list)
    fills: dict = field(default_factory=dict)
    codes: dict[str, DataFrame] = field(default_factory=dict)
    limits: dict[str, tuple[float, float]] = field(default_factory=dict)
    scales: dict[str, tuple[float, float]] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, key: str, columns: list[str], sparse: float = 0.5, factor: float | None = 3.0, scale: bool = True) -> Cleaner:
        """Drops sparse columns, fills numbers by their median and others by their mode, encodes texts, limits outliers, scales, drops constant columns.

        Infinite values count as missing. Columns that are neither numbers nor texts are read as texts. Fewer than two columns left is an error.
        """
        out = cls(key, list(columns))
        out._drop(P.sparse_columns(df, columns, sparse))
        numbers = [c for c in out.columns if P.is_number(df, c)]
        texts = [c for c in out.columns if c not in numbers]
        out.fills = P.medians(df, numbers) | P.modes(df.select(*[F.col(c).cast("string").alias(c) for c in texts]), texts)
        for c in texts:
            own = df.select(F.coalesce(F.col(c).cast("string"), F.lit(out.fills.get(c))).alias(c))
            out.codes[c] = saved(P.label_codes(own, c), "codes")
        if factor is not None:
            out.limits = P.outlier_limits(out._filled(df), numbers, factor)
        plain = out.transform(df)
        out._drop(P.constant_columns(plain, out.columns))
        if len(out.columns) < 2:
            raise ValueError("fewer than 2 features vary")
        if scale:
            out.scales = P.scales(plain, [c for c in numbers if c in out.columns])
        return out

    def _drop(self, gone: list[str]) -> None:
        self.dropped += gone
        self.columns = [c for c in self.columns if c not in gone]

    def _filled(self, df: DataFrame) -> DataFrame:
        numbers = [c for c in self.columns if c not in self.codes]
        out = df.select(self.key, *self.columns).withColumns({c: F.col(c).cast("string") for c in self.codes if c in self.columns})
        out = out.withColumns({c: P.finite(c) for c in numbers if P.is_number(df, c)})
        return P.filled(out, {c: v for c, v in self.fills.items() if c in self.columns})

    def transform(self, df: DataFrame) -> DataFrame:
        """key and the fitted columns of old or new rows; a category that was not there is code 0."""
        out = self._filled(df)
        for c, codes in self.codes.items():
            if c in self.columns:
                out = P.encoded(out, c, codes)
        out = P.limited(out, {c: x for c, x in self.limits.items() if c in self.columns})
        return P.scaled(out, {c: x for c, x in self.scales.items() if c in self.columns})

    def save(self, spark: SparkSession, path: str) -> None:
        """Everything that was fitted, in a new folder that Spark can write."""
        values = {c: getattr(self, c) for c in ("key", "columns", "dropped", "fills", "limits", "scales")}
        _save_values(spark, values | {"codes": list(self.codes)}, f"{path}/values")
        for i, table in enumerate(self.codes.values()):
            table.write.parquet(f"{path}/codes-{i}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Cleaner:
        values = _load_values(spark, f"{path}/values")
        codes = {c: spark.read.parquet(f"{path}/codes-{i}") for i, c in enumerate(values.pop("codes"))}
        pairs = {k: {c: tuple(x) for c, x in values.pop(k).items()} for k in ("limits", "scales")}
        return cls(codes=codes, **values, **pairs)

    def summary(self, spark) -> DataFrame:
        """column_name, state (kept or dropped), fill, scaled and encoded of each column."""
        rows = [(c, "kept" if c in self.columns else "dropped", None if self.fills.get(c) is None else str(self.fills[c]), c in self.scales, c in self.codes) for c in [*self.columns, *self.dropped]]
        return spark.createDataFrame(rows, "column_name string, state string, fill string, scaled boolean, encoded boolean")


@dataclass
class Model:
    """Frozen edges, pattern frequencies (or conditional tables), centre and threshold over a plan's groups."""

    plan: S.Plan
    edges: dict[str, tuple]
    table: DataFrame | None
    how: str
    weights: list[float] | None
    centre: tuple[float, float] | None
    threshold: float | None
    places: int | None = None
    tables: N.ConditionalTables | None = None
    cut: dict = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, plan: S.Plan, how: str = "mean", weights: list[float] | None = None, zscore: bool = True, method: str = "percentile", share: float = 5.0, deviations: float = 2.0, places: int | None = None, likelihood: str = "pattern", structure: str = "hc", most_parents: int = 3) -> Model:
        """places: decimals that scores are rounded to before they meet the threshold, so that equal patterns tie.

        likelihood: pattern (frequencies of whole patterns), or cpd (conditional tables of networks that learn_structures() finds by ``structure``).
        """
        edges, table, tables = S.fitted_edges(df, plan.columns), None, None
        if likelihood == "cpd":
            binned = saved(S.bin_columns(df, plan.columns, plan.bins, edges).select(*plan.columns), "bins")
            tables = N.ConditionalTables.fit(binned, N.learn_structures(binned, plan.groups, structure, most_parents), plan.bins)
        else:
            table = S.frequency_table(df, plan, edges)
        cut = {"method": method, "share": share, "deviations": deviations}
        out = cls(plan, edges, table, how, weights, (0.0, 0.0) if zscore else None, None, places, tables, cut)
        return out._settled(saved(out.likelihoods(df), "likelihoods"))

    def _settled(self, ll: DataFrame) -> Model:
        """With the centre and threshold of saved likelihoods."""
        out = replace(self, centre=S.centre(ll, self.plan, self.how, self.weights) if self.centre is not None else None)
        return replace(out, threshold=S.threshold_value(out._scored(ll), **self.cut))

    def updated(self, df: DataFrame, threshold: float | None = None, **changes) -> Model:
        """A model with other how, weights, method, share, deviations or places: edges and frequencies stay, centre and threshold follow from df.

        threshold: a value to use as it is.
        """
        cut = self.cut | {k: changes.pop(k) for k in list(changes) if k in self.cut}
        out = replace(self, cut=cut, **changes)._settled(saved(self.likelihoods(df), "likelihoods"))
        return out if threshold is None else replace(out, threshold=threshold)

    def likelihoods(self, df: DataFrame) -> DataFrame:
        """key and a score for each group."""
        if self.tables is None:
            return S.log_likelihoods(df, self.plan, self.table, self.edges)
        binned = S.bin_columns(df, self.plan.columns, self.plan.bins, self.edges)
        return binned.select(self.plan.key, *[self.tables.log_likelihood(i).alias(c) for i, c in enumerate(self.plan.scores)])

    def _scored(self, ll: DataFrame) -> DataFrame:
        out = S.anomaly_scores(ll, self.plan, self.how, self.weights, self.centre is not None, self.centre)
        return out if self.places is None else out.withColumn("anomaly_score", F.round("anomaly_score", self.places))

    def score(self, df: DataFrame) -> DataFrame:
        """key, group scores, anomaly_score, threshold and is_anomaly of old or new rows: nothing is fitted again."""
        at = F.lit(self.threshold).cast("double")
        return self._scored(self.likelihoods(df)).withColumn("threshold", at).withColumn("is_anomaly", F.col("anomaly_score") > at)

    def save(self, spark: SparkSession, path: str) -> None:
        """Everything that was fitted, in a new folder that Spark can write."""
        values = {c: getattr(self, c) for c in ("edges", "how", "weights", "centre", "threshold", "places", "cut")}
        values |= {"key": self.plan.key, "groups": self.plan.groups, "bins": self.plan.bins, "networks": None}
        if self.tables is not None:
            values["networks"] = [[g, n, ps, self.tables.cells[g, n]] for g, net in self.tables.networks.items() for n, ps in net.items()]
        _save_values(spark, values, f"{path}/values")
        if self.table is not None:
            self.table.write.parquet(f"{path}/frequencies")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        v = _load_values(spark, f"{path}/values")
        plan, tables = S.Plan(v.pop("key"), v.pop("groups"), v.pop("bins")), None
        if (nodes := v.pop("networks")) is not None:
            nets: dict = {g: {} for g, *_ in nodes}
            for g, n, ps, _ in nodes:
                nets[g][n] = ps
            tables = N.ConditionalTables(plan.bins, nets, {(g, n): cells for g, n, _, cells in nodes})
        v["edges"] = {c: tuple(x) for c, x in v["edges"].items()}
        v["centre"] = None if v["centre"] is None else tuple(v["centre"])
        return cls(plan=plan, table=None if tables else spark.read.parquet(f"{path}/frequencies"), tables=tables, **v)


def detect(df: DataFrame, key: str, columns: list[str], size: int = 3, bins: int = 5, grouping: str = "correlation", **scoring) -> tuple[Cleaner, Model, DataFrame]:
    """Clean, group, fit and score a table: the fitted parts, and the scored rows with the columns that explanations() and performance() read.

    grouping: a strategy of create_groups(); scoring: what Model.fit() takes. The key and columns are saved first: cleaning reads them
    some ten times, and df may be an aggregate that each time would shuffle the whole input.
    """
    df = saved(df.select(key, *columns), "input")
    cleaner = Cleaner.fit(df, key, columns)
    clean = saved(cleaner.transform(df), "clean")
    groups = merged_small(create_groups(clean, cleaner.columns, size, {"linked": "correlation"}.get(grouping, grouping)), 2)
    model = Model.fit(clean, S.Plan(key, groups, bins), **scoring)
    return cleaner, model, saved(model.score(clean), "scored")
