"""Profiling and cleaning of a wide table.

Fitted values are bounded aggregates that the driver sees (a few numbers a column), so fitting reads the rows once or twice and
applying is a projection. Rows that repeat count as often as they stand there; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import exact_quantiles, first_row, running_total

_NUMBERS = ("double", "float", "bigint", "int", "smallint", "tinyint")


def is_number(df: DataFrame, c: str) -> bool:
    kind = df.schema[c].dataType.simpleString()
    return kind in _NUMBERS or kind.startswith("decimal")


def missing_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n_missing and share of each column, from one pass. NaN counts as missing."""
    one = df.agg(F.count("*").alias("n_rows"), *[F.count(F.when(missing(df, c), 1)).alias(f"c{i}") for i, c in enumerate(columns)])
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("n_missing")) for i, c in enumerate(columns)])
    return one.select("n_rows", F.inline(each)).select("column_name", "n_missing", F.round(F.try_divide("n_missing", "n_rows"), 6).alias("share"))


def table_profile(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_columns, n_numeric, n_categorical (strings), n_missing, missing_percent, columns_with_missing, sparse_columns (over half missing)."""
    kinds = [is_number(df, c) for c in df.columns]
    texts = sum(df.schema[c].dataType.simpleString() == "string" for c in df.columns)
    one = df.agg(F.count("*").alias("n_rows"), *[F.count(F.when(missing(df, c), 1)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    gone = [F.col(f"c{i}") for i in range(len(df.columns))]
    total = sum(gone, F.lit(0).cast("long"))
    with_any = sum(((g > 0).cast("long") for g in gone), F.lit(0).cast("long"))
    sparse = sum(((2 * g > F.col("n_rows")).cast("long") for g in gone), F.lit(0).cast("long"))
    percent = F.round(F.coalesce(F.try_divide(100 * total, F.col("n_rows") * len(df.columns)), F.lit(0.0)), 6)
    counts = {"n_columns": len(df.columns), "n_numeric": sum(kinds), "n_categorical": texts}
    return one.select("n_rows", *[F.lit(v).cast("long").alias(k) for k, v in counts.items()], total.alias("n_missing"), percent.alias("missing_percent"), with_any.alias("columns_with_missing"), sparse.alias("sparse_columns"))


def missing(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType.simpleString()
    return F.col(c).isNull() | (F.isnan(c) if kind in ("double", "float") else F.lit(False))


def sparse_columns(df: DataFrame, columns: list[str], most: float = 0.5) -> list[str]:
    """Columns of which more than the share ``most`` is missing."""
    n = first_row(df, *[F.avg(missing(df, c).cast("double")) for c in columns]) if columns else []
    return [c for c, share in zip(columns, n, strict=True) if share is not None and share > most]


def drop_sparse(df: DataFrame, columns: list[str], most: float = 0.5) -> DataFrame:
    return df.drop(*sparse_columns(df, columns, most))


def finite(c: str) -> Column:
    """Infinite and NaN values become null."""
    return F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c))


def infinite_to_zero(c: str) -> Column:
    return F.when(F.abs(F.col(c)) == float("inf"), 0.0).otherwise(F.col(c))


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a missing value in ``columns``: the last resort."""
    gone = F.lit(False)
    for c in columns:
        gone = gone | missing(df, c)
    return df.where(~gone)


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    return {c: q[0] for c, q in exact_quantiles(df.select(*[finite(c).alias(c) for c in columns]), columns, [0.5]).items()}


def filled(df: DataFrame, values: dict) -> DataFrame:
    """Missing values replaced; columns without a value stay."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items() if v is not None})


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    return filled(df.withColumns({c: finite(c) for c in columns}), medians(df, columns))


def modes(df: DataFrame, columns: list[str]) -> dict:
    """The most frequent value of each column, of ties the smallest: all columns of a type in one shuffle of partial counts; the driver sees one value each."""
    out: dict = {c: None for c in columns}
    for kind in {df.schema[c].dataType.simpleString() for c in columns}:
        own = [c for c in columns if df.schema[c].dataType.simpleString() == kind]
        each = F.array(*[F.struct(F.lit(i).alias("i"), F.when(~missing(df, c), F.col(c)).alias("v")) for i, c in enumerate(own)])
        counts = df.select(F.inline(each)).where("v IS NOT NULL").groupBy("i", "v").agg(F.count("*").alias("n"))
        for r in counts.groupBy("i").agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("m")).collect():  # a row for each column
            out[own[r["i"]]] = r["m"]["v"]
    return out


def impute_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    """The most frequent value, of ties the smallest."""
    return filled(df, modes(df, columns))


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """value and code of each distinct value, from 0 in code-point order; null is the text 'nan'."""
    values = df.select(F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias("value")).distinct()
    return running_total(values, ["value"], F.lit(1), "code").select("value", (F.col("code") - 1).alias("code"))


def encoded(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """The column's values replaced by their codes; a value without a code is 0. Codes with few values are broadcast by their size."""
    own = F.coalesce(F.col(f"d.`{column}`").cast("string"), F.lit("nan"))
    joined = df.alias("d").join(codes.select(F.col("value").alias("_v"), F.col("code").alias("_c")).alias("k"), own == F.col("k._v"), "left")
    return joined.select(*[F.coalesce("k._c", F.lit(0).cast("long")).alias(c) if c == column else F.col(f"d.`{c}`") for c in df.columns])


def label_encode(df: DataFrame, column: str) -> DataFrame:
    return encoded(df, column, label_codes(df, column))


def outlier_limits(df: DataFrame, columns: list[str], factor: float = 3.0) -> dict[str, tuple[float, float]]:
    """[Q1 - factor * IQR, Q3 + factor * IQR] of each column that has values; quartiles interpolate."""
    found = exact_quantiles(df, columns, [0.25, 0.75])
    return {c: (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)) for c, (q1, q3) in found.items() if q1 is not None}


def limited(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(a)), F.lit(b))) for c, (a, b) in limits.items()})


def clip_outliers(df: DataFrame, columns: list[str], factor: float = 3.0) -> DataFrame:
    """Values limited to [Q1 - factor * IQR, Q3 + factor * IQR]; quartiles interpolate."""
    return limited(df, outlier_limits(df, columns, factor))


def scales(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation (0 counts as 1) of each column that has values."""
    row = first_row(df, *[f for c in columns for f in (F.avg(c), F.stddev_pop(c))]) if columns else []
    return {c: (row[2 * i], row[2 * i + 1] or 1.0) for i, c in enumerate(columns) if row[2 * i] is not None}


def scaled(df: DataFrame, by: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in by.items()})


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation; a deviation of 0 counts as 1."""
    return scaled(df, scales(df, columns))


def constant_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns of one value or none."""
    row = first_row(df, *[F.coalesce(F.min(c) == F.max(c), F.lit(True)) for c in columns]) if columns else []
    return [c for c, same in zip(columns, row, strict=True) if same]


def drop_constant(df: DataFrame, columns: list[str]) -> DataFrame:
    left = [c for c in columns if c not in set(constant_columns(df, columns))]
    if len(left) < 2:
        raise ValueError("fewer than 2 features vary")
    return df.select(*[c for c in df.columns if c not in columns or c in left])


def summary(df: DataFrame, column: str) -> DataFrame:
    """One row: n, mean, std, low, high, q25, median, q75 of a column."""
    r = lambda c: F.round(c, 6)
    quartiles = exact_quantiles(df, [column], [0.25, 0.5, 0.75])[column]
    one = df.agg(F.count(column).alias("n"), r(F.avg(column)).alias("mean"), r(F.stddev_pop(column)).alias("std"), F.min(column).alias("low"), F.max(column).alias("high"))
    return one.select("*", *[r(F.lit(q).cast("double")).alias(n) for q, n in zip(quartiles, ("q25", "median", "q75"), strict=True)])


def fingerprint(df: DataFrame) -> Column:
    """A 64-bit hash of all columns; nulls count, zeros of either sign are one."""
    plain = [F.col(f"`{c}`") + F.lit(0.0) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes]
    return F.xxhash64(*plain, *[F.col(f"`{c}`").isNull() for c in df.columns])


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of rows that repeat an earlier row, all columns compared; nulls equal nulls.

    Fingerprints are counted first; only rows whose fingerprint occurs again are compared as a whole, so wide rows travel only if they
    (or, rarely, their fingerprints alone) repeat. df is read twice.
    """
    again = df.select(fingerprint(df).alias("_f")).groupBy("_f").agg(F.count("*").alias("_c")).where("_c > 1").select("_f")
    rows = df.withColumn("_f", fingerprint(df)).join(again, "_f", "left_semi").drop("_f")
    return rows.groupBy(*[f"`{c}`" for c in rows.columns]).agg(F.count("*").alias("_c")).agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("n_duplicates"))
