"""Reading wide tables and writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A table to be scored has at least so many columns and rows.
LEAST_COLUMNS, LEAST_ROWS = 2, 10


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV file with a header; 'inf', 'NaN' and blanks are read as numbers and nulls, which inference would get wrong."""
    return spark.read.schema(schema).options(header=True, nanValue="NaN", positiveInf="inf", negativeInf="-inf", nullValue="").csv(path)


# Texts that stand for a missing value, and what numbers, infinities, truth values and times look like.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
WHOLE, ZEROS = r"^\s*[+-]?[0-9]{1,18}\s*$", r"^\s*[+-]?0[0-9]"
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
INFINITE = r"^\s*[+-]?(inf|Inf|INF|infinity|Infinity|INFINITY)\s*$"
TRUTH = r"^(True|TRUE|true|False|FALSE|false)$"
TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?$"


def column_types(texts: DataFrame, times: bool = False, zeros: bool = True) -> dict[str, str]:
    """The narrowest type of each column of texts that all its values have: boolean, bigint, double, timestamp (if ``times``), else string.

    One pass over all rows: a column's aggregate says which types its values so far allow, and those of tasks merge by 'and'. Missing values
    allow all types, and a column without values is double. zeros: whether numbers may begin with a zero before a digit; else such a column is text.
    """
    value = lambda c: F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`"))

    def allows(c: str) -> list[Column]:
        x = value(c)
        number = x.rlike(NUMBER) & (F.lit(zeros) | ~x.rlike(ZEROS))
        return [x.rlike(TRUTH), x.rlike(WHOLE) & number, number | x.rlike(INFINITE), x.rlike(TIME) if times else F.when(x.isNotNull(), F.lit(False))]

    row = texts.agg(*[f for c in texts.columns for f in (F.count(value(c)), *[F.bool_and(a) for a in allows(c)])]).first()
    out = {}
    for i, c in enumerate(texts.columns):
        n, *good = row[5 * i : 5 * i + 5]
        out[c] = "double" if not n else next((t for t, ok in zip(("boolean", "bigint", "double", "timestamp"), good, strict=True) if ok), "string")
    return out


def read_any_csv(spark: SparkSession, path: str, times: bool = False, zeros: bool = True, lines: bool = False) -> DataFrame:
    """A CSV file with a header and any columns, typed by column_types(); missing values are null, quotes in quoted fields are doubled.

    The file is read twice: for the types, and by whoever uses the result. lines: whether quoted fields may hold line ends; a file is then read by one task.
    """
    texts = spark.read.options(header=True, escape='"', multiLine=lines, emptyValue="", nullValue="\u0000").csv(path)  # a header and no inference: texts
    types = column_types(texts, times, zeros)

    def typed(c: str) -> Column:
        x = F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`"))
        if types[c] == "double":
            plain = F.regexp_replace(F.lower(F.trim(x)), "^([+-]?)inf(inity)?$", "$1Infinity")
            return F.regexp_replace(plain, r"^\+", "").cast("double").alias(c)
        return (x if types[c] == "string" else F.trim(x).cast(types[c])).alias(c)

    return texts.select(*[typed(c) for c in texts.columns])


def validated(df: DataFrame) -> DataFrame:
    """df, if it has enough columns and rows; looks at ten rows at most."""
    if len(df.columns) < LEAST_COLUMNS:
        raise ValueError(f"{len(df.columns)} columns; {LEAST_COLUMNS} are needed")
    if df.limit(LEAST_ROWS).count() < LEAST_ROWS:
        raise ValueError(f"fewer than {LEAST_ROWS} rows")
    return df


def write_results(flags: DataFrame, path: str, form: str = "parquet") -> None:
    """Scores, flags and group scores, as parquet or as CSV with a header."""
    writer = flags.write.mode("errorifexists")
    writer.option("header", True).csv(path) if form == "csv" else writer.format(form).save(path)
