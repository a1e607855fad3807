"""Helpers shared by the corpus operators: shared tables, Arrow passes, word hashes and fixed-size bit filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import dropped, dropped_since, mark, new_path, saved, shared_dir  # noqa: F401

#: Rows and bytes in an Arrow batch: texts can be long, and the JVM keeps batches outside its heap.
ARROW_ROWS, ARROW_BYTES = "1000", str(2 << 20)
#: The characters that separate words and that exact dedup deletes.
SPACES = " \t\n\x0b\f\r"


def arrow_pass(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | Iterator[dict] | None]], schema: str, rows: int | None = None) -> DataFrame:
    """mapInArrow with a function from a batch to columns, or to an iterator of such; make() runs once a task and may keep state.

    rows: f gets slices of a batch of at most so many rows, which bounds what it returns at once. The size of Arrow batches
    is a setting of the session that Spark reads when the plan runs, so it stays as set here.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    target = _arrow_schema(df.sparkSession, schema)

    def each(out):
        return [out] if isinstance(out, dict) else out or ()

    def outputs(f, batches):
        for b in batches:
            for i in range(0, len(b), rows or max(1, len(b))):
                yield from each(f(b.slice(i, rows or len(b))))
        last = getattr(f, "last", None)
        if last is not None:
            yield from each(last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in outputs(make(), batches):
            yield pa.RecordBatch.from_arrays([out[x.name].cast(x.type) if isinstance(out[x.name], pa.Array) else pa.array(out[x.name], x.type) for x in target], schema=target)

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def text_bytes(col: str = "text") -> Column:
    """The whole text in UTF-8; null is empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def text_hash(col: str = "text") -> Column:
    """64-bit hash of the whole text, which tells rows of one doc_id apart; null is empty."""
    return F.xxhash64(F.coalesce(F.col(col), F.lit("")))


_P = 0x9E3779B97F4A7C15  # odd multiplier


def word_hashes(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w) for w in words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive entries of h."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    p = np.uint64(_P)
    for i in range(k):
        out *= p
        out += h[i : i + n]
    return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    high = x >> np.uint64(32)
    x = x ^ high
    for _ in range(2):  # in place, as new arrays take longer than the sums
        x *= np.uint64(0xD6E8FEB86659FD93)
        high = np.right_shift(x, np.uint64(32), out=high if isinstance(high, np.ndarray) else None)
        x ^= high
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The different entries of x, sorted (np.unique goes through a hash table, which takes many times as long)."""
    x = np.sort(x)
    return x[np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1]))]


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive entries."""
    n, size = len(a) - w + 1, 1
    if n <= 0:
        return a[:0]
    while size * 2 <= w:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[:n], a[w - size : w - size + n])


def window_minima(g: np.ndarray, w: int) -> np.ndarray:
    """Place of the minimum of every w consecutive entries of g; of equal minima, one and the same for all windows that hold it."""
    if len(g) < w:
        return np.empty(0, np.int64)
    order = np.argsort(g, kind="stable")
    rank = np.empty(len(g), np.int64)
    rank[order] = np.arange(len(g))
    return order[sliding_min(rank, w)]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true entries."""
    d = np.diff(np.concatenate(([0], flags.view(np.int8) if flags.dtype == bool else flags.astype(np.int8), [0])))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the ranges."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, np.minimum(starts, n), 1)
    np.add.at(d, np.minimum(ends, n), -1)
    return np.cumsum(d[:n]) > 0


def dealt_in_blocks(rows: DataFrame, keys: list[str], item: str, block: int) -> DataFrame:
    """in_blocks(), dealt and sorted by (keys, pair)."""
    return in_blocks(rows, keys, item, block).repartition(*keys, "pair").sortWithinPartitions(*keys, "pair")


def in_blocks(rows: DataFrame, keys: list[str], item: str, block: int) -> DataFrame:
    """Rows with a column pair, such that any two rows of a key share some pair.

    A key of more than ``block`` rows is cut into blocks by the hash of ``item``; each pair of blocks is a group
    of its own, so no group passes a few blocks however many rows a key has.
    """
    large = rows.groupBy(*keys).count().where(F.col("count") > block).select(*keys, F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    placed = rows.join(large, keys, "left").withColumn("b", F.pmod(F.xxhash64(item), F.coalesce("blocks", F.lit(1))).cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, F.col("b")) * F.col("blocks") + F.greatest(o, F.col("b")))
    pairs = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(met)
    return placed.select(*rows.columns, F.explode(pairs).alias("pair"))


def joined_dealt(rows: DataFrame, table: DataFrame, keys: list[str], item: str, most: int = 100_000, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """rows.join(table, keys, how), how being inner or left, where no task takes all rows of a frequent key.

    A key of more than ``most`` rows (or of more than a 10,000th of all rows, if that is more) is dealt by the hash of ``item`` over
    parts of about so many rows, and the table's rows of that key are repeated for each part. So there are under 10,000
    such keys however large the input, and they go to all tasks. Keys are not null. Table has few rows a key, and no columns
    of rows but the keys; parts and part are column names of neither. counts: rows by key (keys, count) where they are known.
    """
    n = rows.count()
    most = max(most, n // 10_000)
    if n <= most:
        return rows.join(table, keys, how)
    by_key = counts if counts is not None else rows.groupBy(*keys).count()
    hot = saved(by_key.where(F.col("count") > most).select(*keys, F.ceil(F.col("count") / most).cast("int").alias("parts")), "frequent-keys")
    if hot.isEmpty():
        return rows.join(table, keys, how)
    parts = F.coalesce("parts", F.lit(1))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("part", F.pmod(F.xxhash64(item), parts).cast("int")).drop("parts")
    repeated = table.join(F.broadcast(hot), keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return dealt.join(repeated, [*keys, "part"], how).drop("part")


class BitFilter:
    """A set of 64-bit hashes kept as a bitmap: about 32 bits a hash, from 8 KB to ``most`` bits (16 MB).

    It answers "maybe" or "no" and so only spares the exact join that always follows from rows that
    cannot match. Beyond its largest size it fills, spares less and stays right.
    """

    def __init__(self, bits: np.ndarray, log2: int):
        self.bits, self.log2 = bits, log2

    @classmethod
    def of(cls, df: DataFrame, column: str, most: int = 27) -> BitFilter:
        """Of a bigint column of a table that is cheap to read twice; at most 2**most / 64 pairs of numbers reach the driver."""
        rows = df.where(F.col(column).isNotNull())
        log2 = min(most, max(16, (32 * rows.count()).bit_length()))
        slot = F.pmod(F.col(column), F.lit(1 << log2))
        words = rows.select(slot.alias("s")).groupBy(F.expr("s div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("b")).toArrow()
        bits = np.zeros(1 << (log2 - 6), np.uint64)
        bits[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
        return cls(bits, log2)

    def has(self, h: np.ndarray) -> np.ndarray:
        s = h.astype(np.uint64, copy=False) & np.uint64((1 << self.log2) - 1)
        return ((self.bits[s >> np.uint64(6)] >> (s & np.uint64(63))) & np.uint64(1)).astype(bool)


def maybe_in(bits: BitFilter):
    """A pandas UDF: whether a bigint may be in the set."""

    @F.pandas_udf("boolean")
    def f(h: pd.Series) -> pd.Series:
        return pd.Series(bits.has(h.to_numpy(np.int64)))

    return f
