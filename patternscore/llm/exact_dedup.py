"""Exact dedup with an extendible-hash index on shared files.

The directory is a set of key ranges, one a bucket: it doubles while a bucket holds more than ``bucket_rows`` different keys, bit by
bit and as deep as the keys go. Tasks merge copies of a text before the shuffle, so a text that fills a third
of the corpus sends one row a task. Each owner task holds the buckets of a range of keys, chains texts whose 64-bit key is equal,
compares their bytes and writes its part of the index (one row per distinct text, without the text, sorted by bucket and key) to the
shared folder. Documents then find their bucket in the directory and their group in the bucket.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, arrow_pass, joined_dealt, saved, text_hash

#: A directory has about so many buckets at most, so that it stays small wherever it is sent: larger corpora have larger buckets.
_BUCKETS = 1 << 15
#: Bits of the first look at the keys, and of each further look at the buckets that are still too full.
_FIRST_BITS, _MORE_BITS = 16, 4


def split(counts: np.ndarray, bucket_rows: int) -> tuple[list[int], list[int]]:
    """Of slots with so many keys each, the first slots of buckets by repeated halving, and the single slots that are too full."""
    below = np.concatenate(([0], np.cumsum(counts)))
    starts, full, todo = [], [], [(0, len(counts))]
    while todo:
        a, b = todo.pop()
        if below[b] - below[a] <= bucket_rows:
            starts.append(a)
        elif b - a == 1:
            full.append(a)
        else:
            todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
    return starts, full


def build_directory(keys: DataFrame, bucket_rows: int) -> np.ndarray:
    """Ascending first keys (unsigned) of the buckets of different keys (column h): bucket i holds the keys from entry i to the next."""
    starts, over, bits = [], [0], 0
    while over:
        more = min(64 - bits, _MORE_BITS if bits else _FIRST_BITS)
        rows = keys
        if bits:  # few: each holds over bucket_rows keys
            full = F.broadcast(keys.sparkSession.createDataFrame(pa.table({"p": pa.array(over, pa.int64())})))
            rows = keys.join(full, F.shiftrightunsigned("h", 64 - bits) == F.col("p"), "left_semi")
        bits += more
        slots = rows.groupBy(F.shiftrightunsigned("h", 64 - bits).alias("slot")).count().collect()  # at most 2**more rows for each of over
        counts = {r["slot"] % 2**64: r["count"] for r in slots}
        below, over = over, []
        for p in below:
            first, full = split(np.array([counts.get((p << more) + i, 0) for i in range(1 << more)]), bucket_rows)
            if bits == 64:  # a single key
                first, full = first + full, []
            starts += [((p << more) + i) << (64 - bits) for i in first]
            over += [(p << more) + i for i in full]
    return np.array(sorted(starts), np.uint64)


def bucket_of(directory: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (np.searchsorted(directory, h.view(np.uint64), side="right") - 1).astype(np.int32)


def _bucket(directory: np.ndarray, h: str) -> Column:
    @F.pandas_udf("int")
    def f(x: pd.Series) -> pd.Series:
        return pd.Series(bucket_of(directory, x.to_numpy(np.int64)))

    return f(h)


def _better(a: tuple, b: tuple) -> bool:
    """Of (length, doc_id, hash of the text): the longer text first, then the smaller doc_id (null comes last), then the smaller hash."""
    return (-a[0], a[1] is None, a[1] or 0, a[2]) < (-b[0], b[1] is None, b[1] or 0, b[2])


def _merger(directory: np.ndarray, most_bytes: int):
    def make():
        held: dict[bytes, list] = {}
        size = [0]

        def flush():
            if not held:
                return None
            rows = list(held.values())
            h = np.array([r[0] for r in rows], np.int64)
            out = {"bucket": bucket_of(directory, h), "h": h, "norm": list(held), "copies": [r[2] for r in rows]}
            out |= {c: [r[1][i] for r in rows] for i, c in enumerate(("n", "doc_id", "th"))}
            held.clear()
            size[0] = 0
            return out

        def f(batch):
            for h, norm, *own in zip(*(batch.column(c).to_pylist() for c in ("h", "norm", "n", "doc_id", "th")), strict=True):
                if (r := held.get(norm)) is None:
                    held[norm] = [h, own, 1]
                    size[0] += len(norm) + 300
                else:
                    r[2] += 1
                    if _better(own, r[1]):
                        r[1] = own
            return flush() if size[0] > most_bytes else None

        f.last = flush
        return f

    return make


_INDEX = ("bucket", "h", "chain", "sha", "keep_n", "keep_id", "keep_th", "group_size")


def _owner():
    """Rows arrive by bucket and key: the chain of one key holds each distinct text once."""
    chain: list[list] = []
    at: list = [None, None]

    def take(out):
        for i, (norm, own, copies) in enumerate(chain):
            for k, v in zip(_INDEX, (*at, i, hashlib.sha256(norm).hexdigest(), *own, copies), strict=True):
                out[k].append(v)
        chain.clear()

    def f(batch):
        out = {k: [] for k in _INDEX}
        for bucket, h, norm, copies, *own in zip(*(batch.column(c).to_pylist() for c in ("bucket", "h", "norm", "copies", "n", "doc_id", "th")), strict=True):
            if h != at[1]:
                take(out)
                at[:] = bucket, h
            for e in chain:
                if e[0] == norm:
                    e[2] += copies
                    if _better(own, e[1]):
                        e[1] = own
                    break
            else:
                chain.append([norm, own, copies])
        return out

    def last():
        out = {k: [] for k in _INDEX}
        take(out)
        return out

    f.last = last
    return f


def exact_dedup(docs: DataFrame, bucket_rows: int = 4096, merge_bytes: int = 32 << 20, owner_chars: int = 64 << 20, hot_rows: int = 100_000) -> DataFrame:
    """Of texts that are equal without white space (space, tab to carriage return), the longest stays, then the smallest doc_id.

    Returns a row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).
    A null text is empty, and all empty texts are one group. A null doc_id comes after all others; of different texts of one
    doc_id and length the one with the smaller xxhash64 stays, and rows
    that repeat a doc_id together with its text get the same answer. Other columns are ignored; no rows, no result rows.
    bucket_rows: keys that a bucket holds before it splits; more where the directory would pass its size.
    owner_chars: characters of different texts that an owner task is to read; owners are as many as the session's shuffle
    partitions at least, and beyond those no more than buckets.
    hot_rows: copies of one text beyond which their rows are dealt over several tasks when they look up the index.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).alias("n"), text_hash().alias("th"), F.translate(text, SPACES, "").alias("norm"))
    base = base.withColumn("h", F.xxhash64("norm"))
    keyed = saved(base.select("doc_id", "n", "th", "h", F.sha2("norm", 256).alias("sha")), "keys")
    keys = saved(keyed.groupBy("h").agg(F.max("n").alias("n")), "different-keys")
    size = keys.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("chars")).first()
    directory = build_directory(keys.select("h"), max(bucket_rows, 2 * size["keys"] // _BUCKETS))
    merged = arrow_pass(base.withColumn("norm", F.col("norm").cast("binary")), _merger(directory, merge_bytes), "bucket int, h long, norm binary, n int, doc_id long, th long, copies long")
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owners = max(least, min(len(directory), -(-size["chars"] // owner_chars)))
    owner = F.expr(f"bucket * {owners}L div {len(directory)}")
    owned = (merged.repartition(owners, owner) if owners > least else merged.repartition(owner)).sortWithinPartitions("bucket", "h")
    index = saved(arrow_pass(owned, _owner, "bucket int, h long, chain int, sha string, keep_n int, keep_id long, keep_th long, group_size long"), "exact-index")
    found = joined_dealt(keyed.withColumn("bucket", _bucket(directory, "h")), index.drop("chain"), ["bucket", "h", "sha"], "doc_id", hot_rows)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n")) & (F.col("th") == F.col("keep_th"))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))
