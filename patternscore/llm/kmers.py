"""What the two substring operators share: windows travel to their minimiser's bucket in super-k-mers.

A window is ``k`` consecutive symbols (words or bytes); its minimiser is the smallest hash among its m-grams.
Consecutive windows with one minimiser form a super-k-mer of at most k - m + 1 windows. Equal windows have equal
minimisers, so a minimiser met once in the corpus has no repeated window: its windows never travel. The others go
as packed strings, merged with their copies before the shuffle, to the bucket of their minimiser, where a
``counter`` finds the repeated windows. A bucket of over ``bucket`` different strings is dealt again: its strings are cut into
super-k-mers of the next, longer gram, and in the end into single windows, so no bucket grows with the corpus. Documents are
known by doc_id and a hash of their text; the texts that hold candidates are found with a bitmap of bounded size and joined exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BitFilter, arrow_pass, covered, dropped, saved, signed, text_bytes

_KEY = ["doc_id", "th"]
_SPAN = "array<struct<a:int,b:int>>"


@dataclass(frozen=True)
class Scheme:
    """How a text is a sequence of symbols."""

    k: int
    split: Callable[[bytes], object]  # a text's symbols, with a len()
    cuts: tuple[Callable[[object], tuple[np.ndarray, np.ndarray, np.ndarray]], ...]  # super-k-mers by ever longer grams: start, number of windows, hash
    pack: Callable[[object, int, int], bytes]  # symbols of a range as one string
    counter: Callable[[list[bytes], list[int]], list[list[tuple[int, int]]]]  # bucket's distinct strings and their counts -> ranges of repeated windows
    bucket: int = 2048  # most different strings of a bucket


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), text_bytes().alias("text"))


def _packed_hash(packed: bytes) -> int:
    ph = xxhash.xxh64_intdigest(packed, 7)
    return ph - ((ph >> 63) << 64)


def _scanner(s: Scheme):
    def make():
        def f(batch):
            out = {k: [] for k in ("doc_id", "th", "mini", "ph", "start", "n")}
            rows = list(zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), batch.column("text"), strict=True))
            for doc, th, text in rows:
                symbols = s.split(text.as_py())
                start, n, mini = s.cuts[0](symbols)
                if len(start):
                    out["ph"] += [_packed_hash(s.pack(symbols, a, b)) for a, b in zip(start.tolist(), (start + n + (s.k - 1)).tolist(), strict=True)]
                    out["doc_id"] += [doc] * len(start)
                    out["th"] += [th] * len(start)
                    out["mini"].append(signed(mini))
                    out["start"].append(start.astype(np.int32))
                    out["n"].append(n.astype(np.int32))
            for c in ("mini", "start", "n"):
                out[c] = np.concatenate(out[c]) if out[c] else np.empty(0, np.int64)
            return out

        return f

    return make


def _keeper(s: Scheme, bits: BitFilter, join: bytes, every: bool):
    """Untouched documents get their result at once; the text goes on only where a candidate may be (or everywhere)."""

    def make():
        def f(batch):
            hit = [True] * len(batch) if every else bits.has(batch.column("th").to_numpy()).tolist()
            texts = batch.column("text").to_pylist()
            done = [(None, None, None) if h else finish_text(s, t, None, join) for h, t in zip(hit, texts, strict=True)]
            return {
                "doc_id": batch.column("doc_id"), "th": batch.column("th"), "size": [x[0] for x in done], "kept_sha256": [x[2] for x in done],
                "text": [t if h else None for h, t in zip(hit, texts, strict=True)],
            }

        return f

    return make


def _packer(s: Scheme):
    def make():
        def f(batch):
            out = {k: [] for k in ("mini", "ph", "packed")}
            for text, marks in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                symbols = s.split(text)
                for m in marks:
                    for c, v in zip(out, (m["mini"], m["ph"], s.pack(symbols, m["start"], m["start"] + m["n"] + s.k - 1)), strict=True):
                        out[c].append(v)
            return out

        return f

    return make


def _cutter(s: Scheme, level: int):
    """Strings of a bucket that is too large, cut by the gram of a level; beyond the last gram each window is a string."""

    def make():
        def f(batch):
            out = {k: [] for k in ("mini", "ph", "a", "mini2", "ph2", "packed", "c")}
            for mini, ph, packed, c in zip(*(batch.column(x).to_pylist() for x in ("mini", "ph", "packed", "c")), strict=True):
                symbols = s.split(packed)
                if level < len(s.cuts):
                    start, n, new = s.cuts[level](symbols)
                    cuts = zip(start.tolist(), n.tolist(), signed(new).tolist(), strict=True)
                else:
                    cuts = ((i, 1, None) for i in range(len(symbols) - s.k + 1))
                for a, n, new in cuts:
                    part = s.pack(symbols, a, a + n + s.k - 1)
                    own = _packed_hash(part)
                    for x, v in zip(out, (mini, ph, a, own if new is None else new, own, part, c), strict=True):
                        out[x].append(v)
            return out

        return f

    return make


def _bucketer(s: Scheme):
    """Rows arrive by minimiser; each bucket's strings are counted together."""

    def make():
        held: dict = {"mini": None, "rows": []}

        def count(out):
            rows, held["rows"] = held["rows"], []
            if len(rows) == 1 and rows[0][2] < 2:
                return
            for (ph, _, _), spans in zip(rows, s.counter([r[1] for r in rows], [r[2] for r in rows]), strict=True):
                if spans:
                    out["mini"].append(held["mini"])
                    out["ph"].append(ph)
                    out["spans"].append([{"a": a, "b": b} for a, b in spans])

        def f(batch):
            out = {"mini": [], "ph": [], "spans": []}
            for mini, ph, packed, c in zip(*(batch.column(x).to_pylist() for x in ("mini", "ph", "packed", "c")), strict=True):
                if mini != held["mini"]:
                    count(out)
                    held["mini"] = mini
                held["rows"].append((ph, packed, c))
            return out

        def last():
            out = {"mini": [], "ph": [], "spans": []}
            count(out)
            return out

        f.last = last
        return f

    return make


def finish_text(s: Scheme, text: bytes, spans, join: bytes):
    """Size, symbols removed, digest of what is kept and number of removed runs."""
    symbols = s.split(text)
    n = len(symbols)
    if not spans:
        kept = s.pack(symbols, 0, n)
        return n, 0, hashlib.sha256(kept).hexdigest(), 0, kept
    gone = covered(n, np.array([x["a"] for x in spans]), np.array([x["b"] for x in spans]))
    edges = np.flatnonzero(np.diff(np.concatenate(([1], gone, [1])).astype(np.int8)))
    parts = [s.pack(symbols, a, b) for a, b in edges.reshape(-1, 2).tolist()]
    kept = join.join(parts)
    return n, int(gone.sum()), hashlib.sha256(kept).hexdigest(), int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum()), kept


def _finisher(s: Scheme, join: bytes, with_text: bool):
    def make():
        def f(batch):
            rows = [finish_text(s, t, p, join) for t, p in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            out = {"doc_id": batch.column("doc_id"), "th": batch.column("th")}
            return out | {c: [r[i] for r in rows] for i, c in enumerate(("size", "n_removed", "kept_sha256", "n_spans", "kept")) if with_text or c != "kept"}

        return f

    return make


def repeats_of(strings: DataFrame, s: Scheme, bucket: int, level: int = 1) -> DataFrame:
    """mini, ph, spans (ranges of repeated windows) of the strings (mini, ph, packed, c) of all buckets that hold any."""
    sizes = saved(strings.groupBy("mini").count().where(F.col("count") > bucket).select("mini"), "large-buckets") if level <= len(s.cuts) else None
    split = sizes is not None and not sizes.isEmpty()
    own = strings.join(sizes, "mini", "left_anti") if split else strings
    found = arrow_pass(own.repartition("mini").sortWithinPartitions("mini"), _bucketer(s), f"mini long, ph long, spans {_SPAN}")
    if not split:
        return saved(found, "repeats")
    cut = arrow_pass(strings.join(sizes, "mini", "left_semi"), _cutter(s, level), "mini long, ph long, a int, mini2 long, ph2 long, packed binary, c long", rows=50)
    cut = saved(cut, "cut-strings")
    parts = cut.groupBy(F.col("mini2").alias("mini"), F.col("ph2").alias("ph"), "packed").agg(F.sum("c").alias("c"))
    below = repeats_of(saved(parts, "strings"), s, bucket, level + 1).select(F.col("mini").alias("mini2"), F.col("ph").alias("ph2"), "spans")
    moved = F.transform("spans", lambda x: F.struct((F.col("a") + x["a"]).alias("a"), (F.col("a") + x["b"]).alias("b")))
    above = cut.select("mini", "ph", "a", "mini2", "ph2").join(below, ["mini2", "ph2"]).groupBy("mini", "ph").agg(F.flatten(F.collect_set(moved)).alias("spans"))
    return saved(found.unionByName(above), "repeats")


def remove_repeats(docs: DataFrame, s: Scheme, join: bytes, bucket: int | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, size, n_removed, kept_sha256, n_spans (and kept, the remaining text in UTF-8 bytes, if with_text) of each document."""
    bucket, texts = bucket or s.bucket, _texts(docs)
    supers = saved(arrow_pass(texts, _scanner(s), "doc_id long, th long, mini long, ph long, start int, n int", rows=25), "super-kmers")
    met = saved(supers.groupBy("mini").agg(F.count("*").alias("c")).where("c > 1").select("mini"), "minimisers")
    marked = saved(supers.join(met, "mini").groupBy(*_KEY).agg(F.collect_set(F.struct("start", "n", "mini", "ph")).alias("marks")), "marks")
    dropped(supers, met)
    bits = BitFilter.of(marked, "th")
    scan = saved(arrow_pass(texts, _keeper(s, bits, join, with_text), "doc_id long, th long, size long, kept_sha256 string, text binary", rows=100), "texts")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in _KEY]
    held = scan.where("text IS NOT NULL")
    cand = saved(held.alias("l").join(marked.alias("r"), same, "left").select("l.doc_id", "l.th", "l.text", "r.marks"), "candidates")
    dropped(marked)
    # Copies of one string are merged before they travel, so a bucket's size is its number of different strings.
    packed = arrow_pass(cand.where("marks IS NOT NULL").select("text", "marks"), _packer(s), "mini long, ph long, packed binary", rows=4)
    strings = saved(packed.groupBy("mini", "ph", "packed").agg(F.count("*").alias("c")), "strings")
    repeats = repeats_of(strings, s, bucket)
    dropped(strings)
    spots = cand.select(*_KEY, F.explode("marks").alias("m")).select("m.mini", "m.ph", *_KEY, "m.start")
    ranges = spots.join(repeats, ["mini", "ph"]).select(*_KEY, F.transform("spans", lambda x: F.struct((F.col("start") + x["a"]).alias("a"), (F.col("start") + x["b"] + (s.k - 1)).alias("b"))).alias("spans"))
    spans = ranges.groupBy(*_KEY).agg(F.flatten(F.collect_set("spans")).alias("spans"))
    joined = cand.alias("l").join(spans.alias("r"), same, "left").select("l.doc_id", "l.th", "l.text", "r.spans")
    columns = "doc_id long, th long, size long, n_removed long, kept_sha256 string, n_spans long" + ", kept binary" * with_text
    touched = arrow_pass(joined, _finisher(s, join, with_text), columns, rows=100).drop("th")
    if with_text:
        return touched  # the scan passed every text on
    rest = scan.where("text IS NULL").select("doc_id", "size", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(0).cast("long").alias("n_spans"))
    return touched.unionByName(rest)
