"""Fuzzy line dedup by MinHash.

Every distinct line gets a signature over its character 5-shingles; lines that agree on a band of it meet, exact
Jaccard similarity of their shingle sets decides, and distributed union-find joins what is similar (0.8 or more).
Each component keeps its first line by (doc_id, line number). Lines that share a band first compare sketches of 24 bytes,
which travel with the bands (see sketches); texts travel only if their sketch is like another's. What several bands bring together
is compared once. Tasks send a line's bands once, so a line that is everywhere sends a few rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BitFilter, arrow_pass, distinct, gram_hashes, maybe_in, saved, text_bytes, text_hash
from .graph import components, linked_roots
from .sketches import BANDS, MULTIPLIERS, PACKED, SHIFTS, SKETCH, WORDS, Packer, again_hashes, band_hashes, likely_sets, unlinked_sets

#: Lines that a task remembers, so as not to send their bands again.
_SEEN = 300_000
#: Characters of pairs that are compared together; a group of more compares its lines one by one.
_TOGETHER = 1 << 20


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def shingles(line: str, k: int) -> np.ndarray:
    """64-bit hash of each k consecutive characters, repeats included; a shorter line is one shingle."""
    c = _codes(line)
    return gram_hashes(c, min(k, len(c)))


def bands(lines: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (lines x BANDS) and sketches (the low byte of each hash's minimum): the lines' shingles lie in one array."""
    low = np.empty((SKETCH, len(lines)), np.uint32)
    whole = [i for i, x in enumerate(lines) if len(x) >= k]
    grams = [gram_hashes(_codes("".join([lines[i] for i in whole])), k)] if whole else []
    at = np.cumsum([0] + [len(lines[i]) for i in whole])
    first, last = at[:-1], at[1:] - k + 1
    edges = np.stack((first, last), axis=1).ravel()
    short = [i for i, x in enumerate(lines) if len(x) < k]  # one shingle each
    grams += [shingles(lines[i], k) for i in short]
    whole_n = len(grams[0]) if whole else 0
    h = (np.concatenate(grams) >> np.uint64(32)).astype(np.uint32) if grams else np.empty(0, np.uint32)
    padded = np.append(h[:whole_n], np.uint32(0xFFFFFFFF))
    hashed, at_whole, at_short = np.empty_like(padded), np.array(whole, np.int64), np.array(short, np.int64)
    for j, (m, c) in enumerate(zip(MULTIPLIERS, SHIFTS, strict=True)):
        if whole:
            np.multiply(padded, m, out=hashed)
            hashed += c
            low[j, at_whole] = np.minimum.reduceat(hashed, edges)[::2]
        low[j, at_short] = h[whole_n:] * m + c
    return band_hashes(np.ascontiguousarray(low.T))


def _banded(lines: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """bands() of some 130,000 characters at once, whose shingles' hashes a core's cache holds."""
    out, some, size = [(np.empty((0, BANDS), np.int64), np.empty((0, SKETCH), np.uint8))], [], 0
    for line in lines:
        some.append(line.decode())
        size += len(line)
        if size > 1 << 17:
            out.append(bands(some, k))
            some, size = [], 0
    if some:
        out.append(bands(some, k))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _line_hashes(lines: list[bytes], seed: int = 0) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.array([h(x, seed) for x in lines], np.uint64).view(np.int64)


def _signer(k: int):
    """Packed rows: one for each band of each line that the task has not just seen (band, line, sketch), and one for a line that it sees again."""

    def make():
        packer = Packer()
        seen: dict[int, bool] = {}  # line -> whether it was reported again

        def f(batch):
            fresh, new, again = [], [], []
            for text in batch.column("text").to_pylist():
                for line in text.split(b"\n"):
                    if not line.strip():
                        continue
                    h = xxhash.xxh64_intdigest(line)
                    known = seen.get(h)
                    if known is None:
                        if len(seen) >= _SEEN:
                            seen.clear()
                        seen[h] = False
                        fresh.append(h)
                        new.append(line)
                    elif not known:
                        seen[h] = True
                        again.append(h)
            keys, sketches = _banded(new, k)
            words = np.repeat(np.ascontiguousarray(sketches).view(np.int64).reshape(-1, len(WORDS)), BANDS, axis=0)
            more = np.array(again, np.uint64).view(np.int64)
            lh = np.concatenate((np.repeat(np.array(fresh, np.uint64).view(np.int64), BANDS), more))
            return packer.add(np.concatenate((keys.ravel(), again_hashes(more))), lh, np.concatenate((words, np.zeros((len(more), len(WORDS)), np.int64))))

        f.last = packer.given
        return f

    return make


def _finder(likely: BitFilter, often: BitFilter):
    """Lines that may be in a likely set (with text) or repeat (without)."""

    def make():
        def f(batch):
            lines, at, places = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for no, line in enumerate(text.split(b"\n")):
                    if line.strip():
                        lines.append(line)
                        at.append(i)
                        places.append(no)
            h = _line_hashes(lines)
            with_text = likely.has(h)
            some = np.flatnonzero(with_text | often.has(h))
            found, rows = [lines[x] for x in some.tolist()], np.array(at, np.int64)[some]
            out = {"line": [x.decode() if w else None for x, w in zip(found, with_text[some].tolist(), strict=True)], "lh": h[some], "lk": _line_hashes(found, 5)}
            out |= {c: batch.column(c).take(pa.array(rows)) for c in ("doc_id", "th")}
            out["no"] = np.array(places, np.int32)[some]
            return out

        return f

    return make


#: Bits of a shingle's hash that give way to the number of its line where few lines are compared together: 52 are left.
_OWNER_BITS = 12


def _grams(lines: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and line of every shingle, repeats included."""
    sizes = np.array([len(x) for x in lines])
    owner = np.repeat(np.arange(len(lines)), sizes)
    grams, at = gram_hashes(_codes("".join(lines)), k), owner[: max(0, len(owner) - k + 1)]
    inside = at == owner[k - 1 :]
    short = np.flatnonzero(sizes < k).tolist()
    return np.concatenate([grams[inside], *[shingles(lines[i], k) for i in short]]), np.concatenate((at[inside], np.array(short, np.int64)))


def _by_shingle(grams: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle and line of every different shingle of each of at most 2**_OWNER_BITS lines, by shingle and then by line: one sort of numbers that hold both."""
    bits = np.uint64(_OWNER_BITS)
    both = distinct((grams & ~np.uint64((1 << _OWNER_BITS) - 1)) | owner.astype(np.uint64))
    return both >> bits, (both & np.uint64((1 << _OWNER_BITS) - 1)).astype(np.uint16)


def shingle_sets(lines: list[str], k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Owner and number of every different shingle of each line, by owner; shingles are numbered from 0."""
    grams, owner = _grams(lines, k)
    if len(lines) <= 1 << _OWNER_BITS and len(grams):
        kinds, owner = _by_shingle(grams, owner)
        number = np.concatenate(([0], np.cumsum(kinds[1:] != kinds[:-1])))
        order = np.argsort(owner, kind="stable")  # 16-bit numbers are sorted by their digits
        return owner[order].astype(np.int64), number[order], int(number[-1]) + 1
    kinds, number = np.unique(grams, return_inverse=True)
    both = distinct(owner * len(kinds) + number)
    return both // len(kinds), both % len(kinds), len(kinds)


def similar_pairs(lines: list[str], k: int, least: float) -> np.ndarray:
    """Which of the pairs (lines 0 and 1, 2 and 3, ...) have similarity ``least`` or more."""
    most, out = 1 << _OWNER_BITS, []
    for i in range(0, len(lines), most):
        some = lines[i : i + most]
        kinds, owner = _by_shingle(*_grams(some, k))
        pair = owner // 2
        size = np.bincount(pair, minlength=len(some) // 2)
        shared = np.bincount(pair[1:][(kinds[1:] == kinds[:-1]) & (pair[1:] == pair[:-1])], minlength=len(size))
        out.append(shared >= least * (size - shared) - 1e-9)
    return np.concatenate(out) if out else np.zeros(0, bool)


def similar_forest(ids: list[int], lines: list[str], k: int, least: float) -> list[tuple[int, int]]:
    """Links that connect what all pairs of similarity ``least`` or more connect."""
    if sum(map(len, lines)) > _TOGETHER:
        return _forest_of_long(ids, lines, k, least)
    owner, number, kinds = shingle_sets(lines, k)
    size = np.bincount(owner, minlength=len(lines))
    ends = np.cumsum(size)
    mark, out = np.zeros(kinds, np.uint8), []
    waiting, flat = np.arange(len(lines)), number  # lines that no component has, and their shingles
    queue: list[int] = []
    while len(waiting):
        x = queue.pop() if queue else int(waiting[0])
        own = number[ends[x] - size[x] : ends[x]]
        mark[own] = 1
        shared = np.add.reduceat(mark[flat], np.cumsum(size[waiting]) - size[waiting], dtype=np.int64)
        mark[own] = 0
        near = shared >= least * (size[waiting] + size[x] - shared) - 1e-9
        if near.any():
            found = waiting[near]
            flat, waiting = flat[np.repeat(~near, size[waiting])], waiting[~near]
            found = found[found != x].tolist()
            queue += found
            out += [(ids[x], ids[i]) for i in found]
    return out


def _forest_of_long(ids: list[int], lines: list[str], k: int, least: float) -> list[tuple[int, int]]:
    """similar_forest() that holds the shingles of two lines at once."""
    out, waiting, queue = [], list(range(len(lines))), []
    while waiting:
        x = queue.pop() if queue else waiting.pop(0)
        own = distinct(shingles(lines[x], k))
        left = []
        for i in waiting:
            other = distinct(shingles(lines[i], k))
            shared = len(np.intersect1d(own, other, assume_unique=True))
            if shared >= least * (len(own) + len(other) - shared) - 1e-9:
                out.append((ids[x], ids[i]))
                queue.append(i)
            else:
                left.append(i)
        waiting = left
    return out


def _verifier(k: int, least: float):
    def make():
        held: dict = {"key": None, "ids": [], "lines": []}
        pairs: dict = {"ids": [], "lines": [], "size": 0}

        def judged():
            ids, lines = pairs["ids"], pairs["lines"]
            pairs.update(ids=[], lines=[], size=0)
            good = np.flatnonzero(similar_pairs(lines, k, least)).tolist() if lines else []
            return [(ids[2 * i], ids[2 * i + 1]) for i in good]

        def close(out):
            ids, lines = held["ids"], held["lines"]
            held.update(ids=[], lines=[])
            size = sum(map(len, lines))
            if len(ids) == 2 and size <= _TOGETHER:
                pairs["ids"] += ids
                pairs["lines"] += lines
                pairs["size"] += size
                if pairs["size"] > _TOGETHER:
                    out += judged()
            elif len(ids) > 1:
                out += similar_forest(ids, lines, k, least)

        def columns(out):
            return {"u": [u for u, _ in out], "v": [v for _, v in out]}

        def f(batch):
            out: list = []
            for *key, uid, line in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "uid", "line")), strict=True):
                if key != held["key"]:
                    close(out)
                    held["key"] = key
                held["ids"].append(uid)
                held["lines"].append(line)
            return columns(out)

        def last():
            out: list = []
            close(out)
            return columns(out + judged())

        f.last = last
        return f

    return make


def _sizes(k: int):
    """Number of different shingles of each line (lh, line)."""

    def make():
        def f(batch):
            lines = batch.column("line").to_pylist()
            _, owner = _by_shingle(*_grams(lines, k))
            return {"lh": batch.column("lh"), "size": np.bincount(owner, minlength=len(lines))}

        return f

    return make


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th", "no")


def line_roots(docs: DataFrame, shingle: int = 5, least: float = 0.8, most: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Places of the lines that may repeat (line, lh, lk, doc_id, th, no), and of each different one of them (lh, lk) its first place, its copies and the root of its component.

    lh and lk are the two hashes that a line is known by. most: lines of a band that are compared each with each at once; larger bands go in order first, and then what that left unlinked meets the whole band (see sketches).
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"), text_bytes().alias("text"))
    packed = arrow_pass(texts.select("text"), _signer(shingle), PACKED, rows=200)
    met, often, wide = likely_sets(packed, most)
    found = arrow_pass(texts, _finder(BitFilter.of(met.select("lh").union(wide.select("lh")), "lh"), BitFilter.of(often, "lh")), "line string, lh long, lk long, doc_id long, th long, no int", rows=200)
    found = saved(found, "lines")
    # A line is known by two 64-bit hashes, so its text travels once to here and once to each group that compares it.
    lines = found.groupBy("lh", "lk").agg(F.first("line").alias("line"), F.min(_place()).alias("first"), F.count("*").alias("copies"))
    lines = saved(lines.withColumn("uid", F.monotonically_increasing_id()), "distinct-lines")

    def verified(met: DataFrame) -> DataFrame:
        rows = met.join(lines.where("line IS NOT NULL").select("lh", "uid", "line"), "lh").select("x", "y", "uid", "line")
        return arrow_pass(rows.repartition("x", "y").sortWithinPartitions("x", "y"), _verifier(shingle, least), "u long, v long")

    roots = components(verified(met))
    rooted = lambda: lines.join(roots, lines["uid"] == roots["node"], "left").select("lh", "lk", "first", "copies", F.coalesce("root", "uid").alias("root"))
    if not wide.isEmpty():
        crowded = lines.where("line IS NOT NULL").join(wide.select("lh").distinct(), "lh", "left_semi")
        sizes = arrow_pass(crowded.select("lh", "line"), _sizes(shingle), "lh long, size long").groupBy("lh").agg(F.min("size").alias("size"))
        more = unlinked_sets(wide, rooted().groupBy("lh").agg(F.min("root").alias("root")).join(sizes, "lh"), least=least)
        if more is not None and not (new := saved(verified(more), "new-links")).isEmpty():
            roots = saved(linked_roots(roots, new), "roots")
    return found, rooted()


def repeated_lines(docs: DataFrame, shingle: int = 5, least: float = 0.8, most: int = 4096) -> DataFrame:
    """doc_id, th (xxhash64 of the text) and gone (numbers of the lines that go, from 0) of documents that lose lines."""
    found, keyed = line_roots(docs, shingle, least, most)
    kept = keyed.groupBy("root").agg(F.min("first").alias("keep"), F.sum("copies").alias("size")).where("size > 1")
    keep = keyed.join(kept, "root").select("lh", "lk", "keep")
    lost = found.drop("line").join(keep, ["lh", "lk"]).where(~_place().eqNullSafe(F.col("keep")))
    return lost.groupBy("doc_id", "th").agg(F.collect_set("no").alias("gone"))


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines whose numbers are given."""

    @F.pandas_udf("string")
    def f(texts: pd.Series, gones: pd.Series) -> pd.Series:
        out = []
        for t, g in zip(texts, gones, strict=True):
            drop = set(g.tolist())
            out.append("\n".join([x for i, x in enumerate(t.split("\n")) if i not in drop]))
        return pd.Series(out, dtype=object)

    return f(text, gone)


def _line_count(text: str) -> Column:
    own = F.coalesce(F.col(text), F.lit(""))
    return (F.octet_length(own) - F.octet_length(F.replace(own, F.lit("\n"), F.lit(""))) + 1).cast("long")


def line_dedup(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """docs with the kept lines as text, n_lines and n_removed.

    Lines end at line feeds. Blank lines stay; of every component of similar lines the one with the smallest
    (doc_id, text hash, line number) stays, a null doc_id coming last. A null text counts as empty and stays as it is; rows that repeat
    doc_id and text are one document and get one answer each; other columns are carried along untouched (a column
    n_lines or n_removed would be replaced).
    """
    gone = saved(repeated_lines(docs, shingle, least), "gone-lines")
    maybe = maybe_in(BitFilter.of(gone, "th"))(text_hash())
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    whole = docs.where(~maybe).select(*kept, _line_count("text").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("g.doc_id")) & (text_hash("d.text") == F.col("g.th"))
    joined = docs.where(maybe).alias("d").join(gone.alias("g"), same, "left")

    def taken(rows: DataFrame, text: Column, n_removed: Column) -> DataFrame:
        own = [text.alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
        return rows.select(*own, _line_count("d.text").alias("n_lines"), n_removed.cast("long").alias("n_removed"))

    # One Python pass over the texts that lose lines: null gone, of rows that only share a hash with one, is no line.
    gone_or_none = F.coalesce(F.col("g.gone"), F.array().cast("array<int>"))
    text = F.when(F.col("d.text").isNull(), F.col("d.text")).otherwise(_without(F.coalesce("d.text", F.lit("")), gone_or_none))
    return taken(joined, text, F.size(gone_or_none)).unionByName(whole)

