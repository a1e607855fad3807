"""Spelling variants: words one edit apart, by an even-partition pigeonhole join.

A word of length l is indexed under its two halves. One edit leaves one half of the shorter word (or of either, if they are equally
long) as it is, so a word meets all its near words if it looks up the halves of its own length at their places, and those of words one shorter
with the second half shifted by one. A group of words under one half is cut on: what is not yet matched is halved in turn, so
pairs that agree in one half only by chance are never looked at one by one. Groups of more than ``most`` rows are cut so by Spark, the
rest within tasks.

A pair could be met twice (where the inserted character repeats its neighbour); it counts where the second half was matched only if
the common beginning of both words ends before that half starts, so each pair counts once and tasks can add up what they find.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, mix, saved

#: Runs of letters in UTF-8, A-Z lower-cased: A-Z, a-z and U+00C0 to U+00FF.
_LETTER = rb"(?:[a-z]|\xc3[\x80-\xbf])"
#: Words held by a task before it hands on their counts, and characters of words that it compares at once.
_HELD, _CHARS = 300_000, 8_000_000
_SMALL = 8


def _counter(least: int, damage):
    run = re.compile(_LETTER + b"{%d,}" % least)

    def make():
        held: Counter = Counter()

        def emptied():
            out = {"word": [w.decode() for w in held], "n": list(held.values())}
            held.clear()
            return out

        def f(batch):
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text.lower()  # bytes: A-Z only
                found = Counter(run.findall(text) if len(text) < 1 << 22 else (m.group() for m in run.finditer(text)))
                for word, n in found.items():
                    word = damage(doc, word) if damage else word
                    if word is not None:
                        held[word] += n
                if len(held) > _HELD:
                    yield emptied()

        f.last = emptied
        return f

    return make


def word_counts(docs: DataFrame, least: int = 7, damage=None) -> DataFrame:
    """word, n: runs of ``least`` letters and more in whole texts, A-Z lower-cased, with their number.

    damage(doc_id in bytes, run in bytes) may change a run; it gives None for one that does not count. Null texts have no words; a null
    doc_id is empty; rows that repeat count again.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary").alias("doc"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    return arrow_pass(rows, _counter(least, damage), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _halves(rows: DataFrame) -> DataFrame:
    """Rows with an unmatched stretch (from ``at``; ``rest`` characters of the shorter word) under each of its halves.

    long: the row is the longer word, whose stretch has one character more; bound: see the module's docstring.
    """
    h = F.expr("rest div 2")
    more = F.col("long").cast("int")
    piece = lambda start, n: F.substring("word", start + 1, n)
    one = F.struct(
        F.xxhash64("key", F.lit(1), piece(F.col("at"), h)).alias("key"), (F.col("at") + h).alias("at"), (F.col("rest") - h).alias("rest"), F.col("bound").alias("bound"),
    )
    two = F.struct(
        F.xxhash64("key", F.lit(2), piece(F.col("at") + h + more, F.col("rest") - h)).alias("key"), F.col("at").alias("at"), h.alias("rest"), F.least(F.col("bound"), F.col("at") + h).alias("bound"),
    )
    return rows.select("word", "n", "size", "long", F.explode(F.array(one, two)).alias("x")).select("word", "n", "size", "long", "x.*")


def segments(words: DataFrame, most: int = 100_000) -> DataFrame:
    """word, n, size (length of the shorter words of the group), long, key, at, rest, bound: every word under its halves."""
    base = words.select("word", "n", F.explode(F.array(F.lit(False), F.lit(True))).alias("long"))
    base = base.withColumn("size", F.length("word") - F.col("long").cast("int"))
    rows = _halves(base.select("word", "n", "size", "long", F.xxhash64("size").alias("key"), F.lit(0).alias("at"), F.col("size").alias("rest"), (F.col("size") + 1).alias("bound")))
    while True:
        wide = saved(rows.where("rest > 1").groupBy("key").agg(F.count("*").alias("c"), F.sum(F.length("word")).alias("chars")).where((F.col("c") > most) | ((F.col("chars") > _CHARS) & (F.col("c") > 2))).select("key"), "wide")
        if wide.isEmpty():
            return rows
        rows = saved(rows.join(wide, "key", "left_anti").unionByName(_halves(rows.join(wide, "key", "left_semi"))), "segments")


def _folded(keys: np.ndarray, columns: np.ndarray) -> np.ndarray:
    for i in range(columns.shape[1]):
        keys = mix(keys + columns[:, i].astype(np.uint64) + np.uint64(1))
    return keys


def _near(m: np.ndarray, x: np.ndarray, y: np.ndarray, long: np.ndarray, size: int, bound: int) -> np.ndarray:
    """Whether rows x (short) and y of the letters m are one edit apart and begin alike for less than ``bound`` characters."""
    a, b = m[x], m[y]
    equal = a[:, :size] == b[:, :size]
    begin = np.where(equal.all(axis=1), size, (~equal).argmax(axis=1))
    near = ~long[y] & (equal.sum(axis=1) == size - 1)
    if (longer := np.flatnonzero(long[y])).size:
        shifted = a[longer, :size] == b[longer, 1:]
        end = np.where(shifted.all(axis=1), size, (~shifted)[:, ::-1].argmax(axis=1))
        near[longer] = begin[longer] + end >= size
    return near & (begin < bound)


def pairs_within(m: np.ndarray, long: np.ndarray, key: np.ndarray, size: int, at: int, rest: int, bound: int):
    """Row numbers of near words (x is never the longer one) in groups of equal keys. m: letters, a row each, shorter words end in a 0."""
    todo, xs, ys = [(np.arange(len(m)), key, at, rest, bound)], [], []

    def compare(x, y, bound):
        for i in range(0, len(x), step := max(1, 2_000_000 // (size + 1))):
            near = _near(m, x[i : i + step], y[i : i + step], long, size, bound)
            xs.append(x[i : i + step][near])
            ys.append(y[i : i + step][near])

    while todo:
        rows, key, at, rest, bound = todo.pop()
        order = np.lexsort((long[rows], key))
        rows, key = rows[order], key[order]
        starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        for g in range(2, _SMALL + 1):
            if not len(some := starts[sizes == g]):
                continue
            grid = rows[some[:, None] + np.arange(g)]
            for i in range(g - 1):
                if len(own := grid[~long[grid[:, i]]]):
                    for j in range(i + 1, g):
                        compare(own[:, i], own[:, j], bound)
        large = np.repeat(sizes > _SMALL, sizes)
        if not large.any():
            continue
        if rest <= 1:  # a group has no more rows than there are letters, or pairs of letters
            for s, g in zip(starts[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist(), strict=True):
                own = rows[s : s + g]
                for i in range(int((~long[own]).sum())):
                    compare(np.full(g - i - 1, own[i]), own[i + 1 :], bound)
            continue
        rows, key, h = rows[large], key[large], rest // 2
        shift = long[rows]
        todo.append((rows, _folded(mix(key + np.uint64(1)), m[rows, at : at + h]), at + h, rest - h, bound))
        ends = np.where(shift[:, None], m[rows, at + h + 1 : at + rest + 1], m[rows, at + h : at + rest])
        todo.append((rows, _folded(mix(key + np.uint64(2)), ends), at, h, min(bound, at + h)))
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *xs]), np.concatenate([empty, *ys])


_FOUND = "word string, n long, near long, best_n long, best string"


def _best(words: list[str], n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict:
    """For each word with near ones: how many, and the one of largest n (of ties the least)."""
    a, b = np.concatenate((x, y)), np.concatenate((y, x))
    order = np.lexsort((*m.T[::-1], -n))
    rank = np.empty(len(n), np.int64)
    rank[order] = np.arange(len(n))
    first = np.full(len(n), len(n))
    np.minimum.at(first, a, rank[b])
    count = np.bincount(a, minlength=len(n))
    own = np.flatnonzero(count)
    best = order[first[own]]
    return {"word": [words[i] for i in own.tolist()], "n": n[own], "near": count[own], "best_n": n[best], "best": [words[i] for i in best.tolist()]}


def _joiner():
    """Rows arrive by key; whole groups are compared together, by (size, at, rest, bound)."""
    names = ("key", "size", "at", "rest", "bound", "long", "word", "n")

    def make():
        held: list = []

        def compared(rows):
            kind = np.stack([rows[c] for c in ("size", "at", "rest", "bound")], axis=1)
            kinds, of = np.unique(kind, axis=0, return_inverse=True)
            order = np.argsort(of.ravel(), kind="stable")
            ends = np.cumsum(np.bincount(of.ravel(), minlength=len(kinds)))
            for (size, at, rest, bound), a, b in zip(kinds.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                own = order[a:b]
                words, n, long = [rows["word"][i] for i in own.tolist()], rows["n"][own], rows["long"][own]
                letters = "".join(w.ljust(size + 1, "\0") for w in words).encode("latin-1")
                m = np.frombuffer(letters, np.uint8).reshape(len(words), size + 1)
                x, y = pairs_within(m, long, rows["key"][own].view(np.uint64), size, at, rest, bound)
                if len(x):
                    yield _best(words, n, m, x, y)

        def joined():
            out = {c: np.concatenate([h[c] for h in held]) for c in names if c != "word"}
            return out | {"word": [w for h in held for w in h["word"]]}

        def f(batch):
            one = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names if c != "word"} | {"word": batch.column("word").to_pylist()}
            held.append(one)
            if sum(len(h["key"]) for h in held) < 100_000 and sum(sum(map(len, h["word"])) for h in held) < _CHARS:
                return
            rows = joined()
            cut = int(np.searchsorted(rows["key"], rows["key"][-1]))  # the last group may go on
            held[:] = [{c: v[cut:] for c, v in rows.items()}]
            if cut:
                yield from compared({c: v[:cut] for c, v in rows.items()})

        def last():
            parts = list(compared(joined())) if held else []
            return {c: [v for p in parts for v in p[c]] for c in ("word", "n", "near", "best_n", "best")} if parts else None

        f.last = last
        return f

    return make


def near_words(words: DataFrame, most: int = 100_000) -> DataFrame:
    """word, n, near (number of words one edit apart), best_n and best (the near word of largest n, of ties the least), of words (word, n) that differ."""
    keyed = segments(words, most).select("key", "size", "at", "rest", "bound", "long", "word", "n")
    found = arrow_pass(keyed.repartition("key").sortWithinPartitions("key"), _joiner(), _FOUND)
    none = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), "best"))).alias("b")
    return found.union(none).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("near"), best).select("word", "n", "near", (-F.col("b.m")).alias("best_n"), "b.best")


def variants(words: DataFrame, ratio: int = 10, most: int = 100_000) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n).

    form: the near word of largest n, of ties the least by code points, if that n is ``ratio`` times the word's at least; root: where forms
    lead to from the word. n grows by ``ratio`` with each step, so a few rounds of doubling reach every root. Words hold letters up to U+00FF.
    """
    form = F.col("best_n") >= ratio * F.col("n")
    own = saved(near_words(words, most).select("word", F.when(form, F.col("best")).alias("form"), "n", F.col("near").alias("n_near"), F.when(form, F.col("best_n")).alias("form_n")), "variants")
    steps = saved(own.where("form IS NOT NULL").select("word", F.col("form").alias("to")), "steps")
    while True:
        on = steps.select(F.col("word").alias("to"), F.col("to").alias("next"))
        new = saved(steps.join(on, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "steps")
        steps = new.select("word", "to")
        if new.where("moved").isEmpty():
            break
    return own.join(steps, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def deleted_letter(doc: bytes, run: bytes) -> bytes | None:
    """A run without one letter where 31 divides the crc32 of '<doc_id>:<run>' (the contract's misspellings); None if it is left with under 7 letters."""
    h = zlib.crc32(run, zlib.crc32(doc + b":"))
    if h % 31:
        return run
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode() if len(letters) > 7 else None
