"""Benchmark decontamination by winnowing.

Of every window of ``window`` words, the smallest hash among its k-grams is kept (the leftmost of equal ones), so every passage of
``window`` words or more that a document has in common with an item carries the same fingerprint at the same place on both sides.
Document fingerprints first meet a bitmap of the item fingerprints (16 MB at most), so only likely hits are shuffled; those join
the items on the fingerprint and are extended: words left and right of the fingerprint's place are compared, as far as a
window that holds it can reach, and a common run of ``window`` words or more is hit. Items of fewer words are one
fingerprint of their own length.

A fingerprint that items hold between many different words would pair each of its documents with all of those. Beyond
``contexts`` of them, its windows are cut out on both sides and joined on their words, which gives the same windows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BitFilter, arrow_pass, distinct, gram_hashes, joined_dealt, mix, saved, text_bytes, text_hash, window_minima, word_hashes

#: Lower-cases A-Z and turns every other ASCII character but digits and letters into a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_ANCHORS = "array<struct<fp:bigint,n:int,p:int,at:int,w:array<string>>>"


def _anchors(words: list[bytes], window: int, gram: int, lengths: list[int], whole: bool, maybe):
    """(fp, n, p, at, w) of the fingerprints that pass maybe(): the window's length, the place, and the words that windows reach, fp at ``at``. whole: an item's own."""
    n = len(words)
    if not n:
        return []
    h, out = word_hashes(words), []
    if n >= window:
        g = gram_hashes(h, gram)
        p = distinct(window_minima(g, window - gram + 1))
        out = [(window, gram, p, g[p])]
    for k in ([n] if n < window else []) if whole else lengths:
        if k <= n:
            out.append((k, k, np.arange(n - k + 1), mix(gram_hashes(h, k) + np.uint64(k))))
    found = []
    for size, k, places, fps in out:
        likely = maybe(fps)
        for p, fp in zip(places[likely].tolist(), fps[likely].view(np.int64).tolist(), strict=True):
            first = max(0, p - size + k)
            found.append((fp, size, p, p - first, [x.decode() for x in words[first : p + size]]))
    return found


def _scanner(window, gram, lengths, whole, bits: BitFilter | None):
    maybe = bits.has if bits else lambda fp: np.ones(len(fp), bool)

    def make():
        def f(batch):
            n_words, anchors = [], []
            for text in batch.column("text").to_pylist():
                words = text.translate(WORD_BYTES).split()
                n_words.append(len(words))
                anchors.append([dict(zip(("fp", "n", "p", "at", "w"), x, strict=True)) for x in _anchors(words, window, gram, lengths, whole, maybe)])
            return {"uid": batch.column("uid"), "id": batch.column("id"), "th": batch.column("th"), "n_words": n_words, "anchors": anchors}

        return f

    return make


def _scan(df: DataFrame, key: str, kind: str, name: str, *args) -> DataFrame:
    rows = df.select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast(kind).alias("id"), text_hash().alias("th"), text_bytes().alias("text"))
    return saved(arrow_pass(rows, _scanner(*args), f"uid long, id {kind}, th long, n_words long, anchors {_ANCHORS}"), name)


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, gram: int = 7, contexts: int = 16) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document.

    A word is hit inside any occurrence of an item's window; a document is contaminated if it has a hit and
    at least 5 % of its words are hit. Null and empty texts have no words, hit nothing and are clean; items
    without words or without id have no windows; item ids may be of any type and sort as strings; rows that repeat each get their row; other columns are ignored.
    contexts: different surroundings of a fingerprint among items up to which its hits are extended.
    """
    return _judged(docs, items, window, gram, contexts).drop("th")


def clean_documents(docs: DataFrame, items: DataFrame, window: int = 13, gram: int = 7) -> DataFrame:
    """The rows of docs that contamination() does not call contaminated, with all their columns; rows are told apart by doc_id and text."""
    bad = _judged(docs, items, window, gram).where("contaminated").select("doc_id", "th").distinct()
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("b.doc_id")) & (text_hash("d.text") == F.col("b.th"))
    return docs.alias("d").join(bad.alias("b"), same, "left_anti")


def _agreeing(x: Column, y: Column) -> Column:
    """How many first entries of two arrays without nulls are equal."""
    unlike = F.array_position(F.zip_with(x, y, lambda a, b: a.eqNullSafe(b)), F.lit(False))
    return F.when(unlike == 0, F.size(x)).otherwise(unlike - 1).cast("int")


def _extended(anchors: DataFrame, wanted: DataFrame, hot: int) -> DataFrame:
    """uid, s, n and items of the common runs of n words or more around equal fingerprints."""
    met = joined_dealt(anchors, wanted.withColumnsRenamed({"at": "i_at", "w": "i_w"}), ["fp", "n"], "uid", hot)
    before = _agreeing(F.reverse(F.expr("slice(w, 1, at)")), F.reverse(F.expr("slice(i_w, 1, i_at)")))
    after = _agreeing(F.expr("slice(w, at + 1, size(w))"), F.expr("slice(i_w, i_at + 1, size(i_w))"))
    met = met.withColumn("before", before).withColumn("after", after).where("before + after >= n")
    return met.select("uid", (F.col("p") - F.col("before")).alias("s"), (F.col("before") + F.col("after")).alias("n"), "items")


def _by_words(anchors: DataFrame, wanted: DataFrame, hot: int) -> DataFrame:
    """The same by joining on the words of the windows that lie in w."""
    start = F.explode(F.expr("sequence(0, size(w) - n)")).alias("o")
    cut = F.array_join(F.expr("slice(w, o + 1, n)"), " ").alias("win")
    long_enough = F.expr("size(w) >= n")
    own = anchors.where(long_enough).select("uid", "n", "p", "at", "w", start).select("uid", "n", (F.col("p") - F.col("at") + F.col("o")).alias("s"), cut)
    theirs = wanted.where(long_enough).select("n", "w", "items", start).select("n", cut, F.explode("items").alias("id"))
    return joined_dealt(own, theirs.groupBy("n", "win").agg(F.collect_set("id").alias("items")), ["n", "win"], "uid", hot).select("uid", "s", "n", "items")


def _judged(docs: DataFrame, items: DataFrame, window: int, gram: int, contexts: int = 16, hot: int = 100_000) -> DataFrame:
    """hot: document fingerprints of one value that a task takes at most."""
    items = items.where(F.col("item_id").isNotNull())
    item_rows = _scan(items, "item_id", "string", "item-anchors", window, gram, [], True, None)
    lengths = [r["n_words"] for r in item_rows.where((F.col("n_words") > 0) & (F.col("n_words") < window)).select("n_words").distinct().collect()]  # under 13 numbers
    wanted = item_rows.select("id", F.explode("anchors").alias("a")).groupBy("a.fp", "a.n", "a.at", "a.w").agg(F.collect_set("id").alias("items"))
    wanted = saved(wanted, "item-contexts")
    bits = BitFilter.of(wanted, "fp")
    scanned = _scan(docs, "doc_id", "long", "doc-anchors", window, gram, sorted(lengths), False, bits)
    anchors = scanned.select("uid", F.explode("anchors").alias("a")).select("uid", "a.*")
    wide = wanted.groupBy("fp", "n").count().where(F.col("count") > contexts).drop("count")
    if wide.isEmpty():
        found = _extended(anchors, wanted, hot)
    else:
        wide, on = saved(wide, "wide-fingerprints"), ["fp", "n"]
        found = _extended(anchors, wanted.join(wide, on, "left_anti"), hot)
        of_wide = joined_dealt(anchors, wide, on, "uid", hot)
        found = found.unionByName(_by_words(of_wide, wanted.join(wide, on, "left_semi"), hot))
    per_doc = found.groupBy("uid").agg(F.collect_set(F.struct("s", "n")).alias("spans"), F.collect_set("items").alias("sets"))
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["s"], x["s"] + x["n"] - 1)))))
    names = F.array_sort(F.array_distinct(F.flatten("sets")))
    scored = per_doc.select("uid", hit.cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"))
    zero = F.lit(0).cast("long")
    return (
        scanned.select("uid", F.col("id").alias("doc_id"), "th", "n_words")
        .join(scored, "uid", "left")
        .select("doc_id", "th", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )
