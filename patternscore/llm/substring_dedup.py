"""Substring dedup on words: windows of 35 words, counted exactly in the bucket of their minimiser."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame

from .common import gram_hashes, window_minima, word_hashes
from .kmers import Scheme, remove_repeats


def _super_kmers(words: list[bytes], k: int, m: int):
    if len(words) < k:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64)
    g = gram_hashes(word_hashes(words), m)
    at = window_minima(g, k - m + 1)
    start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return start, np.diff(np.append(start, len(at))), g[at[start]]


def _pack(words: list[bytes], a: int, b: int) -> bytes:
    return b" ".join(words[a:b])


def ranges_of(flags: list[bool]) -> list[tuple[int, int]]:
    out, since = [], None
    for i, x in enumerate([*flags, False]):
        if x and since is None:
            since = i
        elif not x and since is not None:
            out.append((since, i))
            since = None
    return out


def count_windows(strings: list[bytes], counts: list[int], k: int) -> list[list[tuple[int, int]]]:
    """Sort a bucket's windows and mark those that occur twice; a string that came more than once is all repeats."""
    if len(strings) == 1:
        return [[(0, strings[0].count(b" ") + 2 - k)] if counts[0] > 1 else []]
    windows = []
    for i, (text, c) in enumerate(zip(strings, counts, strict=True)):
        w = text.split(b" ")
        windows += [(b" ".join(w[j : j + k]), c, i, j) for j in range(len(w) - k + 1)]
    windows.sort()
    twice: list[list[int]] = [[] for _ in strings]
    for x, w in enumerate(windows):
        if w[1] > 1 or x and windows[x - 1][0] == w[0] or x + 1 < len(windows) and windows[x + 1][0] == w[0]:
            twice[w[2]].append(w[3])
    out = []
    for js in twice:
        flags = [False] * (max(js) + 1 if js else 0)
        for j in js:
            flags[j] = True
        out.append(ranges_of(flags))
    return out


def substring_dedup(docs: DataFrame, window: int = 35, gram: int = 8, with_text: bool = False) -> DataFrame:
    """Remove every word that a window covers whose words also start anywhere else, in this or another document.

    Words are runs of anything but space and tab to carriage return. Returns doc_id, n_words, n_removed and kept_sha256
    (kept words joined by one space) of each document, and the kept text with ``with_text``. Null and empty texts have no words;
    rows that repeat each other count as two occurrences and each get their row; other columns are ignored.
    """
    cuts = tuple(partial(_super_kmers, k=window, m=m) for m in (gram, (gram + window) // 2))
    scheme = Scheme(window, bytes.split, cuts, _pack, partial(count_windows, k=window))
    out = remove_repeats(docs, scheme, b" ", with_text=with_text).withColumnRenamed("size", "n_words")
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", *(["n_spans", out["kept"].cast("string").alias("text")] if with_text else []))
