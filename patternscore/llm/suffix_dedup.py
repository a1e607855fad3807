"""Substring dedup on bytes: strings of 400 bytes that start twice, found in suffix arrays.

Windows of one minimiser meet in its bucket (see kmers). There the strings are cut into blocks aligned to the
minimiser and blocks are numbered by their bytes, so equal windows have equal whole blocks. The suffix array of the
numbers, built by linear grouping, and its longest common prefixes put windows of equal blocks in one group; a window is
repeated if another of its group, at the same place of a block, also has the bytes (under two blocks) that stick out at its ends.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame

from .common import mix, sliding_min
from .kmers import Scheme, remove_repeats
from .substring_dedup import ranges_of


def suffix_array(t: list[int]) -> list[int]:
    """Suffix array of t, whose last entry must be its only smallest.

    First every suffix joins the group of its Lyndon prefix: groups are handled in descending order, and each member's
    previous smaller suffix moves to a new group just above its own. Then the groups' own order follows from one
    pass over the array being filled: a placed suffix places its left neighbour and that one's previous smaller suffixes.
    """
    n = len(t)
    group, members = [0] * n, {}
    for i, c in enumerate(t):
        members.setdefault(c, []).append(i)
    order = sorted(members)
    lists = [members[c] for c in order]
    for g, m in enumerate(lists):
        for i in m:
            group[i] = g
    below, above = [g - 1 for g in range(len(lists))], [g + 1 for g in range(len(lists))]
    above[-1] = -1
    done, previous = [False] * len(lists), [-1] * n
    g = len(lists) - 1
    while g >= 0:
        done[g] = True  # members of g count as not smaller than each other
        hits: dict[int, int] = {}
        for i in sorted(i for i in lists[g] if group[i] == g):
            j = i - 1
            while j >= 0 and done[group[j]]:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for j, times in hits.items():
            moves.setdefault((-times, group[j]), []).append(j)
        for key in sorted(moves):  # more repeats first: later ones slip in below
            old, new = key[1], len(lists)
            lists.append(moves[key])
            done.append(False)
            up = above[old]
            below.append(old)
            above.append(up)
            above[old] = new
            if up >= 0:
                below[up] = new
            for j in moves[key]:
                group[j] = new
        g = below[g]
    sizes = [0] * len(lists)
    for g in group:
        sizes[g] += 1
    free, at, g = [0] * len(lists), 0, 0
    while g >= 0:
        free[g] = at
        at += sizes[g]
        g = above[g]
    out, placed = [-1] * n, [False] * n
    out[0], placed[n - 1] = n - 1, True
    free[group[n - 1]] += 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = True
            s = previous[s]
    return out


def common_prefixes(t: list[int], sa: list[int]) -> tuple[list[int], list[int]]:
    """Rank of each suffix, and for each rank what its suffix has in common with the one before."""
    n = len(t)
    rank, out, h = [0] * n, [0] * n, 0
    for r, i in enumerate(sa):
        rank[i] = r
    for i in range(n):
        if rank[i]:
            j = sa[rank[i] - 1]
            while i + h < n and j + h < n and t[i + h] == t[j + h]:
                h += 1
            out[rank[i]] = h
            if h:
                h -= 1
        else:
            h = 0
    return rank, out


def byte_grams(text: bytes, m: int) -> np.ndarray:
    """Hash of every m (a power of two) consecutive bytes."""
    h = np.frombuffer(text, np.uint8).astype(np.uint64)
    p, size = 0x9E3779B97F4A7C15, 1
    h = (h + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    while size < m:
        h = h[:-size] * np.uint64(p) + h[size:]
        p, size = p * p % 2**64, size * 2
    return mix(h)


def _super_kmers(text: bytes, k: int, m: int):
    if len(text) < k:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64)
    g, w = byte_grams(text, m), k - m + 1
    low = sliding_min(g, w)
    edges = np.append(np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1]))), len(low)).tolist()
    start = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        at = np.flatnonzero(g[a : b + w - 1] == low[a])
        start.append(a)
        if len(at) > 1:  # windows past one place of the minimum belong to the next
            start += [a + int(x) + 1 for x in at[:-1] if a + x + 1 < b]
    start = np.array(start)
    return start, np.diff(np.append(start, len(low))), low[start]


def repeated_windows(strings: list[bytes], counts: list[int], k: int, m: int, block: int = 16) -> list[list[tuple[int, int]]]:
    """Ranges of window starts whose k bytes occur in another string of the bucket, or in a string that came more than once."""
    if len(strings) == 1:
        return [[(0, len(strings[0]) - k + 1)] if counts[0] > 1 else []]
    names: dict[bytes, int] = {}
    t, first, shift = [], [], []
    for i, s in enumerate(strings):
        r = int(np.argmin(byte_grams(s[:k], m))) % block
        first.append(len(t))
        shift.append(r)
        t += [len(strings) + names.setdefault(s[a : a + block], len(names) + 1) for a in range(r, len(s) - block + 1, block)]
        t.append(i + 1)  # ends this string's matches
    t.append(0)
    rank, common = common_prefixes(t, suffix_array(t))
    rank, common = np.array(rank), np.array(common)
    groups, shared = {}, {}  # for a number of blocks: group of each suffix, and whether it has company
    for blocks in {max(0, (k - x) // block) for x in range(block)}:
        own = np.cumsum(common < blocks)[rank] if blocks else np.zeros(len(t), np.int64)
        groups[blocks], shared[blocks] = own, np.bincount(own)[own] > 1
    seen: dict[tuple[int, bytes], int] = {}
    likely = []
    for s, f, r in zip(strings, first, shift, strict=True):
        p = np.arange(len(s) - k + 1)
        b = np.where(p <= r, 0, -((r - p) // block))
        ahead = r + b * block - p  # bytes of the window before its first whole block
        number = np.maximum(0, k - ahead) // block
        places, keys = [], []
        for blocks in groups:
            for x in np.flatnonzero((number == blocks) & shared[blocks][np.minimum(f + b, len(t) - 1)]).tolist():
                u = min(int(ahead[x]), k)
                key = (int(groups[blocks][f + b[x]] if blocks else 0) * 2 * k + u * 2 + (blocks & 1), s[x : x + u] + s[x + u + blocks * block : x + k])
                seen[key] = seen.get(key, 0) + 1
                places.append(x)
                keys.append(key)
        likely.append((places, keys))
    out = []
    for s, c, (places, keys) in zip(strings, counts, likely, strict=True):
        if c > 1:
            out.append([(0, len(s) - k + 1)])
            continue
        flags = [False] * (len(s) - k + 1)
        for x, key in zip(places, keys, strict=True):
            flags[x] = seen[key] > 1
        out.append(ranges_of(flags))
    return out


def _pack(text: bytes, a: int, b: int) -> bytes:
    return text[a:b]


def _split(text: bytes) -> bytes:
    return text


def suffix_dedup(docs: DataFrame, length: int = 400, gram: int = 32, with_text: bool = False) -> DataFrame:
    """Remove every byte that a string of ``length`` bytes covers which also starts anywhere else, in this or another document.

    Texts are their UTF-8 bytes (null: empty). Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and
    kept_sha256 of each document, and the kept bytes as text (invalid where a cut splits a character, hence binary) with
    ``with_text``. Rows that repeat each other count as two occurrences and each get their row; other columns are ignored.
    """
    longer = [gram << i for i in (1, 2, 3) if gram << i <= length]  # powers of two times the gram
    cuts = tuple(partial(_super_kmers, k=length, m=m) for m in (gram, *longer[-1:]))
    scheme = Scheme(length, _split, cuts, _pack, partial(repeated_windows, k=length, m=gram), 8192)
    out = remove_repeats(docs, scheme, b"", with_text=with_text).withColumnRenamed("size", "n_bytes")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []))
