"""Word shingle sets and the links between similar ones, for near-dedup by SimHash groups and by SetSketch bands."""

from __future__ import annotations

import numpy as np

from .common import distinct, gram_hashes, word_hashes


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Hashes of the different k-word shingles: words are lower-cased (A-Z) and split at white space; a shorter text is one shingle."""
    words = text.lower().split()
    return distinct(gram_hashes(word_hashes(words), min(k, len(words)))) if words else np.empty(0, np.uint64)


def set_links(ids: list[int], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that connect what all pairs of sets of Jaccard similarity ``least`` or more connect."""
    kinds, number = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    ends = np.cumsum(size)
    mark, out = np.zeros(len(kinds), np.uint8), []
    waiting, flat = np.arange(len(sets)), number  # sets that no component has, and their shingles
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
