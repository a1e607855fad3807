"""SimHash near-dedup with the generalised pigeonhole principle.

Distinct 64-bit fingerprints are linked at ``radius`` or fewer differing bits. Correlated bits share a part;
a dynamic program gives each part its own threshold t (-1: not probed) with sum(t + 1) = radius + 1, at the
least estimated cost, so every pair within the radius is within t in some part. Rows meet by (part, value),
with the values at distance t added as probes, and every candidate is verified on all 64 bits. Buckets over
``block`` fingerprints are cut into pairs of blocks, each its own group. A group sends on a spanning forest
of its links, not all pairs.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, distinct, dealt_in_blocks, saved, signed, text_bytes, text_hash
from .graph import components
from .sketch_dedup import Search, signed_sets

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_LANES = np.uint64(0x0101010101010101)
#: Cost of a shuffled probe row and of a verified pair, in microseconds (they only steer the plan).
ROW_COST, PAIR_COST = 4.0, 0.004


#: Parts of a plan, the largest threshold of a part, and the radius that they reach: its thresholds + 1 sum to radius + 1.
MOST_PARTS, MOST_THRESHOLD = 5, 2
MOST_RADIUS = MOST_PARTS * (MOST_THRESHOLD + 1) - 1


def bit_majorities(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of consecutive groups of hashes, the 64 bits that are set in over half of each group."""
    starts, owners = [], []
    at = 0
    for i, n in enumerate(sizes):
        starts += range(at, at + n, 255)  # a byte lane counts to 255
        owners += [i] * -(-n // 255)
        at += n
    counts = np.zeros((len(sizes), 64), np.int64)
    if at:
        starts, owners = np.array(starts), np.array(owners)
        for j in range(8):
            lanes = np.add.reduceat((h >> np.uint64(j)) & _LANES, starts).view(np.uint8).reshape(-1, 8)
            for b in range(8):
                counts[:, 8 * b + j] = np.bincount(owners, lanes[:, b], len(sizes))
    bits = (2 * counts > np.asarray(sizes)[:, None]).astype(np.uint64)
    return (bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _fingerprinter(shingle: int):
    def make():
        def f(batch):
            hashes, sizes = [], []
            digest = xxhash.xxh64_intdigest
            for text in batch.column("text").to_pylist():
                words = text.translate(LOWER).split()
                if not words:
                    sizes.append(0)
                    continue
                k = min(shingle, len(words))
                buf = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                starts = [0, *(ends[: len(words) - k] + 1).tolist()]
                hashes += [digest(buf[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)]
                sizes.append(len(starts))
            return {"doc_id": batch.column("doc_id"), "th": batch.column("th"), "fp": signed(bit_majorities(np.array(hashes, np.uint64), np.array(sizes, np.int64)))}

        return f

    return make


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, th (hash of the text) and fp (bigint) of every document: words are lower-cased (A-Z) and split at white space."""
    return arrow_pass(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"), text_bytes().alias("text")), _fingerprinter(shingle), "doc_id long, th long, fp long")


def _bit_counter():
    total = np.zeros((64, 64), np.float64)

    def f(batch):
        fps = batch.column("fp").to_numpy().view(np.uint64)
        b = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        total[:] += b.T @ b
        return None

    def last():
        i, j = np.divmod(np.arange(4096), 64)
        return {"i": i, "j": j, "n": total.ravel().astype(np.int64)}

    f.last = last
    return f


def bit_pairs(fps: DataFrame) -> np.ndarray:
    """How often bits i and j are both set, over all fingerprints (64 x 64)."""
    out = np.zeros((64, 64))
    for r in arrow_pass(fps.select("fp"), _bit_counter, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # 4096 rows
        out[r["i"], r["j"]] = r["n"]
    return out


def correlated_parts(pairs: np.ndarray, n: int, m: int) -> list[list[int]]:
    """64 bits in m parts: each part grows by the bit that correlates most with those it has."""
    p = np.diag(pairs) / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(pairs / n - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    left, parts = list(range(64)), []
    for k in range(m):
        width = len(left) // (m - k)
        part = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(part[0])
        while len(part) < width:
            part.append(max(left, key=lambda b: (corr[b, part].sum(), -b)))
            left.remove(part[-1])
        parts.append(sorted(part))
    return parts


def agreement(pairs: np.ndarray, n: int, part: list[int]) -> np.ndarray:
    """Probability that two fingerprints differ in d = 0, 1, ... bits of a part, each bit given the one before that it follows most."""
    p = np.diag(pairs) / n
    q = p**2 + (1 - p) ** 2
    out = np.array([1.0])
    for k, b in enumerate(part):
        agree = q[b]
        for a in part[:k]:
            both = pairs[a, b] / n
            cells = np.array([both, p[a] - both, p[b] - both, 1 - p[a] - p[b] + both])
            agree = max(agree, float((cells**2).sum() / q[a]))
        out = np.convolve(out, [agree, 1 - agree])
    return out


def probe_plan(pairs: np.ndarray, n: int, radius: int, most_parts: int = MOST_PARTS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part: the cheapest thresholds by dynamic programming, over 2 to most_parts parts."""
    best = (np.inf, [])
    for m in range(2, most_parts + 1):
        parts = correlated_parts(pairs, n, m)
        states = {0: (0.0, [])}  # units of threshold + 1 that are spent -> cost, thresholds
        for part in parts:
            chance = np.cumsum(agreement(pairs, n, part))
            new: dict[int, tuple[float, list[int]]] = {}
            for spent, (cost, ts) in states.items():
                for t in range(-1, min(MOST_THRESHOLD, radius - spent) + 1):
                    ball = sum(comb(len(part), d) for d in range(t + 1))
                    c = cost + (n * ball * ROW_COST + n * n / 2 * chance[min(t, len(chance) - 1)] * PAIR_COST if t >= 0 else 0)
                    if (u := spent + t + 1) not in new or c < new[u][0]:
                        new[u] = (c, [*ts, t])
            states = new
        if radius + 1 in states and states[radius + 1][0] < best[0]:
            best = (states[radius + 1][0], [(p, t) for p, t in zip(parts, states[radius + 1][1], strict=True) if t >= 0])
    return best[1]


def _prober(plan):
    def make():
        def f(batch):
            fps = batch.column("fp").to_numpy()
            u = fps.view(np.uint64)
            part_out, key_out, fp_out, own_out = [], [], [], []
            for i, (bits, t) in enumerate(plan):
                mask = np.uint64(sum(1 << b for b in bits))
                for d in range(t + 1):
                    for flip in combinations(bits, d):
                        key_out.append(signed((u & mask) ^ np.uint64(sum(1 << b for b in flip))))
                        part_out.append(np.full(len(u), i, np.int32))
                        fp_out.append(fps)
                        own_out.append(np.full(len(u), d == 0))
            return {"part": np.concatenate(part_out), "key": np.concatenate(key_out), "fp": np.concatenate(fp_out), "own": np.concatenate(own_out)}

        return f

    return make


def forest(f: np.ndarray, own: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links between fingerprints of a bucket that connect what all its links connect. Probes (own is false) link to own rows only."""
    out: list[tuple[int, int]] = []
    mine, probes = distinct(f[own]), distinct(f[~own])
    if len(mine) <= 256 and len(mine) + len(probes) <= 4096:
        a, b = np.nonzero(np.bitwise_count(mine[:, None] ^ np.concatenate((mine, probes))[None, :]) <= radius)
        keep = (b > a) | (b >= len(mine))
        if keep.sum() <= 2 * len(f):
            both = np.concatenate((mine, probes))
            return list(zip(mine[a[keep]].tolist(), both[b[keep]].tolist(), strict=True))
    waiting = mine
    while len(waiting):
        queue, waiting = [waiting[0]], waiting[1:]
        unlinked = probes
        while queue:
            x = queue.pop()
            near = np.bitwise_count(waiting ^ x) <= radius
            if near.any():
                found = waiting[near]
                waiting = waiting[~near]
                queue += list(found)
                out += [(int(x), int(y)) for y in found]
            if len(unlinked) and (near := np.bitwise_count(unlinked ^ x) <= radius).any():
                out += [(int(x), int(y)) for y in unlinked[near]]
                unlinked = unlinked[~near]
    return out


def _linker(radius: int):
    def make():
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def links(k, f, own):
            cut = np.flatnonzero(np.any(k[1:] != k[:-1], axis=1)) + 1
            bounds = np.concatenate(([0], cut, [len(f)]))
            out = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a > 1:
                    out += forest(f[a:b], own[a:b], radius)
            e = np.array(out, np.uint64).reshape(-1, 2)
            return {"u": signed(np.ascontiguousarray(e[:, 0])), "v": signed(np.ascontiguousarray(e[:, 1]))}

        def joined():
            return tuple(np.concatenate([x[i] for x in held]) for i in range(3))

        def f(batch):
            k = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("part", "key", "pair")], axis=1)
            held.append((k, batch.column("fp").to_numpy().view(np.uint64), batch.column("own").to_numpy(zero_copy_only=False)))
            if np.all(k[-1] == held[0][0][0]):
                return None  # all one group so far
            ks, fs, own = joined()
            last = int(np.flatnonzero(np.any(ks != ks[-1], axis=1))[-1]) + 1
            held[:] = [(ks[last:], fs[last:], own[last:])]
            return links(ks[:last], fs[:last], own[:last])

        def end():
            return links(*joined()) if held else None

        f.last = end
        return f

    return make


def near_links(fps: DataFrame, radius: int = 4, block: int = 4096) -> DataFrame:
    """u, v: links between distinct fingerprints (column fp) that connect all pairs within the radius.

    The plans reach a radius of 14 (five parts, each probed at up to 2 bits); beyond that the radius is refused.
    """
    if not 0 <= radius <= MOST_RADIUS:
        raise ValueError(f"radius {radius} is not between 0 and {MOST_RADIUS}")
    n = fps.count()
    if n < 2:
        return fps.sparkSession.createDataFrame([], "u long, v long")
    plan = probe_plan(bit_pairs(fps), n, radius)
    rows = arrow_pass(fps.select("fp"), _prober(plan), "part int, key long, fp long, own boolean")
    dealt = dealt_in_blocks(rows, ["part", "key"], "fp", block)
    return arrow_pass(dealt, _linker(radius), "u long, v long").distinct()


def simhash_components(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reached over links of at most ``radius`` bits).

    Documents without words have fingerprint zero and link like any other. Null texts are empty, null doc_ids
    never become a component_id unless a component has no other, repeated rows each get their row, and other columns are ignored.
    """
    rows = _rooted(docs, radius, shingle)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_groups(docs: DataFrame, each: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """key, sid, size: the sets of signed_sets() by the component of their documents' fingerprints, over links of at most ``radius`` bits."""
    prints = saved(fingerprints(docs, shingle).select("th", "fp").distinct(), "fingerprints")
    own = prints.select("fp").distinct()
    roots = components(near_links(own, radius))
    keyed = prints.join(roots, prints["fp"] == roots["node"], "left").select("th", F.coalesce("root", "fp").alias("key"))
    return keyed.join(each.where("sid <> 0").select("th", "sid", "size").distinct(), "th").select("key", "sid", "size").distinct()


def near_copies(docs: DataFrame, shingle: int = 5, least: float = 0.8, radius: int = 4) -> DataFrame:
    """doc_id, th (hash of the text) and root (a shingle set's hash) of every row: rows of a root are near copies, over links of ``least`` similarity or more.

    SimHash components are groups of candidates. At 0.8 many pairs differ in more bits than ``radius``, so sets that share a band of SetSketch
    registers are candidates too. Every link is checked on full sets. Documents without words are copies of each other.
    """
    each = saved(signed_sets(docs, shingle), "sets")
    groups = simhash_groups(docs, each, radius, shingle)
    roots = components(Search(docs, each, shingle, least, groups=groups).all_links())
    return each.join(roots, each["sid"] == roots["node"], "left").select("doc_id", "th", F.coalesce("root", "sid").alias("root"))


def near_dedup(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One row of docs from each group of near_copies(), with all its columns.

    The smallest doc_id stays (null comes last), then the smallest hash of the text; of rows that repeat both, any one.
    """
    rows = near_copies(docs, shingle, least).groupBy("root", "doc_id", "th").agg(F.count("*").alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "n")).alias("k"))
    keep = saved(first.select("k.doc_id", "k.th", "k.n"), "kept")
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("k.doc_id")) & (text_hash("d.text") == F.col("k.th"))
    single = docs.alias("d").join(keep.where("n = 1").alias("k"), same, "left_semi")
    if keep.where("n > 1").isEmpty():
        return single
    # Rows that repeat doc_id and text: one of them, whatever their other columns hold.
    repeated = docs.alias("d").join(keep.where("n > 1").alias("k"), same, "left_semi")
    values = F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("r")
    once = repeated.groupBy(F.col("doc_id").alias("_id"), text_hash().alias("_th")).agg(values).select("r.*")
    return single.unionByName(once)


def _rooted(docs: DataFrame, radius: int, shingle: int) -> DataFrame:
    """doc_id, th, fp, root (a fingerprint) and component_id of every row."""
    each = saved(fingerprints(docs, shingle), "fingerprints")
    own = saved(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = components(near_links(own, radius))
    keyed = own.join(roots, own["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = keyed.join(keyed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    return each.join(named, "fp")
