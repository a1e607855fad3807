import random

import numpy as np
import xxhash

from patternscore.llm.simhash import bit_majorities, forest, near_links, simhash_components


def brute_fp(text):
    words = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, radius=4):
    fps = [brute_fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows))


def test_matches_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for d in range(40):
        words = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 30, 200]))]
        for c in range(rng.choice([1, 1, 4])):
            w = list(words)
            if c and len(w) > 20:
                w[rng.randrange(len(w))] = "Changed"
            rows.append((len(rows) * 3, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "ÄÖ ünï Code A B"), (1004, "x " * 50_000)]
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, fp string, root int")
    got = sorted(tuple(r) for r in simhash_components(df).collect())
    assert got == brute(rows)


def test_empty_table(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_links_connect_all_pairs_even_in_split_buckets(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(60):
            x = int(b)
            for k in rng.integers(0, 64, rng.integers(1, 6)):
                x ^= 1 << int(k)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    got = near_links(df, 4, block=16).collect()
    links = {(r["u"] % 2**64, r["v"] % 2**64) for r in got}
    assert all(0 < (a ^ b).bit_count() <= 4 for a, b in links)

    def classes(pairs):
        root = {x: x for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        out = {}
        for x in fps:
            out.setdefault(find(x), set()).add(x)
        return {frozenset(v) for v in out.values()}

    assert classes(links) == classes([(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 4])


def test_forest_and_majorities():
    f = np.array([0, 1, 3, 2**40, 2**40 + 1], np.uint64)
    assert {frozenset(x) for x in forest(f, np.ones(5, bool), 1)} >= {frozenset((0, 1)), frozenset((2**40, 2**40 + 1))}
    h = np.array([1, 1, 2] * 200, np.uint64)
    assert bit_majorities(h, np.array([600, 0])).tolist() == [1, 0]
