import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from patternscore.llm import sketches as sketches_module
from patternscore.llm.line_dedup import _forest_of_long, bands, line_dedup, repeated_lines, similar_forest, similar_pairs
from patternscore.llm.sketches import AGREE, SKETCH, WORDS, longs, unlinked_sets


def grams(line):
    return {line[i : i + 5] for i in range(max(1, len(line) - 4))}


def brute(rows, least=0.8):
    """Kept text of each row; rows with one doc_id and text are one document."""
    lines = sorted({(d is None, d or 0, t or "", i, x) for d, t in rows for i, x in enumerate((t or "").split("\n")) if x.strip()})
    distinct = list(dict.fromkeys(x[4] for x in lines))
    sets = [grams(x) for x in distinct]
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(distinct)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    of = {x: find(i) for i, x in enumerate(distinct)}
    first = {}
    for n, d, t, i, x in lines:
        first.setdefault(of[x], (n, d, t, i))
    out = []
    for d, t in rows:
        kept = [x for i, x in enumerate((t or "").split("\n")) if not x.strip() or first[of[x]] == (d is None, d or 0, t or "", i)]
        out.append((d, "\n".join(kept) if t is not None else None))
    return out


def corpus():
    rng = random.Random(8)
    vocab = [f"word{i}" for i in range(400)] + ["été", "日本語", "\U0001f600"]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.choice([4, 12, 30]))) for _ in range(12)]
    rows = []
    for d in range(60):
        lines = [" ".join(rng.choice(vocab) for _ in range(rng.choice([3, 10, 25]))) for _ in range(rng.choice([0, 1, 4]))]
        for _ in range(rng.choice([0, 1, 2])):
            x = rng.choice(base)
            if rng.random() < 0.5:
                w = x.split()
                w[rng.randrange(len(w))] = rng.choice(vocab)
                x = " ".join(w)
            lines.insert(rng.randrange(len(lines) + 1), x)
        if rng.random() < 0.3:
            lines += ["", "  "]
        rows.append((d, "\n".join(lines)))
    rows += [(70, None), (71, ""), (72, "\n\n"), (73, "ab"), (74, "ab\nab\nac"), (75, "long " * 40_000), (76, "long " * 40_000 + "!"), (None, "ab\nown line of null"), (77, rows[5][1]), (77, rows[5][1])]
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, gone int, lh string")
    got = line_dedup(df).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted(brute(rows), key=repr)
    assert all(r["gone"] == 1 and r["lh"] == "x" for r in got)


@pytest.mark.parametrize("most", [2, 512])
def test_split_buckets_lose_no_link(spark, most):
    rows = [(i, "the very same line that only ends a bit differently in each document " + str(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in repeated_lines(df, most=most).collect()) == list(range(1, 60))


def test_wide_bands_keep_their_links(spark):
    """Two thousand lines with one beginning share bands; pairs of them are hidden among them, and a cluster of near copies."""
    rng = random.Random(4)
    head = "this beginning is shared by very many lines of the corpus and its minima rule most bands of all of them "
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    rows, pairs = [], []
    for i in range(2000):
        line = head + " ".join(word() for _ in range(8))
        rows.append((i, line))
        if i % 10 == 0:
            other = line[:-4] + "zzzz"
            pairs.append(10_000 + i)
            rows.append((10_000 + i, other))
    rows += [(20_000 + i, "a cluster of near copies that differ in nothing but a number near their end, such as this: " + str(i)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lost = {r["doc_id"] for r in repeated_lines(df, most=64).collect()}
    assert len(lost & set(pairs)) >= 0.98 * len(pairs)
    assert len([x for x in lost if x >= 20_000]) >= 0.999 * 1499
    assert not [x for x in lost if x < 10_000]


def test_wide_bands_lose_no_pair(spark, monkeypatch):
    """Where the order of a wide band brings no two lines together, all pairs that share it are found: the same as with bands compared each with each."""
    monkeypatch.setattr(sketches_module, "in_rank_blocks", lambda rows, by, block: rows.withColumn("at", F.monotonically_increasing_id()))
    rng = random.Random(6)
    head = "a beginning that all of the lines share and that rules most minima of them "
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    lines = []
    for _ in range(150):
        words = [word() for _ in range(8)]
        i = rng.randrange(8)
        lines += [head + " ".join(words), head + " ".join([*words[:i], word(), *words[i + 1 :]])]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    lost = lambda most: {r["doc_id"] for r in repeated_lines(df, most=most).collect()}
    whole = lost(100_000)
    assert len(whole) > 100
    assert lost(8) == whole


def test_blocks_of_wide_bands_bring_all_pairs_together(spark):
    """Likely pairs of different roots, by unlinked_sets() in small blocks, are those of a plain loop; pairs of one root need not meet."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, (12, SKETCH), dtype=np.uint8)
    sketches = base[rng.integers(0, 12, 300)]
    change = rng.random(sketches.shape) < 0.3
    sketches = np.where(change, rng.integers(0, 256, sketches.shape, dtype=np.uint8), sketches)
    bands, roots = rng.integers(0, 2, 300), rng.choice([1, 1, 1, 2, 3], 300)
    words = np.ascontiguousarray(sketches).view(np.int64)
    wide = spark.createDataFrame([(int(bands[i]), i, *map(int, words[i])) for i in range(300)], longs(["band", "lh", *WORDS]))
    rooted = spark.createDataFrame([(i, int(roots[i])) for i in range(300)], "lh long, root long")
    want = {(i, j) for i in range(300) for j in range(i) if bands[i] == bands[j] and roots[i] != roots[j] and (sketches[i] == sketches[j]).sum() >= AGREE}
    for block in (7, 100_000):
        sets: dict = {}
        for r in unlinked_sets(wide, rooted, block).collect():
            sets.setdefault((r["x"], r["y"]), []).append(r["lh"])
        got = {(i, j) for s in sets.values() for i in s for j in s if i > j}
        assert len(want) > 100 and want <= got
    assert unlinked_sets(wide, rooted.withColumn("root", F.col("root") * 0)) is None


def test_clashing_columns_and_repeated_rows(spark):
    line = "a line that is long enough to be compared with others"
    rows = [(1, f"{line}\nfirst", 7, "x"), (1, f"{line}\nfirst", 7, "x"), (2, f"{line}\nsecond", 8, "y"), (None, line, 9, "z"), (None, None, 9, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed int, lh string")
    got = line_dedup(df)
    assert sorted(got.columns) == ["doc_id", "lh", "n_lines", "n_removed", "text"]
    want = [(1, f"{line}\nfirst", 2, 0, "x")] * 2 + [(2, "second", 2, 1, "y"), (None, "", 1, 1, "z"), (None, None, 1, 0, "z")]
    assert sorted((tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_removed", "lh").collect()), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_recall_of_banding():
    rng = random.Random(2)
    met = total = 0
    for _ in range(300):
        x = "".join(rng.choice("abcdefgh ij") for _ in range(120))
        y = list(x)
        for _ in range(2):
            y[rng.randrange(120)] = "z"
        y = "".join(y)
        j = len(grams(x) & grams(y)) / len(grams(x) | grams(y))
        if j >= 0.8:
            total += 1
            met += bool(set(bands([x], 5)[0][0].tolist()) & set(bands([y], 5)[0][0].tolist()))
    assert total > 100 and met / total > 0.98


def test_forest():
    assert len(similar_forest([1, 2, 3, 4], ["abcdefghijkl", "abcdefghijklm", "abcdefghijklmn", "zzzzzzzz"], 5, 0.8)) == 2


def test_pairs_and_long_lines_like_sets():
    rng = random.Random(6)
    lines = []
    for _ in range(200):
        x = "".join(rng.choice("abc ") for _ in range(rng.choice([2, 4, 30, 90])))
        lines += [x, x[: max(1, len(x) - rng.choice([0, 1, 3, 9]))] + rng.choice(["", "q"])]
    want = [len(grams(a) & grams(b)) >= 0.8 * len(grams(a) | grams(b)) for a, b in zip(lines[::2], lines[1::2], strict=True)]
    assert similar_pairs(lines, 5, 0.8).tolist() == want and 20 < sum(want) < 190
    for a, b, w in zip(lines[::2], lines[1::2], want, strict=True):
        assert bool(_forest_of_long([1, 2], [a, b], 5, 0.8)) == w == bool(similar_forest([1, 2], [a, b], 5, 0.8))


def test_bands_of_many_lines_are_those_of_each():
    lines = ["ab", "", "abcde", "abcdef" * 30, "x", "été à la plage", "abcdef" * 30]
    for i in (0, 1):
        assert bands(lines, 5)[i].tolist() == [bands([x], 5)[i][0].tolist() for x in lines]


def similar_in_table(queries, lines, least=0.8):
    """(query, line) of different texts with similarity ``least`` or more, each query against all lines."""
    import numpy as np

    from patternscore.llm.line_dedup import shingle_sets

    owner, number, kinds = shingle_sets(lines, 5)
    size = np.bincount(owner, minlength=len(lines))
    ends = np.cumsum(size)
    mark = np.zeros(kinds, np.uint8)
    for q in queries:
        own = number[ends[q] - size[q] : ends[q]]
        mark[own] = 1
        shared = np.add.reduceat(mark[number], ends - size, dtype=np.int64)
        mark[own] = 0
        for i in np.flatnonzero(shared >= least * (size + size[q] - shared) - 1e-9).tolist():
            if i != q:
                yield q, i


def recall_on(spark, folder):
    """Of similar pairs with a line of a document whose id 50 divides: the share of which not both lines were kept; and their number."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    at = {x: i for i, x in enumerate(dict.fromkeys(x for r in rows for x in (r["text"] or "").split("\n") if x.strip()))}
    lines = list(at)
    queries = sorted({at[x] for r in rows if r["doc_id"] % 50 == 0 for x in (r["text"] or "").split("\n") if x.strip()})
    kept = {x for r in line_dedup(docs).select("text").collect() for x in (r["text"] or "").split("\n")}
    pairs = list(similar_in_table(queries, lines))
    return sum(not (lines[a] in kept and lines[b] in kept) for a, b in pairs) / max(1, len(pairs)), len(pairs)


def test_recall_on_the_table(spark):
    recall, pairs = recall_on(spark, "/root/testdata/sf0.01")
    assert pairs >= 10 and recall >= 0.9


def test_more_links_move_only_the_components_that_they_touch(spark, monkeypatch):
    """100 chains of 10; links join some of them, and nodes that none of them has."""
    from patternscore.llm import graph

    chains = [(10 * c + i, 10 * c + i + 1) for c in range(100) for i in range(9)]
    links = [(19, 55), (58, 993), (1007, 1003), (1003, 345), (2001, 2000), (21, 28), (3000, 3000)]
    roots = graph.components(spark.createDataFrame(chains, "u long, v long"))
    want = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(chains + links, "u long, v long")).collect()}
    whole, sizes = graph.components, []
    monkeypatch.setattr(graph, "components", lambda edges: (sizes.append(edges.count()), whole(edges))[1])
    got = graph.linked_roots(roots, spark.createDataFrame(links, "u long, v long")).collect()
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)
    assert sizes == [len(links)]


def test_many_pairs_are_judged_as_each_is():
    rng = random.Random(4)
    lines = []
    for _ in range(3000):
        a = "".join(rng.choice("abcd") for _ in range(rng.randrange(3, 40)))
        lines += [a, a[: rng.randrange(1, len(a))] + rng.choice(["", "x", "abcab"])]
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} if len(x) >= 5 else {x} for x in lines]
    want = [len(a & b) >= 0.8 * len(a | b) - 1e-9 for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert similar_pairs(lines, 5, 0.8).tolist() == want and 100 < sum(want) < 2900


def test_sizes_that_exclude_similarity_keep_items_of_a_wide_band_apart(spark):
    """Of items that all look alike, those of near sizes and different roots meet in any blocks; those whose sizes differ by two classes never do."""
    rng = np.random.default_rng(3)
    n = 240
    sizes, roots = rng.choice([4, 5, 20, 24, 25, 26, 31, 32, 60, 100, 125, 200], n), rng.choice([1, 1, 2, 3, 4], n)
    wide = spark.createDataFrame([(i % 2, i, *([7] * len(WORDS))) for i in range(n)], longs(["band", "lh", *WORDS]))
    rooted = spark.createDataFrame([(i, int(roots[i]), int(sizes[i])) for i in range(n)], "lh long, root long, size long")
    other = [(i, j) for i in range(n) for j in range(i) if i % 2 == j % 2 and roots[i] != roots[j]]
    ratio = lambda i, j: min(sizes[i], sizes[j]) / max(sizes[i], sizes[j])
    for block in (7, 100_000):
        sets: dict = {}
        for r in unlinked_sets(wide, rooted, block).collect():
            sets.setdefault((r["x"], r["y"]), []).append(r["lh"])
        got = {(i, j) for s in sets.values() for i in s for j in s if i > j}
        assert {(i, j) for i, j in other if ratio(i, j) >= 0.8} <= got
        assert not [1 for i, j in got if ratio(i, j) < 0.8**3]


def test_packed_bands_give_what_a_plain_count_gives():
    """Sets, items that repeat, wide bands and buckets that are too large, from packed rows in batches of any cut."""
    import pyarrow as pa

    from patternscore.llm.sketches import _AGAIN, _APART, _REPEAT, _SET, _WIDE, BUCKETS, Packer, _bucket_sifter, again_hashes

    rng = np.random.default_rng(9)
    kinds = rng.integers(-(1 << 63), 1 << 63, 400) & ~np.int64(15)
    kinds[:10] = kinds[0] + (np.arange(10) << 4)  # bands of one bucket
    band = np.concatenate((rng.choice(kinds, 1500), np.full(40, kinds[20])))
    lh = np.concatenate((rng.integers(0, 300, 1500), np.arange(40)))
    words = np.repeat(lh[:, None], len(WORDS), axis=1) * 0 + 5  # all sketches agree
    again = np.array([3, 77, 78], np.int64)
    packer = Packer()
    out = [*packer.add(band, lh, words), *packer.add(again_hashes(again), again, np.zeros((3, len(WORDS)), np.int64)), *packer.given()]
    rows = [(b, r) for x in out for b, r in zip(x["bucket"].tolist(), x["rows"].to_pylist(), strict=True)]
    assert sorted({b for b, _ in rows}) == [b for b, _ in rows] and len(rows[0][1]) % 40 == 0
    want: dict = {}
    for b, x in zip(band.tolist(), lh.tolist(), strict=True):
        want.setdefault(b, []).append(x)
    bucket = {b: (b % (1 << 64)) * BUCKETS >> 64 for b in want}
    for large, step in ((10**6, 5), (10**6, 10**6), (25, 3)):
        f = _bucket_sifter(16, large)()
        parts = [p for i in range(0, len(rows), step) for p in f(pa.table({"bucket": pa.array([b for b, _ in rows[i : i + step]], pa.int32()), "rows": pa.array([r for _, r in rows[i : i + step]], pa.binary())}).to_batches()[0])]
        parts += f.last()
        got = [r for p in parts for r in zip(*(np.asarray(p[c]).tolist() for c in ("kind", "x", "y", "lh", "band")), strict=True)]
        sizes: dict = {}
        for b in want:
            sizes[bucket[b]] = sizes.get(bucket[b], 0) + len(want[b])
        here = {b: x for b, x in want.items() if sizes[bucket[b]] <= large}
        sets: dict = {}
        for kind, x, y, item, _ in got:
            if kind == _SET:
                sets.setdefault((x, y), set()).add(item)
        assert {frozenset(s) for s in sets.values()} == {frozenset(x) for x in here.values() if 1 < len(set(x)) <= 16}
        assert sorted((b, item) for kind, _, _, item, b in got if kind == _WIDE) == sorted((b, x) for b in here for x in set(here[b]) if len(set(here[b])) > 16)
        assert sorted((b, item) for kind, _, _, item, b in got if kind == _APART and not b & int(_AGAIN)) == sorted((b, x) for b in want if b not in here for x in want[b])
        repeated = {item for kind, _, _, item, _ in got if kind == _REPEAT}
        assert repeated >= {x for b in here for x in here[b] if here[b].count(x) > 1 and b & 7 == 0} and repeated >= set(again.tolist()) and len(here) < len(want) or large > 25


def test_large_buckets_keep_their_links(spark):
    """Buckets that are left to Spark's sort give the same sets as those that their task sorts."""
    from patternscore.llm.common import arrow_pass, text_bytes
    from patternscore.llm.line_dedup import _signer
    from patternscore.llm.sketches import PACKED, likely_sets

    docs = spark.createDataFrame([(t,) for _, t in corpus()], "text string").repartition(3)
    packed = arrow_pass(docs.select(text_bytes().alias("text")), _signer(5), PACKED)
    whole, apart = (likely_sets(packed, 4, large=large) for large in (10**6, 2))
    for a, b in zip(whole, apart, strict=True):
        assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}
    assert whole[0].count() > 20 and whole[2].count() > 20
