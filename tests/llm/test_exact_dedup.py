import hashlib

import numpy as np

from patternscore.llm.exact_dedup import bucket_of, build_directory, exact_dedup, split

WS = str.maketrans("", "", " \t\n\x0b\f\r")


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault((t or "").translate(WS), []).append((-len(t or ""), d is None, d))
    keep = {k: min(v) for k, v in groups.items()}
    out = []
    for d, t in rows:
        k = (t or "").translate(WS)
        out.append((d, keep[k][2], len(groups[k]), (-len(t or ""), d) == (keep[k][0], keep[k][2]), hashlib.sha256(k.encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(1, "a b c"), (2, "abc"), (3, "a  bc"), (4, None), (5, ""), (6, " \n"), (7, "é x"), (8, "éx"), (9, "z" * 200_000), (10, "z " * 200_000), (11, "\U0001f600"), (12, "\U0001f600 "), (None, "abc  "), (13, "abc  "), (14, "q"), (14, "q")]


def test_matches_brute_force(spark):
    df = spark.createDataFrame([(d, t, "x", 5) for d, t in ROWS], "doc_id long, text string, h string, n int")
    for kw in ({}, {"bucket_rows": 1, "merge_bytes": 1}, {"bucket_rows": 1, "owner_chars": 1}):
        assert sorted((tuple(r) for r in exact_dedup(df, **kw).collect()), key=repr) == brute(ROWS)


def test_hot_copies(spark):
    rows = [(i, "same text") for i in range(3000)] + [(5000 + i, f"t{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = exact_dedup(df, bucket_rows=16).collect()
    assert len(got) == 3500 and sum(r["kept"] for r in got) == 501
    assert {r["group_size"] for r in got} == {1, 3000}


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_ties_of_one_doc_id(spark):
    df = spark.createDataFrame([(13, "a bc"), (13, "ab c"), (13, "ab c"), (14, "a b c")], "doc_id long, text string")
    kept = [(r["doc_id"], r["kept"]) for r in exact_dedup(df).collect()]
    assert sorted(kept) == [(13, False)] * 3 + [(14, True)]
    got = exact_dedup(df.where("doc_id = 13")).collect()
    assert sum(r["kept"] for r in got) in (1, 2) and {r["keep_id"] for r in got} == {13}  # one text stays, with its repeats
    two = exact_dedup(df.where("doc_id = 13").distinct()).collect()
    assert sum(r["kept"] for r in two) == 1


def test_directory_splits_until_buckets_fit(spark):
    rng = np.random.default_rng(0)
    h = rng.integers(-(1 << 63), (1 << 63) - 1, 5000)
    h[:300] = (h[0] & ~np.int64(0xFFFF)) + np.arange(300)  # keys that differ in their last bits only
    h[300:305] = [-(1 << 63), (1 << 63) - 1, 0, -1, 1]
    keys = spark.createDataFrame([(x,) for x in set(h.tolist())], "h long")
    for rows in (100, 20, 1):
        d = build_directory(keys, rows)
        own = bucket_of(d, np.array(sorted(set(h.tolist())), np.int64))
        assert d[0] == 0 and np.all(d[1:] > d[:-1]) and np.bincount(own).max() <= rows and own.max() < len(d)
    assert build_directory(keys.limit(0), 5).tolist() == [0]
    assert split(np.array([1, 0, 9, 2]), 3) == ([3, 0], [2])


def test_a_text_of_half_the_rows_is_dealt(spark):
    docs = [(d, "same text" + " " * (d % 5) if d % 2 else f"text {d}") for d in range(400)] + [(None, "same text"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(str, exact_dedup(df, hot_rows=10).collect())) == sorted(map(str, exact_dedup(df).collect()))
