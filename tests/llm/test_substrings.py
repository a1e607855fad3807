import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from patternscore.llm.kmers import remove_repeats
from patternscore.llm.substring_dedup import substring_dedup
from patternscore.llm.suffix_dedup import common_prefixes, repeated_windows, suffix_array, suffix_dedup


def brute(rows, k, split, join):
    parts = [split((t or "").encode()) for _, t in rows]
    count = Counter(tuple(p[i : i + k]) if isinstance(p, list) else p[i : i + k] for p in parts for i in range(len(p) - k + 1))
    out = []
    for (d, _), p in zip(rows, parts, strict=True):
        gone = np.zeros(len(p) + 1, bool)
        for i in range(len(p) - k + 1):
            if count[tuple(p[i : i + k]) if isinstance(p, list) else p[i : i + k]] > 1:
                gone[i : i + k] = True
        gone = gone[: len(p)]
        kept = join.join([p[i] if isinstance(p, list) else p[i : i + 1] for i in np.flatnonzero(~gone)])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((d, len(p), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=repr)


def corpus(seed, size):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)] + ["é", "日本"]
    passages = [" ".join(rng.choice(vocab) for _ in range(size)) for _ in range(4)]
    rows = []
    for d in range(40):
        text = [" ".join(rng.choice(vocab) for _ in range(rng.choice([0, 5, 60, 150])))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            p = rng.choice(passages)
            cut = rng.randrange(len(p) // 3)
            text.insert(rng.randrange(len(text) + 1), p[cut:])
        rows.append((d, " ".join(text)))
    whole = " ".join(rng.choice(vocab) for _ in range(200))
    rows += [(100 + i, whole) for i in range(5)]
    rows += [(200, None), (201, ""), (202, "a b c d e " * 40), (203, "zz " * 300), (204, "x" * 3000), (205, rows[0][1]), (205, rows[0][1]), (None, "q " * 20), (206, "aé" * 300)]
    return rows


@pytest.mark.parametrize("bucket", [8192, 3])
def test_words_match_brute_force(spark, bucket, monkeypatch):
    rows = corpus(1, 80)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, th int, marks string")
    monkeypatch.setattr("patternscore.llm.substring_dedup.remove_repeats", lambda *a, **k: remove_repeats(*a, bucket=bucket, **k))
    want = brute(rows, 35, bytes.split, b" ")
    got = sorted((tuple(r) for r in substring_dedup(df).collect()), key=repr)
    assert got == [(d, n, m, h) for d, n, m, _, h, _ in want]
    if bucket == 3:
        texts = sorted(((r["doc_id"], r["text"].encode()) for r in substring_dedup(df, with_text=True).collect()), key=repr)
        assert texts == sorted(((r[0], r[5]) for r in want), key=repr)


@pytest.mark.parametrize("bucket", [8192, 3])
def test_bytes_match_brute_force(spark, bucket, monkeypatch):
    rows = corpus(2, 150)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, th int, marks string")
    monkeypatch.setattr("patternscore.llm.suffix_dedup.remove_repeats", lambda *a, **k: remove_repeats(*a, bucket=bucket, **k))
    want = brute(rows, 400, lambda b: b, b"")
    got = sorted((tuple(r) for r in suffix_dedup(df).collect()), key=repr)
    assert got == [r[:5] for r in want]
    if bucket == 3:
        texts = sorted(((r["doc_id"], bytes(r["kept"])) for r in suffix_dedup(df, with_text=True).collect()), key=repr)
        assert texts == sorted(((r[0], r[5]) for r in want), key=repr)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(none).collect() == [] and suffix_dedup(none).collect() == []


def test_suffix_array_matches_sorting():
    rng = random.Random(0)
    for n in list(range(1, 60)) * 6:
        for letters in (1, 2, 3, 20):
            t = [rng.randrange(1, letters + 1) for _ in range(n)] + [0]
            sa = suffix_array(t)
            assert sa == sorted(range(n + 1), key=lambda i: t[i:])
            rank, common = common_prefixes(t, sa)
            assert [sa[r] for r in rank] == list(range(n + 1))
            for r in range(1, n + 1):
                i, j = sa[r - 1], sa[r]
                h = 0
                while max(i, j) + h <= n and t[i + h] == t[j + h]:
                    h += 1
                assert common[r] == h


def test_bucket_windows_match_counting():
    rng = random.Random(4)
    for _ in range(40):
        core = bytes(rng.choice(b"abcdefgh") for _ in range(60))
        strings, k, m = [], 64, 8
        base = bytes(rng.choice(b"xyz") for _ in range(30)) + core + bytes(rng.choice(b"xyz") for _ in range(30))
        for _ in range(5):
            a, b = rng.randrange(25), rng.randrange(25)
            s = bytearray(base[a : len(base) - b])
            if rng.random() < 0.4:
                s[rng.randrange(10)] = 65
            strings.append(bytes(s))
        strings = [s for s in dict.fromkeys(strings) if len(s) >= k]
        if len(strings) < 2:
            continue
        count = Counter(s[i : i + k] for s in strings for i in range(len(s) - k + 1))
        got = repeated_windows(strings, [1] * len(strings), k, m, block=8)
        from patternscore.llm.suffix_dedup import byte_grams

        anchors = {bytes(s[(p := int(np.argmin(byte_grams(s[:k], m)))) : p + m]) for s in strings}
        if len(anchors) > 1:
            continue  # such strings are never in one bucket
        for s, spans in zip(strings, got, strict=True):
            flags = [count[s[i : i + k]] > 1 for i in range(len(s) - k + 1)]
            assert [any(a <= i < b for a, b in spans) for i in range(len(flags))] == flags
