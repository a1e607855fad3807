import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from patternscore.llm.q_spelling import op12_spelling_variants
from patternscore.llm.spelling import deleted_letter, variants, word_counts

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def brute_words(rows):
    """By the contract's words, without the operator."""
    counts = Counter()
    lower = {i: i + 32 for i in range(65, 91)}
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute(words):
    """Near words by their deletions: words of one length that lose a letter at one place, or of which one is the other's deletion."""
    near, by = defaultdict(set), defaultdict(list)
    for w in words:
        for i in range(len(w)):
            by[w[:i], w[i + 1 :]].append(w)
            if (less := w[:i] + w[i + 1 :]) in words:
                near[w].add(less)
                near[less].add(w)
    for group in by.values():
        for a in group:
            near[a] |= set(group) - {a}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("most", [3, 100_000])
def test_matches_brute_force(spark, most):
    """Few letters, so that words have many near ones and letters repeat; groups cut by Spark and within tasks."""
    rng = random.Random(2)
    words = {}
    for _ in range(3000):
        w = "".join(rng.choice("abÿ") for _ in range(rng.choice([7, 7, 8, 9, 12])))
        words[w] = rng.choice([2, 3, 25, 40, 400, 5000])
    for _ in range(300):  # one beginning, or one end, for many words
        words["prefixprefix" + "".join(rng.choice("abcdefghé") for _ in range(4))] = rng.choice([2, 30])
        words["".join(rng.choice("abcdefghé") for _ in range(4)) + "suffixsuffix"] = 2
    words["q" * 30_000] = 2
    words["q" * 29_999] = 20
    assert found(variants(spark.createDataFrame(list(words.items()), "word string, n long"), most=most)) == brute(words)


def test_words_of_documents(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdéÿ×") for _ in range(rng.choice([3, 6, 7, 8, 11]))) for _ in range(200)]
    rows = [(d, " ".join(rng.choice(vocab).title() if rng.random() < 0.2 else rng.choice(vocab) for _ in range(80))) for d in range(60)]
    rows += [(None, "Straße-straßes straßes"), (7, None), (8, ""), (9, "ΑΒΓabcdefgЖabcdefg ÀÉÎabcd"), (9, "x" * 100_000 + "1" + "y" * 8), (9, "x" * 100_000)] * 2
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, word string, n int")
    got = {r["word"]: r["n"] for r in word_counts(df, damage=deleted_letter).where("n >= 2").collect()}
    assert got == brute_words(rows)
    assert any("÷" in w or "×" in w for w in got)


def test_query_over_a_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = found(op12_spelling_variants(spark, "/root/testdata/sf0.01"))
    assert got == brute(brute_words(rows))
    assert sum(r[1] is not None for r in got) > 50


def test_empty_table(spark):
    assert variants(word_counts(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
