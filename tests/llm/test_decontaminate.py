import hashlib
import random
import re

from patternscore.llm.decontaminate import _judged, clean_documents, contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w = words(t)
        hit, who = set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in wins:
                    hit |= set(range(s, s + n))
                    who |= wins[k]
        out.append((d, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    vocab = ["of", "The", "ünï", "x9", "alpha", "Beta", "γ", "delta"]
    items = [(i, " ".join(rng.choice(vocab) + str(rng.randrange(4)) for _ in range(rng.choice([1, 2, 5, 12, 13, 14, 30])))) for i in range(30)]
    items += [(100, items[3][1]), (101, None), (102, "..."), (7, items[3][1])]
    docs = []
    for d in range(60):
        w = [rng.choice(vocab) + str(rng.randrange(9)) for _ in range(rng.choice([0, 3, 40, 300]))]
        for _ in range(rng.choice([0, 1, 3])):
            got = (items[rng.randrange(30)][1]).upper().split()
            w[len(w) // 2 : len(w) // 2] = got[rng.randrange(3) :]
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(w)))
    docs += [(90, None), (91, ""), (92, items[6][1] * 3), (93, "a " * 60_000)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, uid int, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(tuple(r) for r in contamination(df, bench).collect()) == brute(docs, items)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contamination(none, bench).collect() == []
    row = contamination(spark.createDataFrame([(1, "some words")], "doc_id long, text string"), bench).collect()
    assert [tuple(r)[:4] for r in row] == [(1, 2, 0, 0)] and not row[0]["contaminated"]


def test_common_fingerprints_in_many_surroundings(spark):
    """One phrase between many different words, in many documents: by extension, by words, and with its documents dealt over tasks."""
    rng = random.Random(5)
    phrase = "which of the following is the best way to"
    around = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(6)) for _ in range(40)]
    items = [(f"i{i}", f"{around[i]} {phrase} {around[-i]}") for i in range(40)] + [("i0", f"{around[0]} {phrase} {around[0]}"), ("short", phrase)]
    docs = [(d, f"x{d} {around[rng.randrange(40)]} {phrase} {around[rng.randrange(40)]} y{d}") for d in range(200)]
    docs += [(5, docs[5][1]), (5, "another text of this number"), (500, phrase), (501, f"{phrase} {phrase}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = brute(docs, items)
    for contexts, hot in ((1000, 100_000), (1, 100_000), (1000, 3), (1, 3)):
        got = _judged(df, bench, 13, 7, contexts, hot).drop("th").collect()
        assert sorted(tuple(r) for r in got) == want, (contexts, hot)


def test_rows_that_repeat_and_null_numbers(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = [(None, text), (None, text), (1, text), (1, text), (2, "clean words"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'a' AS fp", "1 AS w", "2 AS items")
    bench = spark.createDataFrame([(1, text), (1, text), (None, "clean words")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["contaminated"]) for r in contamination(df, bench).collect()), key=str)
    assert got == sorted([(None, 20, 20, True)] * 2 + [(1, 20, 20, True)] * 2 + [(2, 2, 0, False), (None, 0, 0, False)], key=str)
    kept = clean_documents(df, bench)
    assert kept.columns == df.columns and sorted((r[:2] for r in map(tuple, kept.collect())), key=str) == [(2, "clean words"), (None, None)]
