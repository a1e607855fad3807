import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from patternscore.llm import setsketch as S
from patternscore.llm.common import mix
from patternscore.llm.q_sketch_dedup import ORACLE_SQL, op11_setsketch
from patternscore.llm.sketch_dedup import set_registers, similar_sets

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().translate(LOWER).split()
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def found(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in df.collect()), key=repr)


def corpus(seed, clusters, most_copies):
    rng = random.Random(seed)
    vocab, rows = [f"w{i}" for i in range(400)], []
    for _ in range(clusters):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 4, 40, 150]))]
        for _ in range(rng.randint(1, most_copies)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                if len(w) > 20:
                    w[rng.randrange(len(w))] = rng.choice(["Changed", *vocab])
            rows.append((len(rows) * 3 + 5, rng.choice([" ", "\t", "\n "]).join(w)))
    rng.shuffle(rows)
    return rows


def test_matches_brute_force(spark):
    rows = corpus(3, 60, 6) + [(1000_000, None), (1000_001, ""), (1000_002, " \n"), (None, "a null id among its copies ok then"), (4, "A NULL id among its copies ok then"), (None, "alone with a null id here")]
    rows += [(9, "the same row comes again here")] * 2 + [(1000_003, "long " * 60_000), (1000_004, "É é E e stay apart"), (1000_005, "É É e e stay apart")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, sid string, root int").repartition(3)
    assert found(similar_sets(df)) == brute(rows)


@pytest.mark.parametrize("most, mass", [(8, 10**9), (10**6, 1500), (40, 10**9)])
def test_wide_groups_lose_no_link(spark, most, mass):
    """One chain of near copies and many near copies of one text, in blocks that are far smaller than the groups."""
    rng = random.Random(most)
    text = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(150):  # each like the one before, the ends unlike
        text = text[:]
        text[(i * 7) % 120] = f"c{i}"
        rows.append((i, " ".join(text)))
    base = [f"b{i}" for i in range(100)]
    for i in range(200):
        own = base[:]
        own[rng.randrange(100)] = f"x{i}"
        rows.append((1000 + i, " ".join(own)))
    assert found(similar_sets(spark.createDataFrame(rows, "doc_id long, text string"), most=most, mass=mass)) == brute(rows)


def test_registers_merge_and_estimate(spark):
    docs = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(500))), (2, " ".join(f"a{i}" for i in range(300, 900))), (3, " ".join(f"a{i}" for i in range(900))), (4, "")], "doc_id long, text string")
    regs = set_registers(docs)
    one = {r["doc_id"]: r["registers"] for r in regs.collect()}
    assert one[4] is None
    union = np.array(regs.where("doc_id < 3").agg(S.merged(F.col("registers")).alias("k")).first()["k"])
    assert (union == np.array(one[3])).all()  # the windows at the seam are in the second document too
    assert S.size_of(np.array(one[3])) == pytest.approx(897, rel=0.4)


def test_likelihood_keeps_similar_sets():
    """At similarity 0.8 none of 2,000 pairs is left out; at 0.3 nearly all are; registers are equal about as often as elements."""
    rng = np.random.default_rng(5)
    for j, kept, share in ((0.8, 2000, 0.8), (0.3, 20, 0.3)):
        hits, equal = 0, 0.0
        for t in range(2000):
            both, apart = int(300 * j), int(300 * (1 - j) / 2)
            x = mix(rng.integers(0, 2**63, both + 2 * apart, dtype=np.uint64))
            a, b = x[: both + apart], np.concatenate((x[:both], x[both + apart :]))
            ka, kb = S.registers(S.least_words(a)), S.registers(S.least_words(b))
            true = both / len(x)
            hits += S.may_reach(ka, len(a), kb[None], np.array([len(b)]), min(0.8, true) if j > 0.5 else 0.8)[0]
            equal += (ka == kb).mean() / 2000
        assert hits == kept if kept == 2000 else hits <= kept
        assert equal == pytest.approx(share, abs=0.03)


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = con.sql(f"SELECT doc_id, n_shingles, component_id, kept FROM ({ORACLE_SQL['op11_setsketch']})").fetchall()
    got = found(op11_setsketch(spark, "/root/testdata/sf0.01"))
    assert got == sorted(want, key=repr)
    assert sum(not r[3] for r in got) > 20


def test_empty_table(spark):
    assert similar_sets(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_small_groups_are_parted_together_as_each_is():
    """Sets of many groups, some near copies: one pass over all pairs gives the parts that each group has by itself, in batches of any cut."""
    import pyarrow as pa

    from patternscore.llm import sketch_dedup
    from patternscore.llm.setsketch import REGISTERS, least_words, likely_parts, likely_parts_of_many, registers

    rng = np.random.default_rng(12)
    groups, low, sizes = [], [], []
    for _ in range(150):
        n = int(rng.integers(2, 12))
        base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        for _ in range(n):
            own = base.copy()
            changed = rng.random(300) < rng.choice([0.0, 0.03, 0.1, 0.4, 1.0])
            own[changed] = rng.integers(0, 1 << 63, int(changed.sum()), dtype=np.uint64)
            own = np.unique(mix(own[: int(rng.choice([300, 290, 200]))]))
            low.append(least_words(own))
            sizes.append(len(own))
        groups.append(n)
    k, size, at = registers(np.array(low)), np.array(sizes), np.cumsum([0, *groups])
    assert k.shape[1] == REGISTERS
    parts = likely_parts_of_many(k, size, groups, 0.8)
    same = lambda p: (p[:, None] == p[None]).tolist()
    for a, b in zip(at[:-1], at[1:], strict=True):
        assert same(parts[a:b]) == same(likely_parts(k[a:b], size[a:b], 0.8))
        assert parts[a:b].min() >= a and parts[a:b].max() < b
    assert 10 < len(set(parts.tolist())) < len(parts) - 50
    key = np.repeat(np.arange(len(groups)), groups)
    table = pa.table({"key": key, "sid": np.arange(len(key)), "size": size, "k": pa.array([x.tobytes() for x in k], pa.binary())})
    for step in (7, 10**6):
        f = sketch_dedup._parted(["key"], 0.8)()
        out = [x for i in range(0, len(key), step) for x in f(table.slice(i, step).combine_chunks().to_batches()[0])] + list(f.last())
        sets: dict = {}
        for x in out:
            for name, sid in zip(zip(x["x"].tolist(), x["y"].tolist(), strict=True), x["sid"].tolist(), strict=True):
                sets.setdefault(name, set()).add(sid)
        want: dict = {}
        for sid, p in enumerate(parts.tolist()):
            want.setdefault(p, set()).add(sid)
        assert {frozenset(s) for s in sets.values()} == {frozenset(s) for s in want.values() if len(s) > 1}
