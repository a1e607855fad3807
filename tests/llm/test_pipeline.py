import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from patternscore.llm import simhash
from patternscore.llm.simhash import near_dedup, simhash_components

groups = getattr(simhash, "simhash_groups", None)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(3)
    words = ["w" + hashlib.md5(str(i).encode()).hexdigest()[:5] for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = text(20)
    texts = {i: text(60) + "\n" + text(25) for i in range(120)}
    for i in range(100, 120):
        texts[i] += " vileword nastyword"
    texts[200], texts[201] = texts[7], texts[7]
    texts[202] = text(30) + "\n" + texts[9].split("\n")[1]  # repeats a line of 9
    texts[203] = item + " " + text(10)
    texts[204] = None
    texts[205] = ""
    d = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], COLUMNS)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i >= 100)) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), texts, docs


def test_stages_keep_the_columns_and_decide(spark, tables):
    d, texts, docs = tables
    now, left = docs, []
    for name, stage in cp.STAGES[:-1]:
        now = cp.saved(stage(spark, now, d), name)
        assert now.columns == docs.columns
        left.append({r["doc_id"]: r for r in now.collect()})
    toxic, lines, near, clean = left
    assert set(toxic) == set(texts) - set(range(100, 120))
    assert set(lines) == set(toxic)
    assert lines[9]["text"] == texts[9] and lines[202]["text"] == texts[202].split("\n")[0]
    assert lines[200]["text"] == "" and lines[200]["n_chars"] == 0 and lines[202]["n_chars"] == len(lines[202]["text"])
    assert set(near) == set(lines) - {201, 204, 205}  # 200, 201, 204 and 205 have no words left: the smallest stays
    assert set(clean) == set(near) - {203}
    pieces = cp.STAGES[-1][1](spark, now, d).collect()
    assert {r["doc_id"] for r in pieces} == set(clean)


def test_copies_leave_one(spark, tables):
    _, texts, docs = tables
    got = sorted(r["doc_id"] for r in near_dedup(docs).collect())
    want = sorted({r["component_id"] for r in simhash_components(docs).collect()})
    assert got == want and 7 in got and not {200, 201} & set(got)


def test_near_copies_go_by_exact_similarity(spark):
    rng = random.Random(8)
    texts, like = [], lambda a, b: len(a & b) / len(a | b)
    for _ in range(60):
        words = [f"v{rng.randrange(5000)}" for _ in range(rng.randrange(60, 200))]
        texts.append(words)
        n = rng.choice([2, 5, 9, 20])  # the last words change: similarities from about 0.7 to 0.98
        texts.append(words[:-n] + [f"z{rng.randrange(5000)}" for _ in range(n)])
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    pairs = [like(sets[2 * i], sets[2 * i + 1]) for i in range(60)]
    assert sum(0.8 <= p < 0.95 for p in pairs) > 10 and sum(p < 0.8 for p in pairs) > 3
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"] for r in near_dedup(docs).collect()}
    assert got == {2 * i for i in range(60)} | {2 * i + 1 for i, p in enumerate(pairs) if p < 0.8}


def test_near_dedup_goes_by_simhash(spark, monkeypatch):
    """Copies with a word in capitals or a changed end fall into one SimHash group, other texts don't, and the stage's candidates hold those groups."""
    rng = random.Random(9)
    texts = [" ".join(f"v{rng.randrange(5000)}" for _ in range(300)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t.upper() + " end") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    monkeypatch.setattr(simhash, "simhash_groups", lambda *a: seen.append(groups(*a)) or seen[-1])
    assert {r["doc_id"] for r in near_dedup(docs).collect()} == set(range(20))
    sizes = sorted(r["count"] for r in seen[0].groupBy("key").count().collect())
    assert sum(sizes) == 40 and sizes[-1] == 2 and sizes.count(2) >= 15


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "q r s t u", "x"), (None, "q r s t u", "x"), (2, "z", None)], "doc_id long, text string, th string")
    got = sorted(near_dedup(docs).collect(), key=str)
    assert len(got) == 3 and {r["doc_id"] for r in got} == {1, 2, None}


def test_run_on_the_small_tables(spark):
    out = cp.run(spark, SMALL)
    used = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert used and all(r["n"] == r["end"] <= 1024 for r in used)


def test_empty_tables(spark, tables, tmp_path):
    d, _, docs = tables
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
