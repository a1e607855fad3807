import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from patternscore.operators import fitness as FT
from patternscore.operators import forest as FO
from patternscore.operators import grouping as G
from patternscore.operators import metrics as M
from patternscore.operators import model as MD
from patternscore.operators import networks as N
from patternscore.operators import optimise as O
from patternscore.operators import preprocess as P
from patternscore.operators import ranks as R
from patternscore.operators import scoring as S
from patternscore.plans.registry import ORACLE_SQL, QUERIES
from patternscore.sources import tables as T

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    rows = got.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    rel = duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(rel.columns)
    order = sorted(rel.columns)
    at = [rel.columns.index(c) for c in order]
    want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
    assert len(rows) == len(want)
    for a, b in zip(sorted((tuple(r[c] for c in order) for r in rows), key=repr), want, strict=True):
        assert a == b


def rollup_rows(duck):
    from patternscore.plans.registry import _ROLLUP, ROLLUP

    return ROLLUP, np.array(duck.sql(f"WITH {_ROLLUP} SELECT {', '.join(ROLLUP)} FROM r ORDER BY l_orderkey").fetchall(), float)


def test_grouping_queries_equal_plain_groups(spark, duck):
    """The queries without SQL: groups from numpy's correlations by plain loops."""
    columns, x = rollup_rows(duck)
    corr = np.round(np.abs(np.corrcoef(x.T)), 6)
    left, greedy = list(range(len(columns))), []
    while left:
        group = [max(left, key=lambda i: (np.mean([corr[i, j] for j in left]), -i))]
        while len(group) < 3 and (rest := [i for i in left if i not in group]):
            best = max(rest, key=lambda i: (np.mean([corr[i, j] for j in group]), -i))
            if np.mean([corr[best, j] for j in group]) <= 0.1:
                break
            group.append(best)
        greedy.append([columns[i] for i in group])
        left = [i for i in left if i not in group]
    for name, want in (("linked_groups", plain_linkage(corr, columns, 3)), ("greedy_groups", greedy)):
        got: dict = {}
        for r in QUERIES[name](spark, DATA).collect():
            got.setdefault(r["group_id"], []).append(r["column_name"])
        assert [sorted(got[i]) for i in sorted(got)] == [sorted(g) for g in want], name


def test_arc_query_is_a_plain_optimum(spark, duck):
    """The arcs of the query beat every network that one more, one less or one turned arc gives, by plain BIC of numpy's bins."""
    from itertools import permutations

    columns, x = rollup_rows(duck)
    low, high = x.min(axis=0), x.max(axis=0)
    codes = sum((x >= low + i * (high - low) / 3).astype(int) for i in (1, 2))
    rows = [dict(zip(columns, map(int, r), strict=True)) for r in codes]
    parents = {c: frozenset() for c in columns}
    for r in QUERIES["network_arcs"](spark, DATA).collect():
        parents[r["child"]] |= {r["parent"]}
    known: dict = {}

    def bic(c, ps):
        if (c, ps) not in known:
            known[c, ps] = plain_bic(rows, c, sorted(ps))
        return known[c, ps]

    def acyclic(net):
        done: set = set()
        while more := {c for c in columns if c not in done and net[c] <= done}:
            done |= more
        return len(done) == len(columns)

    assert acyclic(parents) and any(parents.values())
    for a, b in permutations(columns, 2):
        moves = [parents | {b: parents[b] - {a}}, parents | {b: parents[b] - {a}, a: parents[a] | {b}}] if a in parents[b] else [parents | {b: parents[b] | {a}}]
        for new in filter(acyclic, moves):
            assert sum(bic(c, new[c]) - bic(c, parents[c]) for c in (a, b)) <= 1e-6, (a, b)


def test_null_infinite_constant_and_empty(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("inf")), (3, None), (4, float("nan")), (5, 3.0)], "id long, x double")
    assert [r["x"] for r in P.impute_median(df, ["x"]).orderBy("id").collect()] == [1.0, 2.0, 2.0, 2.0, 3.0]
    one = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None)], "id long, x double")
    assert [r["x"] for r in S.bin_columns(one, ["x"], 4).orderBy("id").collect()] == [0, 0, None]
    assert [r["x"] for r in P.standardise(one, ["x"]).orderBy("id").collect()] == [0.0, 0.0, None]
    assert S.log_likelihoods(one.limit(0), S.Plan("id", [["x"]], 4)).count() == 0
    with pytest.raises(ValueError):
        P.drop_constant(one.na.drop(), ["x"])


def test_saved_patterns_score_new_rows(spark):
    plan = S.Plan("id", [["a"]], 2)
    old = spark.createDataFrame([(i, float(i % 2)) for i in range(10)], "id long, a double")
    table = S.log_frequencies(S.pattern_counts(S.bin_columns(old, ["a"], 2), plan))
    assert {round(r["ll"], 6) for r in table.collect()} == {round(__import__("math").log(6 / 12), 6)}
    assert S.log_likelihoods(old, plan, table).where("group_0 IS NULL").count() == 0


def test_groups_partition_the_columns(spark):
    rows = [(float(i), i * 2.0 + (i % 3), float((i * 7) % 11), float((i * 5) % 13)) for i in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    corr = G.correlation_matrix(df, list("abcd"))
    for groups in (G.linked_groups(corr, list("abcd"), 2), G.greedy_groups(corr, list("abcd"), 2), G.random_groups(list("abcd"), 2)):
        assert sorted(c for g in groups for c in g) == list("abcd")
    assert any({"a", "b"} <= set(g) for g in G.linked_groups(corr, list("abcd"), 2))


def plain_fitness(rows, p):
    s = -rows @ np.array(p.weights)
    flags = s > np.percentile(s, 100 - p.share)
    if not flags.any() or 2 * flags.sum() >= len(s):
        return 0.0
    a, b = s[flags], s[~flags]
    pooled = np.sqrt(((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (len(s) - 2)) if min(len(a), len(b)) > 1 else 0
    d = abs(a.mean() - b.mean()) / pooled if pooled > 1e-10 else 0
    n = [(s > np.percentile(s, 100 - x)).sum() for x in (max(1, p.share - 0.5), p.share, min(10, p.share + 0.5))]
    return 100 * (0.45 * FT.separation_quality(d) + 0.25 * FT.rate_quality(100 * len(a) / len(s)) + 0.2 * min(1, np.exp(-5 * np.std(n) / np.mean(n))) + 0.1 * FT.diversity(p.weights))


def test_fitness_of_a_population(spark):
    rows = np.round(np.random.default_rng(3).normal(-3, 1, (400, 4)), 3)
    df = spark.createDataFrame(rows.tolist(), "a double, b double, c double, d double")
    people = [FT.Candidate.of(np.array([*w, t])) for w, t in (((1, 1, 1, 1), 5), ((0.1, 0.5, 0.9, 0.3), 1.2), ((1, 0.2, 0.2, 0.1), 9.9))]
    got = FT.population_fitness(FT.counted_vectors(df, list("abcd")), list("abcd"), people)
    assert got == pytest.approx([plain_fitness(rows, p) for p in people], abs=1e-6)
    judge = FT.judge_of(FT.counted_vectors(df.repartition(7), list("abcd")), list("abcd"))
    assert judge(people) == pytest.approx(got, abs=1e-6) and judge(people[1:]) == pytest.approx(got[1:], abs=1e-6)
    one = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)] * 20, df.schema)
    assert FT.population_fitness(FT.counted_vectors(one, list("abcd")), list("abcd"), people) == [0.0] * 3
    assert FT.population_fitness(FT.counted_vectors(one.limit(0), list("abcd")), list("abcd"), people) == [0.0] * 3


def test_thresholds_of_many_candidates(spark):
    """Exact order statistics of 60 candidates: scores that crowd in a millionth of their range, ties, and weighted rows."""
    rng = np.random.default_rng(8)
    x = np.concatenate((rng.normal(0, 1e-7, (4000, 3)), np.round(rng.normal(0, 3, (1500, 3)), 1), [[1e6, -1e6, 1e6]]))
    n = rng.integers(1, 9, len(x))
    vectors = spark.createDataFrame([(*r, int(k)) for r, k in zip(x.tolist(), n, strict=True)], "a double, b double, c double, _rows long").repartition(6)
    weights, shares = rng.dirichlet(np.ones(3), 60), rng.uniform(0, 100, (60, 3))
    got = FT.Judge(vectors, list("abc")).cuts(weights, shares)
    for w, s, cuts in zip(weights, shares, got, strict=True):
        scores = -((x[:, 0] * w[0] + x[:, 1] * w[1]) + x[:, 2] * w[2])
        assert cuts == pytest.approx(np.percentile(np.repeat(scores, n), 100 - s), rel=1e-12, abs=1e-15)


def test_searches_find_an_optimum_and_repeat():
    aim = np.array([0.6, 0.3, 0.1])
    judge = lambda people: [100 - 50 * float(((np.array(p.weights) - aim) ** 2).sum()) - abs(p.share - 4) for p in people]
    for search in (lambda: O.genetic(judge, 3, population=60, generations=40), lambda: O.cma_es(judge, 3)):
        found = search()
        assert found.fitness > 99
        assert search().best == found.best
        assert abs(sum(found.best.weights) - 1) < 1e-9 and 1 <= found.best.share <= 10


def test_hill_climbing_finds_the_arcs(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 3, 2000)
    b, c = (a + (rng.random(2000) < 0.1)) % 3, rng.integers(0, 2, 2000)
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), c.tolist(), strict=True)), "a long, b long, c long")
    found = N.hill_climb(df, ["a", "b", "c"])
    assert {frozenset((p, x)) for x, ps in found.items() for p in ps} == {frozenset("ab")}
    assert N.hill_climb(df.limit(0), ["a", "b"]) == {"a": [], "b": []}
    new = spark.createDataFrame([(0, 2, 0), (9, 9, 9)], df.schema)
    assert N.factorised_log_likelihood(new, {"a": [], "b": ["a"]}, table_of=df).where("a = 9").first()["ll"] == -20.0


def test_quantiles_ranks_and_totals(spark):
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 5, 3000):
        x, y = rng.integers(0, 40, n).astype(float), rng.normal(size=n)
        rows = [(a, b if i % 7 else None) for i, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True))]
        df = spark.createDataFrame(rows, "x double, y double").repartition(3)
        got = R.exact_quantiles(df, ["x", "y"], [0.0, 0.25, 0.5, 0.95, 1.0])
        for c, values in (("x", x), ("y", y[np.arange(n) % 7 != 0])):
            want = np.quantile(values, [0.0, 0.25, 0.5, 0.95, 1.0]).tolist() if len(values) else [None] * 5
            assert got[c] == pytest.approx(want)
    totals = R.running_total(spark.range(1000).withColumn("w", F.col("id") % 3), ["id"], F.col("w"), "t").orderBy("id").collect()
    assert [r["t"] for r in totals] == np.cumsum(np.arange(1000) % 3).tolist()
    one = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "x string")
    assert sorted(tuple(r) for r in P.label_codes(one, "x").collect()) == [("a", 0), ("b", 1), ("nan", 2)]


def test_model_freezes_what_it_fitted(spark):
    """Old and new rows: a new pattern, a new category, values outside the edges, nulls and infinities."""
    old = spark.createDataFrame([(i, float(i % 4), "ab"[i % 2], 1.0, None if i % 3 else 2.0) for i in range(40)], "id long, x double, c string, same double, sparse double")
    cleaner = MD.Cleaner.fit(old, "id", ["x", "c", "same", "sparse"])
    assert cleaner.columns == ["x", "c"] and sorted(cleaner.dropped) == ["same", "sparse"]
    clean = cleaner.transform(old)
    model = MD.Model.fit(clean, S.Plan("id", [["x", "c"]], 4), share=10.0)
    again = {r["id"]: r["anomaly_score"] for r in model.score(clean).collect()}
    new = spark.createDataFrame([(0, 0.0, "a", 1.0, 2.0), (100, 0.0, "b", 1.0, None), (101, float("inf"), "never", 1.0, None), (102, 1e9, None, 1.0, None)], old.schema)
    got = {r["id"]: r for r in model.score(cleaner.transform(new)).collect()}
    assert got[0]["anomaly_score"] == again[0]
    # Pattern (0, b) was never seen: each of the four that were has ten rows.
    assert got[100]["group_0"] == pytest.approx(np.log(1 / 44)) and got[100]["is_anomaly"]
    rows = {r["id"]: r for r in cleaner.transform(new).collect()}
    assert rows[101]["c"] == 0 and rows[102]["c"] == 0 and rows[101]["x"] == pytest.approx(0.0)  # code of no category, mode, median
    assert {r["column_name"]: r["state"] for r in cleaner.summary(spark).collect()} == {"x": "kept", "c": "kept", "same": "dropped", "sparse": "dropped"}
    with pytest.raises(ValueError):
        MD.Cleaner.fit(old.limit(0), "id", ["x", "c"])


def test_scores_read_the_rows_once_for_any_groups(spark):
    df = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey", *[(F.col("l_quantity") + i).alias(f"c{i}") for i in range(12)])
    plans = [S.flagged(S.anomaly_scores(S.log_likelihoods(df, p), p)) for p in (S.Plan("l_orderkey", [[f"c{i}" for i in range(a, a + k)] for a in range(0, 12, k)], 3) for k in (6, 2))]
    for out in plans:
        text = out._jdf.queryExecution().executedPlan().toString()
        assert text.count("lineitem.parquet") <= 1


def plain_patterns(rows, groups):
    from collections import Counter

    counts = [Counter(tuple(r[j] for j in g) for r in rows) for g in groups]
    return [[np.log((c[tuple(r[j] for j in g)] + 1) / (len(rows) + len(c))) for g, c in zip(groups, counts, strict=True)] for r in rows]


@pytest.mark.parametrize("bins, width", [(4, 6), (4, 40)])
def test_rare_patterns_travel_in_one_shuffle(spark, bins, width):
    """Groups with nearly a pattern a row, one pattern of half the rows, nulls, and codes of one number or of several."""
    rng = np.random.default_rng(width)
    x = rng.integers(0, bins, (600, width)).astype(float)
    x[:300] = x[0]
    x[-2:] = [[0.0] * width, [bins - 1.0] * width]
    columns = [f"c{j}" for j in range(width)]
    rows = [(i, *[None if (i * 7 + j) % 97 == 0 else v for j, v in enumerate(r)]) for i, r in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in columns)).repartition(5)
    groups = [[(i + j) % width for j in range(width - i % 3)] for i in range(9)]
    want = plain_patterns([r[1:] for r in rows], groups)
    plan = S.Plan("id", [[columns[j] for j in g] for g in groups], bins)
    edges = {c: (0.0, float(bins)) for c in columns}  # codes are the values themselves
    for most in (0, 5, 40, 100_000):
        got = sorted(tuple(r) for r in S.log_likelihoods(df, plan, None, edges, most).collect())
        assert [r[0] for r in got] == list(range(600))
        assert np.allclose([r[1:] for r in got], want)
    table = S.frequency_table(df, plan, edges)
    new = df.limit(50).union(df.limit(1).select(F.lit(1000).cast("long"), *[F.lit(bins - 1.5) if j % 2 else F.lit(0.5) for j in range(width)]))
    for most in (0, 100_000):
        got = {r["id"]: r[1:] for r in S.log_likelihoods(new, plan, table, edges, most).collect()}
        assert all(np.allclose(v, want[k]) for k, v in got.items() if k < 1000)
        assert np.isclose(got[1000][0], np.log(1 / (600 + len({tuple(r[j + 1] for j in groups[0]) for r in rows}))))


def test_wide_groups_are_coded_in_methods_that_the_jvm_compiles(spark):
    """The JVM interprets methods of over 8,000 bytes for good."""
    df = spark.range(100).select("id", *[F.col("id").cast("double").alias(f"c{j}") for j in range(28)])
    plan = S.Plan("id", [[f"c{(2 * i + j) % 28}" for j in range(10 + i % 6)] for i in range(14)], 5)
    rows = S.coded(df, plan, {c: (0.0, 99.0) for c in plan.columns})
    text = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "codegen")
    sizes = [int(x) for x in __import__("re").findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000, sizes


def test_codes_are_those_of_the_bins(spark):
    """Columns of all number types with nulls, NaN, infinities, signed zeros, values outside the edges, on the edges and beyond 2**53."""
    inf, nan, big = float("inf"), float("nan"), 2**53
    some = [(0.0, 0, 0, 0.0), (-0.0, 1, 3, 0.1), (0.3, 2, big + 1, nan), (0.6, 3, big + 3, inf), (nan, 4, -big, -inf), (None, None, None, None), (1.5, 127, 7, 0.7), (-inf, -128, 9, 0.2), (inf, 5, 11, 0.3)]
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(some)], "id string, a double, b byte, c long, d float").selectExpr("*", "cast(b as decimal(9, 2)) as e", "5L as f")
    plan = S.Plan("id", [list("abcdef"), ["e", "a"], ["d"], ["f", "c"]], 3)
    for edges in (None, {"a": (0.0, 0.9), "b": (0, 4), "c": (0, 2 * big + 5), "d": (0.1, 0.7), "e": (0, 3), "f": (None, None)}, {"a": (-inf, 1.0), "b": (-128, 127), "c": (-big, big + 3), "d": (0.0, inf), "e": (1, 1), "f": (5, 9)}):
        bins = {r["id"]: r for r in S.bin_columns(df, plan.columns, 3, edges).collect()}
        for r in S.coded(df, plan, edges).collect():
            for i, g in enumerate(plan.groups):
                assert r[f"code_{i}"] == sum((3 if bins[r["id"]][c] is None else bins[r["id"]][c]) * 4 ** (len(g) - 1 - k) for k, c in enumerate(g)), (r, g, edges)
    wide = S.Plan("id", [list("abcdef") * 6], 3)
    one = {r["id"]: r["code_0"] for r in S.coded(df, plan).collect()}
    assert {r["id"]: r["code_0"] for r in S.coded(df, wide).collect()} != one and all(r["code_0"].count(",") == 1 for r in S.coded(df, wide).collect())


def test_shuffles_do_not_grow_with_groups(spark):
    df = spark.range(500).select("id", *[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(5)).cast("double").alias(f"c{i}") for i in range(16)])
    seen = []
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        for n in (2, 14):
            plan = S.Plan("id", [[f"c{(i + j) % 16}" for j in range(10)] for i in range(n)], 5)
            text = S.log_likelihoods(df, plan, None, None, 10)._jdf.queryExecution().executedPlan().toString()
            seen.append((text.count("Exchange hashpartitioning"), text.count("Exchange SinglePartition"), text.count("SortMergeJoin") + text.count("ShuffledHashJoin")))
        text = S.log_likelihoods(df, plan, None, None, 100_000)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in text  # all patterns are sent
    finally:
        for k in off:
            spark.conf.unset(k)
    assert seen[0] == seen[1] and seen[0][0] <= 4 and seen[0][1] == 0 and seen[0][2] == 2, seen


def test_forest_flags_the_far_end(spark):
    rng = np.random.default_rng(0)
    x = np.round(np.concatenate((rng.normal(size=2000), rng.uniform(6, 9, 40))), 4)
    scored = spark.createDataFrame([(float(v),) for v in x], "anomaly_score double")
    at = S.threshold_value(scored, "forest", 2.5)
    assert (x > at).sum() < len(x) and at <= 9
    cuts, paths = FO.path_lengths(x[:50], np.random.default_rng(1), 6)
    assert np.all(np.diff(cuts) >= 0) and len(paths) == len(cuts) + 1
    assert S.threshold_value(scored.limit(0), "forest") is None


def test_bands_and_comparison(spark):
    d = spark.createDataFrame([(x,) for x in (1.2, 0.9, 0.5, 0.3, 0.1)], "x double")
    assert [r[0] for r in d.select(M.effect_level(F.col("x"))).collect()] == ["excellent", "good", "moderate", "weak", "poor"]
    r = spark.createDataFrame([(x,) for x in (3.0, 5.0, 1.5, 7.0, 7.1, 0.4)], "x double")
    assert [x[0] for x in r.select(M.rate_level(F.col("x"))).collect()] == ["optimal", "optimal", "conservative", "aggressive", "unusual", "unusual"]
    assert [x[0] for x in r.select(M.quality_points(F.col("x"), "anomaly_rate")).collect()] == [4, 4, 2, 2, 2, 0]


def plain_bic(rows, node, parents):
    from collections import Counter

    joint, given = Counter(tuple(r[c] for c in (*parents, node)) for r in rows), Counter(tuple(r[c] for c in parents) for r in rows)
    free = (len({r[node] for r in rows}) - 1) * int(np.prod([len({r[p] for r in rows}) for p in parents] or [1]))
    return sum(n * np.log(n / given[k[:-1]]) for k, n in joint.items()) - 0.5 * np.log(len(rows)) * free


def plain_k2(rows, node, parents):
    from collections import Counter
    from math import lgamma

    kinds = sorted({r[node] for r in rows})
    joint, given = Counter(tuple(r[c] for c in (*parents, node)) for r in rows), Counter(tuple(r[c] for c in parents) for r in rows)
    return sum(lgamma(len(kinds)) - lgamma(n + len(kinds)) + sum(lgamma(joint[(*g, k)] + 1) for k in kinds) for g, n in given.items())


def test_structure_scores_and_searches(spark):
    rng = np.random.default_rng(11)
    n = 3000
    a, b = rng.choice(3, n, p=[0.6, 0.3, 0.1]), rng.integers(0, 2, n)
    c = (a + b + (rng.random(n) < 0.1)) % 3
    d = (c + (rng.random(n) < 0.15)) % 3
    rows = [dict(zip("abcd", map(int, r), strict=True)) for r in zip(a, b, c, d, strict=True)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "a long, b long, c long, d long")
    sums = N.SetSums(N.counted_patterns(df, list("abcd")))
    families = [("c", frozenset("ab")), ("d", frozenset("c")), ("a", frozenset())]
    sums.ask({frozenset()} | {frozenset(x) for x in "abcd"} | {s for x, ps in families for s in (ps, ps | {x})})
    sums.ask_counts(set(families))
    for x, ps in families:
        assert sums.bic(x, ps) == pytest.approx(plain_bic(rows, x, sorted(ps)))
        assert sums.k2(x, ps) == pytest.approx(plain_k2(rows, x, sorted(ps)), rel=1e-9)
    arcs, _ = N.skeleton(df, list("abcd"), alpha=0.001)
    assert arcs == {frozenset("ac"), frozenset("bc"), frozenset("cd")}
    assert N.pc_arcs(df, list("abcd"), alpha=0.001) == {"a": [], "b": [], "c": ["a", "b"], "d": ["c"]}
    for score in ("bic", "k2"):
        found = N.hill_climb(df, list("abcd"), score=score)
        assert {frozenset((p, x)) for x, ps in found.items() for p in ps} >= {frozenset("ac"), frozenset("bc"), frozenset("cd")}
    assert set(N.learned_networks(df, [["a", "b"], ["c"], ["c", "d"]])) == {0, 2}
    for x, free, want in ((3.841458821, 1, 0.05), (5.991464547, 2, 0.05), (18.30703805, 10, 0.05), (1e-9, 3, 1.0), (200.0, 5, 2.8e-41)):
        assert N.chi_square_tail(x, free) == pytest.approx(want, rel=1e-2)


def test_conditional_tables_of_new_rows(spark):
    """Nulls are a value; parents never seen add -5, a value never seen with its parents adds -10, and so does one beyond the bins."""
    rows = [(i, i % 2, (i % 2) if i % 8 else None, i % 3) for i in range(48)]
    df = spark.createDataFrame(rows, "id long, a long, b long, c long")
    tables = N.ConditionalTables.fit(df, {0: {"a": [], "b": ["a"], "c": ["a", "b"]}, 1: {"c": []}}, 3)
    got = {r["id"]: (r["x"], r["y"]) for r in df.select("id", tables.log_likelihood(0).alias("x"), tables.log_likelihood(1).alias("y")).collect()}
    p = lambda keep, of: np.log(sum(map(keep, rows)) / sum(map(of, rows)))
    for r in rows:
        x = p(lambda s: s[1] == r[1], lambda s: True) + p(lambda s: s[1:3] == r[1:3], lambda s: s[1] == r[1]) + p(lambda s: s[1:] == r[1:], lambda s: s[1:3] == r[1:3])
        assert got[r[0]] == pytest.approx((x, np.log(1 / 3)))
    new = spark.createDataFrame([(0, 2, 0, 0), (1, 1, 0, 0), (2, 1, None, 1), (3, 0, 0, 9)], df.schema)
    got = {r["id"]: r["x"] for r in new.select("id", tables.log_likelihood(0).alias("x")).collect()}
    assert got[0] == -10 - 5 - 5 and got[1] == pytest.approx(np.log(0.5) - 10 - 5) and got[2] == pytest.approx(np.log(0.5) - 10 - 5)
    with pytest.raises(ValueError):
        N.ConditionalTables.fit(df, {0: {"a": [f"p{i}" for i in range(12)]}}, 5)
    assert N.ConditionalTables.fit(df.limit(0), {0: {"a": []}}, 3).cells[0, "a"] == [-5.0] * 4
    assert N.learn_structures(df.limit(0), [["a"], ["b", "c"]], "pc") == {0: {"a": []}, 1: {"b": [], "c": []}}


def test_models_of_every_kind_are_saved(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 4), float(i % 3), float((i // 4) % 2)) for i in range(60)], "id long, x double, y double, z double")
    for likelihood in ("pattern", "cpd"):
        model = MD.Model.fit(df, S.Plan("id", [["x", "y"], ["z"]], 3), share=10.0, likelihood=likelihood, structure="hc")
        model.save(spark, str(tmp_path / likelihood))
        again = MD.Model.load(spark, str(tmp_path / likelihood))
        assert sorted(map(tuple, again.score(df).collect())) == sorted(map(tuple, model.score(df).collect()))
        assert again.updated(df, threshold=-9.0).score(df).where("NOT is_anomaly").isEmpty()
        assert again.updated(df, how="max", share=30.0).cut["share"] == 30.0
    _, _, scored = MD.detect(df, "id", ["x", "y", "z"], grouping="variance", likelihood="cpd", structure="pc")
    assert scored.count() == 60


def test_groups_have_exact_quantiles_and_samples(spark):
    rng = np.random.default_rng(2)
    rows = [(None if g == 3 else g, float(v)) for g, n in enumerate((1, 2, 700, 41)) for v in rng.integers(0, 50, n)] + [(9, None)]
    df = spark.createDataFrame(rows, "g long, v double").repartition(5)
    got = {r["g"]: tuple(r)[1:] for r in R.grouped_quantiles(df, ["g"], "v", [0.0, 0.3, 0.5, 1.0]).collect()}
    for g in (0, 1, 2, None):
        own = [v for h, v in rows if h == g and v is not None]
        assert got[g] == pytest.approx((len(own), *np.quantile(own, [0.0, 0.3, 0.5, 1.0])))
    assert set(got) == {0, 1, 2, None}
    flags = spark.range(3000).select("id", (F.col("id") % 10 == 0).alias("is_anomaly")).repartition(7)
    one = sorted(r["id"] for r in M.heatmap_sample(flags, "id").collect())
    assert one == sorted(r["id"] for r in M.heatmap_sample(flags.repartition(2), "id").collect())
    assert len(set(one)) == 100 and sum(i % 10 == 0 for i in one) == 20
    assert one != sorted(r["id"] for r in M.heatmap_sample(flags, "id", seed=1).collect())
    assert M.heatmap_sample(flags.where("id < 50"), "id").count() == 50
    assert M.heatmap_sample(flags.where("NOT is_anomaly"), "id").count() == 100


def test_statistics_without_anomalies(spark):
    flags = spark.createDataFrame([(float(i), False) for i in range(5)], "anomaly_score double, is_anomaly boolean")
    got = {r["part"]: r for r in M.score_statistics(flags).collect()}
    assert got["all"]["median"] == 2.0 and got["anomalies"]["n"] == 0 and got["anomalies"]["median"] is None
    assert {r["part"]: r["n"] for r in M.score_statistics(flags.limit(0)).collect()} == {"all": 0, "anomalies": 0}


def test_csv_types_follow_all_rows(spark, tmp_path):
    """Missing values, infinities, signs, leading zeros, one odd value in a late row, quotes; columns that no value fills."""
    lines = ["whole,real,inf,code,mixed,flag,day,time,none,text"]
    lines += [f"{i},{i}.5,{'-inf' if i == 7 else i},{i:03d},{i},{'True' if i % 2 else 'False'},2024-01-0{i % 9 + 1},2024-01-01 00:00:{i % 60:02d}.5,NA,\"a \"\"{i}\"\", b\"" for i in range(40)]
    lines += ["NaN,nan,+Infinity,,x,,,,,", "+5,1e3,.5,007,1,true,,,,plain"]
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    df = T.read_any_csv(spark, str(tmp_path / "t.csv"))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "double", "bigint", "string", "boolean", "string", "string", "double", "string"]
    rows = df.collect()
    assert rows[40][0] is None and rows[40][1] is None and rows[40][2] == float("inf") and rows[7][2] == float("-inf")
    assert rows[41][0] == 5 and rows[41][1] == 1000.0 and rows[41][3] == 7 and rows[0][9] == 'a "0", b' and rows[40][9] is None
    kinds = dict(T.read_any_csv(spark, str(tmp_path / "t.csv"), times=True, zeros=False).dtypes)
    assert kinds["code"] == "string" and kinds["time"] == "timestamp"
    (tmp_path / "e.csv").write_text("a,b\n")
    assert T.read_any_csv(spark, str(tmp_path / "e.csv")).dtypes == [("a", "double"), ("b", "double")]


def test_duplicates_compare_whole_rows(spark):
    rows = [(1, None, 0.0), (1, None, -0.0), (1, "a", float("nan")), (1, "a", float("nan")), (None, "a", 1.0), (2, "a", 1.0), (2, None, 1.0)]
    assert P.duplicate_rows(spark.createDataFrame(rows, "`a b` long, t string, x double")).first()[0] == 2
    assert P.duplicate_rows(spark.createDataFrame([], "a long, t string")).first()[0] == 0


def test_a_stream_is_scored_as_a_batch(spark, tmp_path):
    """Two arrivals, the second after the first run; a batch written again is there once."""
    from patternscore.streaming.scores import score_stream, scored

    df = spark.createDataFrame([(i, float(i % 5), float(i % 3)) for i in range(80)], "id long, x double, y double")
    model = MD.Model.fit(df, S.Plan("id", [["x", "y"]], 3))
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in ("id < 50", "id >= 50"):
        df.where(part).write.mode("append").parquet(source)
        score_stream(spark.readStream.schema(df.schema).parquet(source), model, out, state).awaitTermination()
    assert sorted(map(tuple, scored(spark, out).collect())) == sorted(map(tuple, model.score(df).collect()))


def test_group_files_and_domains(spark, tmp_path):
    groups = [["a", "b"], ["c"]]
    G.save_groups(spark, groups, str(tmp_path / "groups"))
    assert G.load_groups(spark, str(tmp_path / "groups")) == groups
    names = ["V_1", "V_2", "V_3", "phase_Gr_V_1", "I_1", "I_2", "I_3", "x", "THD_1"]
    assert G.domain_groups(names, 10) == [["V_1", "V_2", "V_3", "phase_Gr_V_1", "THD_1"], ["I_1", "I_2", "I_3", "x"]]


def plain_linkage(corr, columns, size):
    clusters = [[i] for i in range(len(columns))]
    while len(clusters) > max(1, min(len(columns) // size, len(columns) // 2)):
        pairs = [(np.mean([1 - corr[a, b] for a in x for b in y]), i, j) for i, x in enumerate(clusters) for j, y in enumerate(clusters) if i < j]
        _, i, j = min(pairs)
        clusters[i] += clusters.pop(j)
    groups = [[columns[i] for i in sorted(c)] for c in clusters]
    return G.chunks([c for g in groups for c in g], size) if any(len(g) > 1.5 * size for g in groups) else groups


def test_linkage_by_chain_equals_plain_linkage():
    import time

    rng = np.random.default_rng(1)
    for p, size in ((1, 3), (2, 3), (9, 2), (30, 4), (30, 20), (41, 7)):
        corr = np.abs(np.corrcoef(rng.normal(size=(p, 60)) + rng.integers(0, 4, (p, 1)) * rng.normal(size=60))).reshape(p, p)
        assert G.linked_groups(corr, [f"c{i}" for i in range(p)], size) == plain_linkage(corr, [f"c{i}" for i in range(p)], size)
    began = time.time()
    corr = np.abs(np.corrcoef(rng.normal(size=(2000, 50))))
    assert sorted(c for g in G.linked_groups(corr, list(range(2000)), 15) for c in g) == list(range(2000))
    assert time.time() - began < 30


def test_groups_by_every_strategy(spark):
    df = spark.createDataFrame([(float(i), i * 2.0 + (i % 3), float((i * 7) % 11), float((i * 5) % 13)) for i in range(50)], "V_a double, V_b double, I_c double, x double")
    for strategy in (*G.STRATEGIES, "other"):
        groups = G.create_groups(df, df.columns, 2, strategy)
        assert sorted(c for g in groups for c in g) == sorted(df.columns), strategy
    assert G.create_groups(df, df.columns, 2, "variance") == [["V_b", "x"], ["V_a", "I_c"]]


def test_more_groups():
    corr = np.eye(6)
    for i, j in ((0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)):
        corr[i, j] = corr[j, i] = 0.9
    assert G.linked_components(corr, list("abcdef"), 3) == [list("abc"), list("def")]
    assert sorted(G.kmeans_groups(corr, list("abcdef"), 3)) == [list("abc"), list("def")]
    assert G.merged_small([list("abc"), ["d"], ["e", "f"], list("ghi")]) == [list("abcdf"), list("ghie")]


def test_tables_are_read_checked_and_written(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\ninf,x\nNaN,\n" + "1.5,y\n" * 8)
    df = T.validated(T.read_csv(spark, str(tmp_path / "t.csv"), "a double, b string"))
    assert df.where("a = double('inf')").count() == 1 and df.where("b IS NULL").count() == 1 and df.where("isnan(a)").count() == 1
    with pytest.raises(ValueError):
        T.validated(df.limit(9))
    with pytest.raises(ValueError):
        T.validated(df.select("a"))
    T.write_results(df, str(tmp_path / "out"), "csv")
    assert T.read_csv(spark, str(tmp_path / "out"), "a double, b string").count() == 10


def test_detect_aggregates_its_input_once(spark, monkeypatch):
    """What cleaning reads many times is a saved table, not the plan of the input."""
    seen = []

    def fit(df, *rest):
        seen.append(df)
        raise InterruptedError

    monkeypatch.setattr(MD.Cleaner, "fit", fit)
    df = spark.range(20).groupBy((F.col("id") % 5).alias("id")).agg(F.sum("id").alias("x"), F.max("id").alias("y"))
    with pytest.raises(InterruptedError):
        MD.detect(df, "id", ["x", "y"])
    assert "Aggregate" not in seen[0]._jdf.queryExecution().executedPlan().toString() and seen[0].count() == 5
