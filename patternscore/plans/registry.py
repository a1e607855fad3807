"""Queries of the unusual-row engine and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fitness as FT
from ..operators import grouping as G
from ..operators import metrics as M
from ..operators import model as MD
from ..operators import networks as N
from ..operators import optimise as O
from ..operators import preprocess as P
from ..operators import scoring as S
from ..sources import tables as T
from ..sources.shared import new_path, saved
from ..streaming.scores import score_stream, scored

QUERIES: dict = {}
ORACLE_SQL: dict = {}

ROLLUP = ["n_lines", "quantity", "price", "discount", "tax", "top_price", "n_returned"]
ORDERS = S.Plan("o_orderkey", [["o_totalprice", "status"], ["priority", "day"]], 3)


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gappy_orders(spark, sf_dir) -> DataFrame:
    """orders with missing values: prices over 300000, status P and priority 1-URGENT are null."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.when(F.col("o_totalprice") <= 300000, F.col("o_totalprice")).alias("price"), F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("priority"))


def order_features(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long")
    base = o.select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), day.alias("day"))
    return P.label_encode(P.label_encode(base, "status"), "priority")


def order_rollup(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").cast("double").alias("n_lines"), F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"), F.avg("l_discount").alias("discount"),
        F.avg("l_tax").alias("tax"), F.max("l_extendedprice").alias("top_price"), F.sum(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("n_returned"),
    )


_GAPPY = "g AS (SELECT o_orderkey, CASE WHEN o_totalprice <= 300000 THEN o_totalprice END AS price, nullif(o_orderstatus, 'P') AS status, nullif(o_orderpriority, '1-URGENT') AS priority FROM orders)"
_ROLLUP = """r AS (SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS n_lines, sum(l_quantity) AS quantity, sum(l_extendedprice) AS price, avg(l_discount) AS discount,
  avg(l_tax) AS tax, max(l_extendedprice) AS top_price, sum(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS n_returned FROM lineitem GROUP BY l_orderkey)"""


def _edges(c: str, bins: int) -> str:
    return "CASE WHEN hi > lo THEN ".replace("hi", f"max({c}) OVER ()").replace("lo", f"min({c}) OVER ()") + " + ".join(
        f"CAST({c} >= min({c}) OVER () + {i} * (max({c}) OVER () - min({c}) OVER ()) / {bins} AS BIGINT)" for i in range(1, bins)
    ) + f" WHEN {c} IS NOT NULL THEN 0 END"


_FEATURES = """f AS (SELECT o_orderkey, o_totalprice, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS status, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS priority,
  date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders)"""
_BINNED = f"{_FEATURES}, b AS (SELECT o_orderkey, {', '.join(f'{_edges(c, 3)} AS {c}' for c in ORDERS.columns)} FROM f)"
_PATTERNS = f"{_BINNED}, p AS (SELECT o_orderkey, 0 AS group_id, concat_ws('|', o_totalprice, status) AS pattern FROM b UNION ALL SELECT o_orderkey, 1, concat_ws('|', priority, day) FROM b), c AS (SELECT group_id, pattern, count(*) AS n FROM p GROUP BY ALL), w AS (SELECT *, ln((n + 1) / sum(n + 1) OVER (PARTITION BY group_id)) AS ll FROM c)"
_LL = f"{_PATTERNS}, l AS (SELECT o_orderkey, max(ll) FILTER (group_id = 0) AS group_0, max(ll) FILTER (group_id = 1) AS group_1 FROM p JOIN w USING (group_id, pattern) GROUP BY o_orderkey)"
_SCORED = f"{_LL}, a AS (SELECT *, -(group_0 + group_1) / 2 AS raw FROM l), s AS (SELECT *, round((raw - avg(raw) OVER ()) / stddev_pop(raw) OVER (), 9) AS anomaly_score FROM a)"
_FLAGS = f"{_SCORED}, t AS (SELECT quantile_cont(anomaly_score, 0.95) AS threshold FROM s), x AS (SELECT s.*, threshold, anomaly_score > threshold AS is_anomaly FROM s, t)"


def order_likelihoods(spark, sf_dir) -> DataFrame:
    """Group scores of all orders, saved: mean, threshold and flags read this narrow table, not the orders."""
    return saved(S.log_likelihoods(order_features(spark, sf_dir), ORDERS), "likelihoods")


def scored_orders(spark, sf_dir) -> DataFrame:
    """Scores are rounded to 9 places, so that equal patterns tie whatever the order of summation."""
    out = S.anomaly_scores(order_likelihoods(spark, sf_dir), ORDERS)
    return out.withColumn("anomaly_score", F.round("anomaly_score", 9))


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in columns})


@query(f"WITH {_GAPPY} SELECT column_name, n_missing, round(n_missing / n, 6) AS share FROM (SELECT count(*) AS n, count(*) - count(price) AS price, count(*) - count(status) AS status, count(*) - count(priority) AS priority FROM g) UNPIVOT (n_missing FOR column_name IN (price, status, priority))")
def null_profile(spark, sf_dir):
    return P.missing_profile(gappy_orders(spark, sf_dir), ["price", "status", "priority"])


@query(f"WITH {_GAPPY} SELECT o_orderkey, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM g)) AS price FROM g")
def impute_median(spark, sf_dir):
    return P.impute_median(gappy_orders(spark, sf_dir).select("o_orderkey", "price"), ["price"])


@query(f"WITH {_GAPPY} SELECT o_orderkey, coalesce(status, (SELECT status FROM g WHERE status IS NOT NULL GROUP BY status ORDER BY count(*) DESC, status LIMIT 1)) AS status FROM g")
def impute_mode(spark, sf_dir):
    return P.impute_mode(gappy_orders(spark, sf_dir).select("o_orderkey", "status"), ["status"])


@query("SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority FROM orders")
def label_encode(spark, sf_dir):
    return P.label_encode(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")


@query("WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT event_id, round(least(greatest(value, a - 0.5 * (b - a)), b + 0.5 * (b - a)), 6) AS value FROM events, q")
def iqr_clip(spark, sf_dir):
    return rounded(P.clip_outliers(table(spark, sf_dir, "events").select("event_id", "value"), ["value"], 0.5), "value")


@query("SELECT event_id, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 6) AS value FROM events")
def zscore(spark, sf_dir):
    return rounded(P.standardise(table(spark, sf_dir, "events").select("event_id", "value"), ["value"]), "value")


@query("SELECT event_id, value, user_id FROM events")
def drop_constant(spark, sf_dir):
    return P.drop_constant(table(spark, sf_dir, "events").select("event_id", "value", "user_id", F.lit(1).alias("one")), ["value", "user_id", "one"])


@query(f"WITH {_GAPPY} SELECT o_orderkey, status, priority FROM g")
def drop_sparse(spark, sf_dir):
    o = gappy_orders(spark, sf_dir).withColumn("price", F.when(F.col("o_orderkey") < 0, F.col("price")))
    return P.drop_sparse(o, ["price", "status", "priority"])


@query("SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS low, max(value) AS high, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75 FROM events")
def summary_stats(spark, sf_dir):
    return P.summary(table(spark, sf_dir, "events"), "value")


@query("WITH u AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_returnflag = 'R') SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM u)) AS n_duplicates FROM u")
def duplicate_rows(spark, sf_dir):
    """All lineitems with all columns, of which the returned ones are there twice."""
    rows = table(spark, sf_dir, "lineitem")
    return P.duplicate_rows(rows.union(rows.where("l_returnflag = 'R'")))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, user_id, event_type, value, props FROM events")
def csv_events(spark, sf_dir):
    """events written as CSV and read back without a schema: types are found from all rows."""
    path = new_path(spark, "csv")
    table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("string")).write.options(header=True, escape='"').csv(path)
    return T.read_any_csv(spark, path, times=True).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(f"WITH {_ROLLUP} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(coalesce(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 0), 6) AS r FROM r" for i, a in enumerate(ROLLUP) for b in ROLLUP[i + 1 :]))
def corr_pairs(spark, sf_dir):
    return G.correlation_pairs(order_rollup(spark, sf_dir), ROLLUP)


@query(f"WITH {_ROLLUP} SELECT column_name, variance, (row_number() OVER (ORDER BY variance DESC, column_name) - 1) % 2 AS group_id FROM (SELECT {', '.join(f'round(var_samp({c}), 3) AS {c}' for c in ROLLUP)} FROM r) UNPIVOT (variance FOR column_name IN ({', '.join(ROLLUP)}))")
def variance_rank_groups(spark, sf_dir):
    return G.variance_groups(order_rollup(spark, sf_dir), ROLLUP, 3)


@query()
def linked_groups(spark, sf_dir):
    """Average-linkage groups of the rollup's columns. The clustering loop is no SQL."""
    groups = G.linked_groups(G.correlation_matrix(order_rollup(spark, sf_dir), ROLLUP), ROLLUP, 3)
    return spark.createDataFrame([(i, c) for i, g in enumerate(groups) for c in g], "group_id long, column_name string")


@query()
def greedy_groups(spark, sf_dir):
    groups = G.greedy_groups(G.correlation_matrix(order_rollup(spark, sf_dir), ROLLUP), ROLLUP, 3)
    return spark.createDataFrame([(i, c) for i, g in enumerate(groups) for c in g], "group_id long, column_name string")


#: Two groups of the rollup's columns for the group information.
HALVES = [ROLLUP[:4], ROLLUP[4:]]


def _half_sql(i: int, g: list[str]) -> str:
    r = lambda a, b: "1.0" if a == b else f"abs(round(coalesce(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 0), 6))"
    pairs = " + ".join(r(a, b) for a in g for b in g)
    return f"SELECT CAST({i} AS BIGINT) AS group_id, CAST({len(g)} AS BIGINT) AS size, '{','.join(g)}' AS features, round(({' + '.join(f'round(var_samp({c}), 3)' for c in g)}) / {len(g)}, 3) AS mean_variance, round(({pairs}) / {len(g) ** 2}, 6) AS mean_correlation FROM r"


@query(f"WITH {_ROLLUP} " + " UNION ALL ".join(_half_sql(i, g) for i, g in enumerate(HALVES)))
def group_info(spark, sf_dir):
    return rounded(rounded(G.group_info(order_rollup(spark, sf_dir), HALVES), "mean_correlation"), "mean_variance", places=3)


@query("SELECT name, CASE WHEN contains(name, 'V_') THEN 'voltage' WHEN contains(name, 'I_') THEN 'current' WHEN contains(name, 'P_') THEN 'power' WHEN contains(name, 'phi_') OR contains(name, 'phase_') THEN 'phase' WHEN contains(name, '_H') OR contains(name, 'THD_') THEN 'harmonic' ELSE 'other' END AS domain FROM (SELECT DISTINCT p_name || unnest(['V_', 'I_', 'P_', 'phi_', '_H', 'x']) AS name FROM part)")
def domain_groups(spark, sf_dir):
    ends = F.explode(F.array(*[F.lit(x) for x in ("V_", "I_", "P_", "phi_", "_H", "x")]))
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("p"), ends.alias("e")).select(F.concat("p", "e").alias("name")).distinct()
    return names.select("name", G.domain_of(F.col("name")).alias("domain"))


@query(f"WITH {_BINNED} SELECT * FROM b")
def bin_uniform(spark, sf_dir):
    return S.bin_columns(order_features(spark, sf_dir), ORDERS.columns, 3).select("o_orderkey", *ORDERS.columns)


@query(f"WITH {_PATTERNS} SELECT CAST(group_id AS BIGINT) AS group_id, pattern, n FROM c")
def pattern_counts(spark, sf_dir):
    return S.pattern_counts(S.bin_columns(order_features(spark, sf_dir), ORDERS.columns, 3), ORDERS)


@query(f"WITH {_LL} SELECT o_orderkey, round(group_0, 6) AS group_0, round(group_1, 6) AS group_1 FROM l")
def pattern_loglik(spark, sf_dir):
    return rounded(S.log_likelihoods(order_features(spark, sf_dir), ORDERS), "group_0", "group_1")


#: Columns of the lineitems of an order, whole numbers or values as they are, in Spark and SQL alike.
WIDE = {
    "n_lines": "count(*)", "last_line": "max(l_linenumber)", "min_part": "min(l_partkey)", "max_part": "max(l_partkey)", "min_supp": "min(l_suppkey)", "max_supp": "max(l_suppkey)",
    **{f"{f}_{c}": f"{f}(l_{c})" for c in ("quantity", "extendedprice", "discount", "tax") for f in ("min", "max")},
    **{f"n_{x}": f"sum(CASE WHEN l_returnflag = '{x}' THEN 1 ELSE 0 END)" for x in "ANR"}, "n_open": "sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)",
    **{f"q_{x}": f"sum(CASE WHEN l_quantity > {x} THEN 1 ELSE 0 END)" for x in (10, 20, 30, 40)}, **{f"d_{x}": f"sum(CASE WHEN l_discount > 0.0{x} THEN 1 ELSE 0 END)" for x in (2, 5, 8)},
    **{f"p_{x}": f"sum(CASE WHEN l_extendedprice > {x} THEN 1 ELSE 0 END)" for x in (20000, 50000, 80000)},
}
#: 14 groups of 10 to 15 of them: nearly every order has patterns of its own.
WIDE_GROUPS = [[list(WIDE)[(2 * i + j) % len(WIDE)] for j in range(10 + i % 6)] for i in range(14)]


def wide_rollup(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[F.expr(f"CAST({e} AS DOUBLE) AS {c}") for c, e in WIDE.items()])


def _wide_sql(i: int, g: list[str]) -> str:
    cols = ", ".join(g)
    return f"round(ln((count(*) OVER (PARTITION BY {cols}) + 1) / (SELECT count(*) + count(DISTINCT ({cols})) FROM b)), 6) AS group_{i}"


@query(f"WITH v AS (SELECT l_orderkey, {', '.join(f'CAST({e} AS DOUBLE) AS {c}' for c, e in WIDE.items())} FROM lineitem GROUP BY l_orderkey), b AS (SELECT l_orderkey, {', '.join(f'{_edges(c, 5)} AS {c}' for c in WIDE)} FROM v) SELECT l_orderkey, {', '.join(_wide_sql(i, g) for i, g in enumerate(WIDE_GROUPS))} FROM b")
def wide_pattern_loglik(spark, sf_dir):
    """Pattern log-frequencies of 14 wide groups."""
    plan = S.Plan("l_orderkey", WIDE_GROUPS, 5)
    return rounded(S.log_likelihoods(saved(wide_rollup(spark, sf_dir), "rollup"), plan), *plan.scores)


def _aggregate(how: str, sql: str):
    def f(spark, sf_dir):
        ll = S.log_likelihoods(order_features(spark, sf_dir), ORDERS)
        return ll.select("o_orderkey", F.round(S.aggregated(ORDERS.scores, how, [1.0, 3.0]), 6).alias("score"))

    f.__name__ = f"agg_{how}"
    query(f"WITH {_LL} SELECT o_orderkey, round({sql}, 6) AS score FROM l")(f)


for _how, _sql in {"mean": "(group_0 + group_1) / 2", "min": "least(group_0, group_1)", "max": "greatest(group_0, group_1)", "median": "(least(group_0, group_1) + greatest(group_0, group_1)) / 2", "sum": "group_0 + group_1", "weighted": "(group_0 + 3 * group_1) / 4"}.items():
    _aggregate(_how, _sql)


@query(f"WITH {_SCORED} SELECT o_orderkey, round(anomaly_score, 6) AS anomaly_score FROM s")
def zscore_scores(spark, sf_dir):
    return rounded(scored_orders(spark, sf_dir), "anomaly_score").select("o_orderkey", "anomaly_score")


@query(f"WITH {_SCORED} SELECT o_orderkey, round((rank() OVER (ORDER BY anomaly_score) + (count(*) OVER (PARTITION BY anomaly_score) - 1) / 2) / count(*) OVER (), 6) AS rank_share FROM s")
def rank_scores(spark, sf_dir):
    return rounded(S.average_ranks(scored_orders(spark, sf_dir)), "rank_share").select("o_orderkey", "rank_share")


def _threshold(method: str, sql: str):
    def f(spark, sf_dir):
        return rounded(S.threshold(scored_orders(spark, sf_dir), method), "threshold")

    f.__name__ = f"thr_{method}"
    query(f"WITH {_SCORED} {sql}" if sql else None)(f)


_threshold("percentile", "SELECT round(quantile_cont(anomaly_score, 0.95), 6) AS threshold FROM s")
_threshold("std", "SELECT round(avg(anomaly_score) + 2 * stddev_pop(anomaly_score), 6) AS threshold FROM s")
_threshold("iqr", "SELECT round(quantile_cont(anomaly_score, 0.75) + 1.5 * (quantile_cont(anomaly_score, 0.75) - quantile_cont(anomaly_score, 0.25)), 6) AS threshold FROM s")
_threshold("forest", "")
_threshold("adaptive", f", m AS (SELECT CAST(count(*) AS DOUBLE) AS n, any_value(mean) AS mean, sqrt(avg(power(anomaly_score - mean, 2))) AS std, avg(power(anomaly_score - mean, 3)) AS m3, avg(power(anomaly_score - mean, 4)) AS m4, quantile_cont(anomaly_score, 0.95) AS cut FROM s, (SELECT avg(anomaly_score) AS mean FROM s)) SELECT round(CASE WHEN {S.NORMAL_SQL} < {S.NORMAL_K2} THEN mean + 2 * std ELSE cut END, 6) AS threshold FROM m")


@query(f"WITH {_FLAGS} SELECT o_orderkey, round(anomaly_score, 6) AS anomaly_score, is_anomaly FROM x")
def flag_anomalies(spark, sf_dir):
    return rounded(S.flagged(scored_orders(spark, sf_dir)), "anomaly_score").select("o_orderkey", "anomaly_score", "is_anomaly")


@query("SELECT count(*) AS n_rows, CAST(3 AS BIGINT) AS n_columns, CAST(1 AS BIGINT) AS n_numeric, CAST(2 AS BIGINT) AS n_categorical, 3 * count(*) - count(price) - count(status) - count(priority) AS n_missing, round(100 * (3 * count(*) - count(price) - count(status) - count(priority)) / (3 * count(*)), 6) AS missing_percent, CAST((count(price) < count(*)) AS BIGINT) + CAST((count(status) < count(*)) AS BIGINT) + CAST((count(priority) < count(*)) AS BIGINT) AS columns_with_missing, CAST(2 * count(price) < count(*) AS BIGINT) + CAST(2 * count(status) < count(*) AS BIGINT) + CAST(2 * count(priority) < count(*) AS BIGINT) AS sparse_columns FROM g".join([f"WITH {_GAPPY} ", ""]))
def table_profile(spark, sf_dir):
    return P.table_profile(gappy_orders(spark, sf_dir).drop("o_orderkey"))


@query(f"WITH {_GAPPY} SELECT o_orderkey FROM g WHERE price IS NOT NULL AND status IS NOT NULL AND priority IS NOT NULL")
def drop_incomplete(spark, sf_dir):
    return P.drop_incomplete(gappy_orders(spark, sf_dir), ["price", "status", "priority"]).select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 0 ELSE o_totalprice END AS price FROM orders")
def infinite_to_zero(spark, sf_dir):
    price = F.when(F.col("o_totalprice") > 300000, float("inf")).otherwise(F.col("o_totalprice")).alias("price")
    return table(spark, sf_dir, "orders").select("o_orderkey", price).withColumn("price", P.infinite_to_zero("price"))


#: Orders before 1997 are old rows, the others new ones: the cleaning and scoring of all are fitted on the old ones.
_OLD = "CAST(o_orderdate AS DATE) < DATE '1997-01-01'"


def dated_orders(spark, sf_dir) -> DataFrame:
    """Prices over 300000 and priority 1-URGENT are null; old orders have no status P."""
    o = table(spark, sf_dir, "orders")
    old = F.to_date("o_orderdate") < F.lit("1997-01-01").cast("date")
    status = F.when(~old | (F.col("o_orderstatus") != "P"), F.col("o_orderstatus"))
    return o.select("o_orderkey", F.when(F.col("o_totalprice") <= 300000, F.col("o_totalprice")).alias("price"), status.alias("status"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("priority"), old.alias("old"))


_DATED = f"""d AS (SELECT o_orderkey, CASE WHEN o_totalprice <= 300000 THEN o_totalprice END AS price, CASE WHEN NOT ({_OLD}) OR o_orderstatus <> 'P' THEN o_orderstatus END AS status,
  nullif(o_orderpriority, '1-URGENT') AS priority, {_OLD} AS old FROM orders)"""


def _filled_sql(c: str) -> str:
    return f"coalesce({c}, (SELECT {c} FROM d WHERE old AND {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}"


_CLEANED = f"""{_DATED}, fill AS (SELECT o_orderkey, old, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM d WHERE old)) AS price, {_filled_sql('status')}, {_filled_sql('priority')} FROM d),
q AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM fill WHERE old),
cs AS (SELECT status, row_number() OVER (ORDER BY status) - 1 AS code FROM (SELECT DISTINCT status FROM fill WHERE old)),
cp AS (SELECT priority, row_number() OVER (ORDER BY priority) - 1 AS code FROM (SELECT DISTINCT priority FROM fill WHERE old)),
cut AS (SELECT o_orderkey, old, least(greatest(price, a - 0.5 * (b - a)), b + 0.5 * (b - a)) AS price, coalesce(cs.code, 0) AS status, coalesce(cp.code, 0) AS priority FROM fill LEFT JOIN cs USING (status) LEFT JOIN cp USING (priority), q),
clean AS (SELECT o_orderkey, old, (price - (SELECT avg(price) FROM cut WHERE old)) / (SELECT stddev_pop(price) FROM cut WHERE old) AS price, status, priority FROM cut)"""
NEW = S.Plan("o_orderkey", [["price", "status"], ["priority"]], 3)


def _dated_fit(spark, sf_dir):
    rows = dated_orders(spark, sf_dir)
    cleaner = MD.Cleaner.fit(rows.where("old"), "o_orderkey", ["price", "status", "priority"], factor=0.5)
    return rows, cleaner


@query(f"WITH {_CLEANED} SELECT o_orderkey, round(price, 4) AS price, status, priority FROM clean WHERE NOT old")
def fit_transform_new(spark, sf_dir):
    """New orders, cleaned as the old ones were; a status that no old order had is code 0."""
    rows, cleaner = _dated_fit(spark, sf_dir)
    return rounded(cleaner.transform(rows.where("NOT old")), "price", places=4)


def _old_bin(c: str) -> str:
    low, high = f"(SELECT min({c}) FROM clean WHERE old)", f"(SELECT max({c}) FROM clean WHERE old)"
    return f"CASE WHEN {high} > {low} THEN " + " + ".join(f"CAST({c} >= {low} + {i} * ({high} - {low}) / 3 AS BIGINT)" for i in (1, 2)) + f" ELSE 0 END AS {c}"


_CLASSIFIED = f"""{_CLEANED}, b AS (SELECT o_orderkey, old, {', '.join(_old_bin(c) for c in NEW.columns)} FROM clean),
p AS (SELECT o_orderkey, old, 0 AS g, concat_ws('|', price, status) AS pattern FROM b UNION ALL SELECT o_orderkey, old, 1, CAST(priority AS VARCHAR) FROM b),
c AS (SELECT g, pattern, count(*) AS n FROM p WHERE old GROUP BY ALL), w AS (SELECT g, pattern, n, sum(n + 1) OVER (PARTITION BY g) AS total FROM c),
t AS (SELECT g, max(total) AS total FROM w GROUP BY g),
l AS (SELECT o_orderkey, old, sum(-ln((coalesce(n, 0) + 1) / t.total)) / 2 AS raw FROM p JOIN t USING (g) LEFT JOIN w USING (g, pattern) GROUP BY o_orderkey, old),
s AS (SELECT o_orderkey, old, round((raw - (SELECT avg(raw) FROM l WHERE old)) / (SELECT stddev_pop(raw) FROM l WHERE old), 9) AS anomaly_score FROM l)"""


@query(f"WITH {_CLASSIFIED} SELECT o_orderkey, round(anomaly_score, 6) AS anomaly_score, anomaly_score > (SELECT quantile_cont(anomaly_score, 0.95) FROM s WHERE old) AS is_anomaly FROM s WHERE NOT old")
def classify_new(spark, sf_dir):
    """New orders under everything that the old ones fitted: fills, codes, limits, edges, frequencies, mean, deviation and threshold."""
    rows, cleaner = _dated_fit(spark, sf_dir)
    model = MD.Model.fit(saved(cleaner.transform(rows.where("old")), "clean"), NEW, places=9)
    return rounded(model.score(cleaner.transform(rows.where("NOT old"))), "anomaly_score").select("o_orderkey", "anomaly_score", "is_anomaly")


_NEW_FLAGS = ORACLE_SQL["classify_new"]


@query(_NEW_FLAGS)
def saved_model(spark, sf_dir):
    """classify_new with cleaner and model saved and loaded again."""
    rows, cleaner = _dated_fit(spark, sf_dir)
    path = new_path(spark, "model")
    MD.Model.fit(saved(cleaner.transform(rows.where("old")), "clean"), NEW, places=9).save(spark, f"{path}/model")
    cleaner.save(spark, f"{path}/cleaner")
    cleaner, model = MD.Cleaner.load(spark, f"{path}/cleaner"), MD.Model.load(spark, f"{path}/model")
    return rounded(model.score(cleaner.transform(rows.where("NOT old"))), "anomaly_score").select("o_orderkey", "anomaly_score", "is_anomaly")


@query(_NEW_FLAGS)
def stream_flags(spark, sf_dir):
    """classify_new over a stream of the new orders."""
    rows, cleaner = _dated_fit(spark, sf_dir)
    model = MD.Model.fit(saved(cleaner.transform(rows.where("old")), "clean"), NEW, places=9)
    path, source = new_path(spark, "stream"), saved(rows.where("NOT old"), "arriving")
    stream = spark.readStream.schema(source.schema).parquet(source._saved_at)
    score_stream(stream, model, f"{path}/scores", f"{path}/checkpoint", cleaner).awaitTermination()
    return rounded(scored(spark, f"{path}/scores"), "anomaly_score").select("o_orderkey", "anomaly_score", "is_anomaly")


_UPDATED = _CLASSIFIED.replace("sum(-ln((coalesce(n, 0) + 1) / t.total)) / 2 AS raw", "-min(ln((coalesce(n, 0) + 1) / t.total)) AS raw")


@query(f"WITH {_UPDATED} SELECT o_orderkey, round(anomaly_score, 6) AS anomaly_score, anomaly_score > (SELECT quantile_cont(anomaly_score, 0.92) FROM s WHERE old) AS is_anomaly FROM s WHERE NOT old")
def updated_model(spark, sf_dir):
    """New orders under a fitted model whose aggregation and share are changed."""
    rows, cleaner = _dated_fit(spark, sf_dir)
    old = saved(cleaner.transform(rows.where("old")), "clean")
    model = MD.Model.fit(old, NEW, places=9).updated(old, how="min", share=8.0)
    return rounded(model.score(cleaner.transform(rows.where("NOT old"))), "anomaly_score").select("o_orderkey", "anomaly_score", "is_anomaly")


@query(f"WITH {_FLAGS} SELECT o_orderkey, round(anomaly_score, 6) AS anomaly_score FROM x ORDER BY x.anomaly_score DESC, o_orderkey LIMIT 10")
def top_anomalies(spark, sf_dir):
    """The ten highest scores: a top-k report."""
    return rounded(S.flagged(scored_orders(spark, sf_dir)).orderBy(F.desc("anomaly_score"), "o_orderkey").limit(10), "anomaly_score").select("o_orderkey", "anomaly_score")


_CLASSES = f"{_FLAGS}, k AS (SELECT count(*) AS n, count(*) FILTER (is_anomaly) AS n1, count(*) FILTER (NOT is_anomaly) AS n0, avg(anomaly_score) FILTER (is_anomaly) AS m1, avg(anomaly_score) FILTER (NOT is_anomaly) AS m0, var_samp(anomaly_score) FILTER (is_anomaly) AS v1, var_samp(anomaly_score) FILTER (NOT is_anomaly) AS v0 FROM x)"


@query(f"WITH {_CLASSES} SELECT n, n1 AS n_anomalies, round(100 * n1 / n, 6) AS anomaly_rate, round(m1, 6) AS mean_anomaly, round(m0, 6) AS mean_normal, round(coalesce((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n - 2)), 0), 6) AS cohens_d FROM k")
def separation_quality(spark, sf_dir):
    return rounded(S.separation(S.flagged(scored_orders(spark, sf_dir))), "anomaly_rate", "mean_anomaly", "mean_normal", "cohens_d")


_STATS = "count(*) AS n, round(avg(anomaly_score), 6) AS mean, round(stddev_pop(anomaly_score), 6) AS std, round(min(anomaly_score), 6) AS low, round(max(anomaly_score), 6) AS high, round(quantile_cont(anomaly_score, 0.5), 6) AS median, round(quantile_cont(anomaly_score, 0.25), 6) AS q25, round(quantile_cont(anomaly_score, 0.75), 6) AS q75"


@query(f"WITH {_FLAGS} SELECT 'all' AS part, {_STATS} FROM x UNION ALL SELECT 'anomalies', {_STATS} FROM x WHERE is_anomaly")
def score_statistics(spark, sf_dir):
    return rounded(M.score_statistics(saved(S.flagged(scored_orders(spark, sf_dir)), "flags")), "mean", "std", "low", "high", "median", "q25", "q75")


@query(f"""WITH {_FLAGS}, q AS (SELECT is_anomaly, count(*) AS n, quantile_cont(anomaly_score, 0.25) AS q25, quantile_cont(anomaly_score, 0.5) AS median, quantile_cont(anomaly_score, 0.75) AS q75 FROM x GROUP BY is_anomaly)
SELECT is_anomaly, any_value(n) AS n, round(any_value(q25), 6) AS q25, round(any_value(median), 6) AS median, round(any_value(q75), 6) AS q75,
round(min(anomaly_score) FILTER (anomaly_score BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)), 6) AS low_whisker, round(max(anomaly_score) FILTER (anomaly_score BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)), 6) AS high_whisker,
count(*) FILTER (NOT anomaly_score BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS n_outside FROM x JOIN q USING (is_anomaly) GROUP BY is_anomaly""")
def class_quartiles(spark, sf_dir):
    """Box and whiskers of the scores of both classes."""
    return rounded(S.box_plot(saved(S.flagged(scored_orders(spark, sf_dir)), "flags")), "q25", "median", "q75", "low_whisker", "high_whisker")


@query(f"""WITH {_FLAGS}, k AS (SELECT least(20, count(*) FILTER (is_anomaly)) AS few FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY is_anomaly ORDER BY md5('42:' || o_orderkey) || o_orderkey) AS i FROM x)
SELECT o_orderkey, is_anomaly, round(group_0, 6) AS group_0, round(group_1, 6) AS group_1 FROM r, k WHERE i <= CASE WHEN is_anomaly THEN few ELSE 100 - few END""")
def heatmap_sample(spark, sf_dir):
    """The rows of the likelihood picture: 100, of which 20 are anomalies if there are so many. A sampling operator."""
    return rounded(M.heatmap_sample(saved(S.flagged(scored_orders(spark, sf_dir)), "flags"), "o_orderkey"), "group_0", "group_1").select("o_orderkey", "is_anomaly", "group_0", "group_1")


def _performance_sql(name: str, share: float) -> str:
    """A table of one row: metrics of the flags at a threshold share."""
    return f"""{name}x AS (SELECT anomaly_score, anomaly_score > (SELECT quantile_cont(anomaly_score, {1 - share / 100}) FROM s) AS is_anomaly FROM s),
{name}k AS (SELECT count(*) AS n, count(*) FILTER (is_anomaly) AS n1, count(*) FILTER (NOT is_anomaly) AS n0, avg(anomaly_score) FILTER (is_anomaly) AS m1, avg(anomaly_score) FILTER (NOT is_anomaly) AS m0, var_samp(anomaly_score) FILTER (is_anomaly) AS v1, var_samp(anomaly_score) FILTER (NOT is_anomaly) AS v0 FROM {name}x),
{name} AS (SELECT n1 AS n_anomalies, 100 * n1 / n AS anomaly_rate, coalesce((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n - 2)), 0) AS cohens_d, coalesce(abs(m1 - m0), 0) AS separation FROM {name}k)"""


_BANDS = """CASE WHEN cohens_d >= 1.2 THEN 'excellent' WHEN cohens_d >= 0.8 THEN 'good' WHEN cohens_d >= 0.5 THEN 'moderate' WHEN cohens_d >= 0.2 THEN 'weak' ELSE 'poor' END AS effect,
CASE WHEN anomaly_rate BETWEEN 3 AND 5 THEN 'optimal' WHEN anomaly_rate >= 1.5 AND anomaly_rate < 3 THEN 'conservative' WHEN anomaly_rate > 5 AND anomaly_rate <= 7 THEN 'aggressive' ELSE 'unusual' END AS rate,
CASE WHEN cohens_d >= 1.2 THEN 4 WHEN cohens_d >= 0.8 THEN 3 WHEN cohens_d >= 0.5 THEN 2 WHEN cohens_d >= 0.2 THEN 1 ELSE 0 END AS cohens_d_points,
CASE WHEN anomaly_rate BETWEEN 3 AND 5 THEN 4 WHEN anomaly_rate BETWEEN 2 AND 6 THEN 3 WHEN anomaly_rate BETWEEN 1 AND 8 THEN 2 WHEN anomaly_rate BETWEEN 0.5 AND 10 THEN 1 ELSE 0 END AS anomaly_rate_points,
CASE WHEN separation >= 2 THEN 4 WHEN separation >= 1.5 THEN 3 WHEN separation >= 1 THEN 2 WHEN separation >= 0.5 THEN 1 ELSE 0 END AS separation_points"""


@query(f"WITH {_SCORED}, {_performance_sql('y', 5.0)} SELECT n_anomalies, round(anomaly_rate, 6) AS anomaly_rate, round(cohens_d, 6) AS cohens_d, round(separation, 6) AS separation, {_BANDS} FROM y")
def performance_bands(spark, sf_dir):
    one = rounded(M.performance(S.flagged(scored_orders(spark, sf_dir))), "anomaly_rate", "cohens_d", "separation")
    return one.drop("n", "mean_anomaly", "mean_normal")


_COMPARED = ("n_anomalies", "anomaly_rate", "cohens_d", "separation")


@query(f"""WITH {_SCORED}, {_performance_sql('a1', 8.0)}, {_performance_sql('a2', 4.0)},
z AS (SELECT {', '.join(f'a1.{c} AS before_{c}, a2.{c} AS after_{c}, a2.{c} - a1.{c} AS change_{c}' for c in _COMPARED)} FROM a1, a2),
v AS (SELECT *, change_cohens_d > 0.1 OR (after_anomaly_rate BETWEEN 3 AND 5 AND NOT before_anomaly_rate BETWEEN 3 AND 5) OR change_separation > 0 AS better, change_cohens_d < -0.1 OR after_anomaly_rate > 10 OR after_anomaly_rate < 0.5 AS worse FROM z)
SELECT {', '.join(f'before_n_anomalies, after_n_anomalies, change_n_anomalies' if c == 'n_anomalies' else ', '.join(f'round({w}_{c}, 6) AS {w}_{c}' for w in ('before', 'after', 'change')) for c in _COMPARED)},
CASE WHEN better AND NOT worse THEN 'significant_improvement' WHEN better THEN 'mixed_results' WHEN worse THEN 'performance_degradation' ELSE 'marginal_changes' END AS assessment FROM v""")
def compare_results(spark, sf_dir):
    """The orders flagged at a share of 8 percent and at 4 percent."""
    scored = scored_orders(spark, sf_dir)
    before, after = (M.performance(S.flagged(scored, share=x)) for x in (8.0, 4.0))
    return rounded(M.comparison(before, after), *[f"{w}_{c}" for w in ("before", "after", "change") for c in _COMPARED[1:]])


@query(f"WITH {_CLASSES}, y AS (SELECT 100 * n1 / n AS rate FROM k) SELECT round(greatest(exp(-0.5 * (rate - 4) * (rate - 4)), 0.8 * exp(-0.5 * power((rate - 1.5) / 0.5, 2)), 0.6 * exp(-0.5 * power((rate - 7) / 1.5, 2))), 6) AS rate_score FROM y")
def detection_rate_score(spark, sf_dir):
    return S.separation(S.flagged(scored_orders(spark, sf_dir))).select(F.round(S.rate_score(F.col("anomaly_rate")), 6).alias("rate_score"))


@query(f"WITH {_FLAGS}, e AS (SELECT o_orderkey, 'group_0' AS group_name, group_0 AS ll FROM x WHERE is_anomaly UNION ALL SELECT o_orderkey, 'group_1', group_1 FROM x WHERE is_anomaly) SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY ll, group_name) AS rank, group_name, round(ll, 6) AS ll FROM e")
def explain_groups(spark, sf_dir):
    return rounded(S.explanations(S.flagged(scored_orders(spark, sf_dir)), ORDERS), "ll")


@query(f"WITH {_FLAGS} SELECT 'group_0' AS group_name, round(avg(group_0) FILTER (NOT is_anomaly) - avg(group_0) FILTER (is_anomaly), 6) AS contribution FROM x UNION ALL SELECT 'group_1', round(avg(group_1) FILTER (NOT is_anomaly) - avg(group_1) FILTER (is_anomaly), 6) FROM x")
def group_contribution(spark, sf_dir):
    return rounded(S.contributions(S.flagged(scored_orders(spark, sf_dir)), ORDERS), "contribution")


@query(f"WITH {_SCORED}, h AS (SELECT {_edges('anomaly_score', 10)} AS bin FROM s) SELECT bin, count(*) AS n FROM h GROUP BY bin")
def score_histogram(spark, sf_dir):
    return S.histogram(scored_orders(spark, sf_dir), 10)


@query(f"WITH {_BINNED}, c AS (SELECT status AS parent, o_totalprice AS node, count(*) AS n FROM b GROUP BY ALL) SELECT parent, node, n, round(n / sum(n) OVER (PARTITION BY parent), 6) AS p FROM c")
def mle_cpt(spark, sf_dir):
    return rounded(S.conditional_table(S.bin_columns(order_features(spark, sf_dir), ORDERS.columns, 3), "o_totalprice", "status"), "p")


def binned_orders(spark, sf_dir) -> DataFrame:
    return S.bin_columns(order_features(spark, sf_dir), ORDERS.columns, 3).select("o_orderkey", *ORDERS.columns)


#: A structure of the orders' columns for the factorised likelihood.
ARCS = {"status": [], "o_totalprice": ["status"], "priority": [], "day": ["priority", "status"]}


def _share_sql(node: str, given: list[str]) -> str:
    within = lambda cs: f"count(*) OVER ({'PARTITION BY ' + ', '.join(cs) if cs else ''})"
    return f"ln({within([*given, node])} / {within(given)})"


@query(f"WITH {_BINNED} SELECT o_orderkey, round({' + '.join(_share_sql(c, []) for c in ORDERS.columns)}, 6) AS ll FROM b")
def independence_loglik(spark, sf_dir):
    out = N.factorised_log_likelihood(binned_orders(spark, sf_dir), {c: [] for c in ORDERS.columns})
    return rounded(out, "ll").select("o_orderkey", "ll")


@query(f"WITH {_BINNED} SELECT o_orderkey, round({' + '.join(_share_sql(c, g) for c, g in ARCS.items())}, 6) AS ll FROM b")
def factorised_loglik(spark, sf_dir):
    return rounded(N.factorised_log_likelihood(binned_orders(spark, sf_dir), ARCS), "ll").select("o_orderkey", "ll")


@query(f"WITH {_BINNED}, d AS (SELECT o_orderkey, sqrt({' + '.join(f'power({c} - avg({c}) OVER (), 2)' for c in ORDERS.columns)}) AS d FROM b) SELECT o_orderkey, round(CASE WHEN max(d) OVER () > 0 THEN -5 * d / max(d) OVER () ELSE -1 END, 6) AS ll FROM d")
def distance_loglik(spark, sf_dir):
    return rounded(N.distance_log_likelihood(binned_orders(spark, sf_dir), ORDERS.columns), "ll").select("o_orderkey", "ll")


@query()
def network_arcs(spark, sf_dir):
    """Parent and child of each arc that hill climbing on BIC finds. The search is no SQL."""
    found = N.hill_climb(S.bin_columns(order_rollup(spark, sf_dir), ROLLUP, 3), ROLLUP)
    return spark.createDataFrame([(p, c) for c, ps in found.items() for p in ps], "parent string, child string")


@query()
def learned_networks(spark, sf_dir):
    """Arcs of each of the rollup's groups, all rows and columns. The search is no SQL."""
    found = N.learned_networks(S.bin_columns(order_rollup(spark, sf_dir), ROLLUP, 3), HALVES)
    return spark.createDataFrame([(i, p, c) for i, net in found.items() for c, ps in net.items() for p in ps], "group_id long, parent string, child string")


@query()
def pc_arcs(spark, sf_dir):
    """Arcs of the rollup's columns by conditional independence tests. The search is no SQL."""
    found = N.pc_arcs(S.bin_columns(order_rollup(spark, sf_dir), ROLLUP, 3), ROLLUP)
    return spark.createDataFrame([(p, c) for c, ps in found.items() for p in ps], "parent string, child string")


#: Pairs of the lineitems' columns whose networks BIC decides.
PAIRS = S.Plan("l_orderkey", [["n_lines", "last_line"], ["d_5", "min_supp"], ["q_20", "q_30"], ["p_50000", "n_open"]], 3)


def _bic_sql(a: str, b: str) -> str:
    """What an arc between two columns gains."""
    h = lambda *cs: f"(SELECT sum(n * ln(n)) FROM (SELECT count(*) AS n FROM b GROUP BY {', '.join(cs)}))"
    return f"{h(a, b)} - {h(a)} - {h(b)} + (SELECT count(*) * ln(count(*)) - 0.5 * ln(count(*)) * (count(DISTINCT {a}) - 1) * (count(DISTINCT {b}) - 1) FROM b)"


_PAIRED = f"v AS (SELECT l_orderkey, {', '.join(f'CAST({WIDE[c]} AS DOUBLE) AS {c}' for c in PAIRS.columns)} FROM lineitem GROUP BY l_orderkey), b AS (SELECT l_orderkey, {', '.join(f'{_edges(c, 3)} AS {c}' for c in PAIRS.columns)} FROM v), g AS (SELECT {', '.join(f'{_bic_sql(*g)} AS g{i}' for i, g in enumerate(PAIRS.groups))})"


def _pair_sql(i: int, a: str, b: str) -> str:
    share = lambda cs: f"ln(count(*) OVER (PARTITION BY {cs}) / count(*) OVER ())"
    return f"round(CASE WHEN g{i} > 1e-9 THEN {share(f'{a}, {b}')} ELSE {share(a)} + {share(b)} END, 6) AS group_{i}"


@query(f"WITH {_PAIRED} SELECT l_orderkey, {', '.join(_pair_sql(i, *g) for i, g in enumerate(PAIRS.groups))} FROM b, g")
def cpd_loglik(spark, sf_dir):
    """Likelihoods by the conditional tables of learned networks: an arc stands where BIC finds that two columns depend on each other."""
    rows = saved(wide_rollup(spark, sf_dir).select("l_orderkey", *PAIRS.columns), "rollup")
    model = MD.Model.fit(rows, PAIRS, likelihood="cpd", structure="bic")
    return rounded(model.likelihoods(rows), *PAIRS.scores)


@query(f"WITH {_PAIRED} " + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS group_id, CAST(2 AS BIGINT) AS n_features, '{','.join(g)}' AS features, CAST(2 AS BIGINT) AS n_nodes, CAST(g{i} > 1e-9 AS BIGINT) AS n_edges FROM g" for i, g in enumerate(PAIRS.groups)))
def network_info(spark, sf_dir):
    rows = saved(S.bin_columns(wide_rollup(spark, sf_dir), PAIRS.columns, PAIRS.bins).select(*PAIRS.columns), "bins")
    return N.network_info(spark, N.learn_structures(rows, PAIRS.groups, "bic"))


@query()
def detect_unusual(spark, sf_dir):
    """Clean, group, score and flag the rollup of all orders. The grouping loop is no SQL; its parts have their own queries."""
    _, _, scored = MD.detect(order_rollup(spark, sf_dir), "l_orderkey", ROLLUP, places=9)
    return rounded(scored, "anomaly_score").select("l_orderkey", "anomaly_score", "is_anomaly")


def order_vectors(spark, sf_dir) -> DataFrame:
    return saved(FT.counted_vectors(order_likelihoods(spark, sf_dir), ORDERS.scores), "vectors")


#: Weights and shares of the candidates whose fitness is compared.
PEOPLE = [FT.Candidate((w, 1 - w), share) for w, share in ((0.5, 5.0), (0.2, 2.0), (0.9, 9.0))]


def _fitness_sql(i: int, p: FT.Candidate) -> str:
    a, b, c = (1 - x / 100 for x in (max(FT.LEAST_SHARE, p.share - 0.5), p.share, min(FT.MOST_SHARE, p.share + 0.5)))
    bells = ", ".join(f"{top} * exp(-0.5 * power((100 * n1 / n - {at}) / {width}, 2))" for at, width, top in S.BELLS)
    return f"""SELECT CAST({i} AS BIGINT) AS candidate, CASE WHEN n1 = 0 OR 2 * n1 >= n THEN 0 ELSE round(least(100, greatest(0, 100 * (
{FT.PARTS[0]} * least(1, d / 2 + CASE WHEN d > 1.5 THEN 0.1 ELSE 0 END) + {FT.PARTS[1]} * greatest({bells}) + {FT.PARTS[2]} * least(1, exp(-5 * sd / mean)) + {FT.PARTS[3]} * {FT.diversity(p.weights)!r}))), 6) END AS fitness
FROM (SELECT *, coalesce(abs(m1 - m0) / nullif(sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n - 2)), 0), 0) AS d, sqrt((power(n_a - mean, 2) + power(n1 - mean, 2) + power(n_c - mean, 2)) / 3) AS sd FROM (
SELECT count(*) AS n, count(*) FILTER (s > b) AS n1, count(*) FILTER (s <= b) AS n0, count(*) FILTER (s > a) AS n_a, count(*) FILTER (s > c) AS n_c, (n1 + n_a + n_c) / 3 AS mean,
avg(s) FILTER (s > b) AS m1, avg(s) FILTER (s <= b) AS m0, var_samp(s) FILTER (s > b) AS v1, var_samp(s) FILTER (s <= b) AS v0
FROM (SELECT *, quantile_cont(s, {a!r}) OVER () AS a, quantile_cont(s, {b!r}) OVER () AS b, quantile_cont(s, {c!r}) OVER () AS c FROM (SELECT round(-(group_0 * {p.weights[0]!r} + group_1 * {p.weights[1]!r}), 9) AS s FROM l))))"""


@query(f"WITH {_LL} " + " UNION ALL ".join(_fitness_sql(i, p) for i, p in enumerate(PEOPLE)))
def candidate_fitness(spark, sf_dir):
    """Fitness of three candidates."""
    values = FT.population_fitness(order_vectors(spark, sf_dir), ORDERS.scores, PEOPLE, places=9)
    return spark.createDataFrame([(i, round(v, 6)) for i, v in enumerate(values)], "candidate long, fitness double")


def _search(run, spark, sf_dir) -> DataFrame:
    """History of a search. The vectors, which every generation reads, are a saved table."""
    vectors = order_vectors(spark, sf_dir)
    found = run(FT.judge_of(vectors, ORDERS.scores), len(ORDERS.groups))
    return spark.createDataFrame(found.history, "generation long, best double, mean double, deviation double")


@query()
def genetic_search(spark, sf_dir):
    return _search(lambda judge, k: O.genetic(judge, k), spark, sf_dir)


@query()
def cma_es_search(spark, sf_dir):
    return _search(lambda judge, k: O.cma_es(judge, k), spark, sf_dir)
