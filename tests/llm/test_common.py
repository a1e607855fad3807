import pytest

from patternscore.llm.common import joined_dealt


@pytest.mark.parametrize("how", ["inner", "left"])
def test_a_key_of_half_the_rows_is_dealt(spark, how):
    rows = spark.range(4000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN -7 ELSE id END AS k").repartition(8)
    table = spark.createDataFrame([(-7, "hot"), (9, "a"), (9, "b"), (11, "c")], "k long, v string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = joined_dealt(rows, table, ["k"], "id", most=100, how=how)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows.join(table, ["k"], how).collect()), key=str)
        sizes = got.rdd.mapPartitions(lambda it: [sum(1 for r in it if r["k"] == -7)]).collect()
        assert sum(sizes) == 2000 and max(sizes) < 1000  # four tasks; without dealing, one of them has all
        known = rows.groupBy("k").count()
        assert sorted(map(str, joined_dealt(rows, table, ["k"], "id", 100, how, known).collect())) == sorted(map(str, got.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
