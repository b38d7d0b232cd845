import pytest
from pyspark.sql import functions as F

from voxframe.operators.ordering import first_n, number_rows, skip_n


def test_numbers_of_a_hot_group(spark):
    """One group holds most rows and spans all partitions."""
    df = spark.range(5000).select(
        F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 7, None).otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
        ((F.col("id") * 7919) % 5000).alias("t"),
    )
    got = number_rows(df, ["t"], ["g"], "no", start=0)
    rows = sorted((r.g or "", r.t, r.no) for r in got.collect())
    want, counts = [], {}
    for g, t, _ in rows:
        want.append((g, t, counts.get(g, 0)))
        counts[g] = counts.get(g, 0) + 1
    assert rows == want and len(rows) == 5000


def test_hot_group_is_spread(spark):
    df = spark.range(4000).select(F.lit("hot").alias("g"), F.col("id"))
    numbered = number_rows(df, ["id"], ["g"])
    sizes = numbered.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 2 and max(r["count"] for r in sizes) < 4000 / 2


def test_first_and_rest(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    keys = sorted(str(i) for i in range(1000))
    assert [r.k for r in first_n(df, 10, "k").collect()] == keys[:10]
    assert sorted(r.k for r in skip_n(df, 10, ["k"]).collect()) == keys[10:]
    assert skip_n(df, 2000, ["k"]).count() == 0
    assert skip_n(df, 0, ["k"]).count() == 1000


def test_rest_by_several_keys_and_after_nulls(spark):
    rows = [(None, 2), (None, 5), ("a", None), ("a", 1), ("a", 3), ("b", 0)]
    df = spark.createDataFrame(rows, "k string, n int")
    for skipped in range(7):
        rest = sorted(((r.k or "", r.n if r.n is not None else -1) for r in skip_n(df, skipped, ["k", "n"]).collect()))
        assert rest == sorted((k or "", n if n is not None else -1) for k, n in rows)[skipped:]
    one = spark.createDataFrame([(None,), ("x",), ("y",)], "k string")
    assert sorted(r.k for r in skip_n(one, 1, ["k"]).collect()) == ["x", "y"]


def test_rest_is_filtered_at_the_scan(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    rest = skip_n(spark.read.parquet(str(tmp_path / "t")), 10, ["id"])
    assert rest.count() == 90
    plan = rest._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,9)" in plan and "Exchange" not in plan


def test_other_columns_meet_their_numbers(spark):
    rows = [(None, 2, "x"), (None, 5, "y"), ("a", None, "z"), ("a", 1, None), ("b", 0, "w")]
    df = spark.createDataFrame(rows, "k string, n int, `odd.name` string")
    got = number_rows(df, ["n"], ["k"], "no")
    assert got.columns == [*df.columns, "no"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(None, 2, "x", 1), (None, 5, "y", 2), ("a", None, "z", 1), ("a", 1, None, 2), ("b", 0, "w", 1)], key=repr)


def test_keys_that_do_not_identify_a_row_are_refused(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k int, t string")
    with pytest.raises(Exception, match=r"two rows have \[2\]"):
        number_rows(df, ["k"])
    assert sorted(r.row_no for r in number_rows(df.select("k"), ["k"]).collect()) == [1, 2, 3]
