import pytest
from pyspark.sql import functions as F

from lorekeep.operators import skew
from lorekeep.plans.skew_queries import project_key

SCHEMA = "id string, k string, v long, rank int"


@pytest.fixture(scope="module")
def df(spark):
    rows = [(f"i{n}", "hot" if n % 3 else f"k{n % 40}", n, 7) for n in range(3000)]
    rows += [("i1", "hot", 1, 7)] * 5 + [(None, "hot", 9, 7), ("x", None, 4, 7), ("long", "z" * 100_000, None, 7)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


AGGS = lambda: {"n": ("count", F.lit(1)), "ids": ("distinct", F.col("id")), "total": ("sum", F.col("v")), "low": ("min", F.col("v")), "high": ("max", F.col("v"))}


def plain(df):
    return df.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"))


def test_group_aggregate_equals_a_plain_one(df):
    assert skew.heavy_keys(df, "k", 0.3) == ["hot"]
    for share in (0.005, 0.3, 0.999):
        got = skew.group_aggregate(df, "k", AGGS(), F.col("id"), share)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain(df).collect()))


def test_empty(spark, df):
    empty = df.where("false")
    assert skew.group_aggregate(empty, "k", AGGS(), F.col("id")).count() == 0
    assert skew.top_per_key(empty, "k", [F.col("v")], 2).count() == 0
    assert skew.keys_with_share(empty, {"f": F.col("k")}, "id", 0.04).count() == 0
    assert skew.join_on_key(df, empty.select("k", "v"), "k", "inner").count() == 0


def test_top_per_key(df):
    got = skew.top_per_key(df.drop("rank"), "k", [F.col("v").desc_nulls_last(), F.col("id")], 2, share=0.1)
    assert [tuple(r) for r in got.where("k = 'hot'").orderBy("rank").select("id", "v", "rank").collect()] == [("i2999", 2999, 1), ("i2998", 2998, 2)]
    assert got.groupBy("k").count().where("count > 2").count() == 0
    assert skew.top_per_key(df, "k", [F.col("v"), F.col("id")], 1, share=0.1).where("rank <> 1").count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("broadcast_rows", [0, 100])
def test_join(spark, df, how, broadcast_rows):
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 5), (None, 6), ("none", 7)], "k string, v int")
    got = skew.join_on_key(df, right, "k", how, 0.1, broadcast_rows, 4)
    want = df.join(right.withColumnRenamed("v", "v_right"), "k", how)
    assert got.columns == want.columns and got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def test_keys_with_share_counts_ids_once(spark):
    rows = [(f"a{n}", " Big\t") for n in range(4)] + [(f"a{n}", "big") for n in range(4)] + [(f"b{n}", f"p{n}") for n in range(96)] + [(None, "big")] * 50 + [("c", None)]
    e = spark.createDataFrame(rows, "id string, project string")
    got = skew.keys_with_share(e.where("project IS NOT NULL"), {"project": project_key()}, "id", 0.04)
    assert [tuple(r) for r in got.collect()] == [("project", "big")]
