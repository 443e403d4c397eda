import pytest
from pyspark.sql import functions as F

from pergamin.operators import skew


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("total", [None, 30_000, 0])
def test_the_same_as_a_join(spark, how, total):
    hot = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 1000 == 1, None).otherwise(F.col("id") % 5000)
    rows = spark.range(30_000).select(hot.alias("k"), "id")
    other = spark.createDataFrame([(7, "x"), (8, "y"), (10_000, "z"), (None, "n")], "k long, v string")
    got, want = skew.join(rows, other, ["k"], how, total), rows.join(other, ["k"], how)
    assert sorted(got.columns) == sorted(want.columns)
    assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == want.count()
    assert skew.join(rows.limit(0), other, ["k"], how).count() == 0 and skew.join(rows, other.limit(0), ["k"], how).count() == (30_000 if how == "left" else 0)


def test_hot_keys_are_few(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    assert [r.k for r in skew.hot_keys(rows, ["k"]).collect()] == [7]


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from pergamin.session import shared_folder

    chosen = []
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: chosen[0] if chosen else None, setCheckpointDir=chosen.append)
    unset, named = (SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None, v=v: v or default)) for v in (None, "hdfs://shared"))
    with pytest.raises(ValueError):
        shared_folder(unset)
    assert shared_folder(named) == "hdfs://shared"
