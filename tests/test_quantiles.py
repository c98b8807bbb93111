import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorlake.functions import quantiles


def check(df, keys, value, **options):
    data = df.toPandas()
    wanted = data.groupby(keys, dropna=False)[value].describe().reset_index()
    found = quantiles.describe(df, keys, value, **options).toPandas()
    for table in (wanted, found):
        table[keys] = table[keys].astype(object).where(table[keys].notna(), "-").astype(str)
        table.sort_values(keys, inplace=True, ignore_index=True)
    assert found[keys].values.tolist() == wanted[keys].values.tolist()
    numbers = found.drop(columns=keys).to_numpy(dtype=float)
    np.testing.assert_allclose(
        numbers, wanted.drop(columns=keys).to_numpy(dtype=float), rtol=1e-9, atol=1e-9
    )


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """A hot group, a null group, a small one, and heavy repeated values."""
    i = F.col("id")
    df = spark.range(120_000).select(
        F.when(i % 3 == 0, "hot").when(i % 7 == 0, F.lit(None)).when(i % 1000 == 1, "few")
        .otherwise("rest").alias("k"),
        F.when(i % 11 < 3, F.lit(0.5)).when(i % 101 == 0, float("nan")).when(i % 103 == 0, F.lit(None))
        .otherwise(F.pow(F.rand(5), 3) * F.when(i % 2 == 0, -1).otherwise(1)).alias("v"),
    )
    path = str(tmp_path_factory.mktemp("q") / "t")
    df.write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("direct_rows", [1_000, 10_000, 1_000_000])
def test_describe_is_exact_at_every_size(skewed, direct_rows):
    check(skewed, ["k"], "v", direct_rows=direct_rows)


def test_saved_input_gives_the_same(skewed):
    check(skewed, ["k"], "v", direct_rows=10_000, saved=True)


def test_edge_of_a_heavy_value(spark):
    """The wanted rank lies right at the edge of a value held by many rows."""
    for share in (2_499, 2_501, 7_500):
        df = spark.range(10_000).select(
            F.lit("a").alias("k"),
            F.when(F.col("id") < share, 0.0).otherwise(F.col("id") / 7.0).alias("v"),
        )
        check(df, ["k"], "v", direct_rows=1_000)


def test_values_of_very_different_size(spark):
    df = spark.range(30_000).select(
        (F.col("id") % 2).alias("k"), F.exp(F.randn(3) * 60).alias("v")
    ).persist()
    check(df, ["k"], "v", direct_rows=1_000)
    df.unpersist()


def test_small_groups(spark):
    data = pd.DataFrame({"k": list("aabbbcd"), "v": [1, 2, 1, 2, 9, 4, np.nan]})
    check(spark.createDataFrame(data), ["k"], "v")


def test_linear_interpolation(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 4.0, 9.0)], "k string, v double")
    row = quantiles.describe(df, ["k"], "v").first()
    assert (row["p25"], row["p50"], row["p75"]) == (1.75, 3.0, 5.25)


def test_empty_input(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert quantiles.describe(df, ["k"], "v").collect() == []


def test_many_groups_are_not_broadcast(skewed, monkeypatch):
    monkeypatch.setattr(quantiles, "BROADCAST_GROUPS", 1)
    check(skewed, ["k"], "v", direct_rows=1_000)


def test_a_range_that_misses_its_rank_starts_anew(spark, monkeypatch):
    data = spark.range(2_000).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("v"))
    ranked, calls = quantiles._ranked, []

    def missed_once(joined, keys, names):
        calls.append(names)
        return ranked(joined, keys, names).withColumns({"m": F.lit(-1.0), "_missed": F.lit(True)} if len(calls) == 1 else {})

    monkeypatch.setattr(quantiles, "_ranked", missed_once)
    found = quantiles.grouped_quantiles(data, ["k"], "v", {"m": 0.5}, direct_rows=100)
    assert found.first()["m"] == 999.5 and len(calls) == 2



def test_a_group_is_needed(skewed):
    with pytest.raises(ValueError):
        quantiles.describe(skewed, [], "v")
