import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import ordering as O, sampling as S
from tests.conftest import rows


def test_running_totals_with_a_hot_group(spark):
    data = [("hot" if i % 3 else f"g{i % 7}", i, i % 11) for i in range(4000)]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "g string, o int, v int").repartition(7)
    got = {(r["g"], r["o"]): (r["cum_v"], r["total_v"]) for r in O.running_totals(df, [F.col("o")], ["v"], ["g"]).collect()}
    totals, want = {}, {}
    for g, o, v in sorted(data, key=lambda r: r[1]):
        totals[g] = totals.get(g, 0) + v
        want[g, o] = totals[g]
    assert len(got) == len(data)
    assert all(got[k] == (want[k], totals[k[0]]) for k in want)


def test_running_totals_descending_without_groups_and_with_null_group(spark):
    df = spark.createDataFrame([(1, 1), (3, 1), (2, 5)], "o int, v int")
    assert rows(O.running_totals(df, [F.desc("o")], ["v"]), "o", "cum_v", "total_v") == [(1, 7, 7), (2, 6, 7), (3, 1, 7)]
    grouped = spark.createDataFrame([(None, 1, 1), (None, 2, 1), ("a", 1, 4)], "g string, o int, v int")
    assert rows(O.running_totals(grouped, [F.col("o")], ["v"], ["g"]), "g", "o", "cum_v") == [("a", 1, 4), (None, 1, 1), (None, 2, 2)]


def test_row_numbers(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 2)
    out = O.row_numbers(df, [F.col("id")], ["g"])
    assert out.where(F.col("row_number") != F.floor(F.col("id") / 2) + 1).count() == 0


def test_exact_quantiles(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 10)] + [(None,)], "v double")
    got = {r["probability"]: r["quantile"] for r in O.exact_quantiles(df, "v", [0.1, 0.5, 0.9, 0.0, 1.0]).collect()}
    assert {p: round(q, 9) for p, q in got.items()} == {0.1: 1.4, 0.5: 3.0, 0.9: 7.6, 0.0: 1.0, 1.0: 10.0}


def test_exact_quantiles_by_group_match_numpy(spark):
    rng = np.random.default_rng(0)
    data = [("a" if i % 3 else "b", float(round(x, 2))) for i, x in enumerate(rng.normal(size=3000))]
    df = spark.createDataFrame(data, "g string, v double")
    for r in O.exact_quantiles(df, "v", [0.25, 0.9], ["g"]).collect():
        values = [v for g, v in data if g == r["g"]]
        assert abs(r["quantile"] - np.quantile(values, r["probability"])) < 1e-9


def test_average_ranks(spark):
    counts = spark.createDataFrame([(1.0, 2), (5.0, 1), (7.0, 3)], "v double, n long")
    assert rows(O.average_ranks(counts, "v", "n"), "v", "average_rank") == [(1.0, 1.5), (5.0, 3.0), (7.0, 5.0)]


def keyed(spark, n):
    return spark.range(n).select(F.col("id").cast("string").alias("k"), (F.col("id") % 10).alias("v"), (F.col("id") % 3).alias("g"))


@pytest.mark.parametrize("n", [1, 7, 500, 1000])
def test_exact_sample_size_and_order(spark, n):
    df = keyed(spark, 1000)
    want = rows(df.withColumn("h", F.md5(F.concat("k", F.lit("-5")))).orderBy("h").limit(n).select("k"))
    assert rows(S.exact_sample(df, n, "k", 5).select("k")) == want


def test_exact_sample_above_one_prefix_pass(spark, monkeypatch):
    monkeypatch.setattr(S, "_SMALL", 1)
    monkeypatch.setattr(S, "_DIGITS", 1)
    assert S.exact_sample(keyed(spark, 2000), 777, "k", 9).count() == 777


def test_exact_sample_limits(spark):
    df = keyed(spark, 50)
    with pytest.raises(ValueError):
        S.exact_sample(df, 51, "k", 1)
    assert S.exact_sample(df, 51, "k", 1, allow_fewer=True).count() == 50
    with pytest.raises(ValueError, match="repeated"):
        S.exact_sample(df.withColumn("k", F.lit("same")), 10, "k", 1)


def test_exact_sample_is_only_a_filter(spark):
    plan = S.exact_sample(keyed(spark, 200), 50, "k", 1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_exact_sample_reads_its_input_twice(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    df = keyed(spark, 3000)
    sample = S.exact_sample(df.mapInPandas(counted, df.schema), 400, "k", 2)
    assert sample.count() == 400 and sample.select("k").distinct().count() == 400
    assert read.value == 2 * 3000


def test_permute_keeps_the_values_of_each_group(spark):
    df = keyed(spark, 900)
    out = S.permute(df, "v", "k", 3, ["g"])
    counts = lambda d: rows(d.groupBy("g", "v").count())
    assert counts(out) == counts(df) and rows(out.select("k", "g")) == rows(df.select("k", "g"))
    assert rows(out) != rows(df) and rows(out) == rows(S.permute(df.repartition(5), "v", "k", 3, ["g"]))


def test_permute_over_all_rows(spark):
    df = keyed(spark, 300)
    out = S.permute(df, "v", "k", 3)
    assert rows(out.groupBy("v").count()) == rows(df.groupBy("v").count()) and out.count() == 300


def test_a_null_sampling_key_is_an_error(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "k string")
    with pytest.raises(ValueError, match="null"):
        S.exact_sample(df, 2, "k", 1)
