import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabsieve.functions.ranking import average_ranks, exact_quantiles, number_rows, running_totals


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=40))
def test_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = exact_quantiles(df, [], "v", [0.0, 0.3, 0.9, 1.0]).drop("n_values").first()
    assert list(got) == pytest.approx(list(np.quantile(values, [0.0, 0.3, 0.9, 1.0])))


def test_quantiles_with_a_hot_group_and_weights(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 50).alias("k"),
                                    (F.col("id") * 7919 % 1009).cast("double").alias("v"))
    got = {r["k"]: r["m"] for r in exact_quantiles(rows, ["k"], "v", [0.9], ["m"]).collect()}
    want = {r["k"]: r["m"] for r in rows.groupBy("k").agg(F.percentile("v", 0.9).alias("m")).collect()}
    assert got == pytest.approx(want)
    folded = rows.groupBy("k", "v").count()
    weighted = {r["k"]: r["m"] for r in exact_quantiles(folded, ["k"], "v", [0.9], ["m"], weight="count").collect()}
    assert weighted == pytest.approx(want)


def test_positions_ranks_and_following(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("aa",)], "s string")
    assert {r["s"]: r["rn"] for r in number_rows(df, ["s"]).collect()} == {"a": 1, "aa": 2, "b": 3, "c": 4}
    ranks = average_ranks(spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "v double"), [], "v")
    assert {r["v"]: r["avg_rank"] for r in ranks.collect()} == {1.0: 1.0, 2.0: 2.5, 5.0: 4.0}
    nxt = running_totals(spark.range(100).withColumn("w", F.lit(1)), [], ["id"], ["w"], following="nxt").collect()
    assert all(r["nxt"] == (r["id"] + 1 if r["id"] < 99 else None) and r["before_w"] == r["id"] for r in nxt)
