import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsieve.operators import encode, filters, scale
from tabsieve.session import spread_lookup
from tabsieve.sources.tables import with_row_id
from tabsieve.spec import TableSpec


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([(5, 4), (5, 4), (None, 2), (7, 2)], "a int, b int")
    assert encode.most_frequent(df) == {"a": 5, "b": 2}
    assert [tuple(r) for r in encode.impute_most_frequent(df).collect()] == [(5, 4), (5, 4), (5, 2), (7, 2)]


def test_encode_decode_round_trip_with_nulls(spark):
    df = spark.createDataFrame([(1, "b", "x"), (2, None, "y"), (3, "a", "x")], "id int, s string, t string")
    m = encode.category_mapping(df)
    coded = encode.ordinal_encode(df, m)
    assert {r["id"]: r["s"] for r in coded.collect()} == {1: 1.0, 2: None, 3: 0.0}
    assert sorted(map(tuple, encode.ordinal_decode(coded, m).collect())) == sorted(map(tuple, df.collect()))
    as_text = encode.ordinal_encode(df, encode.category_mapping(df, ["s"], True), ["s"], null_as_category=True)
    assert {r["id"]: r["s"] for r in as_text.collect()} == {1: 1.0, 2: 2.0, 3: 0.0}


def test_one_hot_unknown_and_decode(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    m = encode.category_mapping(df)
    other = spark.createDataFrame([(1, "a"), (2, "z")], "id int, s string")
    hot = encode.one_hot_encode(other, m)
    assert sorted(map(tuple, hot.collect())) == [(1, 1.0, 0.0), (2, 0.0, 0.0)]
    assert {r["id"]: r["s"] for r in encode.one_hot_decode(hot, m).collect()} == {1: "a", 2: None}


def test_constant_and_copied_columns(spark):
    df = spark.createDataFrame([(1, 7.3, 1.0, 2.0), (2, 7.3, 3.0, 6.0), (3, 7.3, 2.0, 4.0)], "id int, c double, x double, y double")
    z = scale.standardise(df, ["c", "x"]).select("z_c", "z_x").collect()
    assert all(r["z_c"] == 0.0 for r in z)
    assert np.std([r["z_x"] for r in z]) == pytest.approx(1.0)
    assert filters.constant_columns(df) == ["c"]
    assert filters.duplicate_columns(df, ["x", "y"]) == ["y"]


def test_whitening_equals_mahalanobis(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3)) @ np.array([[1, 0, 0], [2, 1, 0], [0, 3, 1]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double")
    m = np.array([[r["m_0"], r["m_1"], r["m_2"]] for r in scale.whiten(df, ["a", "b", "c"]).orderBy("id").collect()])
    inv = np.linalg.inv(np.cov(x.T, bias=True))
    d = x[0] - x[7]
    assert np.linalg.norm(m[0] - m[7]) == pytest.approx(np.sqrt(d @ inv @ d))
    with pytest.raises(ValueError):
        scale.whiten(df.withColumn("c", F.col("a")), ["a", "c"], strict=True)


def test_stratified_trim_edges(spark):
    rows = [(0, 1, 9.0)] + [(1, 1, 2.0)] * 4 + [(2, 1, float(i)) for i in range(11)]
    df = spark.createDataFrame(rows, "cluster int, `class` int, distance double")
    kept = filters.stratified_trim(df, 0.1).groupBy("cluster").count().collect()
    assert {r["cluster"]: r["count"] for r in kept} == {0: 1, 1: 4, 2: 10}


def test_threshold_split_missing(spark):
    df = spark.createDataFrame([(0, 1.0, "a"), (0, 3.0, "b"), (1, 1.0, "c")], "cluster int, distance double, v string")
    th = spark.createDataFrame([(0, 2.0)], "cluster int, threshold double")
    for mode, kept in (("drop", {"a"}), ("keep", {"a", "c"})):
        k, o = filters.threshold_split(df, th, mode)
        assert {r["v"] for r in k.collect()} == kept and {r["v"] for r in o.collect()} == {"b"}
        assert o.columns == ["v"]
    with pytest.raises(ValueError):
        filters.threshold_split(df, th, "error")


def test_spec_and_row_ids(spark):
    df = spark.createDataFrame([("x", 1)] * 3 + [("y", 2)], "s string, n int")
    ids = with_row_id(df).collect()
    assert sorted(r["row_id"] for r in ids) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        TableSpec(target="nope").validate(df)
    with pytest.raises(ValueError):
        TableSpec(features=("t",)).validate(df.withColumn("t", F.current_timestamp()))


def test_spread_lookup_splits_hot_keys(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1500, 1).otherwise(F.col("id")).alias("k"), "id")
    table = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    counts = rows.groupBy("k").agg(F.count("*").alias("_rows"))
    out = spread_lookup(rows, table, ["k"], counts, n_rows=1_000_000_000 // 400)
    assert out.count() == 3000 and out.where("v != 2 * k").count() == 0
    # with the threshold below the hot key, both branches run
    from tabsieve import session
    out = session.spread_lookup(rows, table.where("k % 2 = 1"), ["k"], counts.withColumn("_rows", F.col("_rows") * 1000), 1_000_000, "left")
    assert out.count() == 3000 and out.where("v is not null and v != 2 * k").count() == 0


@pytest.mark.parametrize("n_rows", [999_999, 1_000_000])
@pytest.mark.parametrize("how,expected", [("left", 6), ("inner", 1)])
def test_spread_lookup_keeps_join_kind_for_absent_hot_key(spark, n_rows, how, expected):
    rows = spark.createDataFrame([("hot",)] * 4 + [("a",), (None,)], "k string")
    table = spark.createDataFrame([("a", 1.0)], "k string, code double")
    counts = rows.where("k is not null").groupBy("k").agg((F.count("*") * 1000).alias("_rows"))
    out = spread_lookup(rows, table, ["k"], counts, n_rows, how)
    assert out.count() == expected and out.where("code is not null").count() == 1


def test_sparse_one_hot_of_many_categories(spark):
    df = spark.range(50_000).select("id", F.concat(F.lit("v"), F.lpad("id", 5, "0")).alias("s"), F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("t"))
    m = encode.category_mapping(df, ["t", "s"])
    hot = encode.one_hot_slots(df, m)
    assert hot.columns == ["id", "one_hot"] and hot.select("one_hot.size").distinct().collect() == [(50_002,)]
    rows = {r["id"]: r["one_hot"]["slots"] for r in hot.where("id IN (0, 4, 49999)").collect()}
    assert rows == {0: [0], 4: [4, 50_000], 49_999: [49_999, 50_000]}
    back = encode.one_hot_slots_decode(hot, m)
    assert back.columns == df.columns and back.exceptAll(df).isEmpty() and back.count() == 50_000


def test_sparse_one_hot_equals_the_wide_form(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "zz", None), (3, "b", "y"), (3, "b", "y")], "id int, s string, t string")
    m = encode.category_mapping(df.where("s <> 'zz'"), ["s", "t"])
    wide = encode.one_hot_encode(df, m)
    ones = sorted((r["id"], [i for i, v in enumerate(r[1:]) if v]) for r in wide.collect())
    assert ones == sorted((r["id"], r["one_hot"]["slots"]) for r in encode.one_hot_slots(df, m).collect())
    assert encode.one_hot_slots(df.limit(0), m).count() == 0
    none = encode.one_hot_slots(df, m.limit(0))
    assert none.columns == ["id", "s", "t", "one_hot"] and {tuple(r["one_hot"]["slots"]) for r in none.collect()} == {()}


def test_long_categories_are_not_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a" * 5000), (2, None), (3, "b" * 5000)], "id int, s string")
    m = encode.category_mapping(df, ["s"])
    assert encode._mapping_sizes(m)["s"] == (2, 10_096)
    monkeypatch.setattr("tabsieve.session.BROADCAST_BYTES", 9000)
    assert {r["id"]: r["s"] for r in encode.ordinal_encode(df, m).collect()} == {1: 0.0, 2: None, 3: 1.0}
