import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from holdfast.functions import scalars
from holdfast.operators import features, prep, split
from holdfast.schema import ID, TARGET


def labelled(spark, n, every=3):
    return spark.range(n).select(F.col("id").alias(ID), F.when(F.col("id") % every == 0, 1).otherwise(0).alias("churn"))


@pytest.mark.parametrize("n", [1, 7, 19, 101, 5000])
def test_split_is_exact_disjoint_and_stable(spark, n):
    df = labelled(spark, n)
    rows = split.stratified_split(df).collect()
    assert sorted(r[ID] for r in rows) == list(range(n))
    for cls in (0, 1):
        size = sum(r.churn == cls for r in rows)
        got = Counter(r.part for r in rows if r.churn == cls)
        assert got["train"] == size * 60 // 100
        assert got["train"] + got["validation"] == size * 80 // 100
    again = split.stratified_split(df.repartition(5)).collect()
    assert {r[ID]: r.part for r in rows} == {r[ID]: r.part for r in again}


def test_split_percentages_are_checked(spark):
    with pytest.raises(ValueError):
        split.stratified_split(labelled(spark, 3), (("train", 60), ("test", 30)))


def test_holdout_takes_the_ceiling_of_every_segment(spark):
    df = spark.range(57).select(F.col("id").alias(ID), F.when(F.col("id") < 11, "a").otherwise("b").alias("segment"))
    got = Counter((r.segment, r.arm) for r in split.hash_holdout(df, "segment").collect())
    assert got == {("a", "control"): 2, ("a", "treatment"): 9, ("b", "control"): 5, ("b", "treatment"): 41}


def test_hash_split_and_sample(spark):
    df = labelled(spark, 20000)
    share = Counter(r.part for r in split.hash_split(df).collect())
    assert share["train"] / 20000 == pytest.approx(0.6, abs=0.02)
    assert split.hash_sample(df, 500).count() == 500 and split.hash_sample(df, 10 ** 6).count() == 20000


def test_ratio_edges(spark):
    rows = [(1.0, 0.0), (None, 2.0), (2.0, None), (0.0, 0.0), (math.inf, 2.0), (math.nan, 1.0), (-3.0, -2.0), (1.0, 4.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = features.add_features(df, (features.Derived("r", "ratio", "a", "b"),
                                     features.Derived("h", "ratio", "a", "b", times=100.0, over=30.0),
                                     features.Derived("d", "difference", "a", "b"))).collect()
    assert [r.r for r in got] == [None, None, None, None, None, None, 1.5, 0.25]
    assert [r.d for r in got] == [1.0, None, None, 0.0, None, None, -1.0, -3.0]
    assert got[7].h == pytest.approx(25 / 30) and got[4].a is None and got[5].a is None


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.half_up(F.lit(-0.0000001), 6).alias("zero"), scalars.half_up(F.lit(-2.5), 0).alias("away"),
        scalars.is_close(F.lit(0.2), F.lit(0.1) + F.lit(0.1)).alias("close"),
        scalars.title_case(F.lit("current_to_6m_usage")).alias("title"),
        F.log1p(F.lit(-1.0)).alias("domain"), F.log1p(F.lit(-2.0)).alias("outside")).first()
    assert math.copysign(1, row.zero) == 1 and row.away == -3.0 and row.close
    assert row.title == "current_to_6m_usage".replace("_", " ").title()
    assert row.domain is None and row.outside is None


def test_median_mode_and_indicators(spark):
    rows = [(1.0, None, "b", "train"), (2.0, None, "a", "train"), (3.0, None, "a", "train"), (10.0, None, "b", "train"),
            (None, 5.0, None, "test")]
    df = spark.createDataFrame(rows, "x double, empty double, c string, part string")
    train = df.filter("part = 'train'")
    medians = prep.fit_medians(train, ["x", "empty"])
    assert medians == {"x": 2.5}  # a column without training values has no median
    assert prep.fit_modes(train, ["c"]) == {"c": "a"}  # lowest of the tied categories
    assert prep.columns_with_nulls(train, ["x", "c"]) == []  # NULL only in test: no indicator
    filled = prep.impute(df, {**medians, "c": "a"}).filter("part = 'test'").first()
    assert filled.x == 2.5 and filled.c == "a"


def test_codes_unknown_and_null(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "c string")
    test = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    codes = prep.fit_codes(train, ["c"])
    assert {r.value: r.code for r in codes.collect()} == {"a": 0, "b": 1, "c": 2}
    got = {r.c: r.c_code for r in prep.apply_codes(test, codes, ["c"]).collect()}
    assert got == {"a": 0, "z": -1, None: -1}
    labels = {r.c: r.c_code for r in prep.label_encode(test, ["c"]).collect()}
    assert labels == {"a": 0, "nan": 1, "z": 2}


def test_lookups_of_several_columns(spark):
    train = spark.createDataFrame([("b", "x"), ("a", "y")], "c string, d string")
    codes = prep.fit_codes(train, ["c", "d"])
    assert [(r.c_code, r.d_code) for r in prep.apply_codes(train, codes, ["c", "d"]).orderBy("c").collect()] == [(0, 1), (1, 0)]


def test_rare_categories_share_a_slot(spark):
    df = spark.createDataFrame([("ten",)] * 10 + [("nine",)] * 9 + [("one",)], "c string")
    slots = prep.fit_onehot_slots(df, ["c"])
    test = spark.createDataFrame([("ten", "t"), ("nine", "t"), ("one", "t"), ("new", "t")], "c string, part string")
    got = {r.slot: r.customers for r in prep.onehot_counts(test, slots, ["c"], ["part"]).collect()}
    assert got == {"ten": 1, prep.INFREQUENT: 2}


def test_constant_column_scale_and_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0)], "x double, k double")
    scales = prep.fit_scales(df, ["x", "k"])
    assert scales == {"x": (2.0, 1.0), "k": (4.0, 1.0)}
    assert [tuple(r) for r in prep.standardise(df, scales).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_ordered_encoding_never_sees_its_own_label(spark):
    rows = [(i, "train" if i < 40 else "test", i % 2, "hot" if i % 3 else "cold") for i in range(60)]
    df = spark.createDataFrame(rows, f"{ID} long, part string, churn int, c string")
    base = {r[ID]: r.encoded for r in prep.ordered_target_encode(df, ["c"]).collect()}
    flipped = df.withColumn("churn", F.when(F.col("part") == "test", 1 - F.col("churn")).otherwise(F.col("churn")))
    assert {r[ID]: r.encoded for r in prep.ordered_target_encode(flipped, ["c"]).collect()} == base
    hot = [r for r in rows if r[1] == "train" and r[3] == "hot"]
    prior = sum(r[2] for r in rows if r[1] == "train") / 40
    want = (sum(r[2] for r in hot) + prior) / (len(hot) + 1)
    assert all(base[r[0]] == pytest.approx(want) for r in rows if r[1] == "test" and r[3] == "hot")


def test_columns_encoded_in_order_same_as_long_form(spark):
    """Also for unseen categories, NULL values and rows without a part."""
    parts = ["train", "train", "train", "validation", "test"]
    rows = [(i, parts[i % 5], i % 3 % 2, None if i % 11 == 0 else "abc"[i % 3], "new" if i % 25 == 4 else "xy"[i % 2], i * 1.5) for i in range(400)]
    df = spark.createDataFrame(rows, f"{ID} long, part string, {TARGET} int, c string, d string, n double").repartition(4)
    long = prep.ordered_target_encode(df, ["c", "d"])
    want = {r[ID]: r for r in prep.encoded_columns(df, long, ["c", "d"]).collect()}
    got = {r[ID]: r for r in prep.encode_ordered(df, ["c", "d"]).collect()}
    assert len(got) == len(rows) and got.keys() == want.keys()
    for key, r in got.items():
        assert (r.part, r.c, r.d, r.n) == (want[key].part, want[key].c, want[key].d, want[key].n)
        assert abs(r.c_te - want[key].c_te) < 1e-12 and abs(r.d_te - want[key].d_te) < 1e-12
    extra = spark.createDataFrame([(1000, None, None, "a", "z", 0.0)], df.schema)
    added = prep.encode_ordered(df.unionByName(extra), ["c", "d"]).where(f"{ID} = 1000").first()
    assert added.d_te == prep.fit_target_lookup(df.where("part = 'train'"), ["d"])[1]
