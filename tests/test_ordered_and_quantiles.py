import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.operators import ordered, profile, quantiles


def test_running_sums_match_a_plain_loop_with_one_hot_group(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.6 else f"g{rng.randrange(5)}", rng.randrange(4), rng.randrange(10))
            for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, p int, v long").repartition(7)
    got = ordered.running_sums(df, [F.desc("p"), F.asc("id")], {"s": "v"}, group=["g"])
    assert got.columns == ["id", "g", "p", "v", "s"]
    want, total = {}, {}
    for i, g, p, v in sorted(rows, key=lambda r: (-r[2], r[0])):
        total[g] = total.get(g, 0) + v
        want[i] = total[g]
    assert {r.id: r.s for r in got.collect()} == want


def test_running_sums_are_split_over_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).select("id", F.lit(0.5).alias("p"))  # every score is tied
        ranked = ordered.global_rank(df, [F.desc("p"), F.asc("id")])
        assert [r.risk_rank for r in ranked.orderBy("id").collect()] == list(range(1, 4001))
        assert "_slot" in ranked._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_exact_quantiles(spark):
    """The bracketed path gives numpy's linear quantiles."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=5000)
    ties = rng.integers(0, 4, size=5000).astype(float)
    rows = [(float(a), float(b), None) for a, b in zip(x, ties)] + [(None, 2.0, None)]
    df = spark.createDataFrame(rows, "x double, ties double, none double")
    probabilities = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    got = quantiles.exact_quantiles(df, ["x", "ties", "none"], probabilities)
    assert got["x"] == pytest.approx(list(np.quantile(x, probabilities)), abs=1e-12)
    assert got["ties"] == pytest.approx(list(np.quantile([*ties, 2.0], probabilities)))
    assert got["none"] == [None] * len(probabilities)


def test_bracket_that_misses_is_widened(spark, monkeypatch):
    real = quantiles._select_ranks
    calls = []

    def narrow(df, targets, brackets):
        calls.append(dict(brackets))
        if len(calls) == 1:
            brackets = {k: (1e9, 2e9) for k in brackets}
        return real(df, targets, brackets)

    monkeypatch.setattr(quantiles, "_select_ranks", narrow)
    df = spark.range(101).select(F.col("id").cast("double").alias("x"))
    assert quantiles.exact_quantiles(df, ["x"], (0.5,)) == {"x": [50.0]}
    assert len(calls) == 2


def test_tied_quartiles_give_fewer_groups(spark):
    rows = [(1.0, 1)] * 6 + [(2.0, 0)] * 2 + [(None, 1)] * 3
    df = spark.createDataFrame(rows, "x double, churn int")
    got = {r.quartile: (r.customers, r.churn_rate_pct) for r in profile.quartile_churn(df, ["x"]).collect()}
    assert got == {"Q1": (6, 100.0), "Q4": (2, 0.0)} or got == {"Q1": (6, 100.0), "Q3": (2, 0.0)}


def test_histogram_edges(spark):
    rows = [(0, float(v)) for v in range(31)] + [(1, 5.0)] * 3 + [(1, None)]
    df = spark.createDataFrame(rows, "churn int, x double")
    got = profile.class_histogram(df, "x").collect()
    zero = sorted((r.bin, r.customers) for r in got if r.churn == 0)
    assert len(zero) == 30 and zero[-1] == (30, 2)  # the maximum falls in the last bin
    want, _ = np.histogram(range(31), bins=30)
    assert [n for _, n in zero] == list(want)
    one = {r.bin: r.customers for r in got if r.churn == 1}
    want, _ = np.histogram([5.0] * 3, bins=30)
    assert [one[b] for b in range(1, 31)] == list(want)


def test_density_integrates_to_the_class_share(spark):
    rng = np.random.default_rng(0)
    rows = [("stayed", float(v)) for v in rng.normal(size=300)] + [("churned", float(v)) for v in rng.normal(2, 1, 100)]
    got = profile.class_density(spark.createDataFrame(rows, "label string, x double"), ["x"], "label").toPandas()
    for label, share in (("stayed", 0.75), ("churned", 0.25)):
        part = got[got.label == label].sort_values("x")
        assert np.trapezoid(part.density, part.x) == pytest.approx(share, abs=0.005)
