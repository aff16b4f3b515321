import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.operators import blend, campaign, importance, metrics, targeting
from holdfast.schema import ID

SCHEMA = f"{ID} long, churn int, model string, p double"

# Published confusion counts and the rates they must give.
PUBLISHED = (
    # TP, FP, FN, TN, accuracy, precision, recall, f1
    (6522, 3832, 3391, 6255, 0.63885, 0.6299014873478849, 0.6579239382628871, 0.6436078353974442),
    (6446, 4034, 3467, 6053, 0.62495, 0.6150763358778626, 0.650257237970342, 0.6321777080370715),
    (6409, 3801, 3503, 6287, 0.6348, 0.6277179236043094, 0.6465899919289749, 0.6370142132988769),
    (8820, 7020, 1092, 3068, 0.5944, 0.5568181818181818, 0.8898305084745762, 0.684995340167754),
    (6553, 3759, 3360, 6328, 0.64405, 0.6354732350659426, 0.6610511449611621, 0.6480098887515451),
    (6428, 3732, 3484, 6356, 0.6392, 0.6326771653543307, 0.6485068603712671, 0.6404942210051017),
    (8852, 6924, 1060, 3164, 0.6008, 0.561105476673428, 0.8930589184826473, 0.689193397695422),
    (6477, 3616, 3436, 6471, 0.6474, 0.6417318933914594, 0.653384444668617, 0.6475057482755173),
    (6408, 3641, 3504, 6447, 0.64275, 0.637675390586128, 0.6464891041162227, 0.6420520014027353),
    (9066, 7304, 846, 2784, 0.5925, 0.5538179596823457, 0.9146489104116223, 0.689901833954798),
)


def scores(spark, rows, model="m"):
    return spark.createDataFrame([(i, y, model, p) for i, (y, p) in enumerate(rows)], SCHEMA)


def test_published_rates_follow_from_published_counts(spark):
    rows = []
    for i, (tp, fp, fn, tn, *_) in enumerate(PUBLISHED):
        rows += [(f"m{i}", 1, 0.9, tp), (f"m{i}", 0, 0.9, fp), (f"m{i}", 1, 0.1, fn), (f"m{i}", 0, 0.1, tn)]
    counted = spark.createDataFrame(rows, "model string, churn int, p double, n int")
    expanded = counted.select("model", "churn", "p", F.explode(F.array_repeat(F.lit(1), F.col("n"))))
    got = {r.model: r for r in metrics.threshold_metrics(expanded, [0.5]).collect()}
    for i, (tp, fp, fn, tn, accuracy, precision, recall, f1) in enumerate(PUBLISHED):
        r = got[f"m{i}"]
        assert (r.tp, r.fp, r.fn, r.tn) == (tp, fp, fn, tn)
        assert (r.accuracy, r.precision, r.recall, r.f1) == pytest.approx((accuracy, precision, recall, f1), abs=1e-7)


def brute_auc(rows):
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_ranking_metrics_with_ties(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(2), rng.randrange(12) / 12) for _ in range(400)]
    got = metrics.ranking_metrics(scores(spark, rows)).first()
    assert got.roc_auc == pytest.approx(brute_auc(rows)) and got.curve_area == pytest.approx(got.roc_auc)
    ap, tp = 0.0, 0
    for t in sorted({p for _, p in rows}, reverse=True):
        flagged = [y for y, p in rows if p >= t]
        ap += (sum(flagged) - tp) / sum(y for y, _ in rows) * sum(flagged) / len(flagged)
        tp = sum(flagged)
    assert got.average_precision == pytest.approx(ap)
    flipped = metrics.ranking_metrics(scores(spark, [(y, 1 - p) for y, p in rows])).first()
    assert flipped.roc_auc == pytest.approx(1 - got.roc_auc)
    curve = metrics.roc_curve(scores(spark, rows)).orderBy("tpr", "fpr").toPandas()
    assert np.trapezoid(curve.tpr, curve.fpr) == pytest.approx(got.roc_auc)


def test_one_class_has_no_area_but_has_rates(spark):
    got = metrics.classification_metrics(scores(spark, [(1, 0.9), (1, 0.2)])).first()
    assert got.roc_auc is None and got.recall == 0.5 and got.precision == 1.0
    none = metrics.classification_metrics(scores(spark, [(0, 0.1)])).first()
    assert (none.precision, none.recall, none.f1, none.accuracy) == (0.0, 0.0, 0.0, 1.0)


def test_threshold_is_inclusive_and_matrix_is_complete(spark):
    got = {(r.actual, r.predicted): r.customers for r in
           metrics.confusion_matrix(scores(spark, [(1, 0.5), (0, 0.4999)])).collect()}
    assert got == {(0, 0): 1, (0, 1): 0, (1, 0): 0, (1, 1): 1}


def brute_sweep(rows):
    grid = [float(np.linspace(0.05, 0.95, 181)[i]) for i in range(181)]
    out = []
    for t in grid:
        tp = sum(y for y, p in rows if p >= t)
        fp = sum(1 - y for y, p in rows if p >= t)
        fn = sum(y for y, _ in rows) - tp
        out.append((t, 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0, fp, fn))
    return out


def test_threshold_sweep_matches_every_grid_point(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(2), rng.choice([rng.random(), 0.05 + rng.randrange(181) * 0.005])) for _ in range(600)]
    got = metrics.threshold_sweep(scores(spark, rows)).orderBy("step").collect()
    want = brute_sweep(rows)
    assert [(r.threshold, r.fp, r.fn) for r in got] == [(t, fp, fn) for t, _, fp, fn in want]
    best = metrics.best_f1_threshold(scores(spark, rows)).first()
    assert best.threshold == max(want, key=lambda r: (r[1], -r[0]))[0]
    cheap = metrics.cheapest_threshold(scores(spark, rows), 15.0, 60.0).first()
    assert cheap.cost == min(15 * fp + 60 * fn for _, _, fp, fn in want)


def test_flat_f1_takes_the_lowest_threshold(spark):
    best = metrics.best_f1_threshold(scores(spark, [(1, 0.99), (0, 0.001)])).first()
    assert best.threshold == 0.05 and best.f1 == 1.0  # the lowest of many equal thresholds
    assert math.isclose(0.05 + 56 * 0.005, 0.33) and math.isclose(0.05 + 62 * 0.005, 0.36)


@pytest.mark.parametrize("n", [7, 19, 20, 101])
def test_capture_truncates_like_head(spark, n):
    rng = random.Random(n)
    rows = [(i, int(rng.random() < 0.5 or i == 0), rng.randrange(5) / 5, float(i)) for i in range(n)]
    df = spark.createDataFrame(rows, f"{ID} long, churn int, p double, rev_Mean double")
    ranked = targeting.rank_customers(df)
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    assert [r[ID] for r in ranked.orderBy("risk_rank").collect()] == [r[0] for r in order]
    curve = targeting.capture_lift_curve(df, n).orderBy("share_pct").collect()
    churners = sum(r[1] for r in rows)
    for i, r in enumerate(curve, 1):
        head = order[: n * i // 20]
        assert (r.share_pct, r.targeted, r.reached) == (i * 5, len(head), sum(h[1] for h in head))
        assert r.churn_capture == pytest.approx(r.reached / churners)
        if head:
            assert r.lift == pytest.approx(r.churn_capture / (len(head) / n))
    assert curve[-1].churn_capture == 1.0 and curve[-1].lift == pytest.approx(1.0)
    top = targeting.top_summary(df, n).first()
    assert top.targeted == n // 5 and targeting.top_share(df, n).count() == n // 5


def test_impact_identity(spark):
    summary = spark.createDataFrame([(20, 0.3, 0.5, 60.0)],
                                    "share_pct int, churn_capture double, overall_rate double, mean_revenue double")
    got = {r.scenario: r for r in targeting.impact_scenarios(summary).collect()}
    base = got["20% save rate"]
    assert base.reached_churners == pytest.approx(15000) and base.campaign_cost == 300000.0
    assert base.gross_value == pytest.approx(15000 * 0.2 * 60 * 12)
    assert base.net_value == pytest.approx(base.gross_value - 300000) and base.roi == pytest.approx(base.net_value / 300000)
    assert (1_950_000 - 300_000) / 300_000 == 5.5  # the published base case


def test_blends(spark):
    df = spark.createDataFrame([(0.2, 0.4)], "p_a double, p_b double")
    assert blend.add_blend(df, {"a": 1.0}, "p").first().p == 0.2
    assert blend.add_blend(df, blend.normalised({"a": 1, "b": 3}), "p").first().p == pytest.approx(0.35)
    with pytest.raises(ValueError, match="sum to one"):
        blend.add_blend(df, {"a": 0.5, "b": 0.49}, "p")
    with pytest.raises(ValueError, match="No probability"):
        blend.add_blend(df, {"a": 0.5, "c": 0.5}, "p")
    with pytest.raises(ValueError, match="Missing required features"):
        blend.require_columns(df, ["p_a", "x"])


def test_importance_share_of_published_gains(spark):
    gains = (52397.94185090065, 44895.07879638672, 35980.9273, 26764.6332, 20247.2498, 18832.2290, 17701.7084,
             14273.1602, 13616.8929, 10465.2922, 9738.8406, 8923.9138)
    shares = (19.1347, 16.3948, 13.1395, 9.7739, 7.3939, 6.8771, 6.4643, 5.2123, 4.9726, 3.8217, 3.5564, 3.2588)
    rows = [(f"numeric__{f}", g) for f, g in zip(importance.FRIENDLY, gains)] + [("numeric__other", 1.0)]
    table = spark.createDataFrame(rows, "feature string, gain double")
    got = [r.share_pct for r in importance.importance_share(table).orderBy(F.desc("gain")).collect()]
    assert got == pytest.approx(shares, abs=1e-4)


def test_base_rate_shift_and_calibration(spark):
    row = spark.createDataFrame([(0.5, 1)], "p double, churn int")
    assert row.select(campaign.shift_base_rate(F.col("p"), 0.5, 0.2).alias("q")).first().q == pytest.approx(0.2)
    df = spark.createDataFrame([(0.95, 1), (1.0, 1), (0.05, 0), (0.0, 1)], "p double, churn int")
    table = {r.bin: r.customers for r in campaign.calibration_table(df).collect()}
    assert table == {1: 2, 10: 2}
    brier = campaign.calibration_summary(df).first().brier
    assert brier == pytest.approx((0.05 ** 2 + 0 + 0.05 ** 2 + 1) / 4)


def test_identical_snapshots_do_not_drift(spark):
    df = spark.range(1000).select((F.col("id") % 97).cast("double").alias("x"))
    assert campaign.feature_drift(df, df, ["x"]).first().psi == pytest.approx(0.0)
    moved = df.select((F.col("x") + 60).alias("x"))
    assert campaign.feature_drift(df, moved, ["x"]).first().psi > 0.25


def test_weekly_write_replaces_only_its_own_date(spark, tmp_path):
    path = str(tmp_path / "weekly")
    df = spark.createDataFrame([(1, 0.5, 10.0, 5.0)], f"{ID} long, p double, months double, totcalls double")
    campaign.write_weekly(campaign.weekly_scores(df, "2000-01-01"), path)
    campaign.write_weekly(campaign.weekly_scores(df.withColumn("p", F.lit(0.7)), "2000-01-08"), path)
    campaign.write_weekly(campaign.weekly_scores(df.withColumn("p", F.lit(0.9)), "2000-01-08"), path)
    assert sorted((str(r.snapshot_date), r.p) for r in spark.read.parquet(path).collect()) == [
        ("2000-01-01", 0.5), ("2000-01-08", 0.9)]
