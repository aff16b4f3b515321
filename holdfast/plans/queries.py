"""Registered queries: each derives its input from the source tables and runs one operator on it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.operators import (
    blend,
    campaign,
    features,
    importance,
    metrics,
    monitoring,
    prep,
    profile,
    quality,
    scorecard,
    split,
    targeting,
)
from holdfast.functions.scalars import half_up_sql, numeric_columns, text_columns
from holdfast.schema import DERIVED_FEATURES, ID, TARGET
from holdfast.session import durable, new_scratch_path
from holdfast.sources import csv, results, store
from holdfast.sources.subscriber import client_table, record_table, subscriber_table
from holdfast.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

SEGMENTS = ("crclscod", "area", "prizm_social_one", "asl_flag")
PREPARED = ("change_mou", "custcare_Mean", "cc_mou_Mean", "hnd_price", "rev_Mean", "mou_Mean")
COMPARED = ("eqpdays", "months", "rev_Mean", "mou_Mean", "change_mou", "totmrc_Mean")
RELATED = ("rev_Mean", "totmrc_Mean", "avgrev", "totrev", "mou_Mean", "avgmou", "totmou", "eqpdays")
FENCED = ("rev_Mean", "mou_Mean", "eqpdays", "months", "hnd_price", "change_mou", "totrev")
DRIFTING = ("eqpdays", "months", "rev_Mean", "mou_Mean", "change_mou", "hnd_price")
DENSE = ("eqpdays", "months", "rev_Mean", "mou_Mean")
ALIKE = 0.95
STORE_BUCKETS = 8
# Texts that stand for a missing value in a customer file.
MISSING_MARKERS = ("", "NA", "NaN", "nan", "null", "NULL", "None", "N/A", "n/a", "#N/A", "<NA>")
MEMBERS = ("hist", "cat_d6", "cat_d7", "cat_d8", "engineered")
PAIR_COLUMNS = ("months", "log_rev_Mean", "log_mou_Mean", "log_totmrc_Mean", "log_eqpdays")
SNAPSHOT = "2000-01-01"
EARLIER = "1999-07-01"


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Every double to a fixed number of digits, without negative zero."""
    return df.selectExpr(*[
        f"{half_up_sql(f'`{f.name}`', special.get(f.name, digits))} as `{f.name}`"
        if isinstance(f.dataType, T.DoubleType) else f"`{f.name}`" for f in df.schema])


def engineered(spark: SparkSession, folder: str) -> DataFrame:
    return features.add_features(subscriber_table(spark, folder))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Derived features, member probabilities and their nested blend ``p``."""
    return blend.add_nested_blend(scorecard.add_scores(engineered(spark, folder)), output="p")


def final_scores(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    return scored(spark, folder).select(ID, TARGET, "p", *extra)


def long_members(df: DataFrame, members: tuple[str, ...] = MEMBERS) -> DataFrame:
    return blend.long_scores(df, list(members), [ID, TARGET])


def as_model(df: DataFrame, name: str = "final") -> DataFrame:
    return df.select(ID, TARGET, F.lit(name).alias("model"), "p")


def with_parts(df: DataFrame, parts: tuple[tuple[str, int], ...] = split.PARTS) -> DataFrame:
    return split.stratified_split(durable(df), parts)


def scored_list(spark: SparkSession, folder: str, *extra: str) -> tuple[DataFrame, int]:
    base = durable(final_scores(spark, folder, *extra))
    return base, base.count()


# --- sources and quality ---------------------------------------------------------------------

def csv_scan_nulls(spark, folder):
    path = new_scratch_path(spark)
    csv.write_table(client_table(spark, folder), path)
    return csv.read_customer_file(spark, path)


def csv_two_files(spark, folder):
    """Both customer files written with every missing-value marker, read, checked and joined.

    The files hold the customers that both tables have; others would rightly fail the check of equal ids.
    """
    path = new_scratch_path(spark)
    client, record = durable(client_table(spark, folder)), durable(record_table(spark, folder))
    client, record = client.join(record.select(ID), ID, "left_semi"), record.join(client.select(ID), ID, "left_semi")
    marker = F.element_at(F.array(*map(F.lit, MISSING_MARKERS)), (F.pmod(F.xxhash64(ID), F.lit(len(MISSING_MARKERS))) + 1).cast("int"))
    for name, df in (("Client.csv", client), ("Record.csv", record)):
        marked = df.select(*[F.coalesce(F.col(c).cast("string"), marker).alias(c) for c in df.columns])
        marked.write.option("header", True).option("escape", '"').csv(f"{path}/{name}")
    columns = join_one_to_one(spark, folder).columns
    return rounded(csv.load_customers(spark, path).select(*columns))


def store_join(spark, folder):
    """Both customer tables kept in buckets of the key and joined bucket by bucket."""
    path = new_scratch_path(spark)
    store.save_bucketed(record_table(spark, folder), f"{path}/record", buckets=STORE_BUCKETS)
    store.save_bucketed(client_table(spark, folder), f"{path}/client", buckets=STORE_BUCKETS)
    record, client = store.open_bucketed(spark, f"{path}/record"), store.open_bucketed(spark, f"{path}/client")
    return rounded(store.join_stores(record, client))


def duplicate_keys(spark, folder):
    orders = quality.duplicate_keys(table(spark, folder, "orders"), "o_custkey", "orders")
    return orders.unionByName(quality.duplicate_keys(table(spark, folder, "customer"), "c_custkey", "customer"))


def on_both(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: operator(client_table(spark, folder), record_table(spark, folder))


def join_one_to_one(spark, folder):
    return rounded(subscriber_table(spark, folder))


# --- profile ---------------------------------------------------------------------------------

def qcut_churn_rate(spark, folder):
    return rounded(profile.quartile_churn(
        durable(subscriber_table(spark, folder).select(TARGET, *profile.QUARTILE_FEATURES))))


def class_histogram(spark, folder):
    return rounded(profile.class_histogram(durable(subscriber_table(spark, folder).select(TARGET, "eqpdays"))))


def pair_sample(spark, folder) -> DataFrame:
    return split.pair_sample(durable(subscriber_table(spark, folder).select(
        ID, TARGET, "months", "rev_Mean", "mou_Mean", "totmrc_Mean", "eqpdays")))


def class_density(spark, folder):
    sample = durable(pair_sample(spark, folder))
    return rounded(profile.class_density(sample, PAIR_COLUMNS, "churn_label"))


def binned_density(spark, folder):
    rows = durable(subscriber_table(spark, folder).select(TARGET, *DENSE))
    return rounded(profile.binned_density(rows, DENSE))


def correlated_pairs(spark, folder):
    rows = durable(subscriber_table(spark, folder))
    return rounded(profile.correlated_pairs(rows, numeric_columns(rows, (ID, TARGET)), ALIKE))


def segment_cube(spark, folder):
    return rounded(profile.segment_cube(split_columns(spark, folder, ("prizm_social_one",)), "prizm_social_one", "part"))


def outlier_counts(spark, folder):
    return rounded(profile.outlier_counts(durable(subscriber_table(spark, folder).select(*FENCED)), FENCED), 2)


# --- splitting and preparation ---------------------------------------------------------------

def split_columns(spark, folder, columns: tuple[str, ...]) -> DataFrame:
    return with_parts(subscriber_table(spark, folder).select(ID, TARGET, *columns))


def stratified_split(spark, folder):
    return split_columns(spark, folder, ())


def stratified_split_7030(spark, folder):
    return with_parts(subscriber_table(spark, folder).select(ID, TARGET), split.PARTS_70_30)


def hash_split(spark, folder):
    return split.hash_split(subscriber_table(spark, folder).select(ID, TARGET))


def median_impute(spark, folder):
    df = durable(split_columns(spark, folder, PREPARED))
    medians = prep.fit_medians(df.filter("part = 'train'"), PREPARED)
    return rounded(prep.impute(df, medians).select(ID, "part", *PREPARED))


def missing_indicators(spark, folder):
    whole = subscriber_table(spark, folder)
    numeric, text = numeric_columns(whole, (ID, TARGET)), text_columns(whole)
    df = durable(with_parts(whole))
    train = df.filter("part = 'train'")
    fitted = {"numeric": prep.columns_with_nulls(train, numeric), "categorical": prep.columns_with_nulls(train, text)}
    flagged = reduce(lambda d, g: prep.add_indicators(d, fitted[g], g), fitted, df)
    names = [prep.indicator_name(c, g) for g, columns in fitted.items() for c in columns]
    totals = flagged.groupBy("part").agg(F.count(F.lit(1)).alias("customers"),
                                         *[F.sum(n).cast("long").alias(n) for n in names])
    return totals.unpivot(["part", "customers"], names, "indicator", "flagged")


def mode_impute(spark, folder):
    df = durable(split_columns(spark, folder, SEGMENTS))
    modes = prep.fit_modes(df.filter("part = 'train'"), SEGMENTS)
    return prep.impute(df, modes).select(ID, "part", *SEGMENTS)


def categorical_fill(spark, folder):
    return prep.fill_categories(subscriber_table(spark, folder).select(ID, *SEGMENTS), SEGMENTS)


def ordinal_encode(spark, folder):
    df = durable(prep.fill_categories(split_columns(spark, folder, SEGMENTS), SEGMENTS))
    coded = prep.apply_codes(df, prep.fit_codes(df.filter("part = 'train'"), SEGMENTS), SEGMENTS)
    return coded.select(ID, "part", *[f"{c}_code" for c in SEGMENTS])


def onehot_counts(spark, folder):
    df = durable(split_columns(spark, folder, SEGMENTS))
    filled = prep.impute(df, prep.fit_modes(df.filter("part = 'train'"), SEGMENTS))
    slots = prep.fit_onehot_slots(filled.filter("part = 'train'"), SEGMENTS)
    return prep.onehot_counts(filled, slots, SEGMENTS, ["part"])


def standardize(spark, folder):
    df = durable(split_columns(spark, folder, PREPARED))
    filled = prep.impute(df, prep.fit_medians(df.filter("part = 'train'"), PREPARED))
    scales = prep.fit_scales(filled.filter("part = 'train'"), PREPARED)
    return rounded(prep.standardise(filled, scales).select(ID, "part", *PREPARED))


def label_encode(spark, folder):
    df = durable(subscriber_table(spark, folder).select(ID, *SEGMENTS))
    return prep.label_encode(df, SEGMENTS).select(ID, *[f"{c}_code" for c in SEGMENTS])


def ordered_target_encode(spark, folder):
    return rounded(prep.ordered_target_encode(durable(split_columns(spark, folder, SEGMENTS)), SEGMENTS))


# --- scores and metrics ----------------------------------------------------------------------

def blend_probabilities(spark, folder):
    members = scorecard.add_scores(engineered(spark, folder))
    blended = blend.add_blend(members, blend.CATEGORICAL_ENSEMBLE, "p_ensemble")
    trees = blend.normalised(blend.TREE_ONLY_ENSEMBLE)
    return rounded(blend.add_blend(blended, trees, "p_trees").select(ID, "p_ensemble", "p_trees"))


def blend_nested(spark, folder):
    both = blend.class_probabilities(F.col("p"))
    return rounded(final_scores(spark, folder).select(
        ID, F.col("p").alias("p_final"), both["stay"].alias("p_stay")))


def predict_at_threshold(spark, folder):
    return final_scores(spark, folder).select(
        ID, TARGET, blend.predict(F.col("p"), 0.5).alias("at_050"), blend.predict(F.col("p"), 0.36).alias("at_036"))


def member_scores(spark, folder) -> DataFrame:
    return durable(long_members(scorecard.add_scores(engineered(spark, folder))).select("model", TARGET, "p"))


def roc_auc(spark, folder):
    return rounded(metrics.ranking_metrics(member_scores(spark, folder)).drop("average_precision"))


def average_precision(spark, folder):
    return rounded(metrics.ranking_metrics(member_scores(spark, folder)).select("model", "average_precision"))


def classification_metrics(spark, folder):
    return rounded(metrics.classification_metrics(durable(as_model(final_scores(spark, folder)))))


def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(as_model(final_scores(spark, folder)))


def roc_curve(spark, folder):
    curve = metrics.roc_curve(as_model(final_scores(spark, folder)))
    return rounded(curve, threshold=9)


def f1_threshold(spark, folder):
    return rounded(metrics.best_f1_threshold(member_scores(spark, folder)))


def f1_sweep(spark, folder):
    return rounded(metrics.threshold_sweep(durable(as_model(final_scores(spark, folder)))).drop("step"))


def cost_threshold(spark, folder):
    return rounded(metrics.cheapest_threshold(member_scores(spark, folder)))


def _selected(parts: DataFrame) -> tuple[float, DataFrame]:
    """Threshold chosen on validation, and test metrics at 0.5 and at that threshold."""
    chosen = metrics.best_f1_threshold(as_model(parts.filter("part = 'validation'"))).first()["threshold"]
    test = as_model(parts.filter("part = 'test'"))
    return chosen, metrics.classification_metrics(test, sorted({0.5, chosen}))


def metrics_two_thresholds(spark, folder):
    return rounded(_selected(durable(with_parts(final_scores(spark, folder))))[1])


def model_comparison(spark, folder):
    parts = with_parts(scored(spark, folder).withColumnRenamed("p", "p_final").select(
        ID, TARGET, *[f"p_{m}" for m in (*MEMBERS, "ensemble", "final")]))
    valid = long_members(parts.filter("part = 'validation'"), (*MEMBERS, "ensemble", "final"))
    table_ = durable(metrics.compare_models(durable(valid)).drop("threshold"))
    place = F.row_number().over(metrics.Window.orderBy(F.desc("roc_auc"), "model"))  # one row per model
    return rounded(table_.withColumn("place", place))


def run_metadata(spark, folder):
    whole = subscriber_table(spark, folder)
    numeric, text = len(numeric_columns(whole, (ID, TARGET))), len(text_columns(whole))
    parts = durable(with_parts(final_scores(spark, folder)))
    threshold, measured = _selected(parts)
    both = {("default" if r.threshold == 0.5 else "selected"): r for r in measured.collect()}
    sizes = {p: F.count_if(F.col("part") == p).alias(p) for p in ("train", "validation", "test")}

    def metric_struct(row):
        names = ("roc_auc", "pr_auc", "accuracy", "precision", "recall", "f1")
        return F.struct(*[F.lit(row[m]).alias(m) for m in names])

    # The field names of the published result documents.
    document = parts.agg(F.struct(*sizes.values()).alias("split_rows"), F.avg(TARGET).alias("target_rate")).select(
        F.lit(TARGET).alias("target"), F.lit("final").alias("selected_model"),
        F.lit("validation ROC-AUC").alias("selection_metric"), F.lit(threshold).alias("decision_threshold"),
        "split_rows", F.lit(numeric + text).alias("feature_count"), F.lit(numeric).alias("numeric_feature_count"),
        F.lit(text).alias("categorical_feature_count"), "target_rate",
        metric_struct(both["default"]).alias("test_metrics_at_0_5"),
        metric_struct(both.get("selected", both["default"])).alias("test_metrics_at_selected_threshold"))
    path = new_scratch_path(spark)
    results.write_document(document, path)
    return rounded(results.read_document(spark, path).select(
        "target", "selected_model", "selection_metric", "decision_threshold",
        *[F.col(f"split_rows.{p}").alias(f"rows_{p}") for p in sizes],
        "feature_count", "numeric_feature_count", "categorical_feature_count", "target_rate",
        F.col("test_metrics_at_0_5.roc_auc").alias("default_roc_auc"),
        F.col("test_metrics_at_0_5.f1").alias("default_f1"),
        F.col("test_metrics_at_selected_threshold.recall").alias("selected_recall"),
        F.col("test_metrics_at_selected_threshold.f1").alias("selected_f1")))


# --- importance ------------------------------------------------------------------------------

def gains(spark, folder) -> DataFrame:
    return scorecard.scorecard_importance(engineered(spark, folder), scorecard.ENGINEERED)


def importance_blend(spark, folder):
    inputs = dict.fromkeys(t.feature for m in blend.TREE_ONLY_ENSEMBLE for t in scorecard.SCORECARDS[m])
    base = durable(engineered(spark, folder).select(*inputs))  # every member reads it
    tables = {m: scorecard.scorecard_importance(base, scorecard.SCORECARDS[m]) for m in blend.TREE_ONLY_ENSEMBLE}
    return rounded(importance.blend_importance(tables, blend.TREE_ONLY_ENSEMBLE))


def permutation_importance(spark, folder):
    inputs = [t.feature for t in scorecard.HIST]
    valid = durable(split_columns(spark, folder, tuple(inputs)).filter("part = 'validation'").drop("part"))
    score = f"{scorecard.score_sql(scorecard.HIST)} as p"
    return rounded(importance.permutation_importance(valid, lambda d: d.selectExpr("*", score), inputs, rows=importance.PUBLISHED_ROWS))


# --- targeting -------------------------------------------------------------------------------

def scored_customers(spark, folder):
    return rounded(targeting.rank_customers(scored_list(spark, folder)[0]))


def top_share(spark, folder):
    base, n = scored_list(spark, folder)
    return targeting.rank_customers(targeting.top_share(base, n)).select(ID, "risk_rank")


def capture_lift_curve(spark, folder):
    return rounded(targeting.capture_lift_curve(*scored_list(spark, folder)))


def top20_summary(spark, folder):
    return rounded(targeting.top_summary(*scored_list(spark, folder, "rev_Mean")))


def impact_scenarios(spark, folder):
    return rounded(targeting.impact_scenarios(targeting.top_summary(*scored_list(spark, folder, "rev_Mean"))), 3, roi=6)


# --- campaign operation ----------------------------------------------------------------------

def weekly_scores(spark, folder):
    path = new_scratch_path(spark)
    campaign.write_weekly(campaign.weekly_scores(scored(spark, folder), SNAPSHOT), path)
    schema = f"{ID} long, p double, snapshot_date date"
    week = F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date")
    return rounded(spark.read.schema(schema).parquet(path).select(week, ID, "p"))


def _scored_signals(spark, folder) -> DataFrame:
    signals = [s for _, s, _ in campaign.ACTIONS]
    return durable(final_scores(spark, folder, *signals))


def retention_actions(spark, folder):
    return rounded(campaign.retention_actions(_scored_signals(spark, folder)))


def _arms(spark, folder) -> DataFrame:
    actions = campaign.retention_actions(_scored_signals(spark, folder), keep=(TARGET, "rev_Mean"))
    segmented = actions.select(ID, F.concat_ws("/", "risk_band", "action").alias("segment"), TARGET, "rev_Mean")
    return split.hash_holdout(durable(segmented), "segment")


def holdout_assignment(spark, folder):
    return _arms(spark, folder).select(ID, "segment", "arm")


def uplift_measurement(spark, folder):
    return rounded(campaign.uplift(_arms(spark, folder)), net_value=3)


def recalibrated_scores(spark, folder):
    return rounded(final_scores(spark, folder).select(
        ID, "p", campaign.shift_base_rate(F.col("p"), 0.5, 0.2).alias("p_shifted")))


def feature_drift_psi(spark, folder):
    old = durable(subscriber_table(spark, folder, EARLIER).select(*DRIFTING))
    return rounded(campaign.feature_drift(old, subscriber_table(spark, folder, SNAPSHOT).select(*DRIFTING), DRIFTING))


def _halves(df: DataFrame) -> list[DataFrame]:
    """Two loads of one week."""
    return [df.where(F.pmod(F.xxhash64(ID), F.lit(2)) == i) for i in range(2)]


def drift_from_state(spark, folder):
    """Drift of a week counted in two loads against bins and counts that were frozen and saved before."""
    path = new_scratch_path(spark)
    old = durable(subscriber_table(spark, folder, EARLIER).select(*DRIFTING))
    frozen = monitoring.freeze_bins(old, DRIFTING)
    monitoring.save_state(path, frozen=frozen, reference=monitoring.count_bins(old, frozen))
    frozen, reference = monitoring.load_state(spark, path, "frozen", "reference")
    week = _halves(subscriber_table(spark, folder, SNAPSHOT).select(ID, *DRIFTING))
    return rounded(monitoring.drift(reference, monitoring.add_counts(*[monitoring.count_bins(w, frozen) for w in week])))


def calibration_from_state(spark, folder):
    path = new_scratch_path(spark)
    first, second = [monitoring.count_scores(w) for w in _halves(durable(final_scores(spark, folder)))]
    monitoring.save_state(path, counts=first)
    monitoring.save_state(path, total=monitoring.add_counts(*monitoring.load_state(spark, path, "counts"), second))
    return rounded(monitoring.calibration(*monitoring.load_state(spark, path, "total")))


def segment_fairness(spark, folder):
    segments = ("prizm_social_one", "crclscod", "area")
    return rounded(campaign.segment_fairness(final_scores(spark, folder, *segments), segments))


def sql_checked_queries() -> dict[str, Query]:
    derived = [f.name for f in DERIVED_FEATURES]
    return {
        "csv_scan_nulls": csv_scan_nulls,
        "join_one_to_one": join_one_to_one,
        "csv_two_files": csv_two_files,
        "store_join": store_join,
        "dq_report": on_both(quality.dq_report),
        "duplicate_keys": duplicate_keys,
        "key_coverage": on_both(quality.key_coverage),
        "key_coverage_offenders": on_both(quality.coverage_offenders),
        "table_profile": lambda s, d: profile.table_profile(subscriber_table(s, d)),
        "missing_counts": lambda s, d: profile.missing_counts(subscriber_table(s, d)).drop("missing_pct"),
        "missing_pct": lambda s, d: rounded(profile.missing_counts(subscriber_table(s, d), 12).drop("missing")),
        "target_balance": lambda s, d: rounded(profile.target_balance(subscriber_table(s, d))),
        "class_mean_compare": lambda s, d: rounded(profile.class_means(subscriber_table(s, d), COMPARED)),
        "qcut_churn_rate": qcut_churn_rate,
        "class_histogram": class_histogram,
        "pair_sample": lambda s, d: rounded(pair_sample(s, d)),
        "class_density": class_density,
        "binned_density": binned_density,
        "correlated_pairs": correlated_pairs,
        "segment_cube": segment_cube,
        "split_summary": lambda s, d: rounded(split.split_summary(stratified_split(s, d))),
        "feature_correlation": lambda s, d: rounded(profile.feature_correlation(subscriber_table(s, d), RELATED)),
        "segment_churn_rate": lambda s, d: rounded(profile.segment_rates(subscriber_table(s, d), SEGMENTS)),
        "outlier_counts": outlier_counts,
        "stratified_split": stratified_split,
        "stratified_split_7030": stratified_split_7030,
        "hash_split": hash_split,
        "engineered_features": lambda s, d: rounded(engineered(s, d).select(ID, *derived)),
        "feature_ratio_stats": lambda s, d: rounded(features.feature_stats(engineered(s, d), derived)),
        "median_impute": median_impute,
        "missing_indicators": missing_indicators,
        "mode_impute": mode_impute,
        "categorical_fill": categorical_fill,
        "ordinal_encode": ordinal_encode,
        "onehot_counts": onehot_counts,
        "standardize": standardize,
        "label_encode": label_encode,
        "ordered_target_encode": ordered_target_encode,
        "blend_probabilities": blend_probabilities,
        "blend_nested": blend_nested,
        "predict_at_threshold": predict_at_threshold,
        "roc_auc": roc_auc,
        "average_precision": average_precision,
        "classification_metrics": classification_metrics,
        "confusion_matrix": confusion_matrix,
        "roc_curve": roc_curve,
        "f1_threshold": f1_threshold,
        "f1_sweep": f1_sweep,
        "cost_threshold": cost_threshold,
        "metrics_two_thresholds": metrics_two_thresholds,
        "model_comparison": model_comparison,
        "run_metadata": run_metadata,
        "importance_top": lambda s, d: rounded(importance.top_importance(gains(s, d), 15)),
        "importance_share": lambda s, d: rounded(importance.importance_share(gains(s, d))),
        "importance_labels": lambda s, d: rounded(importance.importance_labels(gains(s, d))),
        "importance_by_theme": lambda s, d: rounded(importance.importance_by_theme(gains(s, d))),
        "importance_blend": importance_blend,
        "permutation_importance": permutation_importance,
        "scored_customers": scored_customers,
        "top_share": top_share,
        "capture_lift_curve": capture_lift_curve,
        "top20_summary": top20_summary,
        "impact_scenarios": impact_scenarios,
        "weekly_scores": weekly_scores,
        "retention_actions": retention_actions,
        "holdout_assignment": holdout_assignment,
        "uplift_measurement": uplift_measurement,
        "calibration_table": lambda s, d: rounded(campaign.calibration_table(final_scores(s, d))),
        "calibration_summary": lambda s, d: rounded(campaign.calibration_summary(final_scores(s, d))),
        "recalibrated_scores": recalibrated_scores,
        "feature_drift_psi": feature_drift_psi,
        "drift_from_state": drift_from_state,
        "calibration_from_state": calibration_from_state,
        "segment_fairness": segment_fairness,
    }
