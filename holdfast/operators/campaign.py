"""Operating a retention campaign: weekly lists, actions, control groups, uplift and monitoring.

These jobs follow the operating model the project describes in words; it has no code for them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.scalars import half_up, safe_div
from holdfast.operators import monitoring
from holdfast.schema import ID, TARGET

ELIGIBLE = ("months >= 3", "totcalls > 0")

# (action, risk signal, sign): a large signed z-score of the signal points at the action.
ACTIONS = (
    ("handset_upgrade", "eqpdays", 1.0),
    ("plan_fit_review", "current_to_3m_usage", -1.0),
    ("service_recovery", "call_failure_rate", 1.0),
    ("priority_outreach", "rev_Mean", 1.0),
)


def eligible(df: DataFrame, predicates: Sequence[str] = ELIGIBLE) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [F.expr(p) for p in predicates]))


def weekly_scores(scored: DataFrame, snapshot_date: str, predicates: Sequence[str] = ELIGIBLE,
                  key: str = ID) -> DataFrame:
    """Eligible customers with their score, stamped with the snapshot date."""
    return eligible(scored, predicates).select(F.lit(snapshot_date).cast("date").alias("snapshot_date"), key, "p")


def write_weekly(df: DataFrame, path: str) -> None:
    """Replace only the snapshot dates present in ``df``."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("snapshot_date").parquet(path))


def risk_band(p: Column, high: float = 0.6, low: float = 0.4) -> Column:
    return F.when(p >= high, "high").when(p >= low, "medium").otherwise("low")


def retention_actions(df: DataFrame, key: str = ID, keep: Sequence[str] = ()) -> DataFrame:
    """The action whose risk signal stands out most against the portfolio; the first one on ties.

    ``keep`` names further columns of ``df`` to return.

    A missing or constant signal does not stand out.
    """
    stats = df.agg(*[F.avg(s).alias(f"m_{s}") for _, s, _ in ACTIONS],
                   *[F.stddev_pop(s).alias(f"d_{s}") for _, s, _ in ACTIONS]).first()
    z = {}
    for action, signal, sign in ACTIONS:
        mean, deviation = stats[f"m_{signal}"], stats[f"d_{signal}"]
        known = F.lit(0.0) if not deviation else half_up(
            (F.col(signal) - F.lit(mean)) / F.lit(deviation) * F.lit(sign), 6)
        z[action] = F.coalesce(known, F.lit(0.0))
    strongest = F.greatest(*z.values())
    choice = None
    for action, value in z.items():
        choice = F.when(value == strongest, action) if choice is None else choice.when(value == strongest, action)
    return df.select(key, risk_band(F.col("p")).alias("risk_band"), choice.alias("action"),
                     strongest.alias("signal_strength"), *keep)


def uplift(outcomes: DataFrame, segment: str = "segment", arm: str = "arm", target: str = TARGET,
           revenue: str = "rev_Mean", contact_cost: float = 15.0, months: int = 12) -> DataFrame:
    """Per segment: retention of treated against control customers, standard error and net value."""
    treated, y = F.col(arm) == "treatment", F.col(target)
    sums = outcomes.groupBy(segment).agg(
        F.count_if(treated).alias("treated"), F.count_if(~treated).alias("control"),
        F.avg(F.when(treated, 1 - y)).alias("treated_retention"),
        F.avg(F.when(~treated, 1 - y)).alias("control_retention"),
        F.avg(F.when(treated, F.col(revenue))).alias("mean_revenue"),
    )
    rt, rc = F.col("treated_retention"), F.col("control_retention")
    nt, nc = F.nullif(F.col("treated"), F.lit(0)), F.nullif(F.col("control"), F.lit(0))
    gain = rt - rc
    return sums.select(
        segment, "treated", "control", "treated_retention", "control_retention", gain.alias("incremental_retention"),
        F.sqrt(rt * (1 - rt) / nt + rc * (1 - rc) / nc).alias("standard_error"),
        (gain * nt * F.col("mean_revenue") * F.lit(float(months)) - nt * F.lit(contact_cost)).alias("net_value"),
    )


def calibration_table(scored: DataFrame, bins: int = 10, target: str = TARGET) -> DataFrame:
    """Mean score against observed rate in equal-width score bins."""
    slot = F.least(F.floor(F.col("p") * bins) + 1, F.lit(bins)).cast("int")
    return scored.groupBy(slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("customers"), F.avg("p").alias("mean_p"), F.avg(target).alias("observed_rate"))


def calibration_summary(scored: DataFrame, bins: int = 10, target: str = TARGET) -> DataFrame:
    """Brier score and expected calibration error, from one grouping."""
    slot = F.least(F.floor(F.col("p") * bins) + 1, F.lit(bins)).cast("int")
    per_bin = scored.groupBy(slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(target).alias("rate"),
        F.sum(F.pow(F.col("p") - F.col(target), F.lit(2.0))).alias("squares"))
    return per_bin.agg(
        F.sum("n").alias("customers"),
        (F.sum("squares") / F.sum("n")).alias("brier"),
        (F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("calibration_error"),
    )


def shift_base_rate(p: Column, fitted_rate: float, current_rate: float) -> Column:
    """Move a probability to another base rate by a constant on the log-odds."""
    k = F.lit(current_rate / (1 - current_rate) * (1 - fitted_rate) / fitted_rate)
    return k * p / (k * p + 1 - p)


def feature_drift(expected: DataFrame, actual: DataFrame, features: Sequence[str], bins: int = 10) -> DataFrame:
    """Population stability index per feature, on quantile bins of the expected snapshot.

    NULLs form a bin of their own; an empty bin counts as a share of one millionth.
    """
    frozen = monitoring.freeze_bins(expected, features, bins)
    return monitoring.drift(monitoring.count_bins(expected, frozen), monitoring.count_bins(actual, frozen))


def segment_fairness(scored: DataFrame, segments: Sequence[str], threshold: float = 0.5, key: str = ID,
                     target: str = TARGET) -> DataFrame:
    """Selection rate, recall and precision per segment level, with each rate's gap to the column's best."""
    cells = scored.unpivot([target, "p"], list(segments), "segment", "level").filter("level is not null")
    flagged, y = F.col("p") >= threshold, F.col(target)
    counts = cells.groupBy("segment", "level").agg(
        F.count(F.lit(1)).alias("customers"), F.count_if(flagged).alias("flagged"),
        F.count_if(y == 1).alias("churners"), F.count_if(flagged & (y == 1)).alias("hits"))
    rates = counts.select(
        "segment", "level", "customers",
        safe_div(F.col("flagged"), F.col("customers")).alias("selection_rate"),
        safe_div(F.col("hits"), F.col("churners")).alias("recall"),
        safe_div(F.col("hits"), F.col("flagged")).alias("precision"))
    best = rates.groupBy("segment").agg(F.max("selection_rate").alias("top_selection"), F.max("recall").alias("top_recall"))
    return rates.join(best, "segment").select(
        "segment", "level", "customers", "selection_rate", "recall", "precision",
        (F.col("top_selection") - F.col("selection_rate")).alias("selection_gap"),
        (F.col("top_recall") - F.col("recall")).alias("recall_gap"))
