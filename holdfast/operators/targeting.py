"""Ranked customer lists, capture and lift by campaign size, and scenario value.

``scored`` is a written table with the customer key, the label and a probability ``p``. Only the full list is
sorted; shares of it are found by their cut points (see ``cuts``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.operators.cuts import cut_points, is_inside
from holdfast.operators.ordered import global_rank
from holdfast.schema import ID, TARGET

# Planning assumptions.
PORTFOLIO = 100_000
CONTACT_COST = 15.0
MONTHS_RETAINED = 12
SAVE_RATES = ((10, "10% save rate"), (20, "20% save rate"), (30, "30% save rate"))


def rank_customers(scored: DataFrame, key: str = ID) -> DataFrame:
    """Highest risk first, the key deciding ties: adds ``risk_rank`` from 1."""
    return global_rank(scored, [F.desc("p"), F.asc(key)])


def _in_top(scored: DataFrame, places: int, key: str) -> Column:
    return is_inside(cut_points(scored, [places], "p", key).get(places), "p", key)


def top_share(scored: DataFrame, customers: int, percent: int = 20, key: str = ID) -> DataFrame:
    """The first floor(customers * percent / 100) customers, the key deciding ties; not sorted."""
    return scored.filter(_in_top(scored, customers * percent // 100, key))


def capture_lift_curve(scored: DataFrame, customers: int, steps: int = 20, target: str = TARGET, key: str = ID) -> DataFrame:
    """Capture, churn rate and lift of the top 1/steps, 2/steps, ... of customers.

    Share i holds the first floor(customers * i / steps) customers. A row belongs to the first share whose cut it
    does not pass; one grouping and running sums over ``steps`` rows do the rest.
    """
    places = {i: customers * i // steps for i in range(1, steps)}
    cuts = cut_points(scored, sorted(set(places.values())), "p", key)
    step = F.lit(steps)
    for i in reversed(places):
        step = F.when(is_inside(cuts.get(places[i]), "p", key), F.lit(i)).otherwise(step)
    per_step = scored.groupBy(step.alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("long")).alias("churners"))
    grid = scored.sparkSession.range(1, steps + 1).select(F.col("id").cast("int").alias("step"))
    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # ``steps`` rows
    whole = Window.partitionBy()
    run = grid.join(per_step, "step", "left").na.fill(0, ["n", "churners"]).select(
        "step", F.sum("n").over(upto).alias("targeted"), F.sum("churners").over(upto).alias("reached"),
        F.sum("n").over(whole).alias("all_n"), F.sum("churners").over(whole).alias("all_churners"))
    rate = F.col("reached") / F.nullif(F.col("targeted"), F.lit(0))
    overall = F.col("all_churners") / F.nullif(F.col("all_n"), F.lit(0))
    return run.select(
        (F.col("step") * 100 / F.lit(steps)).cast("int").alias("share_pct"),
        "targeted", "reached",
        (F.col("reached") / F.nullif(F.col("all_churners"), F.lit(0))).alias("churn_capture"),
        rate.alias("target_churn_rate"),
        (rate / F.nullif(overall, F.lit(0.0))).alias("lift"),
    )


def top_summary(scored: DataFrame, customers: int, percent: int = 20, revenue: str = "rev_Mean",
                target: str = TARGET, key: str = ID) -> DataFrame:
    """One row: size, capture, churn rate, lift and mean revenue of the top segment."""
    inside = _in_top(scored, customers * percent // 100, key)
    row = scored.agg(
        F.count_if(inside).alias("targeted"),
        F.sum(F.when(inside, F.col(target).cast("long")).otherwise(0)).alias("reached"),
        F.sum(F.col(target).cast("long")).alias("churners"),
        F.avg(target).alias("overall_rate"),
        F.avg(F.when(inside, F.col(revenue))).alias("mean_revenue"),
    )
    rate = F.col("reached") / F.nullif(F.col("targeted"), F.lit(0))
    return row.select(
        F.lit(percent).alias("share_pct"), "targeted", "reached",
        (F.col("reached") / F.nullif(F.col("churners"), F.lit(0))).alias("churn_capture"),
        rate.alias("target_churn_rate"), "overall_rate",
        (rate / F.nullif(F.col("overall_rate"), F.lit(0.0))).alias("lift"), "mean_revenue",
    )


def impact_scenarios(summary: DataFrame, base_rate: float | None = None, portfolio: int = PORTFOLIO,
                     save_rates: Sequence[tuple[int, str]] = SAVE_RATES, contact_cost: float = CONTACT_COST,
                     months: int = MONTHS_RETAINED) -> DataFrame:
    """Yearly value of contacting the top share, one row per assumed save rate.

    ``summary`` is :func:`top_summary`; ``base_rate`` overrides its overall churn rate.
    """
    rate = F.col("overall_rate") if base_rate is None else F.lit(base_rate)
    scenarios = F.array(*[F.struct(F.lit(pct).alias("save_pct"), F.lit(name).alias("scenario"))
                          for pct, name in save_rates])
    targeted = F.floor(F.lit(portfolio) * F.col("share_pct") / 100)
    reached = F.lit(float(portfolio)) * rate * F.col("churn_capture")
    gross = F.col("reached_churners") * (F.col("save_pct") / 100.0) * F.col("mean_revenue") * F.lit(float(months))
    rows = summary.select(reached.alias("reached_churners"), "mean_revenue",
                          (targeted * F.lit(contact_cost)).alias("campaign_cost"), F.inline(scenarios))
    valued = rows.withColumn("gross_value", gross).withColumn("net_value", F.col("gross_value") - F.col("campaign_cost"))
    return valued.select("scenario", "reached_churners", "gross_value", "campaign_cost", "net_value",
                         (F.col("net_value") / F.col("campaign_cost")).alias("roi"))
