"""Fixed-coefficient logistic scores.

They give every scoring, blending, metric and targeting operator a probability column that any
SQL engine reproduces, so those operators can be checked value by value without a fitted model.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.scalars import probability_sql


class Term(NamedTuple):
    feature: str
    center: float
    scale: float
    weight: float


# Our own coefficients: centers and scales near the stand-in data's, weights of plausible sign.
ENGINEERED = (
    Term("eqpdays", 150.0, 150.0, 0.42), Term("months", 45.0, 12.0, -0.31),
    Term("current_to_3m_usage", 1.0, 0.8, -0.24), Term("current_to_lifetime_usage", 1.0, 0.9, -0.18),
    Term("recurring_revenue_share", 1.05, 0.03, 0.14), Term("equipment_age_to_tenure", 0.12, 0.15, 0.13),
    Term("current_to_3m_revenue", 1.0, 0.8, -0.12), Term("hnd_price", 1500.0, 400.0, -0.10),
    Term("totmrc_Mean", 20000.0, 20000.0, 0.09), Term("voice_drop_rate", 0.33, 0.12, 0.08),
    Term("minutes_per_call", 30.0, 40.0, -0.07), Term("call_completion_rate", 0.5, 0.12, -0.06),
    Term("change_mou", 0.0, 70.0, -0.05), Term("customer_care_calls_per_100_calls", 30.0, 25.0, 0.04),
)
HIST = (
    Term("eqpdays", 150.0, 150.0, 0.30), Term("months", 45.0, 12.0, -0.20),
    Term("change_mou", 0.0, 70.0, -0.15), Term("drop_blk_Mean", 0.3, 0.2, 0.10),
    Term("hnd_price", 1500.0, 400.0, -0.08), Term("rev_Mean", 20000.0, 20000.0, 0.05),
)
CAT_D6 = (
    Term("eqpdays", 150.0, 150.0, 0.25), Term("months", 45.0, 12.0, -0.25), Term("models", 15.0, 6.0, -0.10),
    Term("avgmou", 20.0, 12.0, 0.07), Term("totmrc_Mean", 20000.0, 20000.0, 0.06),
)
CAT_D7 = (
    Term("eqpdays", 150.0, 150.0, 0.28), Term("months", 45.0, 12.0, -0.22), Term("uniqsubs", 18.0, 7.0, -0.12),
    Term("avg3rev", 20000.0, 16000.0, -0.08), Term("hnd_price", 1500.0, 400.0, -0.05),
)
CAT_D8 = (
    Term("eqpdays", 150.0, 150.0, 0.33), Term("months", 45.0, 12.0, -0.27), Term("mou_Mean", 15.0, 15.0, -0.16),
    Term("complete_Mean", 0.4, 0.25, -0.09), Term("phones", 20.0, 8.0, 0.06),
)
SCORECARDS = {"hist": HIST, "cat_d6": CAT_D6, "cat_d7": CAT_D7, "cat_d8": CAT_D8, "engineered": ENGINEERED}
INTERCEPT = -0.1


def contribution_sql(term: Term) -> str:
    """Effect of one feature on the log-odds; an unknown value counts as the center."""
    return f"(coalesce({term.feature}, {term.center}D) - {term.center}D) / {term.scale}D * {term.weight}D"


def score_sql(terms: tuple[Term, ...]) -> str:
    """Logistic probability; terms are added left to right."""
    log_odds = " + ".join([f"{INTERCEPT}D", *[contribution_sql(t) for t in terms]])
    return probability_sql(f"1D / (1D + exp(-({log_odds})))")


def add_scores(df: DataFrame, members: dict[str, tuple[Term, ...]] = SCORECARDS) -> DataFrame:
    """One probability column ``p_<member>`` per scorecard."""
    return df.selectExpr("*", *[f"{score_sql(terms)} as p_{name}" for name, terms in members.items()])


def scorecard_importance(df: DataFrame, terms: tuple[Term, ...]) -> DataFrame:
    """Mean absolute effect per input: the gain table of a linear score, in one aggregation."""
    row = df.agg(*[F.expr(f"avg(abs({contribution_sql(t)})) as {t.feature}") for t in terms])
    cells = ", ".join(f"'numeric__{t.feature}', {t.feature}" for t in terms)
    return row.selectExpr(f"stack({len(terms)}, {cells}) as (feature, gain)")
