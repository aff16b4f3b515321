"""Customer-level wide table derived from order, line, part and event tables.

``client_table`` holds who the customer is, ``record_table`` what the customer did up to an
observation date plus the churn label; ``subscriber_table`` joins the two one to one.

The activity branches are left joins on unique keys, so a query that uses none of a branch's
columns does not read that branch at all. Every join and grouping is on a high-cardinality key,
sums are integers (see ``fixed4_sql``), and distinct counts reduce pairs first, so one customer,
part or supplier holding a large part of the rows is combined before it is shuffled by that key
alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions.scalars import fixed4_sql
from holdfast.operators.quality import join_one_to_one
from holdfast.schema import ID, TARGET
from holdfast.sources.tables import table

OBSERVED = "2000-01-01"
HORIZON_DAYS = 180
PEAK_ORIGIN = "1995-01-02"

# (output column, window in days, months the window spans, summed measure)
_WINDOW_MEANS = (
    ("rev_Mean", 180, 6.0, "revenue"),
    ("avg3rev", 360, 12.0, "revenue"),
    ("avg6rev", 720, 24.0, "revenue"),
    ("mou_Mean", 180, 6.0, "usage"),
    ("avg3mou", 360, 12.0, "usage"),
    ("avg6mou", 720, 24.0, "usage"),
    ("totmrc_Mean", 180, 6.0, "charge"),
    ("ovrrev_Mean", 180, 6.0, "surcharge"),
    ("ovrmou_Mean", 180, 6.0, "overuse"),
)
_COUNTS = {
    "attempt": "true",
    "complete": "finished",
    "drop_blk": "returned",
    "plcd_vce": "voice",
    "plcd_dat": "not voice",
    "drop_vce": "voice and returned",
    "blck_vce": "voice and accepted",
    "unan_vce": "voice and open",
    "drop_dat": "not voice and returned",
    "blck_dat": "not voice and accepted",
    "unan_dat": "not voice and open",
    "recv_vce": "voice and pending",
    "peak_vce": "voice and peak",
    "opk_vce": "voice and not peak",
}


def client_table(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer")
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    return (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
        .join(region, F.col("n_regionkey") == region.r_regionkey, "left")
        .select(
            F.col("c_custkey").alias(ID),
            F.nullif(F.col("c_mktsegment"), F.lit("HOUSEHOLD")).alias("crclscod"),
            F.col("n_name").alias("area"),
            F.col("r_name").alias("prizm_social_one"),
        )
    )


def _label_and_tenure(orders: DataFrame) -> DataFrame:
    """Per customer: churn label from the horizon, age range and usual priority before it."""
    return (
        orders.groupBy("o_custkey")
        .agg(
            F.expr("max(case when age >= 0 then age end) as oldest"),
            F.expr("min(case when age >= 0 then age end) as newest"),
            F.expr("max(case when age < 0 then 1 else 0 end) as came_back"),
            F.mode(F.expr("case when age >= 0 then o_orderpriority end"), True).alias("asl_flag"),
        )
        .filter("oldest is not null")
        .selectExpr(
            "o_custkey", "asl_flag",
            "greatest(1D, cast(floor(oldest / 30D) as double)) as months",
            "cast(newest as double) as eqpdays",
            f"cast(1 - came_back as int) as {TARGET}",
        )
    )


def _customer_facts(lines: DataFrame) -> DataFrame:
    """Per customer: line counts, lifetime totals and windowed sums of lines with their order's age and part.

    A customer's lines are summed in each task before they are moved, however many there are.
    """
    net = "l_extendedprice * (1D - l_discount)"
    facts = lines.selectExpr(
        "o_custkey", "age", "p_retailprice", "p_size <= 25 as voice",
        "l_returnflag = 'R' as returned", "l_returnflag = 'A' as accepted", "l_returnflag = 'N' as open",
        "l_linestatus = 'F' as finished", "l_linestatus = 'O' as pending",
        f"datediff(l_shipdate, date'{PEAK_ORIGIN}') % 7 < 5 as peak",
        f"{fixed4_sql(net)} as revenue",
        f"{fixed4_sql('l_quantity')} as usage",
        f"{fixed4_sql('l_extendedprice')} as charge",
        f"{fixed4_sql(f'{net} * l_tax')} as surcharge",
        f"{fixed4_sql('greatest(l_quantity - 40D, 0D)')} as overuse",
    )
    return facts.groupBy("o_custkey").agg(
        *[F.expr(f"count_if({condition}) as {name}") for name, condition in _COUNTS.items()],
        *[F.expr(f"sum(case when age <= {days} then {m} else 0 end) as {name}")
          for name, days, _, m in _WINDOW_MEANS],
        F.expr("sum(revenue) as totrev"),
        F.expr("sum(usage) as totmou"),
        F.expr("max(p_retailprice) as hnd_price"),
    )


def _supplier_variety(lines: DataFrame) -> DataFrame:
    """Per customer: distinct suppliers, and those used in the last 720 days.

    Each pair is reduced to one row first; a customer with very many lines is thereby spread
    over as many groups as it has partners before anything is grouped by customer alone.
    """
    return (
        lines.groupBy("o_custkey", "l_suppkey").agg(F.min("age").alias("last_used"))
        .groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("uniqsubs"), F.count_if(F.col("last_used") <= 720).alias("actvsubs"))
    )


def _part_variety(lines: DataFrame, part: DataFrame) -> DataFrame:
    """Per customer: distinct parts and brands, by the same pair reduction."""
    parts = lines.groupBy("o_custkey", "l_partkey").agg(F.lit(1).alias("seen"))
    return (
        parts.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("o_custkey", "p_brand").agg(F.count(F.lit(1)).alias("parts"))
        .groupBy("o_custkey")
        .agg(F.sum("parts").alias("phones"), F.count(F.lit(1)).alias("models"))
    )


def record_table(spark: SparkSession, folder: str, observed: str = OBSERVED,
                 horizon_days: int = HORIZON_DAYS) -> DataFrame:
    day = F.lit(observed).cast("date")
    orders = (
        table(spark, folder, "orders")
        .filter(F.col("o_orderdate") < F.date_add(day, horizon_days + 1).cast("timestamp_ntz"))
        .withColumn("age", F.datediff(day, "o_orderdate"))
    )
    past = orders.filter(F.col("age") >= 0).select("o_orderkey", "o_custkey", "age")
    part = table(spark, folder, "part")
    lineitem = table(spark, folder, "lineitem")
    of_order = F.col("l_orderkey") == F.col("o_orderkey")
    # Orders after the observation date go before anything else is looked up.
    pairs = lineitem.join(past, of_order)
    facts = _customer_facts(pairs.join(part, F.col("l_partkey") == F.col("p_partkey")))
    care = (
        table(spark, folder, "events")
        .filter(F.col("event_type") == "error")
        .groupBy("user_id")
        .agg(F.expr("count(1) as care_calls"), F.expr(f"sum({fixed4_sql('value')}) as care_value"))
    )
    joined = (
        _label_and_tenure(orders)
        .join(facts, "o_custkey", "left")
        .join(_supplier_variety(pairs), "o_custkey", "left")
        .join(_part_variety(pairs, part), "o_custkey", "left")
        .join(care, F.col("o_custkey") == F.col("user_id"), "left")
    )
    windows = [f"coalesce({n}, 0) / 10000D / {span}D as {n}" for n, _, span, _ in _WINDOW_MEANS]
    rates = [f"coalesce({c}, 0) / months as {c}_Mean" for c in _COUNTS]
    plain = joined.selectExpr(
        f"o_custkey as {ID}", *windows, *rates,
        "coalesce(totrev, 0) / 10000D / months as avgrev",
        "coalesce(totmou, 0) / 10000D / months as avgmou",
        "coalesce(totrev, 0) / 10000D as totrev",
        "coalesce(totmou, 0) / 10000D as totmou",
        "cast(coalesce(attempt, 0) as double) as totcalls",
        "care_calls / months as custcare_Mean",
        "care_value / 10000D / months as cc_mou_Mean",
        *[f"cast(coalesce({c}, 0) as double) as {c}" for c in ("uniqsubs", "actvsubs", "phones", "models")],
        "cast(hnd_price as double) as hnd_price",
        "months", "eqpdays", "asl_flag", TARGET,
    )
    return plain.selectExpr("*", "(mou_Mean - avg3mou) / nullif(avg3mou, 0D) * 100D as change_mou")


def subscriber_table(spark: SparkSession, folder: str, observed: str = OBSERVED) -> DataFrame:
    return join_one_to_one(record_table(spark, folder, observed), client_table(spark, folder))
