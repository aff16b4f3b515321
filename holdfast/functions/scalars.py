"""Scalar column expressions used across operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = "__MISSING__"

# The markers a CSV cell may use for "no value".
NA_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def ratio_sql(numerator: str, denominator: str, times: float = 1.0, over: float = 1.0) -> str:
    """``numerator / denominator`` as double; NULL when either side is NULL or the divisor is 0."""
    quotient = f"cast({numerator} as double) / nullif(cast({denominator} as double), 0D)"
    if times != 1.0:
        quotient = f"{quotient} * {times}D"
    return f"{quotient} / {over}D" if over != 1.0 else quotient


def finite_sql(column: str) -> str:
    """NaN and both infinities become NULL, so that aggregates are not poisoned.

    NaN sorts above infinity, so one comparison rules out all three.
    """
    return f"case when abs({column}) < double('infinity') then {column} end"


def clean_numeric(df: DataFrame) -> DataFrame:
    """Apply :func:`finite_sql` to every floating column of ``df``."""
    return df.selectExpr(*[
        f"{finite_sql(f'`{f.name}`')} as `{f.name}`" if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else f"`{f.name}`" for f in df.schema])


def half_up_sql(value: str, digits: int) -> str:
    """Round half away from zero on the scaled double; never gives negative zero.

    The same arithmetic is available on any engine, whereas decimal-text rounding is not.
    """
    scale = f"{10 ** digits}D"
    return f"signum({value}) * {_floor_sql(f'abs({value}) * {scale} + 0.5D')} / {scale} + 0D"


def _floor_sql(value: str) -> str:
    """Largest whole number not above a non-negative double, as a double: a long would end at 9.2e18."""
    return f"(({value}) - ({value}) % 1D)"


def probability_sql(value: str) -> str:
    """A probability to nine digits, so that equal scores tie on every engine."""
    return f"floor(({value}) * 1000000000D + 0.5D) / 1000000000D"


def half_up(value: Column, digits: int) -> Column:
    """Column form of :func:`half_up_sql`."""
    scale = F.lit(float(10 ** digits))
    scaled = F.abs(value) * scale + F.lit(0.5)
    return F.signum(value) * (scaled - scaled % F.lit(1.0)) / scale + F.lit(0.0)


def safe_div(numerator: Column, denominator: Column) -> Column:
    """Division for rates: 0 when the denominator is 0."""
    return F.coalesce(numerator / F.nullif(denominator.cast("double"), F.lit(0.0)), F.lit(0.0))


def is_close(left: Column, right: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(left - right) <= F.lit(atol) + F.lit(rtol) * F.abs(right)


def fixed4_sql(value: str) -> str:
    """Value as a whole number of ten-thousandths.

    Sums of these are exact and do not depend on the order rows arrive in, so a retried or
    re-partitioned job gives the same total to the last digit.
    """
    return f"floor(({value}) * 10000D + 0.5D)"


def hash_key(key: Column, seed: int | str) -> Column:
    """Uniform, reproducible ordering key per row: hex digest of ``key|seed``."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def hash_fraction(key: Column, seed: int | str) -> Column:
    """First 32 bits of :func:`hash_key` as a number in [0, 1)."""
    return F.conv(F.substring(hash_key(key, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def na_to_null(value: Column) -> Column:
    return F.when(F.trim(value).isin(*NA_MARKERS), F.lit(None)).otherwise(value)


def fill_category(value: Column, marker: str = MISSING) -> Column:
    return F.coalesce(value.cast("string"), F.lit(marker))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def text_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]


def long_cells(df: DataFrame, keep: Sequence[str], columns: Sequence[str],
               name: str = "feature", value: str = "value") -> DataFrame:
    """Wide to long: one row per (row, column) with the kept columns repeated."""
    return df.unpivot(list(keep), list(columns), name, value)


def title_case(value: Column) -> Column:
    """Words separated by underscores, each run of letters capitalised (``6m`` gives ``6M``)."""
    words = F.split(F.regexp_replace(F.lower(value), "([^a-z]+)", "$1\u0001"), "\u0001")
    return F.replace(F.array_join(F.transform(words, F.initcap), ""), F.lit("_"), F.lit(" "))
