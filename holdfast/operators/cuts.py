"""The rows at given places of a global order, found by counting instead of sorting.

An interval of values that holds a wanted place is cut into ``WAYS`` parts; one grouping counts all parts and their
least and greatest values, and the part that holds the place is the next interval. Values that many rows share end
the search at once, because a part shrinks to the values present. What reaches the driver is one row for each part.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WAYS = 1024


class Cut(NamedTuple):
    """The last row inside: its score and, where rows with that score are outside, its key."""

    score: float
    key: object | None


def values_at(df: DataFrame, column: str, ranks: Iterable[int]) -> dict[int, tuple[object, int]]:
    """For each rank (from 1, ascending, without NULLs): the value there and the rows with smaller values.

    Numbers and texts; doubles must be finite. A rank beyond the rows is left out.
    """
    rows = df.select(F.col(column).alias("_x")).where("_x is not null")
    kind = rows.schema["_x"].dataType
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("low"), F.max("_x").alias("high")).first()
    wanted = sorted({r for r in ranks if 0 < r <= whole["n"]})
    found: dict[int, tuple[object, int]] = {}
    spans = {(whole["low"], whole["high"]): (0, wanted)} if wanted else {}
    while spans:
        for (low, high), (before, inside) in list(spans.items()):
            if low == high:
                found.update({r: (low, before) for r in inside})
                del spans[low, high]
        if not spans:
            break
        listed = list(spans)
        part = F.lit(None)
        for i, (low, high) in enumerate(listed):
            within = (F.col("_x") >= F.lit(low)) & (F.col("_x") <= F.lit(high))
            part = F.when(within, F.struct(F.lit(i).alias("span"), _part(kind, low, high).alias("part"))).otherwise(part)
        counted = rows.select("_x", part.alias("_p")).where("_p is not null").groupBy("_p.span", "_p.part").agg(
            F.count(F.lit(1)).alias("n"), F.min("_x").alias("low"), F.max("_x").alias("high")).collect()
        narrower: dict[tuple, tuple[int, list[int]]] = {}
        upto = {i: spans[s][0] for i, s in enumerate(listed)}
        for row in sorted(counted, key=lambda r: (r["span"], r["low"])):
            before = upto[row["span"]]
            upto[row["span"]] += row["n"]
            inside = [r for r in spans[listed[row["span"]]][1] if before < r <= upto[row["span"]]]
            if inside:
                narrower[row["low"], row["high"]] = (before, inside)
        spans = narrower
    return found


def _part(kind: T.DataType, low, high) -> Column:
    """Number of the part of an interval, growing with the value."""
    if isinstance(kind, T.StringType):
        same = len(os.path.commonprefix([low, high]))
        return F.substring("_x", 1, same + 1)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        step = (high - low) / WAYS
        if low + step <= low or high - step >= high:  # hardly more doubles than parts are left
            return F.col("_x").cast("string")
        return F.floor((F.col("_x") - F.lit(low)) / F.lit(step)).cast("string")
    step = (int(high) - int(low)) // WAYS + 1
    return F.expr(f"cast((cast(_x as decimal(20, 0)) - {int(low)}) div {step} as string)")


def cut_points(scored: DataFrame, places: Sequence[int], score: str, key: str) -> dict[int, Cut]:
    """For each place (from 1) of the order by falling ``score``, then rising ``key``: the row there.

    ``scored`` is a written table with unique keys.
    """
    falling = values_at(scored.select((-F.col(score)).alias("_s")), "_s", places)
    values = {place: (-value, before) for place, (value, before) in falling.items()}
    scores = sorted({v for v, _ in values.values()})
    if not scores:
        return {}
    equal = scored.agg(*[F.count_if(F.col(score) == F.lit(v)).alias(f"n{i}") for i, v in enumerate(scores)]).first()
    ties = {v: equal[f"n{i}"] for i, v in enumerate(scores)}
    cuts = {}
    for v in scores:
        split = {place: place - before for place, (value, before) in values.items() if value == v}
        some = [rank for rank in split.values() if rank < ties[v]]
        keys = values_at(scored.where(F.col(score) == F.lit(v)), key, some) if some else {}
        cuts.update({place: Cut(v, keys[rank][0] if rank in keys else None) for place, rank in split.items()})
    return cuts


def is_inside(cut: Cut | None, score: str, key: str) -> Column:
    """Whether a row stands at or before the cut; no row does if there is none."""
    if cut is None:
        return F.lit(False)
    above, level = F.col(score) > F.lit(cut.score), F.col(score) == F.lit(cut.score)
    return above | (level if cut.key is None else level & (F.col(key) <= F.lit(cut.key)))
