"""Exact quantiles of many columns without gathering a column's values in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.operators.ordered import running_sums

_BRACKET_ERROR = 1e-3


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float],
                    ) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column, NULLs ignored; ``None`` for an empty column.

    A one-pass sketch brackets each wanted rank; a second pass counts what lies below each
    bracket and groups only the values inside it. The result is exact because the rank is checked
    against those counts; a bracket that missed is widened to the whole column.
    ``df`` is read two or three times, so pass a written table.
    """
    columns = list(columns)
    if not columns:
        return {}
    counts = df.agg(*[F.expr(f"count(`{c}`) as `{c}`") for c in columns]).first().asDict()
    filled = [c for c in columns if counts[c] > 0]
    targets = {}  # (column, probability index) -> (low rank, high rank, weight), ranks from 0
    for c in filled:
        for i, p in enumerate(probabilities):
            position = p * (counts[c] - 1)
            low = math.floor(position)
            targets[c, i] = (low, math.ceil(position), position - low)
    brackets = {}
    wide = 2 * _BRACKET_ERROR
    wanted = [q for p in probabilities for q in (max(p - wide, 0.0), min(p + wide, 1.0))]
    for c, cuts in zip(filled, df.approxQuantile(filled, wanted, _BRACKET_ERROR) if filled else []):
        for i, p in enumerate(probabilities):
            brackets[c, i] = (cuts[2 * i] if p > wide else -math.inf,
                              cuts[2 * i + 1] if p < 1 - wide else math.inf)
    found = _select_ranks(df, targets, brackets)
    missed = {k: t for k, t in targets.items() if (k, t[0]) not in found or (k, t[1]) not in found}
    if missed:
        found.update(_select_ranks(df, missed, {k: (-math.inf, math.inf) for k in missed}))
    result: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    for (c, i), (low, high, weight) in targets.items():
        a, b = found[(c, i), low], found[(c, i), high]
        result[c][i] = a + (b - a) * weight
    return result


def _select_ranks(df: DataFrame, targets: dict, brackets: dict) -> dict:
    """Value at each wanted rank: ``{((column, i), rank): value}`` for the ranks inside a bracket."""
    spans: dict[tuple, list] = {}  # distinct (column, bracket) -> the targets it serves
    for key in targets:
        spans.setdefault((key[0], *brackets[key]), []).append(key)
    span_list = list(spans)
    lower = {s: f"`{c}` < {lo!r}D" for s, (c, lo, _) in enumerate(span_list) if lo > -math.inf}
    below = dict.fromkeys(range(len(span_list)), 0)
    if lower:
        row = df.agg(*[F.expr(f"count_if({test}) as b{s}") for s, test in lower.items()]).first()
        below.update({s: row[f"b{s}"] for s in lower})

    def cell(s: int, column: str, lo: float, hi: float) -> str:
        tests = [f"`{column}` >= {lo!r}D"] * (lo > -math.inf) + [f"`{column}` <= {hi!r}D"] * (hi < math.inf)
        value = f"cast(`{column}` as double)"
        if tests:
            value = f"case when {' and '.join(tests)} then {value} end"
        return f"named_struct('span', {s}, 'value', {value})"

    cells = ", ".join(cell(s, *span) for s, span in enumerate(span_list))
    values = (
        df.selectExpr(f"inline(array({cells}))").filter("value is not null")
        .groupBy("span", "value").agg(F.expr("count(1) as n"))
    )
    ranked = running_sums(values, [F.col("value")], {"through": "n"}, group=["span"])
    ranks = []  # per span, the wanted ranks counted from the start of its bracket
    for s, span in enumerate(span_list):
        wanted = sorted({rank - below[s] for key in spans[span] for rank in targets[key][:2]})
        ranks.append(f"array({', '.join(f'{r}L' for r in wanted)})")
    served = f"filter(element_at(array({', '.join(ranks)}), span + 1), r -> through > r and through - n <= r)"
    found = {}
    for row in ranked.selectExpr("span", "value", f"{served} as served").filter("size(served) > 0").collect():
        for key in spans[span_list[row.span]]:  # at most one row per wanted rank
            for rank in row.served:
                found[key, rank + below[row.span]] = row.value
    return found
