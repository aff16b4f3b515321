"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. A document's expected number of copies is the ratio of its source's
target to its source's size; the whole part of it is allocated to every document for certain, the rest
``p`` is its inclusion probability, which differs between sources. Within a source documents are ranked
by random odds over inclusion odds, ``(u / (1 - u)) / (p / (1 - p))`` with ``u`` a uniform number made from
the document's id, and taken in this order up to the point nearest to the words that are left to take.

The place where the ranking is cut is found without sorting a source: the words of 256 ranges of the rank
find the range that holds the cut, 256 ranges of that one find it more closely, and only the documents in
that last range, about one in 65,536, are ordered. The result is one row per source; whether a document is
drawn then follows from its own rank, so documents are not moved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.common import word_count
from holdfast.operators.ordered import global_rank
from holdfast.session import durable

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = "mix"
_RANGES = 256


def uniform(identity: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of seed and id; NULL ids share one number."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def pareto_rank(u: Column, p: Column) -> Column:
    """Odds of ``u`` over odds of ``p``, mapped to (0, 1) without changing the order; NULL where p = 0."""
    return F.when(p > 0, (u * (1 - p)) / (u * (1 - p) + p * (1 - u)))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   cap: float = CAP) -> DataFrame:
    """Add ``target`` to one row per source (``source``, ``source_size``).

    Weights repeat over the sources by code point order, NULL last. A target is at most ``cap`` times the
    source's size; what is above goes to the others by weight until none is above.
    """
    ranked = global_rank(sizes, [F.col("source").isNull(), F.col("source")], "_rank")
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = durable(ranked.withColumn("_weight", F.get(listed, ((F.col("_rank") - 1) % len(weights)).cast("int"))).drop("_rank"))
    above, before = F.lit(False), None
    while True:
        total, held, weight = ranked.agg(
            F.sum("source_size"), F.sum(F.when(above, F.col("source_size"))), F.sum(F.when(~above, F.col("_weight")))).first()
        rest = share * (total or 0) - cap * (held or 0)
        if (held, weight) == before or not weight:
            break
        before = held, weight
        above = F.col("_weight") * F.lit(rest) > cap * F.col("source_size") * F.lit(weight)
    part = F.col("_weight") * F.lit(rest) / F.lit(weight) if weight else F.lit(None).cast("double")
    return ranked.withColumn("target", F.when(above, cap * F.col("source_size")).otherwise(part)).drop("_weight")


def _cut(parts: DataFrame, place: str) -> DataFrame:
    """For each source the first range (column ``place``) whose words run beyond ``rest``, and what is
    left for it. ``parts``: source, rest, place, words; at most ``_RANGES`` rows for a source."""
    order = Window.partitionBy("source").orderBy(place)
    run = parts.withColumn("_run", F.sum("words").over(order)).where(F.col("_run") > F.col("rest"))
    first = run.groupBy("source").agg(F.min_by(F.struct(place, (F.col("rest") - F.col("_run") + F.col("words")).alias("rest")), place).alias("c"))
    return first.select("source", f"c.{place}", "c.rest")


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``target``, ``whole`` (certain copies), ``p`` and
    the rank (``cut_rank``, ``cut_id``) of the last document drawn, NULL if none is."""
    rows = docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("doc_id"),
                       word_count(F.col(text_col)).alias("size"))
    # Rows with equal ids are drawn together.
    rows = durable(rows.groupBy("source", "doc_id").agg(F.sum("size").alias("size")).withColumn("u", uniform(F.col("doc_id"), seed)))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = source_targets(sizes, weights, share, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goals = durable(goals.withColumn("whole", F.floor(ratio)).withColumn("p", ratio - F.col("whole"))
                    .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    goal, row = goals.alias("g"), rows.alias("r")
    ranked = row.join(goal, F.col("r.source").eqNullSafe(F.col("g.source"))).select(
        "r.source", "r.doc_id", "r.size", "g.rest", pareto_rank(F.col("r.u"), F.col("g.p")).alias("rank")).where("rank is not null")
    ranked = ranked.withColumn("coarse", F.floor(F.col("rank") * _RANGES)).withColumn(
        "fine", F.floor(F.col("rank") * _RANGES * _RANGES))
    coarse = _cut(ranked.groupBy("source", "rest", "coarse").agg(F.sum("size").alias("words")), "coarse")
    inside = _join_source(ranked.drop("rest"), coarse, "coarse")
    fine = _cut(inside.groupBy("source", "rest", "fine").agg(F.sum("size").alias("words")), "fine")
    inside = _join_source(ranked.drop("rest"), fine, "fine")
    run = Window.partitionBy("source").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    drawn = inside.withColumn("_run", F.sum("size").over(run)).where(F.col("_run") - F.col("size") / 2 <= F.col("rest"))
    last = drawn.groupBy("source").agg(F.max(F.struct("rank", "doc_id")).alias("last"))
    # Without a document drawn in the cut range, all before that range are.
    ends = _left(_left(goals, fine.select("source", "fine"), "source"), last, "source")
    at_range = F.when(F.col("fine").isNotNull(), F.col("fine") / float(_RANGES * _RANGES)).otherwise(2.0)
    return ends.select("source", "source_size", "target", "whole", "p",
                       F.when(F.col("p") > 0, F.coalesce("last.rank", at_range)).alias("cut_rank"), F.col("last.doc_id").alias("cut_id"))


def _join_source(rows: DataFrame, cuts: DataFrame, place: str) -> DataFrame:
    a, b = rows.alias("a"), cuts.alias("b")
    same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col(f"a.{place}") == F.col(f"b.{place}"))
    return a.join(b, same).select("a.*", "b.rest")


def _left(rows: DataFrame, more: DataFrame, key: str) -> DataFrame:
    a, b = rows.alias("a"), more.alias("b")
    added = [F.col(f"b.{c}") for c in more.columns if c != key]
    return a.join(b, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "left").select("a.*", *added)


def with_copies(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` as struct ``row`` with their source's plan and ``copies`` (int, 0 to the cap)."""
    a = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).alias("a")
    b = plan.alias("b")
    identity = F.col(f"a.row.`{id_col}`")
    joined = a.join(b, F.col(f"a.row.`{source_col}`").eqNullSafe(F.col("b.source"))).withColumn(
        "rank", pareto_rank(uniform(identity, seed), F.col("b.p")))
    # NULL ids come first among equal ranks, as they do in the ordering that placed the cut.
    tie = (F.col("rank") == F.col("cut_rank")) & F.col("cut_rank").isNotNull() & (
        identity.isNull() | F.coalesce(identity <= F.col("cut_id"), F.lit(False)))
    drawn = F.coalesce((F.col("rank") < F.col("cut_rank")) | tie, F.lit(False))
    return joined.withColumn("copies", (F.col("whole") + drawn.cast("int")).cast("int")).drop("rank")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; same columns.

    NULL texts and texts without words have size 0. NULL is a source like any other. A source without
    words has target 0 and gives nothing. Rows with equal ids in a source are drawn together. An empty
    table gives an empty table. Equal input gives equal output.
    """
    plan = durable(plan_mix(docs, id_col, text_col, source_col, **options))
    taken = with_copies(docs, plan, id_col, source_col, options.get("seed", SEED)).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("_copy")).select("row.*")


def taken_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies``
    and ``taken`` (size times copies). Defined as in ``mix``; rows that are not taken are included."""
    plan = durable(plan_mix(docs, id_col, text_col, source_col, **options))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    marked = with_copies(rows, plan, seed=options.get("seed", SEED))
    return marked.select("row.*", "source_size", "target", "copies", (F.col("row.size") * F.col("copies")).alias("taken"))


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
         sum(source_size) OVER () AS total
  FROM sources),
filled AS (
  SELECT *, coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
         sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM weighed),
level AS (
  SELECT (1.5 * total - 2.0 * held)::DOUBLE AS rest, open::DOUBLE AS open FROM filled
  WHERE w * (1.5 * total - 2.0 * held)::DOUBLE <= 2.0 * source_size::DOUBLE * open ORDER BY held, open DESC LIMIT 1),
goals AS (
  SELECT source, source_size, CASE WHEN w * l.rest > 2.0 * source_size::DOUBLE * l.open THEN 2.0 * source_size::DOUBLE
                                   ELSE w::DOUBLE * l.rest / l.open END AS target
  FROM filled, level l),
shares AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0 END AS ratio FROM goals),
ranked AS (
  SELECT d.doc_id, d.size, s.source, s.source_size, s.target, floor(ratio) AS whole, ratio - floor(ratio) AS p, u,
         s.target - floor(ratio) * s.source_size AS rest
  FROM sized d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source),
run AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY (u * (1 - p)) / (u * (1 - p) + p * (1 - u)), doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS words
  FROM ranked)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (whole + CASE WHEN p > 0 AND words - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
"""
