"""Quality rules and a hashed n-gram verdict, in DataFrame functions only.

Rules look at each whole text: too few words, or too many words in repeated three-word windows. The
verdict compares two multinomials over hashed features (words and pairs of neighbouring words
in ``BUCKETS`` buckets): one of trusted documents, one of the whole raw corpus. A document's score is its
mean log-likelihood ratio per feature; a document scoring below the threshold is rejected. The
threshold is derived from the trusted documents alone and applied to every document alike.

Corpus and trusted documents are counted in full. A caller may bound the trusted side of the counts to the
labelled rows with the smallest hashes of their ids. Texts stay where they are: trusted ids reach them as bits
of a hashed bitmap, and the few other ids that share a bit are found by a join of ids alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm.common import let, words
from holdfast.session import durable

BUCKETS = 1 << 14
MIN_WORDS = 50
#: A document may score this many standard deviations of the trusted scores below their mean.
SPREADS = 8.0
SYMBOLS = "[^#*$%&|<>]+"
#: Bits of the bitmap of trusted ids for each of them; of the other ids about one in as many shares a bit.
BITS_PER_ID = 32
#: Bits in a row of the bitmap (Spark's bitmaps are 4 kB), and most rows it has (32 MB); beyond, more ids share bits.
ROW_BITS, BITMAP_ROWS = 8 * 4096, 8192
#: Types whose equal values have equal hashes; ids of others are joined to the texts.
_HASHED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


def _lines_twice(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def _words_repeated(hashes: Column) -> Column:
    """Words that lie in a three-word window found at least twice, by the words' 64-bit hashes."""
    windows = F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - 2, F.lit(0))),
                          lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)))
    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), _covered(w)).otherwise(0))


def _covered(windows: Column) -> Column:
    """Places covered by repeated windows: each repeated start covers up to the next one, three at most."""
    placed = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    again = let(placed, lambda p: F.sort_array(F.transform(
        F.filter(p, lambda x, k: (F.get(p, k - 1)["w"].eqNullSafe(x["w"])) | (F.get(p, k + 1)["w"].eqNullSafe(x["w"]))), lambda x: x["i"])))
    steps = let(again, lambda a: F.transform(a, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(a, k + 1) - x, F.lit(3)))))
    return F.aggregate(steps, F.lit(0), lambda total, x: total + x)


def _word_hashes(listed: Column) -> Column:
    return F.transform(listed, lambda w: F.xxhash64(w))


def _buckets(hashes: Column, buckets: int) -> Column:
    """Bucket of every word and of every pair of neighbouring words."""
    firsts = F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0)))
    pairs = F.transform(firsts, lambda h, i: F.pmod(F.xxhash64(h, F.get(hashes, i + 1)), F.lit(buckets)))
    return F.concat(F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets))), pairs)


def _score(hashes: Column, table: Column, buckets: int) -> Column:
    return let(_buckets(hashes, buckets), lambda found: F.try_divide(
        F.aggregate(found, F.lit(0.0), lambda total, b: total + F.get(table, b.cast("int"))), F.size(found)))


def measured(docs: DataFrame, table: list[float] | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) as struct ``row`` and their figures as struct ``rules``: ``n_words``,
    ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed`` and ``score``.

    ``score`` is NULL for a text without words. Every text is split and hashed once.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]).alias("row")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # One constant that the optimizer folds, instead of an expression for each number.
    listed = F.split(F.lit(",".join(map(repr, table or [0.0]))), ",").cast("array<double>")

    def figures(w: Column) -> Column:
        return let(listed, lambda t: let(_word_hashes(w), lambda h: F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _words_repeated(h).cast("long").alias("n_repeat_words"), _score(h, t, len(table or [0.0])).alias("score"))))

    found = docs.select(row, let(words(text), figures).alias("f"),
                        F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
                        _lines_twice(text).cast("long").alias("n_dup_lines"))
    failed = (F.col("f.n_words") < MIN_WORDS) | (100 * F.col("f.n_repeat_words") > 50 * F.col("f.n_words"))
    return found.select("row", F.struct("f.n_words", "f.word_chars", "n_symbols", "n_dup_lines", "f.n_repeat_words",
                                        failed.alias("base_failed"), "f.score").alias("rules"))


def _counts(docs: DataFrame, text_col: str, buckets: int) -> DataFrame:
    return docs.select(F.explode(let(_word_hashes(words(F.col(text_col))), lambda h: _buckets(h, buckets))).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def trusted_sample(docs: DataFrame, trusted: DataFrame, id_col: str, rows: int | None = None) -> DataFrame:
    """The rows of ``docs`` whose id is a trusted one (``doc_id``); with ``rows``, among the ``rows`` trusted ids of
    smallest hash that ``docs`` has."""
    ids = trusted.select("doc_id")
    if rows is not None:
        known = docs.select(F.col(f"`{id_col}`").alias("doc_id"))
        ids = durable(ids.distinct().join(known, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    kind = ids.schema["doc_id"].dataType
    if kind != docs.schema[id_col].dataType or not (isinstance(kind, _HASHED) or kind == T.StringType()):
        return docs.join(ids.withColumnRenamed("doc_id", "_trusted_id"), F.col(f"`{id_col}`") == F.col("_trusted_id"), "left_semi")
    return _with_ids(docs, ids, id_col)


def _slot(key: Column, rows: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(rows * ROW_BITS))


def _with_ids(docs: DataFrame, ids: DataFrame, id_col: str, bitmap_rows: int = BITMAP_ROWS) -> DataFrame:
    """The rows of ``docs`` whose id is among ``ids`` (``doc_id``, of the same type), without moving other columns.

    A bitmap of the hashed ids is broadcast, at most ``bitmap_rows`` rows. Ids of ``docs`` that share a bit with one of
    ``ids`` without being one are listed and left out; where they are too many to broadcast, that join moves the rows
    that have a bit.
    """
    known = durable(ids.where("doc_id is not null").distinct())
    rows = min(max(math.ceil(known.count() * BITS_PER_ID / ROW_BITS), 1), bitmap_rows)
    slot = _slot(F.col("doc_id"), rows)
    bitmap = F.broadcast(durable(known.groupBy(F.floor(slot / ROW_BITS).alias("_cell")).agg(
        F.bitmap_construct_agg(F.pmod(slot, F.lit(ROW_BITS))).alias("_bits"))))

    def marked(frame: DataFrame) -> DataFrame:
        own = _slot(F.col(f"`{id_col}`"), rows)
        at = F.pmod(own, F.lit(ROW_BITS)).cast("int")
        octet = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
        with_bits = frame.where(F.col(f"`{id_col}`").isNotNull()).join(bitmap, F.floor(own / ROW_BITS) == F.col("_cell"))
        return with_bits.where(F.getbit(octet, F.pmod(at, F.lit(8))) == 1).select(*[F.col(f"`{c}`") for c in frame.columns])

    candidates = marked(docs.select(F.col(f"`{id_col}`"))).select(F.col(f"`{id_col}`").alias("_other")).distinct()
    others = durable(candidates.join(known, F.col("_other") == F.col("doc_id"), "left_anti"))
    return marked(docs).join(others, F.col(f"`{id_col}`") == F.col("_other"), "left_anti")


def ratios(corpus: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> list[float]:
    """For each bucket the logarithm of its smoothed share among the target's features over that among the
    corpus's, to six digits. As many numbers as buckets, whatever the corpus."""
    raw = _counts(corpus, text_col, buckets).withColumnRenamed("n", "raw")
    good = _counts(target, text_col, buckets).withColumnRenamed("n", "good")
    space = corpus.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = durable(space.join(raw, "bucket", "left").join(good, "bucket", "left").fillna(0, ["raw", "good"]))
    sums = both.agg(F.sum("raw").alias("raws"), F.sum("good").alias("goods")).first()
    ratio = F.log((F.col("good") + 1) / (sums["goods"] + buckets)) - F.log((F.col("raw") + 1) / (sums["raws"] + buckets))
    return [r["r"] for r in both.orderBy("bucket").select(F.round(ratio, 6).alias("r")).collect()]


def threshold(scored: DataFrame, trusted: DataFrame, id_col: str = "doc_id", spreads: float = SPREADS) -> float:
    """``spreads`` standard deviations below the mean score of all rows of ``scored`` (see ``measured``) that pass
    the rules and whose id is among ``trusted``; minus infinity if there are none."""
    passed = scored.where("not rules.base_failed").select(F.col(f"row.`{id_col}`").alias("doc_id"), "rules.score")
    got = passed.join(trusted.select("doc_id").distinct(), "doc_id", "left_semi").agg(
        F.avg("score").alias("m"), F.stddev_pop("score").alias("d")).first()
    return float("-inf") if got["m"] is None else got["m"] - spreads * got["d"]


def rate(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         trusted_rows: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default; the id among them) as struct ``row``, with ``rules``
    (see ``measured``) and ``kept``.

    ``trusted`` has the ids (``doc_id``) of trusted documents; ids that ``docs`` does not have count for
    nothing. NULL and empty texts have no words and fail the rules. Without any trusted document all
    documents that pass the rules are kept. All trusted documents are counted unless ``trusted_rows`` bounds
    them. Rows with equal ids are rated one by one. An empty table gives
    no rows.
    """
    target = trusted_sample(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([id_col, text_col])]), trusted, id_col, trusted_rows)
    # Written: every text is scored once, then its score is read for the threshold and for the verdict.
    scored = durable(measured(docs, ratios(docs, target, text_col), text_col, keep))
    verdict = F.coalesce(F.col("rules.score") >= threshold(scored, trusted, id_col), F.lit(False))
    return scored.withColumn("kept", ~F.col("rules.base_failed") & verdict)
