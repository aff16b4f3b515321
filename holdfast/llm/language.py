"""Language identification by interpolated Kneser-Ney character models.

A text is lower-cased and written as a sequence of symbols: the UTF-16 code units of each letter (one, or
two from U+10000 on) and 0 for each run of anything else. Every language has a model of
``ORDER`` symbols. Its highest order uses counts, the lower ones the number of different symbols that
precede a gram, all with absolute discounting. All n-grams of all labelled documents are counted.

The models lie side by side in arrays sorted by the gram itself, which is 64 bits, one row of ``float32``
for all languages; no two grams share a row. Models whose highest order has more than ``CELLS`` cells (grams
times languages) are not collected: they stay tables, and the grams of the documents are
joined to them, with the same results. A document's language is that of the lowest cross-entropy per symbol. Documents whose number ``fold`` is 1 take no part in the
counts; they set the sharpness of the score and the cross-entropy beyond which a text is rejected, a fixed
quantile of theirs (see ``QUANTILE``), so that single odd documents do not set it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import begin, map_texts, slices
from holdfast.llm.lookup import KeyTable
from holdfast.session import durable

ORDER = 4
BITS = 16
SYMBOLS = 1 << BITS
#: Cells of the highest order (no other order has more) up to which workers hold the models as arrays.
CELLS = 1 << 22
FOLDS = 5
#: Of each language's rightly predicted calibration documents the share ``QUANTILE`` with the smallest
#: excesses over the mean, in spreads, sets mean and spread; of three or more at least one is left out. A text
#: is rejected beyond ``MARGIN`` times the largest excess among them, or beyond ``SPREADS`` if that is more.
QUANTILE = 0.99
MARGIN = 1.5
SPREADS = 8.0
SHARPNESS = tuple(float(2**k) for k in range(-1, 10))
GRAMS_HELD = 1 << 18


def fold(identity: Column) -> Column:
    """0 to 4 from the CRC-32 of the id as text; 0 is held out. NULL for a NULL id."""
    return (F.crc32(identity.cast("string").cast("binary")) % FOLDS).cast("int")


class Symbols:
    """Texts as symbol sequences."""

    def __init__(self):
        self.letter = np.full(0x110000, -1, np.int8)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts, each beginning with a 0, and the place where each text begins."""
        listed = [t.decode("utf-8", "replace").lower() for t in texts]
        joined = "\0" + "\0\0".join([*listed, ""]) if listed else ""
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        letter = self.letter[points]
        if (new := letter < 0).any():
            for p in np.unique(points[new]).tolist():
                self.letter[p] = chr(p).isalpha()
            letter = self.letter[points]
        symbols = np.where(letter > 0, points, np.uint32(0))
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] > 0) | (symbols[:-1] > 0)
        begins = np.cumsum([0, *(len(t) + 2 for t in listed)])[:-1]
        keep[begins] = True
        place = (np.cumsum(keep) - 1)[begins]
        symbols = symbols[keep]
        if (long := symbols >= SYMBOLS).any():
            ends = np.cumsum(1 + long)
            place = (ends - 1 - long)[place]
            low = ends[long] - 1
            over = symbols[long] - np.uint32(SYMBOLS)
            symbols = np.repeat(symbols, 1 + long)
            symbols[low - 1], symbols[low] = 0xD800 + (over >> 10), 0xDC00 + (over & 0x3FF)
        return symbols.astype(np.uint64), place

    def grams(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The gram that ends at each symbol after a text's first, its text's number, and its rank in it.

        Histories at a text's beginning are filled with 0.
        """
        symbols, begins = self.of(texts)
        ends = np.concatenate([begins[1:], [len(symbols)]]) if len(begins) else begins
        owner = np.repeat(np.arange(len(texts)), ends - begins)
        at = np.arange(len(symbols)) - begins[owner] if len(symbols) else np.zeros(0, np.int64)
        gram = symbols.copy()
        for k in range(1, ORDER):
            back = np.concatenate([np.zeros(k, np.uint64), symbols[:-k]])[: len(symbols)]
            gram |= np.where(at >= k, back, np.uint64(0)) << np.uint64(BITS * k)
        after = at > 0
        return gram[after], owner[after], begins


def count_grams(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(``lang``, ``gram``, ``n``): how often each gram of ``ORDER`` symbols occurs in each language."""
    source = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(__name__)
        symbols = Symbols()
        held: dict[str, tuple[KeyTable, np.ndarray, np.ndarray]] = {}

        def emit() -> pa.RecordBatch:
            keys = np.concatenate([np.zeros(0, np.uint64), *(k for _, k, _ in held.values())])
            counts = np.concatenate([np.zeros(0, np.int64), *(c for _, _, c in held.values())])
            lang = np.repeat(np.array(list(held), object), [len(k) for _, k, _ in held.values()]) if held else []
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

        for batch in batches:
            for part in slices(batch, "t"):
                names, lang = np.unique(np.array(part.column("lang").to_pylist(), object), return_inverse=True)
                gram, owner, _ = symbols.grams([x or b"" for x in part.column("t").to_pylist()])
                for i, name in enumerate(names.tolist()):
                    own = gram[lang[owner] == i]
                    table, keys, counts = held.get(name) or (KeyTable(10), np.zeros(0, np.uint64), np.zeros(0, np.int64))
                    at = table.find(own)
                    new = np.unique(own[at < 0])
                    if len(new):
                        table.add(new, np.arange(len(keys), len(keys) + len(new)))
                        keys = np.concatenate([keys, new])
                        at = table.find(own)
                    held[name] = table, keys, np.pad(counts, (0, len(new))) + np.bincount(at, minlength=len(keys))
                if sum(len(k) for _, k, _ in held.values()) > GRAMS_HELD:
                    yield emit()
        yield emit()

    return source.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Sorted arrays of all languages. ``probs[k]``: discounted probabilities of grams of ``k + 1``
    symbols; ``backs[k]``: weight of the next lower order after a history of ``k + 1`` symbols. With
    ``joined`` both are tables (see ``_rows``) instead of arrays."""

    languages: list[str]
    probs: list[tuple[np.ndarray, np.ndarray]] | list[DataFrame]
    backs: list[tuple[np.ndarray, np.ndarray]] | list[DataFrame]
    base: np.ndarray
    joined: bool = False
    sharpness: float = 1.0
    #: By language: mean cross-entropy, its variance as a + b / symbols, spreads above the mean allowed.
    limits: dict[int, tuple[float, float, float, float]] = field(default_factory=dict)

    def scorer(self) -> "_Scorer":
        """The scorer of a worker process, kept from task to task."""
        if not hasattr(self, "_kept"):
            self._kept = _Scorer(self)
        return self._kept

    def _find(self, table: tuple[np.ndarray, np.ndarray], grams: np.ndarray, missing: float) -> np.ndarray:
        keys, rows = table
        out = np.full((len(grams), len(self.languages)), missing, np.float64)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            hit = keys[at] == grams
            out[hit] = rows[at[hit]]
        return out

    def log_probs(self, grams: np.ndarray) -> np.ndarray:
        """Natural logarithm of each gram's last symbol after its history, for every language."""
        p = np.repeat(self.base[None, :], len(grams), axis=0)
        for k in range(ORDER):
            gram = grams & np.uint64((1 << BITS * (k + 1)) - 1)
            if k:
                p *= self._find(self.backs[k - 1], gram >> np.uint64(BITS), 1.0)
            p += self._find(self.probs[k], gram, 0.0)
        return np.log(p)


def _numbers(languages: list[str], lang_col: str = "lang") -> Column:
    return F.create_map(*[x for i, name in enumerate(languages) for x in (F.lit(name), F.lit(i))])[F.col(lang_col)]


def _tables(frame: DataFrame, languages: list[str], value: str, missing: float) -> tuple[np.ndarray, np.ndarray]:
    """Collect (lang, gram, value), one row for each gram in the order of the unsigned grams."""
    got = frame.select(_numbers(languages).alias("l"), "gram", F.col(value).cast("float").alias("v")).toArrow()
    gram, lang, v = (got.column(c).to_numpy() for c in ("gram", "l", "v"))
    keys, at = np.unique(gram.astype(np.int64).view(np.uint64), return_inverse=True)
    out = np.full((len(keys), len(languages)), missing, np.float32)
    out[at, lang] = v
    return keys, out


def _rows(frame: DataFrame, languages: list[str], value: str, missing: float) -> DataFrame:
    """(``gram``, ``v``): the values of all languages as an array, one row for each gram."""
    listed = frame.select("gram", F.struct(_numbers(languages).alias("l"), F.col(value).cast("float").alias("v")).alias("e"))
    held = listed.groupBy("gram").agg(F.map_from_entries(F.collect_list("e")).alias("m"))
    every = F.sequence(F.lit(0), F.lit(len(languages) - 1))
    return durable(held.select("gram", F.transform(every, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(missing).cast("float"))).alias("v")))


def fit_models(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Kneser-Ney models of all languages of ``lang_col``; rows without one are not used.

    ``None`` if no row has a language.
    """
    grams = durable(count_grams(docs.where(F.col(lang_col).isNotNull()), text_col, lang_col))
    languages = sorted(r["lang"] for r in grams.select("lang").distinct().collect())
    if not languages:
        return None
    joined = grams.select("gram").distinct().count() * len(languages) > CELLS
    tables = _rows if joined else _tables
    probs, backs, base = [], [], None
    for order in range(ORDER, 0, -1):
        ones = grams.groupBy("lang").agg(F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("one"),
                                         F.sum(F.when(F.col("n") == 2, 1).otherwise(0)).alias("two"))
        discount = F.when(F.col("one") * F.col("two") > 0, F.col("one") / (F.col("one") + 2 * F.col("two"))).otherwise(0.5)
        discounts = {r["lang"]: r["d"] for r in ones.select("lang", discount.alias("d")).collect()}
        of = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(float(discounts[name])))])[F.col("lang")]
        history = F.shiftrightunsigned("gram", BITS) if order > 1 else F.lit(0).cast("long")
        sums = grams.groupBy("lang", history.alias("history")).agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))
        both = grams.withColumn("history", history).join(sums, ["lang", "history"])
        probs.insert(0, tables(both.withColumn("p", F.greatest(F.col("n") - of, F.lit(0.0)) / F.col("all")), languages, "p", 0.0))
        weight = sums.select("lang", F.col("history").alias("gram"), (of * F.col("kinds") / F.col("all")).alias("w"))
        if order > 1:
            backs.insert(0, tables(weight, languages, "w", 1.0))
            grams = durable(grams.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1)).alias("gram"))
                            .agg(F.count(F.lit(1)).alias("n")))
        else:
            weights = {r["lang"]: r["w"] for r in weight.collect()}
            base = np.array([weights[name] / SYMBOLS for name in languages])
    return Model(languages, probs, backs, base, joined)


class _Scorer:
    """Cross-entropies of many texts; remembers the grams it has met, at most ``GRAMS_HELD`` of them."""

    def __init__(self, model: Model):
        self.model, self.symbols = model, Symbols()
        self._forget()

    def _forget(self) -> None:
        self.table, self.logs = KeyTable(16), np.zeros((0, len(self.model.languages)), np.float32)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats per symbol for each text and language, and the number of symbols; the
        number is 0 for a text without letters."""
        if len(self.logs) > GRAMS_HELD:
            self._forget()
        gram, owner, _ = self.symbols.grams(texts)
        at = self.table.find(gram)
        new = np.unique(gram[at < 0])
        if len(new):
            self.table.add(new, np.arange(len(self.logs), len(self.logs) + len(new)))
            self.logs = np.concatenate([self.logs, self.model.log_probs(new).astype(np.float32)])
            at = self.table.find(gram)
        sizes = np.bincount(owner, minlength=len(texts))
        sums = np.stack([np.bincount(owner, self.logs[at, k], len(texts)) for k in range(self.logs.shape[1])], axis=1)
        letters = np.bincount(owner, (gram & np.uint64(SYMBOLS - 1)) > 0, len(texts))
        return -sums / np.maximum(sizes, 1)[:, None], np.where(letters > 0, sizes, 0)


def _scored(docs: DataFrame, keep: dict[str, Column], text_col: str, model: Model, with_text: bool = False) -> DataFrame:
    """Columns ``keep`` with ``best``, ``ce``, ``n`` and ``ces``: index and cross-entropy of the best
    language, number of symbols, all cross-entropies; with ``with_text`` the text as ``t`` too."""
    if model.joined:
        return _scored_joined(docs, keep, text_col, model, with_text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = docs.select(*[c.alias(f"k{i}") for i, c in enumerate(keep.values())]).schema.fields

    def make():
        scorer = shared.value.scorer()

        def work(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
            ces, n = scorer(texts)
            best = ces.argmin(axis=1)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * ces.shape[1], pa.int32()), pa.array(ces.reshape(-1)))
            out = {f.name: part.column(f.name) for f in kinds} | ({"t": part.column("t")} if with_text else {})
            out |= {"best": pa.array(best.astype(np.int32)), "ce": pa.array(ces[np.arange(len(texts)), best]),
                    "n": pa.array(n.astype(np.int64)), "ces": listed}
            return pa.RecordBatch.from_arrays(list(out.values()), list(out))

        return work

    schema = [f"{f.name} {f.dataType.simpleString()}" for f in kinds] + ["t binary"] * with_text
    got = map_texts(docs, list(keep.values()), text_col, ", ".join([*schema, "best int, ce double, n long, ces array<double>"]), make)
    return got.select(*[F.col(f.name).alias(name) for f, name in zip(kinds, keep)], *["t"] * with_text, "best", "ce", "n", "ces")


def _gram_logs(grams: DataFrame, model: Model) -> DataFrame:
    """(``gram``, ``logs``) for different grams (``gram``): what ``Model.log_probs`` gives, by joins."""
    rows = grams.withColumn("p", F.array(*map(F.lit, map(float, model.base))))

    def joined(rows: DataFrame, table: DataFrame, key: Column, name: str) -> DataFrame:
        of = table.select(F.col("gram").alias(f"_{name}"), F.col("v").alias(name))
        return rows.withColumn("_key", key).join(of, F.col("_key") == F.col(f"_{name}"), "left").drop("_key", f"_{name}")

    for k in range(ORDER):
        gram = F.col("gram") if k == ORDER - 1 else F.col("gram").bitwiseAND(F.lit((1 << BITS * (k + 1)) - 1))
        if k:
            rows = joined(rows, model.backs[k - 1], F.shiftrightunsigned(gram, BITS), "w")
            rows = rows.withColumn("p", F.transform("p", lambda x, i: x * F.coalesce(F.get("w", i), F.lit(1.0)))).drop("w")
        rows = joined(rows, model.probs[k], gram, "d")
        rows = rows.withColumn("p", F.transform("p", lambda x, i: x + F.coalesce(F.get("d", i), F.lit(0.0)))).drop("d")
    return rows.select("gram", F.transform("p", lambda x: F.log(x).cast("float")).alias("logs"))


def _scored_joined(docs: DataFrame, keep: dict[str, Column], text_col: str, model: Model, with_text: bool) -> DataFrame:
    """``_scored`` with a model of tables. Each document's grams are counted, joined to their logarithms and
    summed as decimals, so that the order of the rows does not matter."""
    kept = docs.select(*[c.alias(f"k{i}") for i, c in enumerate(keep.values())], F.col(text_col).cast("binary").alias("t"))
    kept = durable(kept.withColumn("_row", F.monotonically_increasing_id()))

    def make():
        symbols = Symbols()

        def work(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
            gram, owner, _ = symbols.grams(texts)
            kinds, at = np.unique(gram, return_inverse=True)
            pairs, n = np.unique(owner * max(len(kinds), 1) + at, return_counts=True)
            row = part.column("k0").to_numpy()[pairs // max(len(kinds), 1)]
            return pa.RecordBatch.from_arrays([pa.array(row), pa.array(kinds[pairs % max(len(kinds), 1)].view(np.int64)), pa.array(n.astype(np.int64))],
                                              ["row", "gram", "n"])

        return work

    counts = durable(map_texts(kept, ["_row"], "t", "row long, gram long, n long", make))
    logs = _gram_logs(counts.select("gram").distinct(), model)
    each = range(len(model.languages))
    letters = F.when(F.col("gram").bitwiseAND(F.lit(SYMBOLS - 1)) > 0, F.col("n")).otherwise(0)
    sums = counts.join(logs, "gram").groupBy("row").agg(
        F.sum("n").alias("n"), F.sum(letters).alias("letters"),
        *[F.sum(F.col("n") * F.get("logs", F.lit(i)).cast("decimal(18,12)")).cast("double").alias(f"s{i}") for i in each])
    sums = sums.select("row", F.when(F.col("letters") > 0, F.col("n")).otherwise(0).alias("n"), F.array(*[-F.col(f"s{i}") / F.col("n") for i in each]).alias("ces"))
    got = kept.join(sums, F.col("_row") == F.col("row"), "left").withColumn("ces", F.coalesce("ces", F.array(*[F.lit(0.0)] * len(each))))
    best = (F.array_position("ces", F.array_min("ces")) - 1).cast("int")
    return got.select(*[F.col(f"k{i}").alias(name) for i, name in enumerate(keep)], *["t"] * with_text, best.alias("best"),
                      F.array_min("ces").alias("ce"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "ces")


def calibrate(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Set sharpness, and each language's limit of cross-entropy, from labelled documents that
    took no part in the counts. Without any, the score's sharpness stays 1 and nothing is rejected.

    NULL labels, labels the model does not know, NULL and empty texts and texts without a letter are not used;
    repeated rows count as often as they occur.
    """
    labelled = docs.where(F.col(lang_col).isNotNull())
    got = durable(_scored(labelled, {"row": _numbers(model.languages, lang_col)}, text_col, model).where("n > 0 and row is not null"))
    losses = [F.avg(F.expr(f"ln(aggregate(ces, 0D, (s, c) -> s + exp({b}D * (ces[row] - c))))")).alias(f"l{i}") for i, b in enumerate(SHARPNESS)]
    loss = got.agg(*losses).first()
    if loss["l0"] is not None:
        model.sharpness = SHARPNESS[int(np.argmin([loss[f"l{i}"] for i in range(len(SHARPNESS))]))]
    right = got.where("best = row").select("best", "ce", (1 / F.col("n")).alias("x"))
    counts = _fit_spreads(right, model)
    # Fitted again without the worst, so that mislabelled or mixed documents set neither spread nor limit.
    shares = [min(QUANTILE, (n - 1.5) / n) if (n := counts.get(i, 0)) > 2 else 1.0 for i in range(len(model.languages))]
    cuts = right.groupBy("best").agg(F.percentile_approx(_excess(model), shares, 10_000).alias("cuts"))
    cut = {r["best"]: r["cuts"][r["best"]] for r in cuts.collect()}
    least = F.array(*[F.lit(cut.get(i, 0.0)) for i in range(len(model.languages))])
    right = durable(right.where(_excess(model) <= F.get(least, F.col("best"))))
    _fit_spreads(right, model)
    for r in right.groupBy("best").agg(F.max(_excess(model)).alias("z")).collect():
        model.limits[r["best"]] = (*model.limits[r["best"]][:3], max(MARGIN * r["z"], SPREADS))
    return model


def _fit_spreads(right: DataFrame, model: Model) -> dict[int, int]:
    """Set each language's mean and variance from documents (``best``, ``ce``, ``x`` = 1 / symbols); how
    many there are. The variance of a document's cross-entropy is taken as a + b x, by least squares."""
    means = right.groupBy("best").agg(F.avg("ce").alias("mean"))
    off = right.join(F.broadcast(means), "best").withColumn("y", F.pow(F.col("ce") - F.col("mean"), 2))
    counts = {}
    for r in off.groupBy("best").agg(F.first("mean").alias("mean"), F.avg("y").alias("y"), F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"),
                                     F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx")).collect():
        slope = max(r["xy"] / r["xx"], 0.0) if r["xx"] else 0.0
        model.limits[r["best"]] = (r["mean"], max(r["y"] - slope * r["x"], 1e-4), slope, 0.0)
        counts[r["best"]] = r["n"]
    return counts


def _excess(model: Model) -> Column:
    spreads = _spreads(model)
    return F.expr(f"(ce - {spreads}[best].m) / sqrt({spreads}[best].a + {spreads}[best].b * x)")


def _spreads(model: Model) -> str:
    """The limits as an SQL array by language; a language without any rejects nothing."""
    none = (0.0, 1.0, 0.0, 1e9)
    of = [model.limits.get(i, none) for i in range(len(model.languages))]
    return "array(" + ", ".join("named_struct('m', {!r}D, 'a', {!r}D, 'b', {!r}D, 'z', {!r}D)".format(*map(float, x)) for x in of) + ")"


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) as struct ``row`` with ``lang_pred``, ``score``,
    ``cross_entropy`` and ``rejected``.

    NULL texts, empty texts and texts without a letter are ``und`` with score 0 and rejected; so is every
    text if there is no model. Texts of any length are read whole; of equally good languages the first by
    name is taken.
    """
    keep = docs.columns if keep is None else keep
    if model is None:
        return docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    others = [c for c in keep if c != text_col]
    # A NULL text comes back as NULL; the text itself travels once.
    got = _scored(docs, {f"_{i}": F.col(f"`{c}`") for i, c in enumerate(others)}, text_col, model, text_col in keep)
    place = {c: F.col(f"_{i}") for i, c in enumerate(others)} | {text_col: F.col("t").cast("string")}
    row = F.struct(*[place[c].alias(c) for c in keep]).alias("row")
    names = F.array(*[F.lit(x) for x in model.languages])
    spreads = _spreads(model)
    limit = F.expr(f"{spreads}[best].m + {spreads}[best].z * sqrt({spreads}[best].a + {spreads}[best].b / n)")
    sharp = model.sharpness
    known = F.col("n") > 0
    score = F.expr(f"1D / aggregate(ces, 0D, (s, c) -> s + exp({sharp}D * (ce - c)))")
    return got.select(
        row, F.when(known, F.get(names, F.col("best"))).otherwise("und").alias("lang_pred"),
        F.when(known, score).otherwise(0.0).alias("score"), F.when(known, F.col("ce")).alias("cross_entropy"),
        (~known | (F.col("ce") > limit)).alias("rejected"))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Models from the labelled documents of folds 2 to 4, calibrated on fold 1; fold 0 is not read.

    Rows with a NULL id or label are not read either; ``None`` if no row is left. Repeated rows count as often
    as they occur.
    """
    part = fold(F.col(id_col))
    model = fit_models(docs.where(part > 1), text_col, lang_col)
    return model and calibrate(docs.where(part == 1), model, text_col, lang_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             keep: list[str] | None = None) -> DataFrame:
    """Learn from the labelled rows of ``docs`` and predict every row; see ``predict`` for the columns.

    NULL labels are not learned from; rows with a NULL id are not learned from either. Rows with equal ids
    are predicted one by one. An empty table gives no rows.
    """
    return predict(docs, learn(docs, id_col, text_col, lang_col), text_col, keep)
