"""Kneser-Ney models against a plain implementation, and held-out accuracy."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm import language, queries


def symbols(text):
    out = [0]
    for c in (text or "").lower():
        s = 0 if not c.isalpha() else ord(c) if ord(c) < 2048 else 2048 + ord(c) * 2654435761 % 2**32 % 2048
        if s or out[-1]:
            out.append(s)
    return out if out[-1] == 0 else [*out, 0]


def plain_model(texts, order=language.ORDER):
    """Probability function of an interpolated Kneser-Ney model."""
    counts = Counter()
    for t in texts:
        s = [0] * (order - 1) + symbols(t)
        for i in range(order, len(s)):
            counts[tuple(s[i - order + 1:i + 1])] += 1
    levels = []
    for _ in range(order):
        ones, twos = (sum(1 for n in counts.values() if n == k) for k in (1, 2))
        discount = ones / (ones + 2 * twos) if ones * twos else 0.5
        total, kinds = Counter(), Counter()
        for g, n in counts.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        levels.insert(0, (counts, discount, total, kinds))
        lower = Counter()
        for g in counts:
            lower[g[1:]] += 1
        counts = lower

    def probability(gram):
        p = 1 / language.SYMBOLS
        for k, (counts, discount, total, kinds) in enumerate(levels):
            g = gram[order - k - 1:]
            if total[g[:-1]]:
                p = max(counts[g] - discount, 0) / total[g[:-1]] + discount * kinds[g[:-1]] / total[g[:-1]] * p
        return p

    def entropy(text):
        s = [0] * (order - 1) + symbols(text)
        steps = [probability(tuple(s[i - order + 1:i + 1])) for i in range(order, len(s))]
        return -sum(map(math.log, steps)) / len(steps)

    return entropy


def test_same_as_the_plain_model(spark, documents):
    some = documents.orderBy(F.length("text")).limit(60)
    rows = some.select("text", "lang").collect()
    model = language.fit_models(some)
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r.lang].append(r.text)
    assert model.languages == sorted(by_lang)
    probes = [r.text for r in rows[::7]] + ["xyz qqq", "ñandú 中文字", "a"]
    got, sizes = language._Scorer(model)([p.encode() for p in probes])
    for k, name in enumerate(model.languages):
        entropy = plain_model(by_lang[name])
        assert got[:, k] == pytest.approx([entropy(p) for p in probes], rel=2e-3)  # two of a million lookups may share a slot
    assert sizes.tolist() == [len(symbols(p)) - 1 for p in probes]


def test_held_out_accuracy(spark, folder, documents):
    got = queries.op9_language(spark, folder).join(documents.select("doc_id", "lang"), "doc_id").where("held_out")
    row = got.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"),
                  F.min("score").alias("low"), F.max("score").alias("high"), F.avg(F.col("rejected").cast("int")).alias("rejected")).first()
    assert row.n > 20 and row.right > 0.95 and 0 <= row.low and row.high <= 1 and row.rejected < 0.05


def test_noise_is_rejected_and_text_is_not(spark, documents):
    model = language.learn(documents)
    rng = np.random.default_rng(1)
    noise = [(i, "".join(rng.choice(list("bcdfghjklmnpqrstvwxzжщъыю"), 400))) for i in range(20)]
    assert language.predict(spark.createDataFrame(noise, "doc_id long, text string"), model).where("not rejected").count() == 0
    assert language.predict(documents, model).where("rejected").count() <= documents.count() // 50


def test_labels_ids_and_sources_are_no_inputs(documents):
    model = language.learn(documents)
    hidden = documents.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string"))
    a = {r.row.doc_id: (r.lang_pred, r.score) for r in language.predict(documents, model).collect()}
    assert a == {r.row.doc_id: (r.lang_pred, r.score) for r in language.predict(hidden, model).collect()}


def test_awkward_rows(awkward, empty):
    got = language.identify(awkward)
    assert got.select("row.*").columns == awkward.columns
    rows = got.collect()
    assert len(rows) == awkward.count()
    assert {(r.lang_pred, r.score, r.rejected) for r in rows if r.row.doc_id in (2, 3, 4, 7)} == {("und", 0.0, True)}
    assert [r.row.text for r in rows if r.row.doc_id == 2] == [None]
    assert language.identify(empty).count() == 0
    nothing = language.identify(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.rejected) for r in nothing} == {("und", True)}


def test_every_gram_has_its_own_probability(spark):
    """Ten thousand grams of a hundred languages: no unseen gram gets the probability of another."""
    rows = [(i, "".join(chr(0x4E00 + (i * 101 + j * 7919) % 20000) for j in range(100)), f"l{i:03}") for i in range(100)]
    model = language.fit_models(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    seen, _, _ = language.Symbols().grams([t.encode() for _, t, _ in rows])
    assert np.array_equal(model.probs[-1][0], np.unique(seen))
    other = np.setdiff1d(np.random.default_rng(2).integers(0, 1 << 63, 200_000, np.int64).view(np.uint64), seen)
    assert not model._find(model.probs[-1], other, 0.0).any()


def test_letters_beyond_the_latin_ones_stay_apart():
    texts = [chr(c).encode() for c in (*range(0x4E00, 0x9FFF), 0x20000, 0x20001, 0x2A6D0)]
    symbols, begins = language.Symbols().of(texts)
    ends = [*begins[1:], len(symbols)]
    assert len({tuple(symbols[b:e].tolist()) for b, e in zip(begins, ends)}) == len(texts)
    grams, owner, _ = language.Symbols().grams(["a𠀀b".encode(), "a𠀁b".encode(), b"ab"])
    assert np.bincount(owner).tolist() == [5, 5, 3] and grams[1] >> 16 == grams[6] >> 16 and grams[2] != grams[7]


def test_models_beyond_the_workers_give_the_same(documents, awkward, monkeypatch):
    held = {r.row.doc_id: r for r in language.identify(documents).collect()}
    awkwardly = sorted(language.identify(awkward, keep=["doc_id"]).collect(), key=str)
    monkeypatch.setattr(language, "CELLS", 0)
    rows = language.identify(documents).collect()
    assert len(rows) == len(held)
    for r in rows:
        want = held[r.row.doc_id]
        assert (r.row, r.lang_pred, r.rejected) == (want.row, want.lang_pred, want.rejected)
        assert [r.score, r.cross_entropy] == pytest.approx([want.score, want.cross_entropy], rel=1e-6)
    got = sorted(language.identify(awkward, keep=["doc_id"]).collect(), key=str)
    assert [(r.row, r.lang_pred, r.rejected) for r in got] == [(r.row, r.lang_pred, r.rejected) for r in awkwardly]


def test_limits_follow_the_calibration_documents(spark, documents, monkeypatch):
    """A language whose calibration documents have a long tail gets a wider limit than one without."""
    model = language.fit_models(documents.where(language.fold(F.col("doc_id")) > 1))
    tail = [1.0 + 0.001 * (i % 10) + (0.5 if i < 8 else 0.0) for i in range(300)]
    rows = [(i, x) for i, ces in enumerate((tail, [1.0 + 0.001 * (i % 10) for i in range(300)])) for x in ces]
    scored = spark.createDataFrame([(i, i, x, 400, [x if k == i else 9.0 for k in range(len(model.languages))]) for i, x in rows],
                                   "row int, best int, ce double, n long, ces array<double>")
    monkeypatch.setattr(language, "_scored", lambda *_: scored)
    limits = language.calibrate(documents, model).limits
    assert limits[1][3] == language.SPREADS < limits[0][3] < 20


def test_foreign_texts_are_rejected(spark, documents):
    model = language.learn(documents)
    texts = [
        "La nave attraversava lentamente il porto mentre la gente sul molo aspettava notizie delle proprie famiglie lontane e poi tutti tornavano verso casa",
        "O navio atravessava lentamente o porto enquanto as pessoas no cais esperavam notícias das suas famílias distantes e depois voltavam para casa",
        "Het schip voer langzaam door de haven terwijl de mensen op de kade stonden te wachten op nieuws van hun familie overzee en daarna gingen zij naar huis",
        "Laiva kulki hitaasti sataman halki kun ihmiset laiturilla odottivat uutisia perheistään ja sitten he menivät kotiin",
        "Gemi limandan yavaşça geçerken rıhtımdaki insanlar ailelerinden haber bekliyordu ve sonra evlerine gittiler",
        "Корабль медленно шёл через гавань, пока люди на причале ждали вестей от своих семей", "船慢慢地穿过港口码头上的人们在等待家人的消息"]
    rows = language.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).collect()
    assert len(rows) == len(texts) and all(r.rejected for r in rows)


def test_a_mislabelled_document_does_not_lift_the_limit(spark, documents):
    """One mixed document that is labelled and predicted 'en' leaves foreign text rejected."""
    own = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")
    model = language.fit_models(own.where(language.fold(F.col("doc_id")) > 1))
    calibration = own.where(language.fold(F.col("doc_id")) == 1)
    foreign = ("Het schip voer langzaam door de haven terwijl de mensen op de kade stonden te wachten op nieuws van hun familie overzee en "
               "daarna gingen zij naar huis ")
    noise = "xqzw vkjp zzqx wvkx qqjz "
    mixed = spark.createDataFrame([("m", next(r.text for r in own.where("lang = 'en'").orderBy(F.length("text").desc()).limit(1).collect())[:1500]
                                    + " " + noise * 60, "en")], own.schema)
    language.calibrate(calibration, model)
    en, clean = model.languages.index("en"), dict(model.limits)
    language.calibrate(calibration.unionByName(mixed), model)
    assert language.predict(mixed, model).first().lang_pred == "en"
    texts = spark.createDataFrame([(1, foreign * 4), (2, noise * 40)], "doc_id long, text string")
    got = language.predict(texts.unionByName(mixed.selectExpr("3L doc_id", "text")), model).collect()
    assert all(r.rejected for r in got)
    assert model.limits[en][3] == clean[en][3] == language.SPREADS
