"""Quality rules and verdict against a plain implementation."""

import math
import re
from collections import Counter

import pytest

from holdfast.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words, places = WORD.findall(text), {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i:i + 3]), []).append(i)
    repeated = {j for v in places.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed)


def figures(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_rules(spark, folder, documents):
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    rows = queries.op10_quality(spark, folder).collect()
    assert {r.doc_id: figures(r) for r in rows} == {k: plain(t) for k, t in texts.items()}
    assert not any(r.kept and r.base_failed for r in rows)


def test_verdict_follows_the_labels(spark, folder):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in queries.op10_quality(spark, folder).collect() if not r.base_failed and labels.get(r.doc_id) is not None]
    good, bad = ([r.kept for r in rows if labels[r.doc_id] == q] for q in (1, 0))
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.5 * len(bad)


def test_scores(spark):
    texts = {1: "a b a c", 2: "b b c", 3: "d e f g", 4: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    table = quality.ratios(docs, docs.where("doc_id = 1"), buckets=1 << 14)
    got = {r.row.doc_id: r.rules.score for r in quality.measured(docs, table).collect()}

    def features(t):
        w = t.split()
        return [*w, *zip(w, w[1:])]

    raw = Counter(x for t in texts.values() for x in features(t))
    good = Counter(features(texts[1]))
    ratio = {x: math.log((good[x] + 1) / (sum(good.values()) + (1 << 14))) - math.log((raw[x] + 1) / (sum(raw.values()) + (1 << 14))) for x in raw}
    for k in (1, 2, 3):
        assert got[k] == pytest.approx(sum(ratio[x] for x in features(texts[k])) / len(features(texts[k])), abs=1e-5)
    assert got[4] is None


def test_threshold_is_that_of_all_trusted_documents(spark, documents):
    """Fitted on three documents, the threshold is still the mean and spread of every trusted one."""
    trusted = documents.where("doc_id % 2 = 0").select("doc_id").unionByName(spark.range(10_000_000, 10_000_100).toDF("doc_id"))
    few = quality.trusted_sample(documents, trusted, "doc_id", 3).collect()
    assert len({r.doc_id for r in few}) == 3
    rows = quality.rate(documents, trusted, trusted_rows=3, keep=["doc_id"]).collect()
    assert len(rows) == documents.count() and rows[0].row.__fields__ == ["doc_id"]
    scores = [r.rules.score for r in rows if r.row.doc_id is not None and r.row.doc_id % 2 == 0 and not r.rules.base_failed]
    mean = sum(scores) / len(scores)
    least = mean - quality.SPREADS * math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))
    assert len(scores) > 10 and [r.kept for r in rows] == [not r.rules.base_failed and r.rules.score >= least for r in rows]


def test_all_trusted_documents_are_counted(spark, monkeypatch):
    docs = spark.range(0, 10_050, 1, 2).selectExpr("id as doc_id", "concat('w', id % 7) as text")
    trusted, counted, ratios = docs.select("doc_id").where("doc_id <> 3"), [], quality.ratios
    monkeypatch.setattr(quality, "ratios", lambda corpus, target, *rest: counted.append(target.count()) or ratios(corpus, target, *rest))
    assert quality.rate(docs, trusted.unionByName(trusted)).count() == 10_050 and counted == [10_049]


def test_trusted_texts_are_not_moved(spark):
    """Trusted ids too many to broadcast: the texts stay in place, and the rows found are exactly theirs."""
    docs = spark.range(0, 4_000, 1, 3).selectExpr("if(id % 97 = 0, null, id % 3900 - 50) as doc_id", "concat('w', id) as text")
    trusted = spark.range(-50, 10_000, 2).selectExpr("if(id % 31 = 0, null, id) as doc_id")
    trusted = trusted.unionByName(trusted)
    want = sorted(tuple(r) for r in docs.collect() if r.doc_id is not None and r.doc_id % 2 == 0 and r.doc_id % 31)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        for rows in (quality.BITMAP_ROWS, 1):  # in one row of the bitmap many ids share a bit
            found = quality._with_ids(docs, trusted.select("doc_id"), "doc_id", rows)
            assert sorted(tuple(r) for r in found.collect()) == want
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
        found = quality.trusted_sample(docs, trusted, "doc_id")
        assert sorted(tuple(r) for r in found.collect()) == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    narrow = trusted.selectExpr("cast(doc_id as int) as doc_id")
    assert sorted(tuple(r) for r in quality.trusted_sample(docs, narrow, "doc_id").collect()) == want
    texts = docs.selectExpr("cast(doc_id as string) as doc_id", "text")
    named = trusted.selectExpr("cast(doc_id as string) as doc_id")
    assert quality.trusted_sample(texts, named, "doc_id").count() == len(want)


def test_awkward_rows(spark, awkward, empty):
    trusted = spark.createDataFrame([(1,), (None,), (99,)], "doc_id long")
    rated = quality.rate(awkward, trusted)
    assert rated.select("row.*").columns == awkward.columns
    rows = rated.collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert figures(r.rules) == plain(r.row.text)
    assert quality.rate(empty, trusted).count() == 0
    long = "\n".join(" ".join(f"w{i * j % 977}x{j}" for j in range(9)) for i in range(40))
    docs = spark.createDataFrame([(1, long)], "doc_id long, text string")
    assert [r.kept for r in quality.rate(docs, trusted.where("false")).collect()] == [True]
