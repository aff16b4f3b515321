"""Decontamination against plain window sets, suffix order against sorting, longest matches by search."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from holdfast.llm import decontamination as dec

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, named = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    named |= windows[tuple(w[i:i + n])] - {None}
        out.append((doc, len(w), len(hit), tuple(sorted(map(str, named))), bool(hit)))
    return out


def found(spark, docs, items, **options):
    rows = dec.find_contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                                  spark.createDataFrame(items, "item_id long, text string"), **options).collect()
    return Counter((r.row.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in rows)


def texts(rng, n, letters, most):
    return [" ".join(rng.choices(letters, k=rng.randint(0, most))) for _ in range(n)]


def test_suffix_order():
    rng = np.random.default_rng(2)
    for size, letters, depth in ((1, 1, 5), (50, 1, 60), (300, 2, 7), (300, 3, 400), (500, 100_000, 12)):
        ids = rng.integers(0, letters, size)
        order = dec._sorted_suffixes(ids, depth)
        cut = [ids[i:i + depth].tolist() for i in order]
        assert sorted(order.tolist()) == list(range(size)) and cut == sorted(cut)


@pytest.mark.parametrize("block_words", [1 << 18, 3])
def test_windows_against_sets(spark, block_words):
    # Small alphabets: windows overlap, repeat in a text and in several items.
    rng = random.Random(4)
    docs, items = [], []
    for letters in (["a"], ["a", "B", "É"], ["x1", "中文", "don't", "Σ", "q"]):
        docs += texts(rng, 60, letters, 60)
        items += texts(rng, 12, letters, 25)
    docs = [*enumerate(docs), (5, docs[9]), (None, docs[70]), (900, None), (901, ""), (902, "--- \n!")]
    items = [*enumerate(items), (3, items[20]), (None, "a a a a"), (None, "unseen words here"), (50, None), (51, "!?"), (52, items[3]), (7, items[7])]
    assert found(spark, docs, items, block_words=block_words) == Counter(plain(docs, items))


def test_no_match_crosses_documents(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = [(1, "w0 w1 w2 w3 w4 w5"), (2, "w6 w7 w8 w9 w10 w11"), (3, f"x {item} y"), (4, "w0 w1 w2 w3 w4 w5")]
    got = found(spark, docs, [(1, item)])
    assert got == Counter([(1, 6, 0, (), False), (2, 6, 0, (), False), (3, 14, 12, ("1",), True), (4, 6, 0, (), False)])


def test_longest_matches(spark):
    rng = random.Random(8)
    docs = [(i if i else None, t) for i, t in enumerate(texts(rng, 30, "abcdefgh", 40))]
    items = [*enumerate(texts(rng, 6, "abcdefghz", 15)), (9, "zz zz")]
    spans = [(d, i, words(t)[i:]) for d, t in docs for i in range(len(words(t)))]
    want = {}
    for item, text in items:
        w = words(text)
        for o in range(len(w)):
            def same(s):
                n = 0
                while n < min(len(s), len(w) - o) and s[n] == w[o + n]:
                    n += 1
                return n
            best = max(same(s) for *_, s in spans)
            at = [(d is None, d, i) for d, i, s in spans if same(s) == best]
            if best:
                want[item, o] = (best, len(at), *min(at, key=lambda x: (x[0], x[1] or 0, x[2]))[1:])
    rows = dec.longest_matches(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                               spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(int(r["item"]), r.offset): (r.length, r.locations, r.doc_id, r.at) for r in rows} == want


def test_removal_keeps_clean_rows(spark, awkward, empty):
    items = spark.createDataFrame([(1, "One TWO three four five"), (2, "lorem ipsum " * 30)], "item_id long, text string")
    rows = dec.find_contamination(awkward, items)
    assert rows.count() == awkward.count()
    left = dec.remove_contaminated(awkward, items)
    assert left.columns == awkward.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter([None, None, 2, 3, 4, 5, 6, 7, 8])
    assert dec.find_contamination(empty, items).count() == 0
    assert dec.remove_contaminated(awkward, items.where("false")).count() == awkward.count()


def test_long_repeats(spark, awkward):
    # One word and one phrase repeated for a whole text, and an item as long.
    text = "ha " * 30000
    docs, items = [(1, text), (2, text), (3, "ha ha")], [(1, "ha " * 500), (2, "ho")]
    assert found(spark, docs, items) == Counter([(1, 30000, 30000, ("1",), True), (2, 30000, 30000, ("1",), True), (3, 2, 0, (), False)])


def test_planted_passages(spark, folder, documents):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    got = dec.find_contamination(documents, items).collect()
    want = plain([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert Counter((r.row.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got) == Counter(want)
    assert any(r.contaminated for r in got)
