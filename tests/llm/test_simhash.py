"""Fingerprints, links and components against brute force."""

import itertools
import random
import re

import numpy as np
import xxhash

from holdfast.llm import queries, simhash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_roots(prints, names):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    a = np.array(prints, np.uint64)
    for k in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[k]) <= 4):
            x, y = find(k), find(int(j))
            if x != y:
                parent[max(x, y)] = min(x, y)
    return [names[find(k)] for k in range(len(a))]


def test_any_four_positions_hold_a_triple():
    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(q) for t in simhash.TRIPLES) for q in itertools.combinations(range(8), 4))


def test_documents(spark, folder, documents):
    rows = sorted(documents.select("doc_id", "text").collect())
    prints = [brute_print(r.text) for r in rows]
    want = dict(zip((r.doc_id for r in rows), zip((f"{p:016x}" for p in prints), brute_roots(prints, [r.doc_id for r in rows]))))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op3_simhash(spark, folder).collect()}
    assert got == want


def test_chains_and_clusters_over_blocks(spark):
    rng = random.Random(3)
    prints = {0}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(60):
            y = x
            for _ in range(rng.randint(0, 5)):
                y ^= 1 << rng.randrange(64)
            prints.add(y)
            x = y if rng.random() < 0.3 else x
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(4)
    want = brute_roots(prints, list(range(len(prints))))
    for block in (2048, 7):
        roots = {r.node: r.root for r in simhash.components(simhash.links(frame, 4, block)).collect()}
        got = [roots.get(x, x) for x in signed]
        assert len(set(zip(got, want))) == len(set(want)) == len(set(got))


def test_awkward_rows(awkward, empty):
    rows = simhash.near_duplicates(awkward).collect()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == awkward.count()
    blank = {2, 3, 4}
    assert {by_id[i].fingerprint for i in blank} == {"0" * 16} and {by_id[i].component_id for i in blank} == {2}
    assert by_id[1].component_id == 1
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and ids.count(2) == 1 and 3 not in ids and 4 not in ids
    assert simhash.near_duplicates(empty).count() == simhash.keep_one(empty).count() == 0


def test_components_of_null_ids_keep_one_row(spark):
    rows = spark.createDataFrame([(None, "zz yy xx ww", "q"), (None, "zz yy xx ww", "p"), (None, "a b c d", "k"), (1, "a b c d", "x")],
                                 "doc_id long, text string, component string")
    assert sorted((r.doc_id or 0, r.component) for r in simhash.keep_one(rows).collect()) == [(0, "p"), (1, "x")]
