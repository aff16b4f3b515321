"""Token alignment against a plain version: whole-text tokens, overlaps by comparing spans, groups by search."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from holdfast.llm import alignment, queries
from holdfast.llm.bpe import byte_symbols

from .test_tokens import odd_texts


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        self.byte = {c: b for b, c in byte_symbols().items()}

    def tokens(self, text):
        """(id, start, end) of A and B tokens; none if a tokenizer changes the bytes."""
        if not text:
            return [], []
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        pieces = [[bytes(self.byte[c] for c in self.a.id_to_token(i)) for i in a],
                  [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
                   else self.b.id_to_piece(i).replace("▁", " ").encode() for i in b]]
        if any(b"".join(p) != (" " + text).encode() for p in pieces):
            return [], []
        out = []
        for ids, parts in zip((a, b), pieces):
            ends = np.cumsum([len(p) for p in parts]).tolist()
            out.append([(i, e - len(p), e) for i, p, e in zip(ids, parts, ends)])
        return out

    def align(self, text):
        a, b = self.tokens(text)
        links = [(i, j) for i, (_, s, e) in enumerate(a) for j, (_, s2, e2) in enumerate(b) if s < e2 and s2 < e]
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, start = [], 0
        for end in ends:
            groups.append(tuple(",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in (a, b)))
            start = end
        return a, b, links, groups

    def corpus(self, texts):
        seen = [self.align(t) for t in texts]
        counts = Counter((a[i][0], b[j][0]) for a, b, links, _ in seen for i, j in links)
        best = defaultdict(int)
        for (_, y), n in counts.items():
            best[y] = max(best[y], n)
        rows = []
        for a, b, links, groups in seen:
            ids = [(a[i][0], b[j][0]) for i, j in links]
            text = ";".join("|".join(g) for g in groups)
            rows.append((len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in ids),
                         sum(counts[p] for p in ids), hashlib.sha256(text.encode()).hexdigest() if a else ""))
        return rows


@pytest.fixture(scope="module")
def plain():
    return Plain()


POOL = "aAbBzZ'sStTrevlmd1²½ éÉß\n\t_-!?.́ςσ中\x1f\x0b\0    　᠎\u0085▁<>|"


def texts():
    rng = random.Random(3)
    found = ["", " ", "  ", "a ", " a", "a  b", "a \n b", "x  y", "x  y", "<|endoftext|> x", "a<0x41>b", "▁x", "é " * 9,
             "the cat  sat\ton the\n mat ", "中文 字 text", "a" * 300, "ab" * 200 + " tail"]
    found += ["".join(rng.choices(POOL, k=rng.randint(0, 50))) for _ in range(400)]
    return found + [t for t in odd_texts() if len(t) < 100][:300]


def test_segments_are_tokenized_as_in_the_whole_text(plain):
    aligner = alignment.Aligner()
    for text in texts():
        if not text:
            continue
        parts = alignment.segments(text)
        assert "".join(f" {p}" for p in parts) == f" {text}"
        a, b, same = aligner.tokens(parts)
        want_a, want_b = plain.tokens(text)
        assert bool(same.all()) == bool(want_a), ascii(text)
        if want_a:
            assert [i for x in a for i in x] == [i for i, *_ in want_a], ascii(text)
            assert [i for x in b for i in x] == [i for i, *_ in want_b], ascii(text)


def test_labels_by_pointer_jumping():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 40)
        cuts = [sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n}) for _ in range(2)]
        a, b = alignment.group_labels(np.array(cuts[0]), np.array(cuts[1]))
        ends = sorted(set(cuts[0]) & set(cuts[1]))
        assert a.tolist() == [sum(e < x for e in ends) for x in cuts[0]]
        assert b.tolist() == [sum(e < x for e in ends) for x in cuts[1]]
    staggered = np.arange(2, 20001, 2), np.append(np.arange(1, 20000, 2), 20000)
    a, b = alignment.group_labels(*staggered)
    assert not a.any() and not b.any()


def test_corpus_statistics(spark, plain, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 1 << 10)
    source = texts()
    rows = [(i if i % 7 else None, t) for i, t in enumerate(source)] + [(3, source[3]), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(tuple(r)[1:] for r in alignment.link_statistics(docs).collect())
    assert got == Counter(plain.corpus([t or "" for _, t in rows]))


def test_registered_query(spark, folder, plain, documents):
    pairs = [(r.doc_id, r.text or "") for r in documents.where("length(text) < 2500").select("doc_id", "text").collect()]
    short = documents.where("length(text) < 2500")
    got = {r.doc_id: tuple(r)[1:] for r in alignment.link_statistics(short).collect()}
    assert got == dict(zip([i for i, _ in pairs], plain.corpus([t for _, t in pairs])))
    assert queries.op11_alignment(spark, folder).count() == documents.count()


def test_groups_as_text(spark, plain):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts()[:60])], "doc_id long, text string")
    for r in alignment.align(docs).collect():
        a, b, links, groups = plain.align(texts()[r.doc_id])
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(a), len(b), len(groups), len(links))
        assert r.groups == ";".join("|".join(g) for g in groups)


def test_full_memory(plain, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 5)
    aligner = alignment.Aligner()
    for text in texts()[1:80]:
        aligner.trim()
        _, _, has, totals = alignment._aligned(aligner, [text.encode()])
        a, b, links, groups = plain.align(text)
        assert totals[0].tolist() == [len(a), len(b), len(groups), len(links)] and bool(has[0]) == bool(a)


def test_awkward_and_empty_tables(spark, awkward, empty):
    rows = alignment.link_statistics(awkward).collect()
    assert len(rows) == awkward.count()
    blank = [r for r in rows if r.doc_id in (2, 3)]
    assert len(blank) == 2 and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in blank)
    twins = [tuple(r) for r in rows if r.doc_id == 1]
    assert len(twins) == 2 and twins[0] == twins[1]
    assert alignment.link_statistics(empty).count() == 0 and alignment.align(empty).count() == 0
