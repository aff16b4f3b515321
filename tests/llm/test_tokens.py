"""Token counts, encoding, decoding and token files against the library the vocabularies come from."""

import hashlib
import random
import zlib
from collections import Counter as Bag

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from holdfast.llm import arrow_sequences, bpe, queries, token_counts

POOL = "aAbBzZ'sStTrevlmd1²½ éÉß\n\t_-!?.́ςΣσİıǰẞñÑ中\x1f\x0b\0  "


def odd_texts():
    rng = random.Random(1)
    texts = ["", " ", "  \n ", "a" * 5000, "ab" * 700 + "\n" + "x1y2" * 300, "=" * 3000, "'" * 333 + "s",
             "<|endoftext|>x<|startoftext|><|endof <|endoftext|>", "''s !'s \t's  's x'tx'rex''re 'S 'Ve"]
    texts += ["".join(rng.choices(POOL, k=rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0x2FFF), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)]))
                      for _ in range(30)) for _ in range(300)]
    texts += ["".join(rng.choices(letters, k=rng.randint(50, 900))) for letters in ("a", "ab", "the", "aehtino", "=-") for _ in range(60)]
    return texts


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_is_the_library(word_library):
    texts = odd_texts()
    ids, counts = bpe.WordBpe().encode([t.encode() for t in texts])
    ends = np.cumsum(counts)
    coder = bpe.WordBpe()
    for text, a, b in zip(texts, ends - counts, ends):
        want = word_library.encode(text, add_special_tokens=False).ids
        assert ids[a:b].tolist() == want, ascii(text)
        assert coder.decode(want) == word_library.decode(want, skip_special_tokens=False)


def test_chunks_that_collide_in_polynomial_hashes(word_library):
    # Thue-Morse words and their complements are equal under every polynomial hash modulo 2^64.
    for pair in ("ab", "01", "xz"):
        for size in (256, 512, 1024, 2048, 4096):
            bits = [bin(i).count("1") & 1 for i in range(size)]
            texts = ["".join(pair[b] for b in bits), "".join(pair[1 - b] for b in bits)]
            ids, counts = bpe.WordBpe().encode([t.encode() for t in texts])
            for text, a, b in zip(texts, np.cumsum(counts) - counts, np.cumsum(counts)):
                assert ids[a:b].tolist() == word_library.encode(text, add_special_tokens=False).ids


def test_chunks_with_one_key(word_library, monkeypatch):
    monkeypatch.setattr(bpe, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    coder, texts = bpe.WordBpe(), odd_texts()[9:200]
    for _ in range(2):
        ids, counts = coder.encode([t.encode() for t in texts])
        for text, a, b in zip(texts, np.cumsum(counts) - counts, np.cumsum(counts)):
            assert ids[a:b].tolist() == word_library.encode(text, add_special_tokens=False).ids


def test_special_strings_beside_letters_of_many_scripts(word_library):
    marks = ["<|endoftext|>", "<|startoftext|>"]
    letters = ["a", "É", "中", "Σ", "ǅ", "я", "’", "ﬁ", "😀", "é", "1", ".", " ", ""]
    texts = [f"{x}{m}{y}" for m in marks for x in letters for y in letters]
    texts += [f"{m}{x}{n}" for m in marks for n in marks for x in letters] + ["a <|endoftext|>’ b", "中<|endoftext|><|endoftext|>中"]
    ids, counts = bpe.WordBpe().encode([t.encode() for t in texts])
    for text, a, b in zip(texts, np.cumsum(counts) - counts, np.cumsum(counts)):
        assert ids[a:b].tolist() == word_library.encode(text, add_special_tokens=False).ids, ascii(text)


def test_encoder_with_a_full_cache(word_library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 10)
    coder = bpe.WordBpe()
    for text in odd_texts()[9:60]:
        assert coder.encode([text.encode()])[0].tolist() == word_library.encode(text, add_special_tokens=False).ids


def test_transducer_counts_as_the_library(byte_library):
    texts = odd_texts()
    got = token_counts.Counter().count([t.encode() for t in texts])
    assert got.tolist() == [len(byte_library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_transducer_that_forgets(byte_library, monkeypatch):
    monkeypatch.setattr(token_counts, "TRANSITIONS", 50)
    counter = token_counts.Counter()
    for text in odd_texts()[9:60]:
        assert counter.count([text.encode()]).tolist() == [len(byte_library.encode(text, add_special_tokens=False).ids)]


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_queries_on_documents(spark, folder, documents, word_library, byte_library):
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op8_bpe(spark, folder).collect()}
    assert got == {k: digests(word_library, t) for k, t in texts.items()}
    for r in queries.op1_token_counts(spark, folder).collect():
        n = len(byte_library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 512)
    rows, start = {r.doc_id: r for r in queries.op4_token_files(spark, folder).collect()}, 0
    for k in sorted(texts):
        ids = np.array([*word_library.encode(texts[k] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (rows[k].start, rows[k].n_tokens, rows[k].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_awkward_rows(awkward, word_library, byte_library):
    texts = [(r.doc_id, r.text or "") for r in awkward.collect()]
    got = Bag((r.doc_id, tuple(r.ids)) for r in bpe.encode_decode(awkward).collect())
    assert got == Bag((k, tuple(word_library.encode(t, add_special_tokens=False).ids)) for k, t in texts)
    got = Bag((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(awkward).collect())
    assert got == Bag((k, len(byte_library.encode(t, add_special_tokens=False).ids)) for k, t in texts)
    back = arrow_sequences.round_trip(awkward, shards=3, length=16).collect()
    assert Bag((r.doc_id, r.ids) for r in back) == Bag(
        (k, np.array([*word_library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for k, t in texts)
    order = sorted(back, key=lambda r: r.start)
    assert [r.doc_id for r in order] == sorted((k for k, _ in texts), key=lambda k: (k is not None, k))
    assert [r.start for r in order] == np.cumsum([0, *(r.n_tokens for r in order)])[:-1].tolist()


def test_empty_table(empty):
    assert bpe.encode_decode(empty).count() == token_counts.count_tokens(empty).count() == arrow_sequences.round_trip(empty).count() == 0


def test_files_hold_equal_sequences_and_masks(spark, documents, tmp_path):
    manifest = arrow_sequences.write_sequences(documents, f"file://{tmp_path}", shards=3, length=64).collect()
    assert sum(m.docs for m in manifest) == documents.count()
    for m in manifest:
        with pa.memory_map(f"{tmp_path}/{m.file}.arrow") as f:
            reader = pa.ipc.open_file(f)
            sizes = [reader.get_batch(i).num_rows for i in range(reader.num_record_batches)]
            assert set(sizes[:-1]) <= {arrow_sequences.BATCH} and reader.schema.field("input_ids").type.list_size == 64
            masks = np.concatenate([np.asarray(reader.get_batch(i).column("attention_mask").flatten()) for i in range(len(sizes))])
            assert masks.sum() == m.n_tokens and masks[: m.n_tokens].all()
