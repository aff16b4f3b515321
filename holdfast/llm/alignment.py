"""Alignment of two tokenizers' tokens over the same bytes, by pointer jumping.

Tokenizer A is a byte-level BPE file, tokenizer B a sentencepiece model that puts a space before the text. Both
cut the bytes of ``space + text``; an A token and a B token are linked where their byte ranges overlap, and the
connected groups of tokens are the text's smallest spans that both tokenizers cut alike.

Every token points to its farthest-right overlapping token: an A token to the B token that holds its last byte, a
B token to the A token that holds its last byte, or to itself if both end there. Doubling the successors of all
tokens at once, ``next = next[next]``, ends at each group's terminal token, which labels the group.

Neither tokenizer merges across a space that follows a visible character, so both have a boundary before it, no
group crosses it, and the text falls into segments there. Each different segment is aligned once and remembered
in a bounded table of the worker.

Corpus-wide counts: documents are taken in blocks of bounded bytes. A block is one written row with its
different linked id pairs, their counts, and each document's pairs as numbers into that list; pairs are counted
over the blocks, and the counts go back to the blocks that hold them, not to all workers.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.bpe import byte_symbols
from holdfast.llm.common import map_texts, slices, worker_tables
from holdfast.session import durable

VOCABULARY_A = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY_B = public_tokenizers.path("piece_bpe_32k.model")
BLOCK_BYTES = 1 << 21
REMEMBERED = 300_000
REMEMBERED_LENGTH = 64
_SPACE = "▁"
#: A space after any other character is left inside its segment: the character could be white space.
_VISIBLE = "!-~¡-ᙿ"
_INSIDE = re.compile(f"(?:^|[^{_VISIBLE}]) ")
_CUT = re.compile(f"(?<=[{_VISIBLE}])(?= .)", re.DOTALL)


def segments(text: str) -> list[str]:
    """The segments of ``space + text``, each without its leading space."""
    if _INSIDE.search(text):
        return [s[1:] for s in _CUT.split(f" {text}")]
    parts = text.split(" ")
    if len(parts) > 1 and not parts[-1]:  # a single space ends the text
        parts[-2:] = [f"{parts[-2]} "]
    return parts


class Aligner:
    """Aligns segments; holds both tokenizers and the remembered segments of one worker.

    Remembered, by segment number: whether both tokenizers give back its bytes, numbers of A tokens, B tokens,
    groups and links, the links' pair codes (``a * size_b + b``), and the groups as text.
    """

    def __init__(self, path_a: str = VOCABULARY_A, path_b: str = VOCABULARY_B):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        symbols = {c: x for x, c in byte_symbols().items()}
        self.size_b = self.b.get_piece_size()
        self.bytes_a = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for name, i in self.a.get_vocab(with_added_tokens=True).items():
            known = all(c in symbols for c in name)
            self.bytes_a[i] = bytes(symbols[c] for c in name) if known else name.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        if any(_SPACE in p.lstrip(_SPACE) for p in pieces):
            raise ValueError("Tokenizer B has a token with a space after another character; texts cannot be cut at spaces.")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode()
                        for i, p in enumerate(pieces)]
        self.length_a = np.fromiter(map(len, self.bytes_a), np.int64)
        self.length_b = np.fromiter(map(len, self.bytes_b), np.int64)
        # The id of a token followed by each of the marks that can follow it in a group's text.
        self.marked = [f"{i}{mark}".encode() for mark in ",|" for i in range(len(self.bytes_a))]
        self.first_b = len(self.marked)
        self.marked += [f"{i}{mark}".encode() for mark in ",;" for i in range(self.size_b)]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.facts = np.zeros((0, 5), np.int64)
        self.starts = np.zeros(0, np.int64)
        self.codes = np.zeros(0, np.int64)
        self.texts: list[bytes] = []

    def numbers(self, parts: list[str]) -> np.ndarray:
        """The numbers of segments, aligning those that are new."""
        get = self.known.get
        found = list(map(get, parts))
        new = list(dict.fromkeys(p for p, i in zip(parts, found) if i is None))
        if new:
            self.known.update(zip(new, range(len(self.texts), len(self.texts) + len(new))))
            facts, codes, texts = self._align(new)
            self.starts = np.concatenate([self.starts, len(self.codes) + np.cumsum(facts[:, 4]) - facts[:, 4]])
            self.facts = np.concatenate([self.facts, facts])
            self.codes = np.concatenate([self.codes, codes])
            self.texts += texts
            found = list(map(get, parts))
        return np.array(found, np.int64)

    def trim(self) -> None:
        """Called between blocks: forget everything once too much is remembered."""
        if len(self.texts) > REMEMBERED or len(self.codes) > REMEMBERED * REMEMBERED_LENGTH:
            self._forget()

    def tokens(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """Token ids of segments by A and B, and whether both give back the segment's bytes."""
        whole = [f" {p}" for p in parts]
        ids_a = [e.ids for e in self.a.encode_batch(whole, add_special_tokens=False)]
        ids_b = self.b.encode(parts, num_threads=1)
        of_a, of_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        same = np.ones(len(parts), bool)
        for i, (text, a, b) in enumerate(zip(whole, ids_a, ids_b)):
            raw = text.encode()
            if b"".join(map(of_a, a)) != raw or b"".join(map(of_b, b)) != raw:
                same[i], ids_a[i], ids_b[i] = False, [], []
        return ids_a, ids_b, same

    def _align(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(same, A tokens, B tokens, groups, links) of each segment, pair codes of all links, groups as text."""
        ids_a, ids_b, same = self.tokens(parts)
        n_a = np.fromiter(map(len, ids_a), np.int64, len(parts))
        n_b = np.fromiter(map(len, ids_b), np.int64, len(parts))
        a = np.fromiter((i for x in ids_a for i in x), np.int64, n_a.sum())
        b = np.fromiter((i for x in ids_b for i in x), np.int64, n_b.sum())
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        label_a, label_b = group_labels(ends_a, ends_b)
        n_groups = int(label_b[-1]) + 1 if len(b) else 0
        # Links are the spans between neighbouring ends of either tokenizer.
        ends = np.union1d(ends_a, ends_b)
        codes = a[np.searchsorted(ends_a, ends)] * self.size_b + b[np.searchsorted(ends_b, ends)]
        last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
        bytes_at = np.concatenate([[0], ends_a])[last_a]
        n_links = np.diff(np.searchsorted(ends, bytes_at, "right"), prepend=0)
        in_groups = np.bincount(label_a, minlength=n_groups), np.bincount(label_b, minlength=n_groups)
        before = [np.cumsum(n) - n for n in in_groups]
        groups_at = np.concatenate([[-1], label_b])[last_b] + 1
        # Groups as text: the A tokens of a group, then its B tokens, in order.
        order = np.empty(len(a) + len(b), np.int64)
        ends_group_a = np.diff(label_a, append=-1) != 0
        ends_group_b = np.diff(label_b, append=-1) != 0
        order[np.arange(len(a)) + before[1][label_a]] = a + len(self.bytes_a) * ends_group_a
        order[np.arange(len(b)) + (before[0] + in_groups[0])[label_b]] = self.first_b + b + self.size_b * ends_group_b
        marked, at = list(map(self.marked.__getitem__, order.tolist())), np.cumsum(n_a + n_b).tolist()
        texts = [b"".join(marked[i:j])[:-1] for i, j in zip([0, *at], at)]
        facts = np.stack([same, n_a, n_b, np.diff(groups_at, prepend=0), n_links], axis=1).astype(np.int64)
        return facts, codes, texts


def group_labels(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers (from 0, in order) of A and B tokens that end at the given ascending byte offsets.

    Both sequences cover the same bytes, so both end at the same offset.
    """
    n_a = len(ends_a)
    holder = np.searchsorted(ends_a, ends_b)  # the A token with the last byte of each B token
    own = np.arange(len(ends_b)) + n_a
    both_end = ends_a[holder] == ends_b if n_a else np.zeros(0, bool)
    following = np.concatenate([np.searchsorted(ends_b, ends_a) + n_a, np.where(both_end, own, holder)])
    while not np.array_equal(farther := following[following], following):
        following = farther
    label = np.searchsorted(own[both_end], following)
    return label[:n_a], label[n_a:]


@worker_tables
@lru_cache(maxsize=1)
def shared_aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of a worker process; what it remembers is kept from task to task."""
    return Aligner(path_a, path_b)


def _aligned(aligner: Aligner, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segment numbers of all texts, the text of each, and per text whether it has tokens, and its four counts."""
    parts = [segments(t.decode("utf-8")) if t else [] for t in texts]
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    of = np.repeat(np.arange(len(parts)), counts)
    numbers = aligner.numbers([s for p in parts for s in p])
    facts = aligner.facts[numbers]
    has = (counts > 0) & (np.bincount(of, facts[:, 0] == 0, len(parts)) == 0)
    numbers, of, facts = numbers[has[of]], of[has[of]], facts[has[of]]
    totals = np.stack([np.bincount(of, facts[:, i], len(parts)) for i in range(1, 5)], axis=1).astype(np.int64)
    return numbers, of, has, totals


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_a: str = VOCABULARY_A,
          vocabulary_b: str = VOCABULARY_B) -> DataFrame:
    """One row per document: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links`` and ``groups``.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: the A and B ids of each group in order. NULL and empty texts, and texts
    whose bytes a tokenizer does not give back, have no tokens: zeros and an empty string. Rows with equal or NULL
    ids are aligned one by one; other columns are not read; texts of any length are aligned whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        aligner = shared_aligner(vocabulary_a, vocabulary_b)

        def work(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
            aligner.trim()
            numbers, of, _, totals = _aligned(aligner, texts)
            at = np.searchsorted(of, np.arange(len(texts) + 1)).tolist()
            named = list(map(aligner.texts.__getitem__, numbers.tolist()))
            groups = [b";".join(named[i:j]).decode() for i, j in zip(at, at[1:])]
            return pa.RecordBatch.from_arrays([part.column("k0"), *map(pa.array, totals.T.copy()), pa.array(groups, pa.string())],
                                              ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"])

        return work

    return map_texts(docs, [id_col], text_col, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string", make)


def _blocks(docs: DataFrame, id_col: str, text_col: str, vocabulary_a: str, vocabulary_b: str) -> DataFrame:
    """One row per block: its documents' counts and digests, its different pairs and their counts, and for each
    document its different pairs (as numbers into the block's) and how often it links them."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("k0"), F.col(text_col).cast("binary").alias("t"))
    columns = ("doc_ids", "n_a", "n_b", "n_groups", "n_links", "digests", "pairs", "counts", "sizes", "at", "times")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, made = shared_aligner(vocabulary_a, vocabulary_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "t", BLOCK_BYTES):
                aligner.trim()
                texts = [x or b"" for x in part.column("t").to_pylist()]
                numbers, of, has, totals = _aligned(aligner, texts)
                ends = np.searchsorted(of, np.arange(len(texts) + 1)).tolist()
                named = list(map(aligner.texts.__getitem__, numbers.tolist()))
                digests = [hashlib.sha256(b";".join(named[i:j])).hexdigest() if h else ""
                           for i, j, h in zip(ends, ends[1:], has.tolist())]
                lengths = aligner.facts[numbers, 4]
                shift = np.cumsum(lengths) - lengths
                codes = aligner.codes[np.repeat(aligner.starts[numbers] - shift, lengths) + np.arange(lengths.sum())]
                pairs, at, counts = np.unique(codes, return_inverse=True, return_counts=True)
                by_doc, times = np.unique(np.repeat(of, lengths) * max(len(pairs), 1) + at, return_counts=True)
                doc, at = np.divmod(by_doc, max(len(pairs), 1))
                whole = [part.column("k0"), *map(pa.array, totals.T.copy()), pa.array(digests, pa.string()), pa.array(pairs),
                         pa.array(counts), pa.array(np.bincount(doc, minlength=len(texts))), pa.array(at.astype(np.int32)),
                         pa.array(times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([made]), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in whole)],
                    ["block", *columns])
                made += 1
        pa.default_memory_pool().release_unused()

    kinds = [kind, *["long"] * 4, "string", *["long"] * 3, "int", "int"]
    return source.mapInArrow(run, ", ".join(["block long", *(f"{c} array<{k}>" for c, k in zip(columns, kinds))]))


def link_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_a: str = VOCABULARY_A,
                    vocabulary_b: str = VOCABULARY_B) -> DataFrame:
    """Alignment of every document against the whole corpus' links.

    Per row of ``docs``: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose id pair is
    linked more often in the corpus than, or as often as, any other pair with its B id), ``count_sum`` (sum of the
    corpus counts of its links' pairs) and ``groups_sha256`` (digest of the ``groups`` of :func:`align`, empty
    without tokens). NULLs, empty and long texts, repeated rows and other columns as in :func:`align`; a table
    without rows gives none.
    """
    size_b = shared_aligner(vocabulary_a, vocabulary_b).size_b
    blocks = durable(_blocks(docs, id_col, text_col, vocabulary_a, vocabulary_b))
    counted = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(
        F.sum("p.counts").alias("n"))
    # A B id has at most one pair for each entry of A's vocabulary.
    of_b = Window.partitionBy(F.pmod("pair", F.lit(size_b)))
    counted = counted.withColumn("best", F.col("n") == F.max("n").over(of_b))
    asked = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(counted, "pair").groupBy("block").agg(F.collect_list(F.struct("place", "n", "best")).alias("answers"))
    joined = blocks.drop("pairs", "counts").join(answers, "block", "left")
    plain = ("doc_ids", "n_a", "n_b", "n_groups", "n_links", "digests")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                sizes, at, times = (row.column(c).flatten().to_numpy() for c in ("sizes", "at", "times"))
                found = row.column("answers").flatten()
                count, best = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
                place = found.field("place").to_numpy()
                count[place] = found.field("n").to_numpy()
                best[place] = found.field("best").to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                n_best, count_sum = (np.diff(np.concatenate([[0], np.cumsum(x[at] * times.astype(np.int64))])[ends]) for x in (best, count))
                yield pa.RecordBatch.from_arrays(
                    [*(row.column(c).flatten() for c in plain), pa.array(n_best), pa.array(count_sum)],
                    ["doc_id", *plain[1:-1], "groups_sha256", "n_best", "count_sum"])

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                                  "n_best long, count_sum long").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
