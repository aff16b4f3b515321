"""Byte-pair encoding and decoding of whole texts with a contiguous rank array.

A short word is held as one contiguous row of parts (token ids between boundaries) with the merge rank
of every adjacent pair beside it. Each step scans the ranks for the minimum, replaces the pair by its
merged token, deletes the boundary between them and refreshes the two neighbouring ranks. Words of equal
length are stepped together as the rows of one array. Words beyond ``SHORT`` bytes, where repeated
scanning would grow with the square of the length, keep the same ranks in a heap over linked parts.

Encoding follows the vocabulary file: special strings in a text are single tokens, the rest is NFC
normalised, lower-cased per character, split into pieces and merged piece by piece. Pieces never cross
white space, so the result of each white-space-delimited chunk is remembered in a bounded cache.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from holdfast.llm.common import map_texts, worker_tables
from holdfast.llm.lookup import KeyTable, equal_spans, span_hashes

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SHORT = 64
CACHE_CHUNKS = 480_000
CACHE_BYTES = 1 << 25
_NONE = np.int32(2**31 - 1)
#: Beyond these characters the classes and case of a letter depend on the Unicode version.
_LATIN_END = "\u024f"


def byte_symbols() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(plain))
    return table


class WordBpe:
    """Encoder for a vocabulary file of BPE with word ends; one per task."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        symbols = byte_symbols()
        self.inner = np.array([vocab[symbols[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[symbols[b] + end] for b in range(256)], np.int32)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]]
        table = np.array(pairs, np.int64).reshape(-1, 3)
        keys = table[:, 0] << 32 | table[:, 1]
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int32)
        self.merged = table[:, 2].astype(np.int32)
        self.lookup: dict[int, int] = {}
        self.names: list[str] = [""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for name, i in [*vocab.items(), *self.specials.items()]:
            self.names[i] = name
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        self.tables = Tokenizer.from_file(path)
        self.byte_of = {c: b for b, c in symbols.items()}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.piece_at = regex.compile(split)
        self._forget()

    def _forget(self) -> None:
        self.table = KeyTable(18)
        # The bytes of every remembered chunk; a chunk is the remembered one only if all of them are equal.
        self.chunks = np.zeros(0, np.uint8)
        self.chunk_starts = np.zeros(0, np.int64)
        self.chunk_lengths = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _add(self, chunks: list[bytes]) -> None:
        encoded = self._encode_chunks(chunks)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        self.chunk_starts = np.concatenate([self.chunk_starts, len(self.chunks) + np.cumsum(sizes) - sizes])
        self.chunk_lengths = np.concatenate([self.chunk_lengths, sizes])
        self.chunks = np.concatenate([self.chunks, np.frombuffer(b"".join(chunks), np.uint8)])
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, *encoded])

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of parts; ``_NONE`` where the vocabulary has no merge."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where((self.pair_keys[at] == keys) & (right >= 0), self.pair_ranks[at], _NONE)

    def _short(self, parts: np.ndarray) -> list[np.ndarray]:
        """Merge equally long words, one in each row of ``parts``."""
        done: list[np.ndarray | None] = [None] * len(parts)
        rows, width = np.arange(len(parts)), parts.shape[1]
        ranks = self.ranks(parts[:, :-1], parts[:, 1:]) if width > 1 else np.zeros((len(parts), 0), np.int32)
        while len(rows):
            if width > 1:
                at = ranks.argmin(axis=1)
                least = ranks[np.arange(len(rows)), at]
                ended = least == _NONE
            else:
                ended = np.ones(len(rows), bool)
            if ended.any():
                for row, word in zip(rows[ended].tolist(), parts[ended]):
                    done[row] = word
                go = ~ended
                rows, parts, ranks = rows[go], parts[go], ranks[go]
                if not len(rows):
                    break
                at, least = at[go], least[go]
            # Every remaining row merges one pair, so all rows stay equally long.
            every = np.arange(len(rows))
            parts[every, at] = self.merged[least]
            columns = np.arange(width - 1)
            parts = np.take_along_axis(parts, columns + (columns > at[:, None]), axis=1)
            width -= 1
            columns = np.arange(max(width - 1, 0))
            ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), axis=1)
            some = every[at > 0]
            ranks[some, at[some] - 1] = self.ranks(parts[some, at[some] - 1], parts[some, at[some]])
            some = every[at < width - 1]
            ranks[some, at[some]] = self.ranks(parts[some, at[some]], parts[some, at[some] + 1])
        return done

    def _long(self, parts: list[int]) -> np.ndarray:
        """Merge one word of any length: a heap of (rank, place) over linked parts."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.ranks(np.array(parts[:-1], np.int32), np.array(parts[1:], np.int32)).tolist() + [int(_NONE)]
        lookup = self.lookup = self.lookup or dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist()))
        heap = [(r, i) for i, r in enumerate(rank) if r != _NONE]
        heapq.heapify(heap)
        merged = self.merged
        while heap:
            r, i = heapq.heappop(heap)
            if rank[i] != r:
                continue
            j = after[i]
            parts[i], rank[j], after[i] = int(merged[r]), -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0:
                    rank[k] = lookup.get(parts[k] << 32 | parts[after[k]], int(_NONE)) if after[k] < n else int(_NONE)
                    if rank[k] != _NONE:
                        heapq.heappush(heap, (rank[k], k))
        out, i = [], 0
        while i < n:
            out.append(parts[i])
            i = after[i]
        return np.array(out, np.int32)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece (non-empty bytes of one pre-split word)."""
        out: list[np.ndarray] = [None] * len(pieces)
        by_length: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            by_length.setdefault(len(piece), []).append(i)
        for length, where in by_length.items():
            flat = np.frombuffer(b"".join([pieces[i] for i in where]), np.uint8).reshape(-1, length)
            parts = self.inner[flat]
            parts[:, -1] = self.last[flat[:, -1]]
            encoded = self._short(parts) if length <= SHORT else [self._long(row) for row in parts.tolist()]
            for i, ids in zip(where, encoded):
                out[i] = ids
        return out

    def _pieces(self, chunk: str) -> list[bytes | int]:
        """Normalise one chunk and split it; special strings come out as their ids.

        Beyond Latin letters this uses the vocabulary file's own tables.
        """
        if chunk.isascii():
            text = chunk.lower()
        elif max(chunk) > _LATIN_END:
            if (parts := self.special_at.split(chunk))[1:]:
                return [y for i, p in enumerate(parts) if p for y in ([self.specials[p]] if i % 2 else self._pieces(p))]
            text = self.tables.normalizer.normalize_str(chunk)
            return [bytes(map(self.byte_of.__getitem__, p)) for p, _ in self.tables.pre_tokenizer.pre_tokenize_str(text)]
        else:
            text = unicodedata.normalize("NFC", chunk).lower()
        if text.isalpha():
            return [text.encode()]
        if text[-1] in ".," and text[:-1].isalpha():
            return [text[:-1].encode(), text[-1].encode()]
        if "<|" in text and (parts := self.special_at.split(chunk))[1:]:
            return [y for i, p in enumerate(parts) if p for y in ([self.specials[p]] if i % 2 else self._pieces(p))]
        return [p.encode() for p in self.piece_at.findall(text)]

    def _encode_chunks(self, chunks: list[bytes]) -> list[np.ndarray]:
        pieces = [self._pieces(c.decode("utf-8", "replace")) for c in chunks]
        distinct = list(dict.fromkeys(p for x in pieces for p in x if type(p) is bytes))
        merged = dict(zip(distinct, self.merge(distinct)))
        merged |= {i: np.array([i], np.int32) for i in self.specials.values()}
        none = np.zeros(0, np.int32)
        return [merged[x[0]] if len(x) == 1 else np.concatenate([merged[p] for p in x]) if x else none for x in pieces]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts (UTF-8) after one another, and the number of each text's."""
        joined = b" ".join([*texts, b""])
        data = np.frombuffer(joined, np.uint8)
        blank = np.concatenate([[True], (data == 32) | ((data >= 9) & (data <= 13))])
        turns = np.flatnonzero(blank[1:] != blank[:-1])
        first, last = turns[::2], turns[1::2]
        if len(self.lengths) > CACHE_CHUNKS or len(self.chunks) > CACHE_BYTES:
            self._forget()
        key = span_hashes(data, first, last)
        at = self.table.find(key)
        new, where = np.unique(key[at < 0], return_index=True)
        if len(new):
            where = np.flatnonzero(at < 0)[where]
            spans = zip(first[where].tolist(), last[where].tolist())
            self.table.add(new, np.arange(len(self.lengths), len(self.lengths) + len(new)))
            self._add([joined[a:b] for a, b in spans])
            at = self.table.find(key)
        same = equal_spans(data, first, last - first, self.chunks, self.chunk_starts[at], self.chunk_lengths[at])
        if (odd := np.flatnonzero(~same)).size:  # other chunks with the key of a remembered one
            spans = zip(first[odd].tolist(), last[odd].tolist())
            at[odd] = np.arange(len(self.lengths), len(self.lengths) + len(odd))
            self._add([joined[a:b] for a, b in spans])
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(total)]
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        ends = np.concatenate([[0], ends])
        return ids, np.diff(ends[np.searchsorted(first, bounds)])

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary file names no decoder: token strings joined by one space, special ones kept."""
        return " ".join(map(self.names.__getitem__, ids))


@worker_tables
@lru_cache(maxsize=1)
def shared_bpe(path: str) -> WordBpe:
    """The encoder of a worker process; its tables and cache are kept from task to task."""
    return WordBpe(path)


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document: ``doc_id``, ``ids`` (its token ids) and ``decoded`` (those ids as text).

    NULL and empty texts give no ids and an empty decoded text. Rows with equal or NULL ids are encoded
    one by one; other columns of ``docs`` are not read. Texts of any length are encoded whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        bpe = shared_bpe(vocabulary)

        def work(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
            ids, counts = bpe.encode(texts)
            ends = np.concatenate([[0], np.cumsum(counts)])
            listed = ids.tolist()
            decoded = [bpe.decode(listed[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            arrays = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            return pa.RecordBatch.from_arrays([part.column("k0"), arrays, pa.array(decoded, pa.string())],
                                              ["doc_id", "ids", "decoded"])

        return work

    return map_texts(docs, [id_col], text_col, f"doc_id {kind}, ids array<int>, decoded string", make)
