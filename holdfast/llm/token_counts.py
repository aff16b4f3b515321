"""Token counts of whole texts by a finite-state transducer compiled from a byte-level BPE vocabulary.

The encoding of a word's prefix ends in exactly one token, the suffix that is a valid neighbour of the last
token of what stands before it; the prefix then has one token more than that. So a state needs only, for
each place from which a longer token could still reach past the next byte, the last token there and its
count relative to the present one. That is a finite set: a transition on a byte leads to one state and
emits the (possibly negative) change of the token count. States and transitions are compiled when a text
first needs them and kept up to ``TRANSITIONS``; beyond that they are dropped and compiled again.

A text is cut into chunks of ``CHUNK`` bytes that are stepped together, one lane each. A chunk's state map
is constant from its first word boundary on; before that it depends on the state at its start. The maps
are composed left to right over all chunks: exits of constant maps are known at once, heads are then run
from their true entry states, and only chunks whose entry state turns out different are run again.
Counts are prefix sums of the emissions.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from holdfast.llm.bpe import byte_symbols
from holdfast.llm.common import map_texts, worker_tables
from holdfast.llm.lookup import KeyTable

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
CHUNK = 64
TRANSITIONS = 1_200_000
LETTER, NUMBER, OTHER, SPACE, EDGE, UNKNOWN = range(6)


class Transducer:
    """Deterministic transducer of one vocabulary file; state 0 is the beginning of a word."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in byte_symbols().items()}
        self.file = Tokenizer.from_file(path)
        self.symbols = {i: name for name, i in spec["model"]["vocab"].items()}
        names = {i: bytes(map(byte_of.__getitem__, name)) for i, name in self.symbols.items()}
        self.tokens = {name: i for i, name in names.items() if self._is(self.symbols[i], [i])}
        self.prefixes = {name[:k] for name in self.tokens for k in range(len(name))}
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.neighbours: dict[tuple[int, int], bool] = {}
        self.forget()

    def _is(self, symbols: str, ids: list[int]) -> bool:
        return [t.id for t in self.file.model.tokenize(symbols)] == ids

    def forget(self) -> None:
        start = (b"", ((0, -1, 0),))
        self.states = [start]
        self.number = {start: 0}
        self.table = KeyTable(18)
        self.next = np.zeros(0, np.int32)
        self.emits = np.zeros(0, np.int8)

    def _transition(self, state: int, byte: int) -> tuple[int, int]:
        """State reached and change of the count. ``places``: (bytes since, last token there, count)."""
        suffix, places = self.states[state]
        seen = suffix + bytes([byte])
        for since, last, count in places:
            token = self.tokens.get(seen[len(seen) - since - 1:])
            if token is None:
                continue
            fits = last < 0 or self.neighbours.get((last, token))
            if fits is None:
                fits = self._is(self.symbols[last] + self.symbols[token], [last, token])
                self.neighbours[last, token] = fits
            if fits:
                break
        change = count + 1
        kept = [(since + 1, last, count - change) for since, last, count in places
                if seen[len(seen) - since - 1:] in self.prefixes]
        key = (seen[len(seen) - kept[0][0]:] if kept else b"", (*kept, (0, token, 0)))
        number = self.number.setdefault(key, len(self.states))
        if number == len(self.states):
            self.states.append(key)
        return number, change

    def step(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the transitions for keys ``state << 8 | byte``, compiling those not met before."""
        at = self.table.find(keys)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = np.unique(keys[missing])
            made = [self._transition(k >> 8, k & 255) for k in new.tolist()]
            self.table.add(new, np.arange(len(self.next), len(self.next) + len(new)))
            self.next = np.concatenate([self.next, np.array([m[0] for m in made], np.int32)])
            self.emits = np.concatenate([self.emits, np.array([m[1] for m in made], np.int8)])
            at[missing] = self.table.find(keys[missing])
        return at

    def emissions(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Change of the token count at each byte; ``starts``: a word begins here. The first byte does."""
        if len(self.next) > TRANSITIONS:
            self.forget()
        rows = -(-len(data) // CHUNK)
        pad = rows * CHUNK - len(data)
        bytes_at = np.ascontiguousarray(np.pad(data, (0, pad)).reshape(rows, CHUNK).T)
        start_at = np.ascontiguousarray(np.pad(starts, (0, pad), constant_values=True).reshape(rows, CHUNK).T)
        out = np.zeros((CHUNK, rows), np.int8)
        leaves = np.zeros(rows, np.int32)  # exit state of each chunk's map
        head = np.where(start_at.any(axis=0), start_at.argmax(axis=0), CHUNK)  # bytes before the constant part
        for j in range(CHUNK):
            leaves[start_at[j]] = 0
            at = self.step(leaves.astype(np.uint64) << np.uint64(8) | bytes_at[j])
            leaves, out[j] = self.next[at], self.emits[at]
        enters = np.zeros(rows, np.int32)  # the entry states that heads were run from
        todo = np.flatnonzero(head > 0)
        while len(todo):
            todo = todo[enters[todo] != leaves[todo - 1]]
            state = enters[todo] = leaves[todo - 1]
            ends, lanes = head[todo], todo
            for j in range(int(ends.max(initial=0))):
                if (ends <= j).any():
                    lanes, state, ends = lanes[ends > j], state[ends > j], ends[ends > j]
                at = self.step(state.astype(np.uint64) << np.uint64(8) | bytes_at[j, lanes])
                state, out[j, lanes] = self.next[at], self.emits[at]
            # What is left are chunks without a boundary; their exits are their followers' entries.
            leaves[lanes[ends == CHUNK]] = state[ends == CHUNK]
            todo = lanes[ends == CHUNK] + 1
            todo = todo[(todo < rows)]
            todo = todo[head[todo] > 0]
        return out.T.reshape(-1)[: len(data)]


class Counter:
    """Token counts of many texts at once."""

    def __init__(self, path: str = VOCABULARY):
        self.transducer = Transducer(path)
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)

    def _classes(self, points: np.ndarray) -> np.ndarray:
        """Class of each code point, as the vocabulary file's own splitting rule takes it."""
        found = self.classes[points]
        if (new := found == UNKNOWN).any():
            pieces = lambda text: len(self.transducer.file.pre_tokenizer.pre_tokenize_str(text))
            for p in np.unique(points[new]).tolist():
                c = chr(p)
                self.classes[p] = (LETTER if pieces(f"a{c}a") == 1 else NUMBER if pieces(f"1{c}1") == 1
                                   else OTHER if pieces(f"-{c}-") == 1 else SPACE)
            found = self.classes[points]
        return found

    def _starts(self, points: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where the splitting rule begins a new word; ``edges`` are separators, words of their own."""
        kind = self._classes(points)
        kind[edges] = EDGE
        before = np.concatenate([[EDGE], kind[:-1]])
        after = np.concatenate([kind[1:], [EDGE]])
        blank = np.concatenate([[False], points[:-1] == 32]) & (before == SPACE)
        # Of a run of white space the last one is apart if a word follows; a last space joins that word.
        starts = np.where(kind == SPACE, (before != SPACE) | (after < SPACE), (kind != before) & ~blank)
        starts |= (kind == EDGE) | (before == EDGE)
        quote = np.flatnonzero((points == 39) & (kind == OTHER) & (before != OTHER) & ~blank)
        if len(quote):
            wide = np.concatenate([points, np.zeros(3, points.dtype)])
            wide[np.concatenate([edges, [len(points)]])] = 0
            one, two = wide[quote + 1], wide[quote + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = np.isin(one.astype(np.int64) << 32 | two, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])
            hit = quote[short | long]
            ends = hit + np.where(short, 2, 3)[short | long]
            starts[hit + 1] = False
            ends = ends[ends < len(points)]
            starts[ends[kind[ends] == LETTER]] = True
        return starts

    def count(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text; special strings in a text are one token each."""
        decoded = [t.decode("utf-8", "replace") for t in texts]
        extra = np.zeros(len(texts), np.int64)
        pieces, owner = [], []
        for i, text in enumerate(decoded):
            parts = [text]
            for special in self.transducer.specials:
                if special in text:
                    parts = [y for p in parts for y in p.split(special)]
            extra[i] = len(parts) - 1
            pieces += parts
            owner += [i] * len(parts)
        joined = "\0".join([*pieces, ""])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        edges = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1) - 1
        starts = self._starts(points, edges)
        data = np.frombuffer(joined.encode(), np.uint8)
        if len(data) > len(points):
            width = np.ones(len(points), np.int64) + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
            place = np.cumsum(width) - width
            at = np.zeros(len(data), bool)
            at[place[starts]] = True
            starts, edges = at, place[edges]
        total = np.concatenate([[0], np.cumsum(self.transducer.emissions(data, starts), dtype=np.int64)])
        per_piece = total[edges] - total[np.concatenate([[0], edges[:-1] + 1])] if len(edges) else np.zeros(0, np.int64)
        np.add.at(extra, owner, per_piece)
        return extra


@worker_tables
@lru_cache(maxsize=1)
def shared_counter(path: str) -> Counter:
    """The counter of a worker process; its compiled transitions are kept from task to task."""
    return Counter(path)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens``, both long.

    NULL and empty texts have no bytes and no tokens. Rows with equal or NULL ids are counted one by one;
    other columns are not read. Texts of any length are counted whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        counter = shared_counter(vocabulary)

        def work(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [part.column("k0"), pa.array([len(t) for t in texts], pa.int64()), pa.array(counter.count(texts))],
                ["doc_id", "n_bytes", "n_tokens"])

        return work

    return map_texts(docs, [id_col], text_col, f"doc_id {kind}, n_bytes long, n_tokens long", make)
