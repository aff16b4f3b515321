"""Benchmark decontamination with suffix arrays of the training documents.

The documents are taken in shards of bounded bytes. Each shard gets an array of its word suffixes in the order of
their first words, as many as the longest benchmark item has. Every suffix of every benchmark item is looked up by
binary search, word after word: the interval of suffixes that share its first words shrinks until the next word is
found no more. Its last interval is the item suffix's longest verbatim match in the shard with all locations; the
interval at the length of a window holds all occurrences of that window.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. A window is ``WINDOW``
consecutive words of an item; an item of fewer, but not none, is one window.

The benchmark is written once, equal texts as one entry, and every task reads it in blocks of ``BLOCK_WORDS`` words
from the shared folder: a block against a shard at a time, however long the benchmark is. The documents are not
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import map_texts, slices
from holdfast.session import new_scratch_path

WINDOW = 10
SHARD_BYTES = 1 << 22
BLOCK_WORDS = 1 << 18
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def split_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts after one another, and the number of each text's."""
    joined = b" ".join([*texts, b""]).translate(_FOLD)
    is_word = np.frombuffer(joined, np.uint8) != 32
    edges = np.flatnonzero(np.diff(is_word, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined.translate(None, b" "))])
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return words, np.diff(np.searchsorted(starts, bounds))


class Benchmark(NamedTuple):
    """A block of benchmark entries: their words after one another, the words of each, and its item ids."""

    words: pa.Array
    counts: np.ndarray
    items: list[list[str]]


class SuffixArray:
    """The word suffixes of a shard's documents, ordered by their first ``depth`` words.

    ``ids`` holds the words' numbers, each document followed by a number of its own, so that no match crosses
    documents; ``order`` holds the suffixes' places; ``document`` and ``offset`` tell where a place is.
    """

    def __init__(self, texts: list[bytes], depth: int):
        words, self.counts = split_words(texts)
        coded = words.dictionary_encode()
        self.vocabulary = coded.dictionary
        n, size = len(words), len(coded.dictionary)
        of = np.repeat(np.arange(len(texts)), self.counts)
        self.document = np.repeat(np.arange(len(texts)), self.counts + 1)
        self.first = np.cumsum(self.counts + 1) - self.counts - 1
        self.ids = np.zeros(n + len(texts), np.int64)
        self.ids[np.arange(n) + of] = coded.indices.to_numpy()
        self.ids[self.first + self.counts] = size + np.arange(len(texts))
        self.order = _sorted_suffixes(self.ids, depth)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(self.ids, minlength=size + len(texts)))])

    def _bound(self, low: np.ndarray, high: np.ndarray, word: np.ndarray, depth: int, after: bool) -> np.ndarray:
        """In each interval, the first suffix whose word at ``depth`` is not below (``after``: is above) ``word``."""
        low, high = low.copy(), high.copy()
        while (todo := np.flatnonzero(low < high)).size:
            middle = (low[todo] + high[todo]) >> 1
            found = self.ids[self.order[middle] + depth]
            below = found <= word[todo] if after else found < word[todo]
            low[todo] = np.where(below, middle + 1, low[todo])
            high[todo] = np.where(below, high[todo], middle)
        return low

    def search(self, block: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every suffix of the block's entries: (entry, offset, length of the longest match, its interval's
        bounds, bounds of the interval of the window that starts there; an empty one where none does or matches)."""
        coded = block.words.dictionary_encode()
        known = pc.fill_null(pc.index_in(coded.dictionary, self.vocabulary), -1).to_numpy().astype(np.int64)
        ids = np.append(known[coded.indices.to_numpy()] if len(known) else np.zeros(0, np.int64), -1)
        entry = np.repeat(np.arange(len(block.counts)), block.counts)
        ends = np.cumsum(block.counts)[entry]
        place = np.arange(len(entry))
        offset, left = place - (ends - block.counts[entry]), ends - place
        window = np.minimum(block.counts, WINDOW)[entry]
        length = np.zeros(len(entry), np.int64)
        low, high = np.zeros(len(entry), np.int64), np.full(len(entry), len(self.order))
        window_low, window_high = np.zeros(len(entry), np.int64), np.zeros(len(entry), np.int64)
        live, depth = place, 0
        while len(live):
            live = live[(left[live] > depth) & (ids[np.minimum(live + depth, len(entry))] >= 0)]
            word = ids[live + depth]
            if depth:
                lower = self._bound(low[live], high[live], word, depth, False)
                upper = self._bound(lower, high[live], word, depth, True)
            else:
                lower, upper = self.starts[word], self.starts[word + 1]
            found = lower < upper
            live = live[found]
            depth += 1
            low[live], high[live], length[live] = lower[found], upper[found], depth
            whole = live[window[live] == depth]
            window_low[whole], window_high[whole] = low[whole], high[whole]
        return entry, offset, length, np.stack([low, high]), window_low, window_high

    def places(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of all suffixes in intervals, and the number of the interval of each."""
        n = high - low
        of = np.repeat(np.arange(len(n)), n)
        return self.order[np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)], of


def _sorted_suffixes(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes in the order of their first ``depth`` numbers, by prefix doubling.

    The first sort is by as many numbers as fit into 63 bits; then only suffixes that are still equal to another
    are sorted again, each time by twice as many.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64)
    bits = int(ids.max() + 1).bit_length()
    ordered = max(1, 63 // bits)
    padded = np.concatenate([ids + 1, np.zeros(ordered, np.int64)])
    key = padded[:n].copy()
    for i in range(1, ordered):
        key = key << bits | padded[i:n + i]
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.zeros(n + 1, np.int64)
    group = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    rank[order] = group + 1
    while ordered < depth:
        todo = np.flatnonzero(~starts | ~np.append(starts[1:], True))
        if not len(todo):
            break
        place = order[todo]
        key = group[todo] * (n + 1) + rank[np.minimum(place + ordered, n)]
        by_key = np.argsort(key, kind="stable")
        order[todo], key = place[by_key], key[by_key]
        starts[todo[1:][key[1:] != key[:-1]]] = True
        group[todo] = np.maximum.accumulate(np.where(starts[todo], todo, 0))
        rank[order[todo]] = group[todo] + 1
        ordered *= 2
    return order


def write_benchmark(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> tuple[str, int]:
    """Write the entries to the shared folder; returns the folder and the words of the longest entry.

    Items with equal words are one entry with all their ids. Items without words (NULL among them) have none;
    words of items whose id is NULL are looked for, but such items are not named.
    """
    def make():
        def work(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
            words, counts = split_words(texts)
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            return pa.RecordBatch.from_arrays([part.column("k0"), pa.ListArray.from_arrays(pa.array(ends), words)], ["item", "words"])

        return work

    split = map_texts(items, [F.col(item_col).cast("string")], text_col, "item string, words array<binary>", make)
    folder = new_scratch_path(items.sparkSession)
    split.where(F.size("words") > 0).groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items")).write.parquet(folder)
    longest = items.sparkSession.read.schema("words array<binary>").parquet(folder).agg(F.max(F.size("words"))).first()[0]
    return folder if "://" in folder else f"file://{folder}", longest or 0


def _blocks(folder: str, block_words: int) -> Iterator[Benchmark]:
    store, path = pa.fs.FileSystem.from_uri(folder)
    names = sorted(f.path for f in store.get_file_info(pa.fs.FileSelector(path)) if f.base_name.endswith(".parquet"))
    held, n = [], 0
    for name in names:
        with store.open_input_file(name) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=min(256, block_words)):
                held.append(batch)
                n += len(batch.column("words").flatten())
                if n >= block_words:
                    yield _block(held)
                    held, n = [], 0
    if held:
        yield _block(held)


def _block(held: list[pa.RecordBatch]) -> Benchmark:
    whole = pa.Table.from_batches(held).combine_chunks()
    lists = whole.column("words").chunk(0)
    return Benchmark(lists.flatten().cast(pa.binary()), pc.list_value_length(lists).to_numpy().astype(np.int64),
                     whole.column("items").to_pylist())


@lru_cache(maxsize=1)
def _single_block(folder: str, block_words: int) -> Benchmark | None:
    """The benchmark, if it is one block; a worker keeps it from task to task."""
    blocks = _blocks(folder, block_words)
    first = next(blocks, None)
    return first if first and next(blocks, None) is None else None


def benchmark_blocks(folder: str, block_words: int) -> Iterator[Benchmark]:
    single = _single_block(folder, block_words)
    return iter([single]) if single else _blocks(folder, block_words)


def _contaminated(shard: SuffixArray, folder: str, block_words: int) -> tuple[np.ndarray, list[list[str]], np.ndarray]:
    """Per document: words hit, ids of the items found (sorted as text), longest match of an item's suffix."""
    n_docs = len(shard.counts)
    change = np.zeros(len(shard.ids) + 1, np.int64)
    named: list[set[str]] = [set() for _ in range(n_docs)]
    for block in benchmark_blocks(folder, block_words):
        entry, _, _, _, low, high = shard.search(block)
        found = np.flatnonzero(low < high)
        # Equal windows of several entries have one interval.
        key = low[found] * (WINDOW + 1) + np.minimum(block.counts, WINDOW)[entry[found]]
        _, first, at = np.unique(key, return_index=True, return_inverse=True)
        size = key[first] % (WINDOW + 1)
        place, of = shard.places(low[found][first], high[found][first])
        change += np.bincount(place, minlength=len(change)) - np.bincount(place + size[of], minlength=len(change))
        # (window, document) pairs, then (entry, document) pairs through the windows' entries.
        window, doc = np.divmod(np.unique(of * n_docs + shard.document[place]), max(n_docs, 1))
        by_window = np.argsort(at, kind="stable")
        entries, ends = entry[found][by_window], np.searchsorted(at[by_window], np.arange(len(first) + 1))
        n = np.diff(ends)[window]
        pick = np.arange(n.sum()) + np.repeat(ends[window] - (np.cumsum(n) - n), n)
        pairs = np.unique(np.repeat(doc, n) * max(len(block.counts), 1) + entries[pick])
        for d, e in zip(*(x.tolist() for x in np.divmod(pairs, max(len(block.counts), 1)))):
            named[d].update(block.items[e])
    hit = np.cumsum(change[:-1]) > 0
    runs = np.flatnonzero(np.diff(hit, prepend=False, append=False)).reshape(-1, 2)
    longest = np.zeros(n_docs, np.int64)
    if len(runs):
        np.maximum.at(longest, shard.document[runs[:, 0]], runs[:, 1] - runs[:, 0])
    return np.bincount(shard.document[hit], minlength=n_docs), [sorted(x) for x in named], longest


def find_contamination(docs: DataFrame, items: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id",
                       text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                       block_words: int = BLOCK_WORDS) -> DataFrame:
    """What each document holds of the benchmark ``items``; one row per row of ``docs``.

    ``row`` (the columns ``keep``, ``id_col`` if not given), ``n_words``, ``n_hit`` (words inside any occurrence of a
    window), ``items`` (ids of the items with an occurring window, as text, sorted), ``longest`` (words of the
    longest run of hit words) and ``contaminated``. NULL and empty texts have no words and no hits. Repeated rows
    and rows with NULL ids are looked at one by one, texts of any length whole. Of items with one id every text
    counts, for one item. An empty benchmark leaves all documents clean; an empty table gives no rows.
    """
    folder, depth = write_benchmark(items, item_col, item_text_col)
    row = F.struct(*[F.col(f"`{c}`") for c in keep or [id_col]])
    source = docs.select(row.alias("row"), F.col(text_col).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", SHARD_BYTES):
                shard = SuffixArray([x or b"" for x in part.column("t").to_pylist()], depth)
                n_hit, named, longest = _contaminated(shard, folder, block_words)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(shard.counts), pa.array(n_hit), pa.array(named, pa.list_(pa.string())),
                     pa.array(longest), pa.array(n_hit > 0)], ["row", "n_words", "n_hit", "items", "longest", "contaminated"])
        pa.default_memory_pool().release_unused()

    kind = source.schema["row"].dataType.simpleString()
    return source.mapInArrow(run, f"row {kind}, n_words long, n_hit long, items array<string>, longest long, contaminated boolean")


def remove_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with all their columns."""
    return find_contamination(docs, items, keep=docs.columns, **options).where("not contaminated").select("row.*")


def longest_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The longest verbatim match of every suffix of every item in the documents.

    ``item``, ``offset`` (the suffix's first word, from 0), ``length`` (words matched), ``locations`` (how many
    suffixes of documents match as long) and ``doc_id``, ``at`` (one of them: the smallest id, NULL last, then the
    smallest word number). Suffixes whose first word occurs nowhere have no row. Items with equal words share their
    rows' values; items without an id have none.
    """
    folder, depth = write_benchmark(items, item_col, item_text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("k0"), F.col(text_col).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", SHARD_BYTES):
                shard = SuffixArray([x or b"" for x in part.column("t").to_pylist()], depth)
                by_id = pc.array_sort_indices(part.column("k0"), null_placement="at_end").to_numpy()
                rank = np.empty(len(by_id), np.int64)
                rank[by_id] = np.arange(len(by_id))
                # Of each interval the place in the document of the smallest id: the least of these numbers.
                preferred = rank[shard.document[shard.order]] * len(shard.ids) + shard.order
                for block in benchmark_blocks(folder, block_words):
                    entry, offset, length, (low, high), _, _ = shard.search(block)
                    found = np.flatnonzero(length)
                    if not len(found):
                        continue
                    key, at = np.unique(low[found] * (len(shard.ids) + 1) + high[found], return_inverse=True)
                    bounds = np.stack(np.divmod(key, len(shard.ids) + 1), axis=1).reshape(-1)
                    place = np.minimum.reduceat(np.append(preferred, 0), bounds)[::2][at] % len(shard.ids)
                    doc = shard.document[place]
                    for i in range(0, len(found), 65536):
                        some = slice(i, i + 65536)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([block.items[e] for e in entry[found[some]].tolist()], pa.list_(pa.string())),
                             pa.array(offset[found[some]]), pa.array(length[found[some]]),
                             pa.array((high - low)[found[some]]), part.column("k0").take(pa.array(doc[some])),
                             pa.array((place - shard.first[doc])[some])], ["items", "offset", "length", "locations", "doc_id", "at"])

    rows = source.mapInArrow(run, f"items array<string>, offset long, length long, locations long, doc_id {kind}, at long")
    by_length = rows.groupBy("items", "offset", "length").agg(
        F.sum("locations").alias("locations"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "at")).alias("place"))
    best = by_length.groupBy("items", "offset").agg(F.max_by(F.struct("length", "locations", "place"), "length").alias("best"))
    return best.select(F.explode("items").alias("item"), "offset", "best.length", "best.locations", "best.place.doc_id", "best.place.at")


#: Windows by position, for a second engine.
CONTAMINATION_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT item_id, least(10, len(w)) AS n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS x
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d JOIN sizes ON len(w) >= n)),
found AS (SELECT dw.r, dw.p, dw.n, bw.item_id FROM dw JOIN bw USING (n, x)),
hit AS (
  SELECT r, count(DISTINCT k) AS n_hit
  FROM (SELECT r, unnest(range(p, p + n)) AS k FROM (SELECT DISTINCT r, p, n FROM found)) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
